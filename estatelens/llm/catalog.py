"""The registered queries of the corpus operators and their checks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language, minhash, mixing, neighbours, packing, periodic, permutations, repetition, secret_spans, spelling, templates, tokenfile, warc
from .common import table


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage and verdict of every document."""
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of every document in the mix of all sources."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_spans.scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    return templates.dedup_lines(table(spark, sf_dir, "documents"), counts=True)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of every document, read back from the token file of all documents."""
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every twentieth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.predict(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record of every page, read back from the archives of all pages."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every vector."""
    return permutations.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), deletions=True)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_line_dedup, op3_quality, op4_mixing, op5_near_duplicates, op6_token_file, op7_neighbours, op8_language, op9_packing, op10_warc, op11_periodic_runs, op12_near_vectors, op13_spelling_variants)}
CHECKS = {"op1_secrets": secret_spans.SQL, "op2_line_dedup": templates.SQL, "op3_quality": repetition.SQL, "op4_mixing": mixing.SQL, "op5_near_duplicates": minhash.SQL, "op10_warc": warc.SQL, "op12_near_vectors": permutations.SQL, "op13_spelling_variants": spelling.SQL}
