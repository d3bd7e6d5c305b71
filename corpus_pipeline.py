"""A corpus from raw documents to packed training sequences, in stages that each read the last one's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from estatelens.llm import minhash, mixing, packing, repetition, templates
from estatelens.llm.common import fresh, table
from estatelens.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return repetition.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars follows. Those of which nothing is left go."""
    lean = templates.dedup_lines(docs, emptied=False)
    return lean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else lean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id."""
    return minhash.one_of_each(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, and documents of small sources again, as often as the mix of sources places them; in the order of slots."""
    clash = {c: fresh(c, docs.columns + list(mixing.PLACING)) for c in docs.columns if c.lower() in mixing.PLACING}
    mixed = mixing.mix(docs.withColumnsRenamed(clash))
    mixed = mixed.repartitionByRange("slot").sortWithinPartitions("slot", "doc_id").drop(*mixing.PLACING)
    return mixed.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

# The packing stage needs a tokenizer, which SQL has not; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
