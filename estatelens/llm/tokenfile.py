"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank of frequency over all documents, so frequent ids take one byte. Four ranks share one
control byte, two bits each for the number of bytes less one; the bytes themselves, little-endian, follow in a stream
of their own. A file holds chunks of whole documents; a chunk that one document overfills holds that document alone.
Decoding takes a control byte to the source positions of its four ranks by table lookup, all control bytes at once.

A token file is a folder with two tables: `ranks` (rank, id) and `chunks` (shard, chunk, base, doc_ids, lengths,
control, data); shards and chunks are in the order of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import discard, materialize, scratch_dir
from .common import slices
from .tokens import TOKEN_SLICE, WORDS, encoder

END = 1
# Tokens after which a chunk is closed.
CHUNK = 1 << 18
VOCABULARY = 1 << 16

# For each control byte: bytes of each of its four numbers, of all four, and where each byte of the four comes from.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
TOTALS = SIZES.sum(1)
_starts = np.cumsum(SIZES, 1) - SIZES
_byte = np.arange(4)
# Bytes that a number does not have point far behind, where they read as 0.
SOURCE = np.where(_byte < SIZES[:, :, None], _starts[:, :, None] + _byte, 1 << 40).reshape(256, 16)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The `n` numbers of `encode`; raises ValueError if the streams do not fit."""
    codes = np.frombuffer(control, np.uint8)
    if len(codes) != -(-n // 4):
        raise ValueError("wrong number of control bytes")
    ends = np.cumsum(TOTALS[codes])
    padding = -n % 4
    raw = np.frombuffer(data + bytes(padding + 1), np.uint8)
    if (ends[-1] if n else 0) != len(data) + padding:
        raise ValueError("wrong number of data bytes")
    at = np.minimum((ends - TOTALS[codes])[:, None] + SOURCE[codes], len(raw) - 1)
    return raw[at].view("<u4").ravel()[:n]


def id_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (16-bit, little-endian, END behind them) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), END.to_bytes(2, "little")
        for part in slices(batches, "text", TOKEN_SLICE):
            ids = [t + end for t in code.batch(part.column("text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame) -> DataFrame:
    """How often each id occurs: id, n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in slices(batches, "ids"):
            held = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(held, "<u2"), minlength=VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at])})

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORDS) -> None:
    """Write the token file of every row of `docs`, in ascending doc_id order, to the folder `path`.

    A null or empty text has the end id only. Null ids come first; rows that repeat a doc_id follow each other in
    the order of their ids. Other columns are not read; an empty table gives a file without chunks. Ranks and the
    token counts of shards are all that reaches the driver: at most VOCABULARY and one number a task.
    """
    spark = docs.sparkSession
    ids = materialize(id_table(docs, tokenizer), "zstd")
    counts = id_counts(ids).toArrow()
    order = np.lexsort((counts["id"].to_numpy(), -counts["n"].to_numpy()))
    by_rank = counts["id"].to_numpy()[order]
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(by_rank)), pa.int64()), "id": pa.array(by_rank)})).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(VOCABULARY, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, np.ndarray]] = []
        size, chunk, base = 0, 0, 0

        def closed() -> pa.RecordBatch:
            control, data = encode(rank_of[np.concatenate([v for _, v in held])])
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int64()), "base": pa.array([base], pa.int64()),
                "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                "lengths": pa.array([[len(v) for _, v in held]], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append((doc, np.frombuffer(value, "<u2")))
                size += len(held[-1][1])
                if size >= CHUNK:
                    yield closed()
                    held, chunk, base, size = [], chunk + 1, base + size, 0
        if held:
            yield closed()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "chunk long, base long, doc_ids array<long>, lengths array<long>, control binary, data binary").withColumn(
        "shard", F.spark_partition_id()).write.option("compression", "none").parquet(f"{path}/chunks")
    discard(ids)


def decoded(spark: SparkSession, path: str, schema: str, columns: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    """doc_id, start, n_tokens and `columns` of every document: a function of ids of some documents and their bounds."""
    inverse = np.array([r[1] for r in sorted(spark.read.parquet(f"{path}/ranks").collect())], np.uint32)  # at most VOCABULARY rows
    chunks = spark.read.parquet(f"{path}/chunks")
    held = chunks.groupBy("shard").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, b) -> a + b)")).alias("n")).collect()  # one row a shard
    before, first = 0, {}
    for shard, n in sorted(tuple(r) for r in held):
        first[shard] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                lengths = np.array(chunk["lengths"], np.int64)
                ids = inverse[decode(chunk["control"], chunk["data"], int(lengths.sum()))]
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(chunk["doc_ids"], pa.int64()),
                    "start": pa.array(first[chunk["shard"]] + chunk["base"] + bounds[:-1]),
                    "n_tokens": pa.array(lengths)} | columns(ids, bounds))

    return chunks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens (long) and ids (array of int) of every document in the file."""
    def columns(ids: np.ndarray, bounds: np.ndarray) -> dict:
        return {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))}

    return decoded(spark, path, "ids array<int>", columns)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the file."""
    def columns(ids: np.ndarray, bounds: np.ndarray) -> dict:
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return {"ids_crc32": pa.array(crc, pa.int64())}

    return decoded(spark, path, "ids_crc32 long", columns)


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the token file of `docs` to the shared folder, read it back and return its checksums."""
    path = scratch_dir(docs.sparkSession)
    write_tokens(docs, path)
    return checksums(docs.sparkSession, path)
