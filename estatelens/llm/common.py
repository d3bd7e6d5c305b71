"""Reading the tables and walking Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Bytes of text that one numpy step works on; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of each; a null text is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts in `column` take at most `limit` bytes, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    # Workers stay for later stages; what Arrow keeps of these batches would count there.
    pa.default_memory_pool().release_unused()


# Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column of `taken` is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name
