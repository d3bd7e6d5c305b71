"""Sorting, first-per-key, exact ranking and repeatable sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import materialize
from .quantiles import join_null_safe


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in `order`. Combined map-side, so hot keys are cheap."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def dense_index(df: DataFrame, order: list[str], by: list[str] = (), name: str = "row_index") -> DataFrame:
    """Row numbers from 1, within `by`, in ascending `order`, with no single-task sort.

    Rows are range-partitioned and sorted, written once, and each partition's
    rows are shifted by the counts of the partitions before it. `order` has to
    be unique within a group for a repeatable result.
    """
    by = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(
        df.repartitionByRange(parts, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33))
    )
    runs = numbered.groupBy(*by, "__part").agg(
        F.count("*").alias("__n"), F.min("__at").alias("__start")
    ).withColumn("__one", F.lit(1))
    before = Window.partitionBy(*by, "__one").orderBy("__part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    runs = materialize(
        runs.withColumn("__shift", F.sum("__n").over(before) - F.col("__n")).select(
            *by, "__part", "__start", "__shift"
        )
    )
    joined = join_null_safe(numbered, runs, [*by, "__part"])
    index = (F.col("__shift") + F.col("__at") - F.col("__start") + 1).alias(name)
    return joined.select(*df.columns, index)


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int) -> DataFrame:
    """At most n rows, those first by a seeded hash of the key: the same on any partitioning.

    Rows are counted by the head of their hash (at most 4,096 counts), so only rows up to the
    head that holds the n-th are sorted.
    """
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    coded = df.withColumn("__h", code)
    head, seen, last = F.substring("__h", 1, 3), 0, "fff"
    for row in coded.groupBy(head.alias("head")).count().orderBy("head").collect():
        last, seen = row[0], seen + row[1]
        if seen >= n:
            break
    return coded.where(head <= last).orderBy("__h", *keys).limit(n).drop("__h")


def largest_per_id(df: DataFrame, id_column: str, area_column: str, tie: str) -> DataFrame:
    """The row with the largest area for each id; rows without an id are all kept."""
    with_id = first_per_key(
        df.where(F.col(id_column).isNotNull()), [id_column], [-F.col(area_column), F.col(tie)]
    )
    return with_id.unionByName(df.where(F.col(id_column).isNull()))
