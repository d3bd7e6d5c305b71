"""Row numbers within large groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh


def ranked(rows: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """`rows` with a long column `name`: the row's number, from 0, in its group, ordered by (bucket, *order).

    `bucket` splits every group into parts of one task each and must rise with the order wanted; counts of parts,
    not rows, are what a group brings together. Null groups are groups.
    """
    part, before = fresh("part", [*rows.columns, name]), fresh("before", [*rows.columns, name])
    rows = rows.withColumn(part, bucket)
    sizes = rows.groupBy(*groups, part).agg(F.count("*").alias(before))
    sizes = sizes.withColumn(before, F.sum(before).over(Window.partitionBy(*groups).orderBy(part)) - F.col(before))
    keys = [*groups, part]
    other = sizes.select(*(F.col(k).alias(f"r_{i}") for i, k in enumerate(keys)), before)
    match = [rows[k].eqNullSafe(other[f"r_{i}"]) for i, k in enumerate(keys)]
    joined = rows.join(other, match).drop(*(f"r_{i}" for i in range(len(keys))))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, F.col(before) + own - 1).drop(part, before)
