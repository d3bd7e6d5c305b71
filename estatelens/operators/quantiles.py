"""Exact grouped quantiles and summaries that never gather a group in one task.

Spark's exact `percentile` keeps a map of all distinct values of a group in one
aggregation buffer. Here each group is first counted into narrow logarithmic
buckets (combined map-side), the buckets that hold the wanted ranks are found,
and only their values are counted and ranked.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import materialize

# Buckets per doubling of the value, and a shift past the smallest exponent.
BUCKETS_PER_OCTAVE = 1024
_SHIFT = 2_000_000

# Rows up to which the values of a bucket are ranked by one task, and the parts a fuller bucket is split into.
RANKED_ROWS = 200_000
PARTS = 1024

# Bits of a double that each scan of `medians` leaves undecided, and rows that a task counts at a time.
UNDECIDED = (40, 20, 0)
ROWS_AT_ONCE = 100_000


def value_bucket(x: Column) -> Column:
    """A bucket number that never decreases as x grows."""
    def magnitude(v):
        return F.floor(F.least(F.log2(v), F.lit(2000.0)) * BUCKETS_PER_OCTAVE) + _SHIFT

    return F.when(x > 0, magnitude(x)).when(x < 0, -magnitude(-x)).otherwise(F.lit(0)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; keeps the left copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def summarize(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Per group: count, mean, std (n-1), min, max and exact linear-interpolation quantiles.

    `quantiles` maps output names to probabilities. Null and NaN values are left out;
    a null group key is a group of its own. Without group columns an empty input has
    one row of count 0. Two scans of the input, and one more for each time that buckets of different values hold
    more than RANKED_ROWS rows and are split; a single value is never split, however many rows have it.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *by, F.col(value).cast("double").alias("__x"), value_bucket(F.col(value).cast("double")).alias("__b")
    )
    keys = [*by, "__one"]
    buckets = (
        rows.groupBy(*by, "__b")
        .agg(
            F.count("*").alias("__n"),
            F.avg("__x").alias("__mean"),
            (F.var_pop("__x") * F.count("*")).alias("__m2"),
            F.min("__x").alias("__min"),
            F.max("__x").alias("__max"),
        )
        .withColumn("__one", F.lit(1))
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        buckets.withColumn("__total", F.sum("__n").over(group))
        .withColumn("__before", F.sum("__n").over(upto) - F.col("__n"))
        .withColumn("mean", F.sum(F.col("__mean") * F.col("__n")).over(group) / F.col("__total"))
        .withColumn(
            "__m2",
            F.sum(F.col("__m2") + F.col("__n") * F.pow(F.col("__mean") - F.col("mean"), F.lit(2.0))).over(group),
        )
        .withColumn("min", F.min("__min").over(group))
        .withColumn("max", F.max("__max").over(group))
    )
    last = F.col("__total") - 1
    ranks = F.array(
        *[f((last * F.lit(float(p)))).cast("long") for p in quantiles.values() for f in (F.floor, F.ceil)]
    )
    inside = F.exists(
        ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n"))
    ) if quantiles else (F.col("__before") == 0)
    facts = ["__total", "mean", "__m2", "min", "max"]
    wanted = materialize(
        placed.where(inside).select(
            *by, "__b", "__n", F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), "__before", *facts
        )
    )
    std = F.when(F.col("count") > 1, F.sqrt(F.col("__m2") / (F.col("count") - 1)))
    if not quantiles:
        totals = wanted.withColumnRenamed("__total", "count")
        if not by:
            totals = totals.agg(
                F.coalesce(F.max("count"), F.lit(0)).alias("count"), *[F.max(c).alias(c) for c in ("mean", "__m2", "min", "max")]
            )
        return totals.select(*by, "count", "mean", std.alias("std"), "min", "max")

    # Further scans: split what is still too full to be ranked by one task.
    at = [*by, "__b"]
    full = (F.col("__n") > RANKED_ROWS) & (F.col("__lo") < F.col("__hi"))
    while not wanted.where(full).isEmpty():
        share = (F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
        part = F.when(full, F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("long")
        finer = f"__b{len(at)}"
        rows = join_null_safe(rows, wanted.select(*at, "__n", "__lo", "__hi"), at).withColumn(finer, part).drop("__n", "__lo", "__hi")
        counted = rows.groupBy(*at, finer).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        counted = join_null_safe(counted, wanted.drop("__n", "__lo", "__hi"), at)
        upto = Window.partitionBy(*at).orderBy(finer).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = counted.withColumn("__before", F.col("__before") + F.sum("__n").over(upto) - F.col("__n"))
        at = [*at, finer]
        wanted = materialize(counted.where(inside).select(*at, "__n", "__lo", "__hi", "__before", *facts))

    # Last scan: rank the distinct values of the wanted buckets only.
    counted = join_null_safe(rows, wanted.select(*at), at).groupBy(*at, "__x").agg(F.count("*").alias("__n"))
    counted = join_null_safe(counted, wanted.drop("__n", "__lo", "__hi"), at)
    order = Window.partitionBy(*at).orderBy("__x").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counted.withColumn("__before", F.col("__before") + F.sum("__n").over(order) - F.col("__n"))

    def at_rank(rank: Column) -> Column:
        hit = (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__n"))
        return F.max(F.when(hit, F.col("__x")))

    picks = []
    for name, p in quantiles.items():
        position = last * F.lit(float(p))
        picks.append(at_rank(F.floor(position)).alias(f"__lo_{name}"))
        picks.append(at_rank(F.ceil(position)).alias(f"__hi_{name}"))
    totals = [F.max(c).alias(c) for c in ("mean", "__m2", "min", "max")]
    result = ranked.groupBy(*by).agg(F.coalesce(F.max("__total"), F.lit(0)).alias("count"), *totals, *picks)

    def interpolated(name: str, p: float) -> Column:
        position = (F.col("count") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (lo + (hi - lo) * (position - F.floor(position))).alias(name)

    return result.select(
        *by, "count", "mean", std.alias("std"), "min", "max",
        *[interpolated(name, p) for name, p in quantiles.items()],
    )


def median_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column name with its exact median over the non-null values."""
    return df.sparkSession.createDataFrame(list(medians(df, list(columns)).items()), "column string, median double")


def place(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles `x`, equal where these are equal; the same step leads back."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _tables(batches):
    """Arrow batches put together to about ROWS_AT_ONCE rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each column over its values; columns without one are left out. Nulls and NaN count as none.

    Three scans: each counts the values by further bits of their place in the order, inside the one or two parts that
    still hold the middle. Tasks count in numpy, Spark adds the counts up; a few numbers a column reach the driver.
    """
    rows, spark = _doubles(df, columns), df.sparkSession
    wanted: dict[tuple[int, int], tuple] = {}
    if not columns:
        return {}
    for step, left in enumerate(UNDECIDED):
        heads = {k: np.array(sorted(h for c, h in wanted if c == k), np.int64) for k in range(len(columns))}
        more = UNDECIDED[step - 1] - left if step else 64

        def count(batches, left=left, heads=heads, more=more, first=not step):
            for table in _tables(batches):
                for k in range(table.num_columns):
                    x = table.column(k).drop_null().to_numpy()
                    code = place(x[~np.isnan(x)]) >> left
                    if not first:
                        code = code[np.isin(code >> more, heads[k])]
                    code, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"k": np.full(len(code), k, np.int32), "code": code, "n": n.astype(np.int64)})

        counts = rows.mapInArrow(count, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
        if step:
            known = [(k, h, before, total) for (k, h), (before, total) in wanted.items()]
            known = spark.createDataFrame(known, "k int, head long, before long, total long")
            counts = counts.withColumn("head", F.shiftright("code", more)).join(known, ["k", "head"])
        else:
            counts = counts.withColumns({"head": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "total": F.sum("n").over(Window.partitionBy("k"))})
        upto = Window.partitionBy("k", "head").orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("end", F.col("before") + F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
        low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
        found = placed.where(((low >= F.col("start")) & (low < F.col("end"))) | ((high >= F.col("start")) & (high < F.col("end"))))
        wanted = {(r.k, r.code): (r.start, r.total) for r in found.select("k", "code", "start", "total").collect()}
        if not wanted:
            return {}
    ends: dict[int, list] = {}
    for k, code in sorted(wanted):
        bits = np.array([code], np.int64)
        ends.setdefault(k, []).append(float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0]))
    return {columns[k]: v[0] if len(v) == 1 else v[0] + (v[1] - v[0]) * 0.5 for k, v in ends.items()}


def moments(df: DataFrame, columns: list[str], fills: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column in one scan, with `fills` in place of nulls."""
    def merge(batches):
        n, mean, m2 = (np.zeros(len(columns)) for _ in range(3))
        for table in _tables(batches):
            for k in range(len(columns)):
                x = table.column(k).fill_null(fills[columns[k]]).to_numpy()
                own = x.mean()
                off, both = own - mean[k], n[k] + len(x)
                m2[k] += ((x - own) ** 2).sum() + off * off * n[k] * len(x) / both
                mean[k] += off * len(x) / both
                n[k] = both
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(columns), dtype=np.int32), "n": n, "mean": mean, "m2": m2})

    parts = materialize(_doubles(df, columns).mapInArrow(merge, "k int, n double, mean double, m2 double").where("n > 0"))
    whole = parts.groupBy("k").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("middle"))
    off = F.col("mean") - F.col("middle")
    found = parts.join(whole, "k").groupBy("k").agg(
        F.first("middle").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * off * off) / F.first("total")).alias("std")
    )
    return {columns[r.k]: (r["mean"], r["std"]) for r in found.collect()}


def unpivot_numeric(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Long form (column, value) of numeric columns, nulls dropped, `keep` columns carried."""
    narrowed = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return narrowed.unpivot(list(keep), columns, "column", "value").where(F.col("value").isNotNull())


def modes_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per text column with its most frequent value, the lowest on ties."""
    narrowed = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        narrowed.unpivot([], columns, "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    best = F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value")))
    return counts.groupBy("column").agg(best.alias("mode"))
