"""Grouped summaries of sales, result tables and predictions."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import to_number
from .quantiles import join_null_safe, modes_of, median_of, summarize, unpivot_numeric

PRICE = "resale_price"


def sale_summary(df: DataFrame, by: str | None = None) -> DataFrame:
    """Count, mean, median, min and max price, in all or by one column."""
    keys = [by] if by else []
    prices = df.select(*keys, to_number(F.col(PRICE)).alias(PRICE))
    return summarize(prices, keys, PRICE, {"median": 0.5}).select(
        *keys, "count", "mean", "median", "min", "max"
    )


def address_rollup(df: DataFrame) -> DataFrame:
    """Per address: number of sales, mean price, first and last month."""
    return df.groupBy("address_key", "town", "block", "street_name").agg(
        F.count("*").alias("txn_count"),
        F.avg(PRICE).alias("avg_resale_price"),
        F.min("month").alias("min_month"),
        F.max("month").alias("max_month"),
    )


def polygon_rollup(points: DataFrame, polygon_id: str) -> DataFrame:
    """Per polygon with points: points, their sales, mean of their mean prices."""
    return points.where(F.col(polygon_id).isNotNull()).groupBy(polygon_id).agg(
        F.count("*").alias("matched_point_count"),
        F.sum("txn_count").alias("matched_txn_count"),
        F.avg("avg_resale_price").alias("mean_avg_resale_price"),
    )


def lines_per_station(df: DataFrame, station: str, line: str) -> DataFrame:
    """Sorted distinct non-blank lines per station. Distinct first, so lists stay short."""
    pairs = df.select(F.col(station), F.col(line)).distinct()
    named = F.when(F.trim(F.col(line)) != "", F.col(line))
    lists = pairs.groupBy(station).agg(F.array_sort(F.collect_list(named)).alias("lines_present"))
    return lists.withColumn("line_count", F.size("lines_present"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value, null as 'Unknown'."""
    named = df.select(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias(column))
    counts = named.groupBy(column).agg(F.count("*").alias("count"))
    return counts.withColumn("pct", F.col("count") / df.select(F.count("*")).scalar())


def distribution_with_price(df: DataFrame, column: str) -> DataFrame:
    """Share per value with the mean and median price of that value."""
    named = df.where(F.col(PRICE).isNotNull()).select(
        F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias(column), PRICE
    )
    prices = summarize(named, [column], PRICE, {"median_price": 0.5})
    return prices.select(
        column,
        "count",
        (F.col("count") / named.select(F.count("*")).scalar()).alias("pct"),
        F.col("mean").alias("mean_price"),
        "median_price",
    )


def factor_distributions(df: DataFrame, factors: list[str]) -> DataFrame:
    """Each value of each factor with its count, share within the factor, mean and median price."""
    long = unpivot_numeric(df.where(F.col(PRICE).isNotNull()), factors, keep=[PRICE])
    prices = summarize(long, ["column", "value"], PRICE, {"median_price": 0.5})
    share = F.col("count") / F.sum("count").over(Window.partitionBy("column"))
    return prices.select(
        F.col("column").alias("factor"), "value", "count", share.alias("pct"),
        F.col("mean").alias("mean_price"), "median_price",
    )


def price_stats(df: DataFrame) -> DataFrame:
    probs = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    return summarize(df, [], PRICE, probs)


def price_stats_by(df: DataFrame, by: str) -> DataFrame:
    probs = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    return summarize(df, [by], PRICE, probs)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return summarize(
        unpivot_numeric(df, columns), ["column"], "value", {"median": 0.5, "p25": 0.25, "p75": 0.75}
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair (both orders) over rows complete for the pair."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"c{i}").alias("r")))
    return one.select(F.explode(F.array(*cells)).alias("p")).select(
        F.col("p.a").alias("column_a"), F.col("p.b").alias("column_b"), F.col("p.r").alias("corr")
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    named = df.where(F.col("month").isNotNull())
    return summarize(named, ["month"], PRICE, {"median_price": 0.5}).select(
        "month", "count", F.col("mean").alias("mean_price"), "median_price"
    )


def postal_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-blank postal code, most first."""
    code = F.trim(F.col(column).cast("string"))
    return (
        df.select(code.alias("postal_code")).where(F.length("postal_code") > 0)
        .groupBy("postal_code").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "postal_code")
    )


def town_good_schools(sales: DataFrame, distances: DataFrame, good: DataFrame) -> DataFrame:
    """Good schools that reach each town: addresses inside and the sales at them."""
    per_address = (
        sales.where(F.col("address_key").isNotNull() & F.col("town").isNotNull())
        .groupBy("address_key", "town").agg(F.count("*").alias("transaction_count"))
    )
    keys = good.select(F.upper("join_key").alias("__key")).distinct()
    linked = distances.where(F.col("inside_good_school_1km") == 1).join(
        keys, F.upper("boundary_school_join_key") == F.col("__key"), "left_semi"
    )
    return (
        linked.join(per_address, "address_key")
        .groupBy("town", F.col("boundary_school_name").alias("school_name"))
        .agg(
            F.countDistinct("address_key").alias("address_count"),
            F.sum("transaction_count").alias("transaction_count"),
        )
        .orderBy("town", F.desc("transaction_count"), F.desc("address_count"), "school_name")
    )


def result_coverage(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """Result and skipped rows per school, over schools found in either table."""
    keys = ["boundary_school_name", "school_group"]
    done = results.groupBy(*keys).agg(F.count("*").alias("result_rows"))
    left = skipped.groupBy(*keys).agg(F.count("*").alias("skipped_rows"))
    both = done.join(left, keys, "full")
    return both.select(
        *keys,
        F.coalesce("result_rows", F.lit(0)).alias("result_rows"),
        F.coalesce("skipped_rows", F.lit(0)).alias("skipped_rows"),
        (F.coalesce("result_rows", F.lit(0)) > 0).alias("has_results"),
    )


def premium_summary(results: DataFrame, skipped: DataFrame, pct: str, money: str) -> DataFrame:
    """Mean and median premium over fitted towns, and how many towns were skipped."""
    long = unpivot_numeric(results, [pct, money])
    stats = summarize(long, ["column"], "value", {"median": 0.5})

    def pick(column: str, field: str) -> Column:
        return F.max(F.when(F.col("column") == column, F.col(field)))

    return stats.agg(
        F.max("count").alias("count"),
        pick(pct, "mean").alias("mean_premium_pct"),
        pick(pct, "median").alias("median_premium_pct"),
        pick(money, "mean").alias("mean_premium_sgd"),
        pick(money, "median").alias("median_premium_sgd"),
    ).withColumn("skipped_town_count", skipped.select(F.count("*")).scalar())


def best_rows(df: DataFrame, goals: dict[str, str], tie: str) -> DataFrame:
    """For each metric, the row that is best by it ('max' or 'min'), ties by `tie`."""
    row = F.struct(*[F.col(c) for c in df.columns])
    picks = []
    for metric, goal in goals.items():
        key = -F.col(metric) if goal == "max" else F.col(metric)
        picks.append(
            F.struct(
                F.lit(metric).alias("best_by"),
                F.min_by(row, F.struct(key.alias("m"), F.col(tie).alias("t"))).alias("row"),
            )
        )
    return df.agg(F.array(*picks).alias("p")).select(F.explode("p").alias("p")).select("p.best_by", "p.row.*")


def profile(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """(column, median, mode) per profiled column: medians of numbers, modes of text."""
    medians = median_of(df, numeric).select("column", "median", F.lit(None).cast("string").alias("mode"))
    modes = modes_of(df, text).select("column", F.lit(None).cast("double").alias("median"), "mode")
    return medians.unionByName(modes)


def domain_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values of each column, one row per value, sorted."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    return long.where(F.col("value").isNotNull()).distinct().orderBy("column", "value")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, t in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def names_concat(df: DataFrame, by: str, name: str, out: str) -> DataFrame:
    """Sorted distinct non-blank names per key joined by ', '; '' when there are none."""
    pairs = df.select(by, F.when(F.trim(F.col(name)) != "", F.col(name)).alias(name)).distinct()
    return pairs.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias(out))


def treated_share(df: DataFrame, by: str, count: str) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("rows"),
        F.avg(F.coalesce((F.col(count) > 0).cast("int"), F.lit(0))).alias("treated_share"),
    )


def map_summary(df: DataFrame) -> DataFrame:
    """Totals over a prediction table, one row."""
    totals = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct("town").alias("town_count"),
        F.avg(PRICE).alias("avg_actual"),
        F.avg("prediction_error").alias("mean_error"),
        F.avg(F.abs("prediction_error")).alias("mean_abs_error"),
        F.avg("good_school_within_1km").alias("good_school_share"),
    )
    predicted = summarize(df, [], "predicted_resale_price", {"median_predicted": 0.5})
    return totals.withColumns(
        {
            "avg_predicted": predicted.select("mean").scalar(),
            "median_predicted": predicted.select("median_predicted").scalar(),
        }
    )


def group_comparison(df: DataFrame, by: str) -> DataFrame:
    """Listings, mean predicted and actual price, mean error and school share by group."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias("listings"),
        F.avg("predicted_resale_price").alias("avg_predicted"),
        F.avg(PRICE).alias("avg_actual"),
        F.avg("prediction_error").alias("avg_error"),
        F.avg("good_school_within_1km").alias("near_good_school_share"),
    )


def top_groups(df: DataFrame, by: str, n: int) -> DataFrame:
    return group_comparison(df, by).orderBy(F.desc("avg_predicted"), F.desc("listings"), by).limit(n)


def exposure_gap(df: DataFrame, towns_in_text: str | None = None) -> DataFrame:
    """Mean prediction by exposure and their gap, and the town with the highest mean.

    With a text, also how the towns it mentions compare: their best mean town.
    """
    p = F.col("predicted_resale_price")
    near = F.col("good_school_within_1km") == 1
    gap = df.agg(
        F.avg(F.when(near, p)).alias("mean_near"), F.avg(F.when(~near, p)).alias("mean_far")
    ).withColumn("gap", F.col("mean_near") - F.col("mean_far"))
    towns = df.where(F.col("town").isNotNull())
    if towns_in_text is not None:
        towns = towns.where(F.lit(towns_in_text.upper()).contains(F.upper("town")))
    means = towns.groupBy("town").agg(F.avg(p).alias("m"))
    top = means.agg(F.min_by("town", F.struct((-F.col("m")).alias("m"), F.col("town"))).alias("t"), F.max("m").alias("m"))
    return gap.withColumns(
        {"top_town": top.select("t").scalar(), "top_town_mean": top.select("m").scalar()}
    )


def extent(df: DataFrame, x: str, y: str, margin: float = 0.0) -> DataFrame:
    return df.agg(
        (F.min(x) - margin).alias("min_x"), (F.min(y) - margin).alias("min_y"),
        (F.max(x) + margin).alias("max_x"), (F.max(y) + margin).alias("max_y"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from min to max, empty ones included, the last closed on the right."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    spark = df.sparkSession
    if ends.lo is None:
        return spark.createDataFrame([], "bin int, bin_low double, bin_high double, count long")
    lo, width = ends.lo, (ends.hi - ends.lo) / bins or 1.0 / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width).cast("int"))
    counts = values.groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_low"),
        (lo + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles and the furthest values within 1.5 IQR of the box, per group."""
    named = df.where(F.col(by).isNotNull() & F.col(column).isNotNull()).select(by, column)
    boxes = summarize(named, [by], column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(column)
    whiskers = join_null_safe(named, boxes.select(by, "q1", "q3"), [by]).groupBy(by).agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
    )
    return join_null_safe(
        boxes.select(by, "count", "q1", "median", "q3"), whiskers, [by]
    ).orderBy("median", by)
