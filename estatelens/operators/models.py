"""Features and price models: ridge, least squares, per-town fits, pruning, variant benchmark."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..functions.tails import student_two_sided
from ..scratch import materialize
from .absorb import WideModel, ridge_absorbed
from .aggregates import treated_share
from .filters import route_by_threshold
from .gram import (
    Design, Sums, collect_sums, few_grams, gram, is_wide, levels_of, make_design, residual_sum, solve, total_sum,
)
from .leastsquares import least_squares
from .ordering import dense_index
from .quantiles import median_of, medians, modes_of, moments, summarize

# The model columns of the study.
DISTANCES = (
    "nearest_mall_walking_distance_m",
    "nearest_mrt_walking_distance_m",
    "nearest_bus_stop_walking_distance_m",
    "nearest_hawker_centre_walking_distance_m",
    "nearest_supermarket_walking_distance_m",
    "nearest_park_walking_distance_m",
    "nearest_pcn_walking_distance_m",
)
STRUCTURE = ("floor_area_sqm", "lease_age_years", "remaining_lease_years", "storey_mid")
AMENITIES = (
    "ln_nearest_mall_walking_distance_m", "malls_within_10min_walk",
    "ln_nearest_mrt_walking_distance_m", "mrt_unique_lines_within_10min_walk",
    "ln_nearest_bus_stop_walking_distance_m", "bus_stops_within_5min_walk",
    "ln_nearest_hawker_centre_walking_distance_m", "hawker_centres_within_5min_walk",
    "ln_nearest_supermarket_walking_distance_m", "supermarkets_within_10min_walk",
    "ln_nearest_park_walking_distance_m", "parks_within_5min_walk",
    "ln_nearest_pcn_walking_distance_m", "pcns_within_5min_walk",
)
SCHOOL_COUNTS = ("school_count_1km", "good_school_count_1km", "school_count_2km", "good_school_count_2km")
EXPOSURE = "good_school_within_1km"
FULL_NUMERIC = (
    "floor_area_sqm", "lease_age_years", "remaining_lease_years", "storey_mid",
    "sale_year", "sale_month", "months_since_start",
    *AMENITIES[:4], *SCHOOL_COUNTS, EXPOSURE, *AMENITIES[4:],
)
REDUCED_NUMERIC = tuple(
    c for c in FULL_NUMERIC if c not in ("remaining_lease_years", "sale_year", "sale_month", EXPOSURE)
)
CATEGORIES = ("town", "flat_type", "flat_model")
TARGET = "log_resale_price"

# Defaults for prediction inputs whose column is absent or empty.
FALLBACK_TEXT = {"month": "2025-01", "town": "TAMPINES", "flat_type": "4 ROOM", "flat_model": "Model A"}
FALLBACK_NUMBER = {
    "floor_area_sqm": 90.0, "lease_commence_date": 1995.0, "remaining_lease_years": 70.0, "storey_mid": 8.0,
    "nearest_mall_walking_distance_m": 500.0, "malls_within_10min_walk": 1.0,
    "nearest_mrt_walking_distance_m": 500.0, "mrt_unique_lines_within_10min_walk": 1.0,
    "school_count_1km": 2.0, "good_school_count_1km": 0.0, "school_count_2km": 5.0, "good_school_count_2km": 1.0,
    "nearest_bus_stop_walking_distance_m": 200.0, "bus_stops_within_5min_walk": 3.0,
    "nearest_hawker_centre_walking_distance_m": 700.0, "hawker_centres_within_5min_walk": 1.0,
    "nearest_supermarket_walking_distance_m": 500.0, "supermarkets_within_10min_walk": 1.0,
    "nearest_park_walking_distance_m": 500.0, "parks_within_5min_walk": 1.0,
    "nearest_pcn_walking_distance_m": 500.0, "pcns_within_5min_walk": 1.0,
}


def feature_columns(start: Column) -> dict[str, Column]:
    """Every derived model column over the raw sale columns."""
    month = S.parse_month(F.col("month"))
    out = {
        "month_dt": month,
        "month_period": S.month_text(month),
        "sale_year": F.year(month).cast("double"),
        "sale_month": F.month(month).cast("double"),
        "months_since_start": S.months_between_starts(month, start).cast("double"),
        "remaining_lease_years": S.remaining_lease_years(F.col("remaining_lease")),
        "storey_mid": S.storey_mid(F.col("storey_range")),
        "lease_age_years": S.lease_age_years(month, F.col("lease_commence_date")),
        EXPOSURE: S.good_school_indicator(F.col("good_school_count_1km")).cast("double"),
        TARGET: S.log_price(F.col("resale_price")),
    }
    for c in DISTANCES:
        out[f"ln_{c}"] = S.log_distance(F.col(c))
    return out


def engineer_features(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Model table: target, 26 numeric and 3 category columns; rows without a usable price,
    month or floor area are dropped. `keep` columns are carried along."""
    start = df.select(F.min(S.parse_month(F.col("month")))).scalar()
    derived = feature_columns(start)

    def pick(c: str) -> Column:
        return derived[c] if c in derived else S.to_number(F.col(c))

    out = df.select(
        *keep,
        derived[TARGET].alias(TARGET),
        *[pick(c).alias(c) for c in FULL_NUMERIC],
        *CATEGORIES,
        derived["month_period"].alias("month_period"),
        S.to_number(F.col("resale_price")).alias("resale_price"),
        derived["month_dt"].alias("month_dt"),
    )
    return out.dropna(subset=[TARGET, "month_dt", "floor_area_sqm", "resale_price"])


def time_split(df: DataFrame, test_months: int) -> tuple[DataFrame, DataFrame]:
    """Rows before, and in, the last `test_months` calendar months."""
    cutoff = F.add_months(df.select(F.max("month_dt")).scalar(), 1 - test_months)
    return df.where(F.col("month_dt") < cutoff), df.where(F.col("month_dt") >= cutoff)


# -- floor-area balancing -------------------------------------------------------------------

def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct exact quantile edges; one bin fewer than edges."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    row = summarize(df, [], column, probs).first()
    return sorted({row[f"q{i}"] for i in range(bins + 1)}) if row else []


def bin_of(x: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin; the first also holds its lower edge."""
    out = F.when(x < edges[0], F.lit(None))
    for i in range(len(edges) - 1):
        out = out.when(x <= edges[i + 1], F.lit(i))
    return out.cast("int")


def _linear_quantile(values: list[float], p: float) -> float:
    return float(np.quantile(np.asarray(values, dtype=float), p))


def bin_sizes(df: DataFrame, column: str, bins: int, fraction: float):
    """Edges, {bin: rows} and the bin-size quantile to balance towards."""
    edges = quantile_edges(df, column, bins)
    counted = df.groupBy(bin_of(F.col(column), edges).alias("bin")).agg(F.count("*").alias("n")).collect()
    sizes = {r.bin: r.n for r in counted if r.bin is not None}
    return edges, sizes, _linear_quantile(list(sizes.values()), fraction)


def rebalance(df: DataFrame, column: str, bins: int, fraction: float, key: list[str], seed: int) -> DataFrame:
    """Bins below the target size are redrawn with replacement up to it; others are kept whole.

    Draws are rows of `spark.range` that pick a row number by seeded hash, so the
    sizes are exact and the sample repeats on any partitioning.
    """
    edges, sizes, target = bin_sizes(df, column, bins, fraction)
    target = int(target)
    small = sorted(b for b, n in sizes.items() if n < target)
    binned = df.withColumn("floor_area_bin", bin_of(F.col(column), edges))
    whole = binned.where(~F.col("floor_area_bin").isin(small)) if small else binned
    if not small:
        return whole
    numbered = dense_index(binned.where(F.col("floor_area_bin").isin(small)), key, by=["floor_area_bin"])
    order = F.array(*[F.lit(b) for b in small])
    counts = F.array(*[F.lit(sizes[b]).cast("long") for b in small])
    slot = (F.floor(F.col("id") / target)).cast("int")
    draws = df.sparkSession.range(target * len(small)).select(
        F.get(order, slot).alias("floor_area_bin"),
        (F.pmod(F.xxhash64("id", F.lit(seed)), F.get(counts, slot)) + 1).alias("row_index"),
    )
    drawn = draws.join(numbered, ["floor_area_bin", "row_index"]).select(*whole.columns)
    return whole.unionByName(drawn)


def balance_weights(df: DataFrame, column: str, bins: int, fraction: float) -> DataFrame:
    """`sample_weight` per row: target size over bin size, at least 1."""
    edges, sizes, target = bin_sizes(df, column, bins, fraction)
    index = bin_of(F.col(column), edges)
    weight = F.when(index.isNull(), F.lit(None).cast("double"))
    for b, n in sizes.items():
        weight = weight.when(index == b, F.lit(max(1.0, target / n)))
    return df.withColumn("floor_area_bin", index).withColumn("sample_weight", weight)


# -- preparation and linear models ----------------------------------------------------------

@dataclass
class Preparation:
    """Fitted fills and scales: medians, means and population deviations, modes, levels."""

    numeric: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    modes: dict[str, str]
    levels: dict[str, tuple[str, ...]]

    def filled(self, df: DataFrame) -> DataFrame:
        fills = {c: F.coalesce(F.col(c), F.lit(self.medians[c])) for c in self.numeric}
        fills |= {c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.modes.items()}
        return df.withColumns(fills)

    def scaled(self, column: str) -> Column:
        x = F.coalesce(F.col(column), F.lit(self.medians[column]))
        return (x - self.means[column]) / self.scales[column]

    def design(self, y_shift: float = 0.0) -> Design:
        return Design(
            numeric=tuple(self.numeric), categories=self.levels, shift=self.means, scale=self.scales,
            y_shift=y_shift, fills=self.medians | {c: m for c, m in self.modes.items() if m is not None},
        )


def prepare(train: DataFrame, numeric: list[str], fields: list[str], levels: bool = True) -> Preparation:
    """Fit the preparation on the training rows only; without `levels` the categories are only filled."""
    middles = medians(train, numeric)
    fills = {c: float(middles.get(c) or 0.0) for c in numeric}
    modes = {r["column"]: r["mode"] for r in modes_of(train, fields).collect()} if fields else {}
    stats = moments(train, numeric, fills)
    means = {c: float(stats[c][0]) for c in numeric}
    scales = {c: float(stats[c][1]) or 1.0 for c in numeric}
    return Preparation(list(numeric), fills, means, scales, modes, levels_of(train, list(fields)) if levels else {})


def one_hot(df: DataFrame, prep: Preparation) -> DataFrame:
    """Indicator columns `field=level`; an unseen level gives zeros."""
    cols = []
    for c, levels in prep.levels.items():
        value = F.coalesce(F.col(c), F.lit(prep.modes.get(c)))
        cols += [(value == level).cast("int").alias(f"{c}={level}") for level in levels]
    return df.select("*", *cols)


@dataclass
class LinearModel:
    """A fitted linear model of the log price, applied as one column expression."""

    prep: Preparation
    intercept: float
    numeric: dict[str, float]
    effects: dict[str, dict[str, float]]

    def log_price(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in self.numeric.items():
            out = out + self.prep.scaled(c) * F.lit(b)
        for c, by_level in self.effects.items():
            value = F.coalesce(F.col(c), F.lit(self.prep.modes.get(c)))
            pairs = [F.lit(v) for kv in by_level.items() for v in kv]
            out = out + F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(0.0))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("predicted_log_price", self.log_price()).withColumn(
            "predicted_resale_price", F.exp("predicted_log_price")
        )

    def coefficients(self, spark) -> DataFrame:
        """(feature, coefficient) of every term but the constant."""
        rows = [(f"num__{c}", float(b)) for c, b in self.numeric.items()]
        rows += [(f"cat__{c}_{k}", float(b)) for c, m in self.effects.items() for k, b in m.items()]
        return spark.createDataFrame(rows, "feature string, coefficient double")

    def importance(self, spark, top: int = 100) -> DataFrame:
        return self.coefficients(spark).withColumn("abs_coefficient", F.abs("coefficient")).orderBy(
            F.desc("abs_coefficient"), "feature"
        ).limit(top)

    def slopes(self, df: DataFrame) -> DataFrame:
        """(feature, coefficient, slope): cross product of each term with the residuals over `df`, 0 for unseen levels.

        On the rows of the fit it is alpha times the coefficient for a ridge; sums combine before they are shuffled.
        """
        levels = [F.concat(F.lit(f"cat__{c}_"), F.coalesce(F.col(c), F.lit(self.prep.modes.get(c)))) for c in self.effects]
        residual = (F.col(TARGET) - self.log_price()).alias("residual")
        # One array, as the optimizer follows every column that is part of another one.
        one = df.select(residual, F.array(*[self.prep.scaled(c) for c in self.numeric]).alias("x")).agg(
            F.array(*[F.sum(F.col("residual") * F.get("x", F.lit(i))) for i in range(len(self.numeric))]).alias("slope")
        )
        names = F.array(*[F.lit(f"num__{c}") for c in self.numeric])
        sums = one.select(names.alias("feature"), "slope").select(F.inline(F.arrays_zip("feature", "slope"))) if self.numeric else None
        if levels:
            # The residual is worked out before the levels are taken apart, not once for each of them.
            entries = df.select(residual, F.array(*levels).alias("level")).select("residual", F.explode("level").alias("feature"))
            by_level = entries.groupBy("feature").agg(F.sum("residual").alias("slope"))
            sums = by_level if sums is None else sums.unionByName(by_level)
        return self.coefficients(df.sparkSession).join(sums, "feature", "left").select(
            "feature", "coefficient", F.coalesce("slope", F.lit(0.0)).alias("slope")
        )


def model_from(prep: Preparation, design: Design, index: list[int], beta: np.ndarray, sums: Sums) -> LinearModel:
    """Coefficients of the terms `index` (without the constant) to a model."""
    total = sums.xx[0, 0]
    mean_x, mean_y = sums.xx[0, index] / total, sums.xy[0] / total
    intercept = float(mean_y - mean_x @ beta + design.y_shift)
    numeric: dict[str, float] = {}
    effects: dict[str, dict[str, float]] = {c: {} for c in design.categories}
    for k, b in zip(index, beta):
        name, level = design.terms[k]
        if level is None:
            numeric[name] = float(b)
        else:
            effects[name][level] = float(b)
    return LinearModel(prep, intercept, numeric, {c: m for c, m in effects.items() if m})


def ridge_beta(centred: Sums, alpha: float) -> np.ndarray:
    return np.linalg.solve(centred.xx + alpha * np.eye(len(centred.xx)), centred.xy)


def fit_ridge(
    train: DataFrame, numeric: list[str], fields: list[str] = CATEGORIES, alpha: float = 1.0,
    weight: str | None = None,
) -> LinearModel | WideModel:
    """Ridge with unpenalised constant on prepared columns; optional row weights.

    Categories with too many levels for a dense design are absorbed; the fit is the same.
    """
    if is_wide(train, list(fields)):
        return ridge_absorbed(train, prepare(train, list(numeric), list(fields), levels=False), list(fields), TARGET, alpha, weight)
    prep = prepare(train, list(numeric), list(fields))
    design = prep.design(float(train.agg(F.avg(TARGET)).first()[0]))
    sums = collect_sums(gram(train, design, TARGET, weight))
    index = list(range(1, len(design.terms)))
    return model_from(prep, design, index, ridge_beta(sums.centred(), alpha), sums)


def prediction_metrics(df: DataFrame, models: dict[str, LinearModel]) -> DataFrame:
    """R² of the log price, RMSE and MAE of the price, per model, in one pass."""
    y, price = F.col(TARGET), F.col("resale_price")
    aggs = [F.count("*").alias("n"), F.var_pop(y).alias("v")]
    for i, m in enumerate(models.values()):
        p = m.log_price()
        aggs += [
            F.sum((y - p) * (y - p)).alias(f"e{i}"),
            F.avg((price - F.exp(p)) * (price - F.exp(p))).alias(f"r{i}"),
            F.avg(F.abs(price - F.exp(p))).alias(f"a{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("variant"), F.col("n").alias("rows"),
            (1 - F.col(f"e{i}") / (F.col("v") * F.col("n"))).alias("r2_log"),
            F.sqrt(f"r{i}").alias("rmse"), F.col(f"a{i}").alias("mae"),
        )
        for i, name in enumerate(models)
    ])
    return one.select(F.explode(rows).alias("m")).select("m.*")


# -- ordinary least squares -----------------------------------------------------------------

def term_name(name: str, level: str | None) -> str:
    return name if level is None else f"C({name})[T.{level}]"


def ols_table(df: DataFrame, numeric: list[str], fields: list[str], y: str = TARGET) -> DataFrame:
    """Coefficient table of a least-squares fit: coef, std_err, t, p_value, 95 % interval of every term at any number of levels."""
    return least_squares(df, list(numeric), list(fields), y)


def effect_row(sums: Sums, k: int, scale: float) -> dict:
    """Coefficient k with classical standard error, t-based p-value and premium interval."""
    beta, inverse, rank = solve(sums)
    free = sums.n - rank
    variance = residual_sum(sums, beta) / free if free > 0 else float("nan")
    coef, se = beta[k] / scale, math.sqrt(max(inverse[k, k], 0.0) * variance) / scale if free > 0 else float("nan")
    return {
        "coef_log_points": float(coef),
        "std_err": float(se),
        "p_value": float(student_two_sided(coef / se, free)) if se > 0 else float("nan"),
        "premium_pct": float(math.exp(coef) - 1),
        "ci_low_pct": math.exp(coef - 1.96 * se) - 1,
        "ci_high_pct": math.exp(coef + 1.96 * se) - 1,
        "r_squared": float(1 - residual_sum(sums, beta) / total_sum(sums)),
    }


# Nested specifications, each adding columns to the one before.
NESTED = (
    ("raw_only", (EXPOSURE,), ()),
    ("structural", STRUCTURE, ("flat_type", "flat_model")),
    ("structural_plus_time", (), ("month_period",)),
    ("structural_plus_time_town", (), ("town",)),
    ("add_access_amenities", AMENITIES, ()),
    ("add_school_counts", SCHOOL_COUNTS, ()),
)


def nested_trace(df: DataFrame) -> DataFrame:
    """Follow the exposure coefficient through six nested specifications, in one pass.

    Rows are grouped by how many of the specifications they are complete for, and
    the sums of the deeper groups are added to those of the shallower ones.
    """
    depth: Column = F.lit(0)
    complete: Column = F.col(TARGET).isNotNull()
    for _, numeric, fields in NESTED:
        for c in (*numeric, *fields):
            complete = complete & F.col(c).isNotNull()
        depth = depth + complete.cast("int")
    numeric = [c for _, cols, _ in NESTED for c in cols]
    fields = [c for _, _, cols in NESTED for c in cols]
    rows = df.withColumn("depth", depth).where(F.col("depth") > 0)
    design = make_design(rows, numeric, fields, TARGET)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in numeric}
    by_depth = collect_sums(few_grams(rows.withColumns(zero), design, TARGET, "depth"), "depth")
    out, columns = [], set()
    for k, (name, cols, more) in enumerate(NESTED, start=1):
        columns |= {*cols, *more}
        parts = [s for d, s in by_depth.items() if d >= k]
        if not parts:
            continue
        sums = parts[0]
        for s in parts[1:]:
            sums = sums + s
        index = [0] + [i for i, (c, _) in enumerate(design.terms) if c in columns]
        row = effect_row(sums.take(index), 1, design.scale[EXPOSURE])
        out.append((name, sums.n, *[row[c] for c in _EFFECT]))
    schema = "specification string, rows long, " + ", ".join(f"{c} double" for c in _EFFECT)
    return df.sparkSession.createDataFrame(out, schema)


_EFFECT = ("coef_log_points", "std_err", "p_value", "premium_pct", "ci_low_pct", "ci_high_pct", "r_squared")


def town_premiums(df: DataFrame, min_rows: int = 1500, min_share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Per-town effect of one more good school within 1 km, and the towns skipped with a reason."""
    count = "good_school_count_1km"
    named = df.where(F.col("town").isNotNull())
    prices = summarize(named, ["town"], "resale_price", {"median": 0.5})
    groups = materialize(treated_share(named, "town", count))
    fit, skipped = route_by_threshold(
        groups, (F.col("rows") >= min_rows) & (F.col("treated_share") >= min_share), "below_threshold"
    )
    numeric, fields = [count, *STRUCTURE, *AMENITIES], ["flat_type", "flat_model", "month_period"]
    rows = named.join(fit.select("town"), "town", "left_semi").dropna(subset=[*numeric, *fields, TARGET])
    design = make_design(rows, numeric, fields, TARGET)

    def effect(frame: pd.DataFrame) -> pd.DataFrame:
        sums = Sums.from_cells(frame)
        row = effect_row(sums, 1, design.scale[count])
        return pd.DataFrame([{"town": frame["town"].iloc[0], "fit_rows": sums.n, **row}])

    schema = "town string, fit_rows long, " + ", ".join(f"{c} double" for c in _EFFECT)
    effects = materialize(gram(rows, design, TARGET, by=["town"]).groupBy("town").applyInPandas(effect, schema))
    # Towns without complete rows, or with too few for an error, are skipped with a reason of their own.
    effects = effects.where(~F.isnan("coef_log_points") & ~F.isnan("p_value"))
    failed = fit.join(effects.select("town"), "town", "left_anti").withColumn("reason", F.lit("fit_failed"))
    skipped = skipped.unionByName(failed.select(skipped.columns))
    results = effects.join(groups.select("town", "treated_share"), "town").join(
        prices.select("town", F.col("mean").alias("town_mean_resale_price"), F.col("median").alias("town_median_resale_price")),
        "town",
    ).select(
        "town", F.col("fit_rows").alias("rows"), "treated_share", *_EFFECT,
        (F.col("premium_pct") * F.col("town_mean_resale_price")).alias("premium_sgd_at_town_mean_price"),
        (F.col("premium_pct") * F.col("town_median_resale_price")).alias("premium_sgd_at_town_median_price"),
        "town_mean_resale_price", "town_median_resale_price",
    )
    return results.orderBy("p_value", F.desc("premium_pct")), skipped.orderBy(F.desc("rows"), "town")


# -- column selection and penalised fits ----------------------------------------------------

def raw_sums(sums: Sums, prep: Preparation, columns: list[str]) -> np.ndarray:
    """Uncentred cross products of columns in their own units, from the scaled sums."""
    index = [0] + [1 + prep.numeric.index(c) for c in columns]
    g = sums.xx[np.ix_(index, index)]
    back = np.zeros((len(columns), len(index)))
    for k, c in enumerate(columns):
        back[k, 0], back[k, k + 1] = prep.means[c], prep.scales[c]
    return back @ g @ back.T


def vif_scores(g: np.ndarray) -> np.ndarray:
    """Uncentred variance inflation of each column; infinite where it is a combination of others."""
    d = np.sqrt(np.diag(g))
    d = np.where(d > 0, d, 1.0)
    g = g / np.outer(d, d)
    out = np.empty(len(g))
    for k in range(len(g)):
        rest = [i for i in range(len(g)) if i != k]
        values, vectors = np.linalg.eigh(g[np.ix_(rest, rest)])
        keep = values > 1e-12 * values.max()
        along = vectors[:, keep].T @ g[rest, k]
        left = g[k, k] - float(along @ (along / values[keep]))
        out[k] = 1.0 / left if left > 1e-10 else np.inf
    return out


def vif_prune(sums: Sums, prep: Preparation, columns: list[str], threshold: float) -> list[str]:
    """Drop the column of largest inflation while it exceeds the threshold and more than 2 remain."""
    left = list(columns)
    while len(left) > 2:
        scores = vif_scores(raw_sums(sums, prep, left))
        worst = int(np.argmax(scores))
        if scores[worst] <= threshold:
            break
        left.pop(worst)
    return left


def f_scores(sums: Sums, prep: Preparation, columns: list[str]) -> dict[str, float]:
    """F statistic of each column alone against the target."""
    c = sums.centred()
    out = {}
    for name in columns:
        k = prep.numeric.index(name)
        r2 = c.xy[k] ** 2 / (c.xx[k, k] * c.yy) if c.xx[k, k] > 0 else 0.0
        out[name] = r2 / (1 - r2) * (sums.n - 2) if r2 < 1 else math.inf
    return out


def select_k_best(sums: Sums, prep: Preparation, columns: list[str], k: int) -> list[str]:
    scores = f_scores(sums, prep, columns)
    best = sorted(columns, key=lambda c: -scores[c])[:k]
    return [c for c in columns if c in best]


class NotConverged(ArithmeticError):
    """A penalised fit whose duality gap does not close."""


def duality_gaps(centred: list[Sums], penalties: list[tuple[float, float]], b: np.ndarray) -> np.ndarray:
    """How far (sample, penalty) the objective of `elastic_nets`, times n, is from its least value at most.

    Two dual points are tried and the better one counts: the residual scaled until no column exceeds the penalty, with
    the quadratic part as further rows of the design, and, where there is a quadratic part, the residual as it is, which
    pays for what exceeds the penalty. A gap of 0 proves the fit.
    """
    n = np.array([[float(c.n)] for c in centred])
    alpha, ratio = (np.array(v) for v in zip(*penalties))
    lam, ridge = n * alpha * ratio, n * alpha * (1 - ratio)
    xy, yy = np.stack([c.xy for c in centred]), np.array([[c.yy] for c in centred])
    pull = xy[:, :, None] - np.einsum("fkj,fjm->fkm", np.stack([c.xx for c in centred]), b)
    target = yy - np.einsum("fk,fkm->fm", xy, b)
    rss = target - np.einsum("fkm,fkm->fm", b, pull)
    squares, sizes = (b * b).sum(axis=1), np.abs(b).sum(axis=1)
    steepest = np.abs(pull - ridge[:, None, :] * b).max(axis=1, initial=0.0)
    shrink = np.where(steepest > lam, lam / np.maximum(steepest, 1e-300), 1.0)
    primal = rss / 2 + lam * sizes + ridge * squares / 2
    scaled = shrink * target - shrink**2 * (rss + ridge * squares) / 2
    beyond = (np.maximum(np.abs(pull) - lam[:, None, :], 0.0) ** 2).sum(axis=1)
    paid = np.where(ridge > 0, target - rss / 2 - beyond / np.maximum(2 * ridge, 1e-300), -np.inf)
    return primal - np.maximum(scaled, paid)


def elastic_nets(centred: list[Sums], penalties: list[tuple[float, float]], tol: float = 1e-6, check: int = 10) -> np.ndarray:
    """Coefficients (sample, term, penalty) of every (alpha, ratio) on every sample at once.

    Coordinate descent on the sums for 1/(2n)·‖y−Xb‖² + α(ρ‖b‖₁ + (1−ρ)/2·‖b‖²), with α and ρ above 0. It ends when the
    duality gap of every fit is at most `tol` of the sum of squares of its target, looked at every `check` sweeps; there
    is no limit of sweeps. A fit that stands still with a larger gap raises `NotConverged`.
    """
    if any(a <= 0 or r <= 0 for a, r in penalties):
        raise ValueError("penalties need an alpha and a share of the absolute part above 0")
    g = np.stack([c.xx for c in centred])
    n = np.array([[float(c.n)] for c in centred])
    alpha, ratio = (np.array(v) for v in zip(*penalties))
    lam, ridge = n * alpha * ratio, n * alpha * (1 - ratio)
    d = np.einsum("fkk->fk", g)
    b = np.zeros((len(centred), g.shape[1], len(penalties)))
    pull = np.repeat(np.stack([c.xy for c in centred])[:, :, None], len(penalties), axis=2)
    allowed = np.array([[tol * max(c.yy, 0.0)] for c in centred])
    live = np.flatnonzero(d.max(axis=0) > 1e-12)
    while True:
        moved = 0.0
        for _ in range(check):
            for k in live:
                dk = d[:, k, None]
                z = pull[:, k] + dk * b[:, k]
                new = np.sign(z) * np.maximum(np.abs(z) - lam, 0.0) / np.maximum(dk + ridge, 1e-12)
                step = new - b[:, k]
                if step.any():
                    pull -= g[:, :, k, None] * step[:, None, :]
                    b[:, k] = new
                    moved = max(moved, float((np.abs(step) * np.sqrt(dk)).max()))
        open_gaps = duality_gaps(centred, penalties, b) > allowed
        if not open_gaps.any():
            return b
        if moved <= 1e-14 * math.sqrt(max(max(c.yy for c in centred), 1e-300)):
            raise NotConverged(f"{int(open_gaps.sum())} penalised fits stand still above their tolerance")


def cross_validate(folds: dict[int, Sums], index: list[int], alphas: list[float], ratios: list[float]):
    """(alpha, ratio) of least mean held-out squared error, from per-fold sums."""
    parts = list(folds.values())
    whole = parts[0]
    for s in parts[1:]:
        whole = whole + s
    penalties = [(float(a), float(r)) for r in ratios for a in sorted(alphas, reverse=True)]
    trains = [(whole - held).take([0, *index]) for held in parts]
    coefs = elastic_nets([t.centred() for t in trains], penalties)
    errors = np.zeros(len(penalties))
    for train, held, betas in zip(trains, parts, coefs):
        test = held.take([0, *index])
        for m in range(len(penalties)):
            level = (train.xy[0] - train.xx[0, 1:] @ betas[:, m]) / train.xx[0, 0]
            errors[m] += residual_sum(test, np.concatenate([[level], betas[:, m]])) / test.n / len(parts)
    alpha, ratio = penalties[int(np.argmin(errors))]
    return alpha, ratio, whole


def fold_of(df: DataFrame, key: list[str], folds: int) -> DataFrame:
    """Contiguous folds of near-equal size in the order of the key; the first ones take the rest."""
    numbered = materialize(dense_index(df.select(*key), key))
    n = numbered.count()
    size, extra = divmod(n, folds)
    # Row numbers of the last row before and the first row of each fold but the first.
    firsts = [f * size + min(f, extra) + 1 for f in range(1, folds)]
    edge = {r.row_index: tuple(r[c] for c in key) for r in numbered.where(F.col("row_index").isin([*firsts, *(i - 1 for i in firsts)])).collect()}
    cuts = [(edge.get(i - 1), edge[i]) for i in firsts if i in edge]
    if all(None not in first and last != first for last, first in cuts):
        # Only keys are sorted; the rows are compared with the first key of each fold.
        return df.withColumn("fold", sum((_at_least(key, first).cast("int") for _, first in cuts), F.lit(0)))
    numbered = dense_index(df, key)
    at = F.col("row_index") - 1
    late = F.floor((at - extra) / max(size, 1))
    return numbered.withColumn("fold", F.when(at < extra * (size + 1), F.floor(at / (size + 1))).otherwise(late).cast("int"))


def _at_least(key: list[str], first: tuple) -> Column:
    """Whether a row's key comes at or after `first`; nulls come before."""
    column, value = F.col(key[0]), F.lit(first[0])
    if len(key) == 1:
        return F.coalesce(column >= value, F.lit(False))
    return F.coalesce(column > value, F.lit(False)) | (F.coalesce(column == value, F.lit(False)) & _at_least(key[1:], first[1:]))


ALPHAS = tuple(float(a) for a in np.logspace(-4, 0, 20))
RATIOS = (0.1, 0.3, 0.5, 0.7, 0.9)


def fit_penalised(train: DataFrame, numeric: list[str], key: list[str], ratios: list[float]):
    """Cross-validated lasso (ratios [1.0]) or elastic net; returns model, alpha, ratio."""
    prep = prepare(train, list(numeric), list(CATEGORIES))
    design = prep.design(float(train.agg(F.avg(TARGET)).first()[0]))
    folded = fold_of(train, key, 5)
    folds = collect_sums(few_grams(folded, design, TARGET, "fold"), "fold")
    return _penalised(folds, prep, design, list(range(1, len(design.terms))), ratios)


def _penalised(folds, prep, design, index, ratios):
    alpha, ratio, whole = cross_validate(folds, index, list(ALPHAS), list(ratios))
    beta = elastic_nets([whole.take([0, *index]).centred()], [(alpha, ratio)])[0, :, 0]
    return model_from(prep, design, index, beta, whole), alpha, ratio


def variant_benchmark(
    train: DataFrame, test: DataFrame, key: list[str], vif_threshold: float = 10.0, k_best: int = 12,
    bins: int = 8, fraction: float = 0.75, seed: int = 42,
) -> DataFrame:
    """Eight model variants scored on the same test months, best test RMSE first.

    Six variants share one pass of per-fold sums over the training rows.
    """
    prep = prepare(train, list(FULL_NUMERIC), list(CATEGORIES))
    design = prep.design(float(train.agg(F.avg(TARGET)).first()[0]))
    folded = fold_of(train, key, 5)
    folds = collect_sums(few_grams(folded, design, TARGET, "fold"), "fold")
    sums = None
    for s in folds.values():
        sums = s if sums is None else sums + s

    def index_of(numeric) -> list[int]:
        wanted = set(numeric)
        return [i for i, (c, level) in enumerate(design.terms) if i and (level is not None or c in wanted)]

    def ridge(numeric) -> LinearModel:
        index = index_of(numeric)
        return model_from(prep, design, index, ridge_beta(sums.take([0, *index]).centred(), 1.0), sums)

    reduced = list(REDUCED_NUMERIC)
    pruned = vif_prune(sums, prep, list(FULL_NUMERIC), vif_threshold)
    chosen = select_k_best(sums, prep, reduced, min(k_best, len(reduced)))
    lasso, lasso_alpha, _ = _penalised(folds, prep, design, index_of(reduced), [1.0])
    net, net_alpha, net_ratio = _penalised(folds, prep, design, index_of(reduced), RATIOS)
    balanced = rebalance(train, "floor_area_sqm", bins, fraction, key, seed).drop("floor_area_bin")
    weighted = balance_weights(train, "floor_area_sqm", bins, fraction)
    models = {
        "ridge_baseline": ridge(FULL_NUMERIC),
        "ridge_reduced": ridge(reduced),
        "ridge_vif_pruned": ridge(pruned),
        "ridge_f_regression": ridge(chosen),
        "lasso_reduced": lasso,
        "elasticnet_reduced": net,
        "ridge_floor_area_rebalanced": fit_ridge(balanced, reduced),
        "ridge_floor_area_weighted": fit_ridge(weighted, reduced, weight="sample_weight"),
    }
    rebalanced = "ridge_floor_area_rebalanced"
    on_train = prediction_metrics(train, {k: m for k, m in models.items() if k != rebalanced}).unionByName(
        prediction_metrics(balanced, {rebalanced: models[rebalanced]})
    )
    on_test = prediction_metrics(test, models)
    facts = [
        (name, {"ridge_baseline": len(FULL_NUMERIC), "ridge_vif_pruned": len(pruned)}.get(name, len(reduced)),
         {"lasso_reduced": lasso_alpha, "elasticnet_reduced": net_alpha}.get(name),
         net_ratio if name == "elasticnet_reduced" else None,
         ", ".join(chosen) if name == "ridge_f_regression" else None)
        for name in models
    ]
    facts = train.sparkSession.createDataFrame(
        facts,
        "variant string, numeric_feature_count int, alpha double, l1_ratio double, selected_numeric_features string",
    )
    return (
        facts.join(on_train.select("variant", F.col("rows").alias("train_rows"), F.col("r2_log").alias("train_r2_log"),
                                   F.col("rmse").alias("train_rmse_sgd"), F.col("mae").alias("train_mae_sgd")), "variant")
        .join(on_test.select("variant", F.col("r2_log").alias("test_r2_log"), F.col("rmse").alias("test_rmse_sgd"),
                             F.col("mae").alias("test_mae_sgd")), "variant")
        .orderBy("test_rmse_sgd", "test_mae_sgd")
    )


# -- scoring incomplete requests ------------------------------------------------------------

def prediction_defaults(df: DataFrame) -> dict[str, object]:
    """One default per prediction input: medians and modes, rebuilt lease and storey text."""
    work = df.withColumn("remaining_lease_years", S.remaining_lease_years(F.col("remaining_lease"))).withColumn(
        "storey_mid", S.storey_mid(F.col("storey_range"))
    )
    numbers = S.present(work.columns, list(FALLBACK_NUMBER))
    texts = S.present(work.columns, list(FALLBACK_TEXT))
    typed = work.withColumns({c: S.to_number(F.col(c)) for c in numbers})
    medians = {r["column"]: r["median"] for r in median_of(typed, numbers).collect()}
    modes = {r["column"]: r["mode"] for r in modes_of(work, texts).collect()}
    number = {c: float(medians[c]) if medians.get(c) is not None else v for c, v in FALLBACK_NUMBER.items()}
    text = {c: modes.get(c) or v for c, v in FALLBACK_TEXT.items()}
    low = max(math.floor(number["storey_mid"] - 1), 1)
    high = max(math.ceil(number["storey_mid"] + 1), low)
    lease = max(round(number.pop("remaining_lease_years")), 1)
    number.pop("storey_mid")
    number["lease_commence_date"] = int(round(number["lease_commence_date"]))
    return {**text, **number, "remaining_lease": f"{lease} years", "storey_range": f"{low:02d} TO {high:02d}"}


def score_with_defaults(requests: DataFrame, defaults: dict[str, object], model: LinearModel, start: str) -> DataFrame:
    """Price partial requests: missing inputs take their default and are listed.

    `start` is the first month of the training data as YYYY-MM. Requests whose month,
    lease or storey text cannot be read get a null price.
    """
    have = set(requests.columns)
    names = sorted(defaults)
    given = {c: F.col(c).isNotNull() if c in have else F.lit(False) for c in names}
    listed = requests.withColumns({
        "provided_raw_fields": F.array_compact(F.array(*[F.when(given[c], F.lit(c)) for c in names])),
        "defaulted_raw_fields": F.array_compact(F.array(*[F.when(~given[c], F.lit(c)) for c in names])),
    })
    filled = listed.withColumns({
        c: F.coalesce(F.col(c), F.lit(defaults[c])) if c in have else F.lit(defaults[c]) for c in names
    })
    derived = feature_columns(F.lit(start + "-01").cast("date"))
    derived.pop(TARGET)
    counts = {c: S.to_number(F.col(c)) for c in FULL_NUMERIC if c not in derived}
    ready = filled.withColumns({**derived, **counts})
    usable = (
        F.col("month_dt").isNotNull() & F.col("remaining_lease_years").isNotNull() & F.col("storey_mid").isNotNull()
    )
    return ready.withColumn("predicted_price", F.when(usable, F.round(F.exp(model.log_price()), 2))).withColumn(
        "used_defaults", F.size("defaulted_raw_fields") > 0
    )
