"""Boundary regression discontinuity: local-linear fits per school, and a pooled comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import scalar as S
from ..functions.tails import normal_two_sided
from ..scratch import materialize
from .filters import explode_bandwidths, route_by_threshold
from .gram import Design, Sums, as_chunks, chunk_sizes, gram, make_design, residual_sum, score_sums, solve, total_sum
from .models import STRUCTURE, TARGET
from .quantiles import summarize

BANDWIDTHS = (100, 200, 300, 500)
CONTROL_FIELDS = ("town", "flat_type", "flat_model", "month_period")
JUMP = ("treat", "running_km", "treat_running")
GOOD_JUMP = ("treat_good", "running_good", "treat_running_good")
SCHOOL = ["boundary_school_name", "is_good_school"]


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability."""
    return z.map(normal_two_sided)


def rdd_features(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The study's own columns of a sale; rows without key, month or usable price are dropped."""
    month = S.parse_month(F.col("month"))
    derived = {
        "lease_age_years": S.lease_age_years(month, F.col("lease_commence_date")),
        "remaining_lease_years": S.remaining_lease_years(F.col("remaining_lease")),
        "storey_mid": S.storey_mid(F.col("storey_range")),
        "floor_area_sqm": S.to_number(F.col("floor_area_sqm")),
    }
    return df.select(
        *keep, "address_key", "month", month.alias("month_dt"), S.month_text(month).alias("month_period"),
        "town", "flat_type", "flat_model", S.to_number(F.col("resale_price")).alias("resale_price"),
        S.log_price(F.col("resale_price")).alias(TARGET), *[derived[c].alias(c) for c in STRUCTURE],
    ).dropna(subset=["address_key", "month_dt", "resale_price", TARGET])


def boundary_sales(sales: DataFrame, distances: DataFrame) -> DataFrame:
    """Sales joined to every boundary near their address, complete for the controls."""
    return sales.join(distances, "address_key").dropna(subset=[TARGET, *STRUCTURE, "signed_distance_m"])


def local_rows(df: DataFrame, bandwidths=BANDWIDTHS) -> DataFrame:
    """One row per sale, boundary and bandwidth it lies within, with regressors and kernel weight."""
    d = F.col("signed_distance_m")
    treat = (d <= 0).cast("double")
    good = F.col("is_good_school").cast("double")
    km = d / 1000
    return explode_bandwidths(df, "signed_distance_m", list(bandwidths)).withColumns({
        "treat": treat, "running_km": km, "treat_running": treat * km,
        "treat_good": treat * good, "running_good": km * good, "treat_running_good": treat * km * good,
        "kernel_weight": S.triangular_weight(d, F.col("bandwidth_m")),
    })


def _design(rows: DataFrame, jump: tuple[str, ...]):
    """Controls are centred and scaled; the jump terms stay in their units."""
    design = make_design(rows, [*jump, *STRUCTURE], list(CONTROL_FIELDS), TARGET)
    return replace(
        design,
        shift={**design.shift, **{c: 0.0 for c in jump}},
        scale={**design.scale, **{c: 1.0 for c in jump}},
    )


def boundary_groups(df: DataFrame, local: DataFrame, bandwidths=BANDWIDTHS) -> DataFrame:
    """Rows inside, outside and in total for every school and bandwidth, zeros included."""
    counts = local.groupBy(*SCHOOL, "bandwidth_m").agg(
        F.count("*").alias("sample_size"), F.sum((F.col("signed_distance_m") <= 0).cast("long")).alias("inside_n")
    )
    wanted = df.where(F.col(SCHOOL[0]).isNotNull()).select(*SCHOOL).distinct().withColumn(
        "bandwidth_m", F.explode(F.array(*[F.lit(float(h)) for h in bandwidths]))
    )
    zero = F.lit(0).cast("long")
    return wanted.join(counts, [*SCHOOL, "bandwidth_m"], "left").select(
        *SCHOOL, "bandwidth_m",
        F.coalesce("sample_size", zero).alias("sample_size"),
        F.coalesce("inside_n", zero).alias("inside_n"),
        (F.coalesce("sample_size", zero) - F.coalesce("inside_n", zero)).alias("outside_n"),
    )


def school_group(good: Column) -> Column:
    return F.when(good, "good").otherwise("non_good")


def premium_columns(coef: Column, se: Column) -> dict[str, Column]:
    return {
        "cutoff_premium_pct": S.premium_pct(coef),
        "cutoff_ci_low_pct": S.premium_pct(coef - 1.96 * se),
        "cutoff_ci_high_pct": S.premium_pct(coef + 1.96 * se),
    }


@dataclass
class SweepRows:
    """The local rows of all fits of a sweep with their group sizes and design, and the groups left out."""

    rows: DataFrame
    fit: DataFrame
    skipped: DataFrame
    sizes: DataFrame
    design: Design


def sweep_rows(df: DataFrame, bandwidths, min_total: int, min_side: int) -> SweepRows:
    keys = [*SCHOOL, "bandwidth_m"]
    local = materialize(local_rows(df, bandwidths))
    groups = materialize(boundary_groups(df, local, bandwidths))
    enough = (
        (F.col("sample_size") >= min_total) & (F.col("inside_n") >= min_side) & (F.col("outside_n") >= min_side)
    )
    fit, skipped = route_by_threshold(groups, enough, "insufficient_boundary_sample")
    rows = local.join(fit.select(*keys), keys, "left_semi")
    return SweepRows(rows, fit, skipped, as_chunks(fit, keys, "sample_size"), _design(rows, JUMP))


def rdd_sweep(
    df: DataFrame, bandwidths=BANDWIDTHS, min_total: int = 150, min_side: int = 40
) -> tuple[DataFrame, DataFrame]:
    """Fit every school at every bandwidth, with and without controls: (results, skipped).

    Triangular weights, HC1 errors, normal p-values. All fits share two grouped
    passes over the local rows: one for the sums, one for the robust errors.
    """
    keys = [*SCHOOL, "bandwidth_m"]
    inputs = sweep_rows(df, bandwidths, min_total, min_side)
    rows, fit, skipped, sizes, design = inputs.rows, inputs.fit, inputs.skipped, inputs.sizes, inputs.design
    parts = {"uncontrolled": list(range(1 + len(JUMP))), "controlled": list(range(len(design.terms)))}

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        sums = Sums.from_cells(frame)
        out = []
        for name, index in parts.items():
            part = sums.take(index)
            beta, inverse, rank = solve(part)
            full, row = np.zeros(len(design.terms)), np.zeros(len(design.terms))
            full[index], row[index] = beta, inverse[1]
            r2 = 1 - residual_sum(part, beta) / total_sum(part)
            out.append((*[frame[c].iloc[0] for c in keys], name, sums.n, rank, float(beta[1]), r2,
                        full.tolist(), [row.tolist()], [0.0] * len(full), 0.0))
        return pd.DataFrame(out, columns=[*keys, *_SOLVED])

    schema = "boundary_school_name string, is_good_school boolean, bandwidth_m double, " + _SOLVED_SCHEMA
    fits = materialize(
        gram(rows, design, TARGET, "kernel_weight", keys, sizes).groupBy(*keys).applyInPandas(solved, schema)
    )
    scores = score_sums(
        rows, design, TARGET, "kernel_weight", keys,
        fits.select(*keys, "specification", "beta", "picked", "centre", "level"), sizes,
    )
    prices = summarize(rows, keys, "resale_price", {"median": 0.5}).select(
        *keys, F.col("mean").alias("local_mean_resale_price"), F.col("median").alias("local_median_resale_price")
    )
    free = F.col("n") - F.col("rank")
    se = F.when(free > 0, F.sqrt(F.col("s") * F.col("n") / free))
    coef = F.col("coef")
    results = (
        fits.join(scores.where(F.col("k") == 0), [*keys, "specification"]).join(prices, keys).join(fit, keys)
        .withColumn("se", se)
        .select(
            "boundary_school_name", school_group(F.col("is_good_school")).alias("school_group"), "bandwidth_m",
            "specification", "sample_size", "inside_n", "outside_n",
            coef.alias("cutoff_coef_log_points"), F.col("se").alias("cutoff_std_err"),
            normal_p(coef / F.col("se")).alias("cutoff_p_value"),
            *[c.alias(name) for name, c in premium_columns(coef, F.col("se")).items()],
            (S.premium_pct(coef) * F.col("local_mean_resale_price")).alias("cutoff_price_jump_sgd_at_local_mean_price"),
            (S.premium_pct(coef) * F.col("local_median_resale_price")).alias("cutoff_price_jump_sgd_at_local_median_price"),
            "local_mean_resale_price", "local_median_resale_price", "r_squared",
        )
        .orderBy("boundary_school_name", "bandwidth_m", "specification")
    )
    skipped = skipped.select(
        "boundary_school_name", school_group(F.col("is_good_school")).alias("school_group"), "bandwidth_m",
        "sample_size", "inside_n", "outside_n", "reason",
    ).orderBy("boundary_school_name", "bandwidth_m")
    return results, skipped


_SOLVED = ["specification", "n", "rank", "coef", "r_squared", "beta", "picked", "centre", "level"]
_SOLVED_SCHEMA = (
    "specification string, n long, rank int, coef double, r_squared double, beta array<double>, "
    "picked array<array<double>>, centre array<double>, level double"
)


def within_schools(cells: DataFrame, p: int) -> DataFrame:
    """Sums about each school's own means, added over the schools of a bandwidth: rows (bandwidth_m, i, j, s).

    `cells` are the sums of p terms by bandwidth and school. i, j count the terms after the constant, then y. Rows
    with i = -1 hold the number of rows, -2 that of schools, -3 to -5 the raw sums of weights, y and y squared, and -6
    the weight of each term j.
    """
    def within(frame: pd.DataFrame) -> pd.DataFrame:
        sums = Sums.from_cells(frame)
        if sums.xx[0, 0] <= 0:
            c = Sums(sums.n, np.zeros((p - 1, p - 1)), np.zeros(p - 1), 0.0)
        else:
            c = sums.centred()
        m = np.zeros((p, p))
        m[:-1, :-1], m[:-1, -1], m[-1, -1] = c.xx, c.xy, c.yy
        i, j = np.triu_indices(p)
        extra = [(-1, 0, sums.n), (-2, 0, 1.0), (-3, 0, sums.xx[0, 0]), (-4, 0, sums.xy[0]), (-5, 0, sums.yy)]
        extra += [(-6, k, w) for k, w in enumerate(np.diag(sums.xx))]
        out = pd.DataFrame({"i": i, "j": j, "s": m[i, j]})
        out = pd.concat([out, pd.DataFrame(extra, columns=["i", "j", "s"])], ignore_index=True)
        out.insert(0, "bandwidth_m", frame["bandwidth_m"].iloc[0])
        return out

    return (
        cells.groupBy("bandwidth_m", "boundary_school_name").applyInPandas(within, "bandwidth_m double, i int, j int, s double")
        .groupBy("bandwidth_m", "i", "j").agg(F.sum("s").alias("s"))
    )


def school_means(cells: DataFrame) -> DataFrame:
    """(bandwidth_m, boundary_school_name, w, m): weight and weighted means of the terms, then y, of each school."""
    by_school = cells.where(F.col("i") == 0).groupBy("bandwidth_m", "boundary_school_name").agg(
        F.max(F.when(F.col("j") == 0, F.col("s"))).alias("w"),
        F.array_sort(F.collect_list(F.struct("j", "s"))).alias("v"),
    ).where(F.col("w") > 0)
    return by_school.select(
        "bandwidth_m", "boundary_school_name", "w", F.transform("v", lambda e: e["s"] / F.col("w")).alias("m")
    )


def rdd_interaction(df: DataFrame, bandwidths=BANDWIDTHS) -> DataFrame:
    """Pooled fits per bandwidth: the jump at other schools and its difference at good schools.

    School effects are taken out within each school's sums, so their number never
    enters the size of the solve.
    """
    keys = ["bandwidth_m", "boundary_school_name"]
    rows = materialize(local_rows(df, bandwidths))
    sizes = chunk_sizes(rows, keys)
    design = _design(rows, (*JUMP, *GOOD_JUMP))
    p = len(design.terms)
    jump = list(range(1 + len(JUMP) + len(GOOD_JUMP)))
    parts = {"uncontrolled": jump, "controlled": list(range(p))}
    picked = [1, 1 + len(JUMP)]
    cells = materialize(gram(rows, design, TARGET, "kernel_weight", keys, sizes))

    pooled = within_schools(cells, p)

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        extra = frame.loc[frame["i"] < -1].set_index("i")["s"]
        sums = Sums.from_cells(frame.loc[frame["i"] >= -1])
        total = extra[-5] - extra[-4] ** 2 / extra[-3]
        out = []
        for name, index in parts.items():
            at = [k - 1 for k in index if k]
            part = sums.take(at)
            beta, inverse, rank = solve(part)
            full, chosen = np.zeros(p), np.zeros((2, p))
            full[[k for k in index if k]] = beta
            for r, k in enumerate(picked):
                chosen[r, [q for q in index if q]] = inverse[at.index(k - 1)]
            out.append((frame["bandwidth_m"].iloc[0], name, sums.n, rank + int(extra[-2]),
                        float(full[picked[0]]), float(full[picked[1]]),
                        1 - residual_sum(part, beta) / total, full.tolist(), chosen.tolist()))
        return pd.DataFrame(out, columns=["bandwidth_m", "specification", "n", "rank", "base", "diff", "r_squared", "beta", "picked"])

    fits = materialize(pooled.groupBy("bandwidth_m").applyInPandas(
        solved,
        "bandwidth_m double, specification string, n long, rank int, base double, diff double, r_squared double, "
        "beta array<double>, picked array<array<double>>",
    ))
    means = school_means(cells).drop("w")
    fitted = F.aggregate(
        F.arrays_zip(F.slice("m", 1, p).alias("a"), F.col("beta").alias("b")), F.lit(0.0),
        lambda acc, e: acc + e["a"] * e["b"],
    )
    solutions = means.join(fits.select("bandwidth_m", "specification", "beta", "picked"), "bandwidth_m").select(
        *keys, "specification", "beta", "picked", F.slice("m", 1, p).alias("centre"),
        (F.get("m", F.lit(p)) - fitted).alias("level"),
    )
    scores = score_sums(rows, design, TARGET, "kernel_weight", keys, solutions, sizes).groupBy(
        "bandwidth_m", "specification"
    ).agg(F.sum(F.when(F.col("k") == 0, F.col("s"))).alias("s0"), F.sum(F.when(F.col("k") == 1, F.col("s"))).alias("s1"))
    good = F.col("is_good_school").cast("long")
    facts = rows.groupBy("bandwidth_m").agg(
        F.count("*").alias("sample_size"), F.sum(good).alias("n_good_rows"), F.sum(1 - good).alias("n_non_good_rows"),
        F.avg("resale_price").alias("local_mean_resale_price"),
    )
    free = F.col("n") - F.col("rank")
    base, diff = F.col("base"), F.col("diff")
    return (
        fits.join(scores, ["bandwidth_m", "specification"]).join(facts, "bandwidth_m")
        .withColumn("se0", F.when(free > 0, F.sqrt(F.col("s0") * F.col("n") / free)))
        .withColumn("se1", F.when(free > 0, F.sqrt(F.col("s1") * F.col("n") / free)))
        .select(
            "bandwidth_m", "specification", "sample_size", "n_good_rows", "n_non_good_rows",
            base.alias("non_good_cutoff_coef_log_points"), F.col("se0").alias("non_good_cutoff_std_err"),
            S.premium_pct(base).alias("non_good_cutoff_premium_pct"),
            diff.alias("good_school_diff_coef_log_points"), F.col("se1").alias("good_school_diff_std_err"),
            normal_p(diff / F.col("se1")).alias("good_school_diff_p_value"),
            S.premium_pct(diff).alias("good_school_diff_premium_pct"),
            (S.premium_pct(diff) * F.col("local_mean_resale_price")).alias("good_school_diff_sgd_at_local_mean_price"),
            S.premium_pct(base + diff).alias("good_school_total_cutoff_premium_pct"),
            "local_mean_resale_price", "r_squared",
        )
        .orderBy("bandwidth_m", "specification")
    )


def rdd_summary(sales: DataFrame, schools: DataFrame, near: DataFrame, results: DataFrame) -> DataFrame:
    """One row of sizes: addresses, sales, schools by group, joined rows, schools with results."""
    good = F.col("is_good_school")
    one = sales.agg(
        F.countDistinct("address_key").alias("transactions_with_geocoded_addresses"),
        F.count("*").alias("transaction_rows_used"),
    )
    s = schools.agg(
        F.count("*").alias("a"), F.sum(good.cast("long")).alias("b"), F.sum((~good).cast("long")).alias("c")
    )
    return one.withColumns({
        "school_buffers_total": s.select("a").scalar(),
        "school_buffers_good": s.select("b").scalar(),
        "school_buffers_non_good": s.select("c").scalar(),
        "school_specific_rows_used": near.select(F.count("*")).scalar(),
        "school_specific_schools_with_results": results.select(F.countDistinct("boundary_school_name")).scalar(),
    })


def mean_premium(flats: DataFrame, key: str, names: str, premiums: DataFrame) -> DataFrame:
    """Mean premium over a comma list of school names; null where none is known.

    `premiums` has (boundary_school_name, cutoff_premium_pct); the names of a flat
    match regardless of case and outer blanks.
    """
    listed = flats.select(key, F.explode(F.split(F.col(names), ",")).alias("n"))
    lookup = premiums.where(F.col("cutoff_premium_pct").isNotNull()).select(
        F.upper(F.trim("boundary_school_name")).alias("k"), "cutoff_premium_pct"
    )
    found = listed.join(lookup, F.upper(F.trim("n")) == F.col("k")).groupBy(key).agg(
        F.avg("cutoff_premium_pct").alias("school_rdd_premium_pct")
    )
    return flats.join(found, key, "left")


def premium_attribution(flats: DataFrame, key: str, names: str, results: DataFrame, bandwidth: float = 100) -> DataFrame:
    """Money premium of each flat from its good schools' controlled estimates at one bandwidth."""
    picked = results.where(
        (F.lower(F.trim("specification")) == "controlled") & (F.col("bandwidth_m") == bandwidth)
    ).select("boundary_school_name", "cutoff_premium_pct")
    out = mean_premium(flats, key, names, picked)
    price = F.col("predicted_resale_price") * F.col("school_rdd_premium_pct")
    return out.withColumn("premium_price", price).withColumn("has_flat_premium", price.isNotNull())
