"""Coefficient tables of the boundary study: every term of every fit with its robust error.

The estimates come from the sums of cross products, the errors from a second pass that adds up the outer products of
the scores of each group (`gram.meat`). In the pooled fits the effect of each school is taken out inside its own sums
and put back at the end, one school at a time, so that the number of schools enters no solve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.tails import normal_two_sided
from ..scratch import discard, materialize
from .filters import contains_ci
from .gram import Design, Sums, chunk_sizes, gram, meat, solve, symmetric
from .models import TARGET, term_name
from .rdd import BANDWIDTHS, GOOD_JUMP, JUMP, SCHOOL, _design, local_rows, school_group, school_means, sweep_rows, within_schools

# Written as products of their columns in the tables.
TERM_NAMES = {
    "treat_running": "treat:running_km", "treat_good": "treat:good_school", "running_good": "running_km:good_school",
    "treat_running_good": "treat:running_km:good_school",
}
WEIGHT = "kernel_weight"
ESTIMATES = ["term", "coef", "std_err", "z", "p_value", "ci_low", "ci_high"]
ESTIMATES_SCHEMA = "term string, coef double, std_err double, z double, p_value double, ci_low double, ci_high double"
SOLUTION_SCHEMA = "specification string, terms array<int>, beta array<double>, centre array<double>, level double"
# 97.5 % point of the normal distribution.
REACH = 1.959963984540054


def used_terms(design: Design, weights: np.ndarray, controls: bool, jump: int) -> list[int]:
    """Terms of a fit: constant, jump, and with controls the others, of each category without its first level present."""
    if not controls:
        return list(range(1 + jump))
    index, at = list(range(1 + len(design.numeric))), 1 + len(design.numeric)
    for levels in design.categories.values():
        present = [k for k in range(at, at + len(levels)) if weights[k] > 0]
        index += present[1:]
        at += len(levels)
    return index


def estimate(name: str, coef: float, variance: float) -> tuple:
    """One row of a table; a term that the rows do not determine has no error."""
    se = math.sqrt(variance) if variance > 0 else float("nan")
    z = coef / se
    return name, coef, se, z, normal_two_sided(z), coef - REACH * se, coef + REACH * se


def name_of(design: Design, k: int) -> str:
    name, level = design.terms[k]
    return TERM_NAMES.get(name, name) if level is None else term_name(name, level)


def to_units(design: Design, terms: list[int]) -> np.ndarray:
    """Matrix that takes coefficients of centred and scaled columns back to the units of the columns."""
    back = np.eye(len(terms))
    for at, k in enumerate(terms):
        if 0 < k <= len(design.numeric):
            c = design.numeric[k - 1]
            back[at, at] = 1.0 / design.scale[c]
            if terms[0] == 0:
                back[0, at] = -design.shift[c] / design.scale[c]
    return back


def sweep_coefficients(df: DataFrame, bandwidths=BANDWIDTHS, min_total: int = 150, min_side: int = 40) -> DataFrame:
    """All terms of the fits of every school at every bandwidth, with and without controls.

    (boundary_school_name, school_group, bandwidth_m, specification, term, coef, std_err, z, p_value, ci_low, ci_high);
    HC1 errors, normal p-values and 95 % intervals. Categories are coded against their first level among the rows of
    the fit, as `C(name)[T.level]`.
    """
    keys = [*SCHOOL, "bandwidth_m"]
    inputs = sweep_rows(df, bandwidths, min_total, min_side)
    rows, design = materialize(inputs.rows), inputs.design
    cells = materialize(gram(rows, design, TARGET, WEIGHT, keys, inputs.sizes))
    key_schema = "boundary_school_name string, is_good_school boolean, bandwidth_m double, "

    def fits(sums: Sums) -> Iterator[tuple]:
        for name in ("uncontrolled", "controlled"):
            terms = used_terms(design, np.diag(sums.xx), name == "controlled", len(JUMP))
            yield name, terms, *solve(sums.take(terms))

    def solved(frame: pd.DataFrame) -> pd.DataFrame:
        key = [frame[c].iloc[0] for c in keys]
        out = [(*key, name, terms, beta.tolist(), [0.0] * len(terms), 0.0) for name, terms, beta, _, _ in fits(Sums.from_cells(frame))]
        return pd.DataFrame(out, columns=[*keys, "specification", "terms", "beta", "centre", "level"])

    solutions = materialize(cells.groupBy(*keys).applyInPandas(solved, key_schema + SOLUTION_SCHEMA))
    scores = materialize(meat(rows, design, TARGET, WEIGHT, keys, solutions, inputs.sizes))

    def tables(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        key, sums = [frame[c].iloc[0] for c in keys], Sums.from_cells(frame)
        for name, terms, beta, inverse, rank in fits(sums):
            middle = symmetric(outer[outer["specification"] == name])[:-1, :-1]
            back, free = to_units(design, terms), sums.n - rank
            half = back @ inverse
            variance = np.diag(half @ middle @ half.T) * (sums.n / free if free > 0 else float("nan"))
            beta = back @ beta
            beta[0] += design.y_shift
            out += [(*key, name, *estimate(name_of(design, k), float(b), float(v))) for k, b, v in zip(terms, beta, variance)]
        return pd.DataFrame(out, columns=[*keys, "specification", *ESTIMATES])

    found = cells.groupBy(*keys).cogroup(scores.groupBy(*keys)).applyInPandas(tables, key_schema + "specification string, " + ESTIMATES_SCHEMA)
    found = materialize(found.select(
        "boundary_school_name", school_group(F.col("is_good_school")).alias("school_group"), "bandwidth_m", "specification", *ESTIMATES
    ))
    discard(rows, cells, solutions, scores)
    return found


def interaction_coefficients(df: DataFrame, bandwidths=BANDWIDTHS) -> DataFrame:
    """All terms of the pooled fits: (bandwidth_m, specification, term, coef, std_err, z, p_value, ci_low, ci_high).

    School effects are coded against the first school with weight, whose level is the intercept.
    """
    keys = ["bandwidth_m", "boundary_school_name"]
    rows = materialize(local_rows(df, bandwidths))
    sizes = chunk_sizes(rows, keys)
    design = _design(rows, (*JUMP, *GOOD_JUMP))
    p = len(design.terms)
    cells = materialize(gram(rows, design, TARGET, WEIGHT, keys, sizes))
    means = materialize(school_means(cells))

    # p x p numbers for each bandwidth.
    fits = {}
    for h, frame in within_schools(cells, p).toPandas().groupby("bandwidth_m"):
        weights = frame.loc[frame["i"] == -6].set_index("j")["s"]
        schools = int(frame.loc[frame["i"] == -2, "s"].sum())
        sums = Sums.from_cells(frame.loc[frame["i"] >= -1])
        for name in ("uncontrolled", "controlled"):
            terms = used_terms(design, weights.reindex(range(p)).to_numpy(), name == "controlled", len(JUMP) + len(GOOD_JUMP))[1:]
            beta, inverse, rank = solve(sums.take([k - 1 for k in terms]))
            fits[h, name] = (terms, beta, inverse, sums.n, rank + schools)

    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for h, school, m in zip(frame["bandwidth_m"], frame["boundary_school_name"], frame["m"]):
                for name in ("uncontrolled", "controlled"):
                    terms, beta = fits[h, name][:2]
                    centre = np.asarray(m, float)[terms]
                    out.append((h, school, name, terms, beta.tolist(), centre.tolist(), float(m[p] - centre @ beta)))
            yield pd.DataFrame(out, columns=[*keys, "specification", "terms", "beta", "centre", "level"])

    solutions = materialize(means.mapInPandas(levels, "bandwidth_m double, boundary_school_name string, " + SOLUTION_SCHEMA))
    scores = materialize(meat(rows, design, TARGET, WEIGHT, keys, solutions, sizes))
    pooled = scores.groupBy("bandwidth_m", "specification", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    outer = {key: symmetric(frame)[:-1, :-1] for key, frame in pooled.groupby(["bandwidth_m", "specification"])}
    covariance = {}
    for key, (_, _, inverse, n, rank) in fits.items():
        covariance[key] = inverse @ outer[key] @ inverse

    # The last column of a school's sums: what its own rows add to the errors of its level and of the slopes.
    own = scores.join(scores.groupBy(*keys, "specification").agg(F.max("j").alias("last")), [*keys, "specification"]).where("j = last")
    own = own.groupBy(*keys, "specification").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("v"))
    effects = materialize(means.join(own, keys))
    first = effects.groupBy("bandwidth_m").agg(F.min("boundary_school_name").alias("boundary_school_name"))
    bases = {(r.bandwidth_m, r.specification): r for r in effects.join(first, keys).collect()}

    def zero(terms: list[int]) -> np.ndarray:
        """Where the columns themselves are 0, in centred and scaled units."""
        at = np.zeros(len(terms))
        for n, k in enumerate(terms):
            if k <= len(design.numeric):
                c = design.numeric[k - 1]
                at[n] = -design.shift[c] / design.scale[c]
        return at

    def school_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                key = r.bandwidth_m, r.specification
                terms, beta, inverse, n, rank = fits[key]
                cov, base, scale = covariance[key], bases[key], n / (n - rank) if n > rank else float("nan")

                def parts(row):
                    m, v = np.asarray(row.m, float), np.asarray(row.v, float)
                    d = m[terms] - zero(terms)
                    return m[p] - d @ beta, d, v[:-1] @ inverse / row.w, v[-1] / row.w ** 2

                level, d, cross, lone = parts(r)
                spread = lone - 2 * cross @ d + d @ cov @ d
                if r.boundary_school_name == base.boundary_school_name:
                    out.append((*key, *estimate("Intercept", float(level + design.y_shift), float(spread * scale))))
                    continue
                level_0, d_0, cross_0, lone_0 = parts(base)
                spread += lone_0 - 2 * cross_0 @ d_0 + d_0 @ cov @ d_0 - 2 * (d @ cov @ d_0 - cross @ d_0 - cross_0 @ d)
                out.append((*key, *estimate(term_name("boundary_school_name", r.boundary_school_name), float(level - level_0), float(spread * scale))))
            yield pd.DataFrame(out, columns=["bandwidth_m", "specification", *ESTIMATES])

    schema = "bandwidth_m double, specification string, " + ESTIMATES_SCHEMA
    schools = effects.mapInPandas(school_rows, schema)
    slopes = []
    for key, (terms, beta, _, n, rank) in fits.items():
        back = to_units(design, terms)
        variance = np.diag(back @ covariance[key] @ back.T) * (n / (n - rank) if n > rank else float("nan"))
        slopes += [(*map(_plain, key), *estimate(name_of(design, k), float(b), float(v))) for k, b, v in zip(terms, back @ beta, variance)]
    found = materialize(schools.unionByName(df.sparkSession.createDataFrame(slopes, schema)))
    discard(rows, cells, means, solutions, scores, effects)
    return found


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def filter_coefficients(
    table: DataFrame, school_name: str | None = None, group: str | None = None, specification: str | None = None,
    bandwidth_m: float | None = None, term: str | None = None,
) -> DataFrame:
    """Rows of a coefficient table by parts of school and term names, and by group, specification and bandwidth.

    Texts match regardless of case; what is not given does not restrict.
    """
    if school_name:
        table = table.where(contains_ci("boundary_school_name", school_name))
    if group:
        table = table.where(F.lower("school_group") == group.lower())
    if specification:
        table = table.where(F.lower("specification") == specification.lower())
    if bandwidth_m is not None:
        table = table.where(F.col("bandwidth_m") == bandwidth_m)
    return table.where(contains_ci("term", term)) if term else table
