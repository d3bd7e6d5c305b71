"""Row filters over sales and result tables, composed into one predicate per call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import to_number

TEXT_FILTERS = ("town", "flat_type", "flat_model", "street_name", "block", "storey_range")
RANGE_FILTERS = ("floor_area_sqm", "lease_commence_date", "resale_price")


def in_ci(column: str, values: list[str]) -> Column:
    return F.upper(F.col(column)).isin([v.upper() for v in values])


def month_in(values: list[str]) -> Column:
    return F.col("month").isin(list(values))


def month_range(start: str | None = None, end: str | None = None) -> Column:
    """Months compared as text, both ends inclusive."""
    tests = []
    if start:
        tests.append(F.col("month") >= start)
    if end:
        tests.append(F.col("month") <= end)
    return all_of(tests)


def number_range(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive bounds on a column read as a number; 0 is a bound like any other."""
    value = to_number(F.col(column))
    tests = []
    if low is not None:
        tests.append(value >= low)
    if high is not None:
        tests.append(value <= high)
    return all_of(tests)


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def sale_predicate(columns: list[str], **given) -> Column:
    """One predicate from the given sale filters.

    Text filters take lists, `month` a list, `month_from` / `month_to` text, and
    `min_X` / `max_X` numbers. Filters left out, empty, or on absent columns are ignored.
    """
    have = set(columns)
    tests: list[Column] = []
    for column in TEXT_FILTERS:
        if given.get(column) and column in have:
            tests.append(in_ci(column, given[column]))
    if "month" in have:
        if given.get("month"):
            tests.append(month_in(given["month"]))
        tests.append(month_range(given.get("month_from"), given.get("month_to")))
    for column in RANGE_FILTERS:
        if column in have:
            tests.append(number_range(column, given.get(f"min_{column}"), given.get(f"max_{column}")))
    return all_of(tests)


def filter_sales(df: DataFrame, **given) -> DataFrame:
    return df.where(sale_predicate(df.columns, **given))


def contains_ci(column: str, text: str, regex: bool = False) -> Column:
    """Case-blind search in a text column; literal unless `regex` is set. Null never matches."""
    c = F.col(column)
    hit = c.rlike("(?i)" + text) if regex else F.upper(c).contains(text.upper())
    return F.coalesce(hit, F.lit(False))


def lookup_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.lower(F.col(column)) == value.lower())


def filter_results(df: DataFrame, *, group=None, specification=None, bandwidth=None, school=None) -> DataFrame:
    """Boundary-study result rows by school group, specification, bandwidth and school text."""
    tests = []
    if group:
        tests.append(F.lower("school_group") == group.lower())
    if specification:
        tests.append(F.lower("specification") == specification.lower())
    if bandwidth is not None:
        tests.append(F.col("bandwidth_m") == bandwidth)
    if school:
        tests.append(contains_ci("boundary_school_name", school))
    return df.where(all_of(tests))


def significant(p_column: str, low: float | None = None, high: float | None = None, alpha: float | None = None) -> Column:
    """p-value strictly under `alpha`, and within [low, high] when those are given."""
    tests = [number_range(p_column, low, high)]
    if alpha is not None:
        tests.append(F.col(p_column) < alpha)
    return all_of(tests)


def primary_level(df: DataFrame, level: str, latitude: str, longitude: str) -> DataFrame:
    """Schools whose level text mentions PRIMARY and that have coordinates."""
    return df.where(
        F.upper(F.col(level)).contains("PRIMARY")
        & to_number(F.col(latitude)).isNotNull()
        & to_number(F.col(longitude)).isNotNull()
    )


def explode_bandwidths(df: DataFrame, distance: str, bandwidths: list[float]) -> DataFrame:
    """One copy of each row per bandwidth that its distance falls within."""
    wide = F.filter(
        F.array(*[F.lit(float(h)) for h in bandwidths]), lambda h: F.abs(F.col(distance)) <= h
    )
    return df.withColumn("bandwidth_m", F.explode(wide))


def route_by_threshold(groups: DataFrame, enough: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Split a table of group counts into groups to fit and groups skipped with a reason."""
    ok = F.coalesce(enough, F.lit(False))
    return groups.where(ok), groups.where(~ok).withColumn("reason", F.lit(reason))
