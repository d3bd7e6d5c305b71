"""Normal equations of fitted models, in one pass over the rows: what a check in SQL can tell about a fit of any size."""

from pyspark.sql import DataFrame, functions as F

from ..scratch import materialize


def term(name, value):
    """One entry of a row of a design; `name` is a text or a column, null where the row has no such term."""
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("term"), value.cast("double").alias("value"))


def dummy(column: str):
    return term(F.format_string(f"C({column})[T.%s]", F.col(column)), F.lit(1.0))


def coefficient_maps(keys: list[str], coefficients: DataFrame) -> DataFrame:
    """(keys, parts, coefs): the coefficients of each fit as maps by term, in a map of about as many parts as a part has terms."""
    known = coefficients.where(F.col("term").isNotNull()).select(*keys, "term", F.struct("coef").alias("c"))
    sizes = known.groupBy(*keys).agg(F.ceil(F.sqrt(F.count("*"))).alias("parts"))
    known = known.join(sizes, keys) if keys else known.crossJoin(sizes)
    parts = known.groupBy(*keys, "parts", _part(F.col("term"), F.col("parts")).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("term", "c"))).alias("m"))
    return materialize(parts.groupBy(*keys, "parts").agg(F.map_from_entries(F.collect_list(F.struct("part", "m"))).alias("coefs")))


def _part(name, parts):
    return F.pmod(F.xxhash64(name), parts)


def cross_products(rows: DataFrame, keys: list[str], coefficients: DataFrame) -> DataFrame:
    """(keys, term, cross): sum of w * value * (y - fitted) over the rows of each fit and term that is in it.

    `rows` has the keys of a fit, y, w and x, an array of `term`; `coefficients` has keys, term and coef. Terms of a
    row without a coefficient count as 0, as first levels do. Each row meets the coefficients of its fit as one row, so
    its terms are never shuffled; only sums are.
    """
    coefs = coefficient_maps(keys, coefficients)
    rows = rows.select(*keys, "y", "w", "x")
    rows = rows.join(coefs, keys) if keys else rows.crossJoin(coefs)
    known = F.transform("x", lambda e: F.struct(
        e["term"].alias("term"), e["value"].alias("value"),
        F.try_element_at(F.try_element_at("coefs", _part(e["term"], F.col("parts"))), e["term"]).alias("c"),
    ))
    rows = rows.select(*keys, "y", "w", F.filter(known, lambda e: e["c"].isNotNull()).alias("x"))
    fitted = F.aggregate("x", F.lit(0.0), lambda acc, e: acc + F.coalesce(e["c"]["coef"] * e["value"], F.lit(0.0)))
    # Worked out before the terms are taken apart, not once for each of them.
    residuals = rows.select(*keys, (F.col("w") * (F.col("y") - fitted)).alias("residual"), "x")
    return residuals.select(*keys, "residual", F.inline("x")).groupBy(*keys, "term").agg(
        F.sum(F.col("residual") * F.col("value")).alias("cross")
    )
