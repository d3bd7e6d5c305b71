"""Demand ranking of schools from ballot ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import parse_ratio, tier_label
from .ordering import dense_index


def rank_schools(df: DataFrame, name: str, phases: list[str], top_n: int) -> DataFrame:
    """Rank schools by total applicants over total vacancies; the first `top_n` are good.

    Phases without a readable ratio do not count. Ties go to more applicants, then
    to the name. The rank is exact without sorting all schools in one task.
    """
    def total(field: str) -> Column:
        parts = [F.coalesce(parse_ratio(F.col(p))[field], F.lit(0)) for p in phases]
        return reduce(lambda a, b: a + b, parts)

    scored = (
        df.withColumn("applicants_total", total("applicants"))
        .withColumn("vacancies_total", total("vacancies"))
        .where(F.col("vacancies_total") > 0)
        .withColumn("overall_subscription_rates", F.col("applicants_total") / F.col("vacancies_total"))
        .withColumn("__s", -F.col("overall_subscription_rates"))
        .withColumn("__a", -F.col("applicants_total"))
    )
    ranked = dense_index(scored, ["__s", "__a", name], name="rank")
    return (
        ranked.drop("__s", "__a")
        .withColumn("is_good_school", F.col("rank") <= top_n)
        .withColumn("school_tier", tier_label(F.col("is_good_school")))
    )
