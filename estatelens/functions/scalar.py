"""Column expressions for cleaning and deriving sale, school and station attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what counts as a plain number in text columns.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# Accepted spellings of "true", in the narrow and the wide reading.
TRUE_WORDS = ("true", "1", "yes")
TRUE_WORDS_WIDE = ("1", "true", "yes", "y", "good")


def to_number(c: Column) -> Column:
    """Text or number to double; anything unreadable becomes null.

    The type test is folded away by the optimizer, so numbers are not read as text.
    """
    text = c.cast("string")
    parsed = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.typeof(c) == "string", parsed).otherwise(c.try_cast("double"))


def parse_month(c: Column) -> Column:
    """`YYYY-MM` text to the first day of that month; other text becomes null."""
    text = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}$"), c)
    return F.try_to_timestamp(text, F.lit("yyyy-MM")).cast("date")


def month_text(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def months_between_starts(month: Column, start: Column) -> Column:
    """Whole months from `start` to `month`."""
    return (F.year(month) - F.year(start)) * 12 + F.month(month) - F.month(start)


def remaining_lease_years(c: Column) -> Column:
    """'61 years 04 months' to 61.33; text without either unit gives 0, null stays null."""
    text = F.lower(F.trim(c))

    def unit(name: str) -> Column:
        return F.coalesce(F.regexp_extract(text, rf"(\d+)\s+{name}", 1).try_cast("int"), F.lit(0))

    return F.when(c.isNotNull(), unit("year") + unit("month") / F.lit(12.0))


def storey_mid(c: Column) -> Column:
    """Mean of the first two whole numbers in the text, or the only one."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    first = F.get(numbers, F.lit(0)).try_cast("double")
    second = F.get(numbers, F.lit(1)).try_cast("double")
    return F.when(F.size(numbers) >= 2, (first + second) / 2).when(F.size(numbers) == 1, first)


def log_distance(c: Column) -> Column:
    """Natural log of a distance in metres, with distances under 1 m taken as 1 m."""
    metres = to_number(c)
    return F.when(metres.isNotNull(), F.log(F.greatest(metres, F.lit(1.0))))


def lease_age_years(month: Column, lease_start: Column) -> Column:
    return F.year(month) - to_number(lease_start)


def good_school_indicator(count: Column) -> Column:
    return F.coalesce((to_number(count) > 0).cast("int"), F.lit(0))


def log_price(price: Column) -> Column:
    """Natural log; null where the price is missing or not positive."""
    value = to_number(price)
    return F.when(value > 0, F.log(value))


def address_key(town: Column, block: Column, street: Column) -> Column:
    """`town|block|street`, trimmed; null when a part is missing."""
    parts = [F.trim(c) for c in (town, block, street)]
    return F.when(
        town.isNotNull() & block.isNotNull() & street.isNotNull(), F.concat_ws("|", *parts)
    )


def join_key(name: Column) -> Column:
    """School name reduced to upper-case letters and digits, without a final PRIMARY."""
    squeezed = F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")
    return F.regexp_replace(squeezed, "PRIMARY$", "")


def parse_ratio(c: Column) -> Column:
    """'a/v' to struct(applicants, vacancies, ratio); null unless v is positive."""
    pattern = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    applicants = F.regexp_extract(c, pattern, 1).try_cast("long")
    vacancies = F.regexp_extract(c, pattern, 2).try_cast("long")
    return F.when(
        vacancies > 0,
        F.struct(
            applicants.alias("applicants"),
            vacancies.alias("vacancies"),
            (applicants / vacancies).alias("ratio"),
        ),
    )


def station_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.upper(c)), r"\s+", " ")


def full_station_name(name: Column, transport: Column) -> Column:
    return F.concat_ws(" ", station_name(name), station_name(transport), F.lit("STATION"))


def parse_lines(c: Column) -> Column:
    """Line list from JSON, from Python-style list text, or from comma-separated text."""
    trimmed = F.trim(c)
    as_json = F.from_json(F.when(trimmed.startswith("["), trimmed), "array<string>")
    unbracketed = F.when(trimmed.rlike(r"^\[.*\]$"), F.regexp_replace(trimmed, r"[\[\]'\"]", "")).otherwise(trimmed)
    items = F.coalesce(as_json, F.split(unbracketed, ","), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def normalise_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def is_true(c: Column) -> Column:
    """Wider reading of truth: more words, and any non-zero number."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin(*TRUE_WORDS_WIDE) | (to_number(text) != 0), F.lit(False))


def fill_count(c: Column) -> Column:
    return F.coalesce(to_number(c).cast("int"), F.lit(0))


def tier_label(good: Column) -> Column:
    return F.when(good, "Good").otherwise("Normal")


def split_label(is_test: Column) -> Column:
    return F.when(is_test, "test").otherwise("train")


def premium_pct(coef: Column) -> Column:
    """Log-point effect to a relative change."""
    return F.exp(coef) - 1


def triangular_weight(distance: Column, bandwidth: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(distance) / bandwidth)


def first_present(columns: list[str], candidates: list[str]) -> str:
    """The first candidate name among `columns`, ignoring case."""
    by_lower = {name.lower(): name for name in columns}
    for name in candidates:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    raise ValueError(f"none of {candidates} is a column")


def present(columns: list[str], wanted: list[str]) -> list[str]:
    """Those of `wanted` that exist, in the given order."""
    have = set(columns)
    return [name for name in wanted if name in have]
