"""Column expressions that take labelled values out of HTML text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Class names of the status dots on ballot cards and the texts they stand for.
STATUS = (
    ("moe-vacancies-ballot-card--dot-active-in-phase-green", "All applicants were successful"),
    ("moe-vacancies-ballot-card--dot-active-in-phase-red", "There were more applicants than vacancies"),
    ("VacanciesBallot_triangle__3pm5V", "No registration was conducted"),
)
PHASES = ("1", "2A", "2B", "2C", "2C_sup")
CARD_PHASE = "moe-vacancies-ballot-card__phase"
MISSING = "N/A"


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]*>", ""))


def description_field(description: Column, name: str) -> Column:
    """Text of the cell after the header cell `name`; null when absent or empty."""
    cell = F.regexp_extract(description, rf"<th>{re.escape(name)}</th>\s*<td>(.*?)</td>", 1)
    value = F.trim(F.regexp_replace(F.regexp_replace(cell, "<.*?>", ""), r"\\/", "/"))
    return F.when(value != "", value)


def label_value(html: Column, label: str) -> Column:
    """Text of the data element that follows the title element with this label, before the next title."""
    pattern = (
        rf"(?s)class=\"[^\"]*info-title[^\"]*\"[^>]*>\s*{re.escape(label)}\s*</[^>]+>(?:(?!info-title).)*?"
        r"class=\"[^\"]*info-data[^\"]*\"[^>]*>([^<]*)<"
    )
    value = F.trim(F.regexp_extract(html, pattern, 1))
    return F.when(value != "", value)


def tag_texts(html: Column, tag: str) -> Column:
    """Texts of every element of one tag, inner tags stripped."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))
    return F.transform(found, strip_tags)


def attribute_values(html: Column, tag: str, attribute: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf'<{tag} [^>]*{attribute}="([^"]*)"'), F.lit(1))


def status_text(dot_class: Column) -> Column:
    """Status named by a dot class; other text stays, nothing becomes N/A."""
    out = F.when(F.coalesce(F.trim(dot_class), F.lit("")) == "", MISSING)
    for name, text in STATUS:
        out = out.when(dot_class.contains(name), text)
    return out.otherwise(F.trim(dot_class))


def ratio_text(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.trim(a), F.lit("/"), F.trim(b))).otherwise(MISSING)


def ballot_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per card: name, vacancies and per phase status, ratio, balloting and its ratio."""
    card = F.col(html)
    pieces = F.split(card, rf'class="[^"]*{CARD_PHASE}[ "]')
    head = F.get(pieces, F.lit(0))
    out = [
        F.col(key),
        F.coalesce(F.get(tag_texts(head, "h3"), F.lit(0)), F.lit("")).alias("name"),
        F.trim(
            F.regexp_extract(card, r'(?s)ballot-card__total-vacancies[^>]*>.*?<p[^>]*>([^<]*)<', 1)
        ).alias("vacancies"),
    ]
    for i, phase in enumerate(PHASES, start=1):
        part = F.get(pieces, F.lit(i))
        if phase == "1":
            text = F.array_join(F.coalesce(tag_texts(part, "p"), F.array().cast("array<string>")), " ")
            out.append(F.when(part.isNull(), MISSING).otherwise(status_text(text)).alias("phase_1"))
            continue
        dot = F.regexp_extract(part, r'<h4[^>]*class="([^"]*)"', 1)
        status = F.when(part.isNull(), MISSING).otherwise(status_text(dot))
        ratio = F.when(part.isNotNull(), ratio_text(label_value(part, "Applicants"), label_value(part, "Vacancies")))
        drawn = F.trim(F.regexp_extract(part, r'(?s)ballot-card__balloting[^>]*>.*?<span[^>]*>([^<]*)<', 1))
        balloting = F.when(F.coalesce(drawn, F.lit("")) == "", MISSING).otherwise(drawn)
        ballot_ratio = F.when(
            balloting == "Yes",
            ratio_text(label_value(part, "Balloting applicants"), label_value(part, "Vacancies for ballot")),
        ).otherwise(MISSING)
        shown = F.coalesce(ratio, F.lit(MISSING))
        if phase == "2C_sup":
            shown = F.when(status == STATUS[2][1], MISSING).otherwise(shown)
        out += [
            status.alias(f"phase_{phase.lower()}"), shown.alias(f"phase_{phase.lower()}_ratio"),
            balloting.alias(f"phase_{phase.lower()}_balloting"), ballot_ratio.alias(f"phase_{phase.lower()}_balloting_ratio"),
        ]
    return pages.select(*out)
