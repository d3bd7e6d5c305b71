"""Linear models with categories of any number of levels, whose effects are taken out instead of solved for.

Rows with the same levels form one cell, and only cells are worked on: their weights and mean columns. The effects of
each category in turn, with the constant, are set to what the others leave, by level, until nothing moves (block
coordinate descent; one category takes two rounds). What is then left of the numeric columns and y gives the p x p system of
the numeric columns alone, the same as that of a design with an indicator for every level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tails import student_quantile_975, student_two_sided
from ..scratch import discard, materialize
from .gram import Design, Sums, collect_sums, gram, residual_sum, solve
from .quantiles import join_null_safe

# Rounds end when no effect moves by more than this, in units of the scaled columns; without that they raise.
TOLERANCE, MOST_ROUNDS = 1e-9, 2_000


@dataclass
class Absorbed:
    """Sums of the numeric columns and y without the effects of `fields`, and what was taken out.

    `constant` and the columns e0, e1, ... of `effects[field]` (level, e0, ...) hold the effects on each numeric
    column, then on y.
    """

    design: Design
    fields: list[str]
    sums: Sums
    constant: np.ndarray
    effects: dict[str, DataFrame]
    cells: DataFrame

    def level_effects(self, beta: np.ndarray) -> DataFrame:
        """(field, level, effect) in the fit with coefficients `beta` of the scaled columns."""
        out = None
        for name, table in self.effects.items():
            effect = _combined(len(beta), beta)
            part = table.select(F.lit(name).alias("field"), F.col("level"), effect.alias("effect"))
            out = part if out is None else out.unionByName(part)
        return out

    def intercept(self, beta: np.ndarray) -> float:
        return float(self.constant[-1] - self.constant[:-1] @ beta) + self.design.y_shift


def _combined(p: int, beta: np.ndarray) -> Column:
    effect = F.col(f"e{p}")
    for k, b in enumerate(beta):
        effect = effect - F.col(f"e{k}") * F.lit(float(b))
    return effect


def absorb(df: DataFrame, design: Design, fields: list[str], y: str, weight: str | None = None, alpha: float = 0.0) -> Absorbed:
    """Take the effects of `fields` and a constant out of the numeric columns of `design` and y.

    `alpha` penalises the squared effects of levels, not the constant. A null level is a level. Raises
    ArithmeticError if the effects do not settle.
    """
    names = [*design.numeric, y]
    size, keys = len(names), [f"f{i}" for i in range(len(fields))]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    scaled = [(F.col(c) - design.shift.get(c, 0.0)) / design.scale.get(c, 1.0) for c in design.numeric] + [F.col(y) - design.y_shift]
    rows = df.select(*[F.col(c).cast("string").alias(k) for c, k in zip(fields, keys)], w.alias("w"), *[x.cast("double").alias(f"m{k}") for k, x in enumerate(scaled)])
    means = rows.groupBy(*keys).agg(F.sum("w").alias("w"), *[(F.sum(F.col("w") * F.col(f"m{k}")) / F.sum("w")).alias(f"m{k}") for k in range(size)])
    means = materialize(means.where("w > 0"))
    cells = materialize(means.select(*keys, "w", *[F.col(f"m{k}").alias(f"r{k}") for k in range(size)]))
    effects = {
        k: materialize(cells.groupBy(F.col(k).alias("level")).agg(F.sum("w").alias("n")).select("level", "n", *[F.lit(0.0).alias(f"e{i}") for i in range(size)]))
        for k in keys
    }
    constant, index = np.zeros(size), range(size)
    for _ in range(MOST_ROUNDS):
        moved, left, sums_of = 0.0, cells, []
        for key in keys:
            # What a level holds without its own effect and the constant: its rest s, plus both.
            sums = materialize(left.groupBy(F.col(key).alias("level")).agg(*[F.sum(F.col("w") * F.col(f"r{k}")).alias(f"s{k}") for k in index]))
            both = join_null_safe(effects[key], sums, ["level"])
            # The constant moves with the effects of this category; it is where their penalty is least.
            pull = F.col("n") * alpha / (F.col("n") + alpha) if alpha else F.col("n")
            level = [F.col(f"s{k}") / F.col("n") + F.col(f"e{k}") + float(constant[k]) for k in index]
            facts = both.agg(
                *[(F.sum(pull * level[k]) / F.sum(pull)).alias(f"c{k}") for k in index],
                F.max(F.greatest(F.lit(0.0), *[F.abs((F.col(f"s{k}") - alpha * F.col(f"e{k}")) / (F.col("n") + alpha)) for k in index])).alias("moved"),
            ).first()
            after = np.array([float(facts[f"c{k}"] or 0.0) for k in index])
            moved = max(moved, float(facts["moved"] or 0.0))
            new = [(level[k] - float(after[k])) * F.col("n") / (F.col("n") + alpha) for k in index]
            moves = both.select("level", "n", *[new[k].alias(f"e{k}") for k in index],
                                *[(new[k] + float(after[k]) - F.col(f"e{k}") - float(constant[k])).alias(f"d{k}") for k in index])
            left = join_null_safe(left, moves.select(F.col("level").alias(key), *[f"d{k}" for k in index]), [key]).select(
                *keys, "w", *[(F.col(f"r{k}") - F.col(f"d{k}")).alias(f"r{k}") for k in index])
            constant = after
            sums_of.append((key, sums, moves.drop(*[f"d{k}" for k in index])))
        if moved <= TOLERANCE:
            discard(*[sums for _, sums, _ in sums_of])
            break
        # One write a round; what it was made of goes.
        old = [cells, *effects.values(), *[sums for _, sums, _ in sums_of]]
        cells, effects = materialize(left), {key: materialize(table) for key, _, table in sums_of}
        discard(*old)
    else:
        raise ArithmeticError(f"effects of {fields} still move by {moved} after {MOST_ROUNDS} rounds")

    def products(table: DataFrame, prefix: str, own: str | None) -> Sums:
        plain = Design(tuple(f"{prefix}{k}" for k in range(size - 1)))
        return collect_sums(gram(table, plain, f"{prefix}{size - 1}", own))

    whole = collect_sums(gram(df, Design(design.numeric, {}, False, design.shift, design.scale, design.y_shift), y, weight))
    sums = whole - products(means, "m", "w") + products(cells, "r", "w")
    if alpha:
        for table in effects.values():
            own = products(table, "e", None)
            sums = sums + Sums(0, alpha * own.xx, alpha * own.xy, alpha * own.yy)
    sums.n = whole.n
    discard(means)
    return Absorbed(design, list(fields), sums.take(range(1, size)), constant, dict(zip(fields, effects.values())), cells)


def effect_rank(cells: DataFrame, keys: list[str]) -> int:
    """Rank of the indicators of all categories, the constant included.

    Exact for one or two categories: levels less connected parts. With more, each further one is counted against the
    first only, which can only overstate the rank.
    """
    rank = cells.select(keys[0]).distinct().count()
    for key in keys[1:]:
        pairs = materialize(cells.select(F.col(keys[0]).alias("a"), F.col(key).alias("b")).distinct())
        parts = materialize(pairs.select("a", F.coalesce(F.col("a"), F.lit("")).alias("part")).distinct())
        while True:
            near = join_null_safe(pairs, parts, ["a"]).groupBy("b").agg(F.min("part").alias("part"))
            after = join_null_safe(pairs, near, ["b"]).groupBy("a").agg(F.min("part").alias("next"))
            after = materialize(join_null_safe(after, parts, ["a"]))
            changed = not after.where("next <> part").isEmpty()
            discard(parts)
            parts = after.select("a", F.col("next").alias("part"))
            if not changed:
                break
        rank += pairs.select("b").distinct().count() - parts.select("part").distinct().count()
        discard(pairs, parts)
    return rank


def scaled_design(df: DataFrame, numeric: list[str], y: str) -> Design:
    stats = df.agg(
        F.avg(y).alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(numeric)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(numeric)]
    ).first()
    return Design(
        tuple(numeric), {}, False, {c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(numeric)},
        {c: float(stats[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(numeric)}, float(stats["y"] or 0.0),
    )


def ols_absorbed(df: DataFrame, numeric: list[str], fields: list[str], y: str) -> tuple[DataFrame, DataFrame]:
    """Least squares with all effects of `fields` taken out: (table, effects).

    The table has term, coef, std_err, t, p_value and 95 % interval of every numeric column, as in a fit with an
    indicator for every level; effects has field, level and effect, each category about the constant `Intercept`,
    which is the effects' row without field.
    """
    rows = df.dropna(subset=[*numeric, *fields, y])
    design = scaled_design(rows, list(numeric), y)
    found = absorb(rows, design, list(fields), y)
    beta, inverse, rank = solve(found.sums)
    free = found.sums.n - rank - effect_rank(found.cells, [f"f{i}" for i in range(len(fields))])
    variance = residual_sum(found.sums, beta) / free if free > 0 else float("nan")
    reach, out = student_quantile_975(free) if free > 0 else float("nan"), []
    for k, c in enumerate(design.numeric):
        b, s = beta[k] / design.scale[c], float(np.sqrt(inverse[k, k] * variance)) / design.scale[c]
        t = b / s if s > 0 else float("nan")
        p = float(student_two_sided(t, free)) if free > 0 else float("nan")
        out.append((c, float(b), s, float(t), p, float(b - reach * s), float(b + reach * s)))
    table = df.sparkSession.createDataFrame(
        out, "term string, coef double, std_err double, t double, p_value double, ci_low double, ci_high double"
    )
    at_zero = found.intercept(beta) - sum(beta[k] * design.shift[c] / design.scale[c] for k, c in enumerate(design.numeric))
    constant = df.sparkSession.createDataFrame([(None, "Intercept", float(at_zero))], "field string, level string, effect double")
    discard(found.cells)
    return table, constant.unionByName(found.level_effects(beta))


@dataclass
class WideModel:
    """A ridge fit whose level effects are a table (field, level, effect); an unseen level has no effect."""

    prep: object
    intercept: float
    numeric: dict[str, float]
    effects: DataFrame
    fields: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        out, price = df, F.lit(self.intercept)
        for c, b in self.numeric.items():
            price = price + self.prep.scaled(c) * F.lit(b)
        for i, c in enumerate(self.fields):
            own = self.effects.where(F.col("field") == c).select(F.col("level").alias(f"__l{i}"), F.col("effect").alias(f"__e{i}"))
            value = F.coalesce(F.col(c).cast("string"), F.lit(self.prep.modes.get(c)))
            out = out.join(own, value == F.col(f"__l{i}"), "left")
            price = price + F.coalesce(F.col(f"__e{i}"), F.lit(0.0))
        out = out.withColumn("predicted_log_price", price).drop(*[f"__{x}{i}" for i in range(len(self.fields)) for x in "le"])
        return out.withColumn("predicted_resale_price", F.exp("predicted_log_price"))

    def importance(self, spark, top: int = 100) -> DataFrame:
        own = spark.createDataFrame([(f"num__{c}", float(b)) for c, b in self.numeric.items()], "feature string, coefficient double")
        named = self.effects.select(F.concat(F.lit("cat__"), "field", F.lit("_"), "level").alias("feature"), F.col("effect").alias("coefficient"))
        rows = own.unionByName(named).withColumn("abs_coefficient", F.abs("coefficient"))
        return rows.orderBy(F.desc("abs_coefficient"), "feature").limit(top)


def ridge_absorbed(train: DataFrame, prep, fields: list[str], y: str, alpha: float, weight: str | None = None) -> WideModel:
    """Ridge with penalised levels and unpenalised constant on rows prepared by `prep`."""
    rows = prep.filled(train)
    mean = float(train.agg(F.avg(y)).first()[0])
    design = Design(tuple(prep.numeric), {}, False, prep.means, prep.scales, mean)
    found = absorb(rows, design, list(fields), y, weight, alpha)
    beta = np.linalg.solve(found.sums.xx + alpha * np.eye(len(design.numeric)), found.sums.xy)
    effects = materialize(found.level_effects(beta))
    discard(found.cells, *found.effects.values())
    return WideModel(prep, found.intercept(beta), dict(zip(design.numeric, map(float, beta))), effects, list(fields))
