"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in a seeded random order, form blocks. Target weights are whole numbers of slots of a period.
Block j of a source with share a of D slots in all is released at floor(j * D / a) and due at ceil((j + 1) * D / a);
in each slot the released block with the earliest deadline goes next. As shares add up to D, the schedule repeats
after D slots, so it is found for one period and every block of any number of periods gets its slot in closed form.
At every slot each source is less than one block from its share.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh
from .ranking import ranked

BLOCK_DOCS = 8
# Slots of one period, about, where weights are rounded to whole slots; no more sources than this are taken.
SLOTS = 1000
# Explicit weights whose ratios are whole numbers that add up to at most this are met as they are.
EXACT_SLOTS = 10_000
# Without explicit weights: shares of documents to this power, which lifts small sources.
TEMPERATURE = 0.9
# Epochs of a row that one array holds.
EPOCHS_AT_ONCE = 4096
SEED = "mix-1"
BUCKET_DIGITS = 3
# Columns that tell where a row is placed.
PLACING = ("slot", "block", "epoch", "release", "deadline")


def source_key(source: Column) -> Column:
    """Tells a null source from an empty one."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("none"))


def ratios(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """The weights as whole numbers in the same ratios, and what a weight of 1 is then."""
    exact = {name: Fraction(str(value)) for name, value in weights.items()}
    if any(value < 0 for value in exact.values()):
        raise ValueError("weights may not be negative")
    unit = math.lcm(*(value.denominator for value in exact.values()))
    numbers = {name: int(value * unit) for name, value in exact.items()}
    common = math.gcd(unit, *numbers.values())
    return {name: n // common for name, n in numbers.items()}, unit // common


def plan(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a source: key, blocks, share, period (slots), times (slot of each of its blocks in a period), length.

    length is the slot count of the whole mix: until every source's last block was placed once. A source that
    `weights` does not name has weight 1; one with weight 0 has no row. The tables here have one row a source.
    """
    sizes = docs.groupBy(source_key(F.col("source")).alias("key")).agg(F.count("*").alias("docs"))
    weight, whole = F.pow(F.col("docs").cast("double"), F.lit(TEMPERATURE)), F.lit(None).cast("long")
    if weights is not None:
        numbers, rest = ratios(weights)
        weight = F.lit(float(rest))
        for name, value in numbers.items():
            weight = F.when(F.col("key") == "=" + name, F.lit(float(value))).otherwise(weight)
        whole = F.when(weight <= EXACT_SLOTS, weight).cast("long")
    sizes = sizes.select(
        "key", F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"), weight.alias("weight"), whole.alias("whole"))
    one = sizes.limit(SLOTS + 1).agg(F.sort_array(F.collect_list(F.struct("key", "blocks", "weight", "whole"))).alias("s"))
    one = one.filter(F.assert_true(F.size("s") <= SLOTS, F.lit(f"more than {SLOTS} sources")).isNull())
    if weights is not None:
        unknown = F.array_except(F.array(*(F.lit("=" + name) for name in weights)).cast("array<string>"), F.expr("transform(s, x -> x.key)"))
        one = one.filter(F.assert_true(
            (F.size("s") == 0) | (F.size(unknown) == 0), F.concat(F.lit("no such sources: "), F.concat_ws(" ", unknown))).isNull())
        some = F.expr("size(s) = 0 or exists(s, x -> x.weight > 0)")
        one = one.filter(F.assert_true(some, F.lit("all sources have weight 0")).isNull())
    one = one.withColumn("s", F.expr("filter(s, x -> x.weight > 0)"))
    one = one.withColumn("total", F.expr("aggregate(s, 0D, (t, x) -> t + x.weight)"))
    one = one.withColumn("share", F.expr(
        f"transform(s, x -> cast(if(total <= {EXACT_SLOTS} and forall(s, y -> y.whole is not null), x.whole,"
        f" greatest(1, round({SLOTS} * x.weight / total))) as int))"))
    one = one.withColumn("period", F.expr("aggregate(share, 0, (t, x) -> t + x)"))
    # In each slot: among the released blocks, the earliest deadline, then the first source.
    one = one.withColumn("turns", F.expr("""
        aggregate(sequence(0, period - 1),
          struct(transform(share, x -> 0) as done, cast(array() as array<int>) as turns),
          (state, t) -> struct(
            transform(state.done, (n, i) -> n + if(i = cast(array_min(transform(share, (a, k) ->
              if(state.done[k] < a and (state.done[k] * bigint(period)) div a <= t,
                 (((state.done[k] + 1) * bigint(period) + a - 1) div a) * size(share) + k, null))) % size(share) as int), 1, 0)) as done,
            concat(state.turns, array(cast(array_min(transform(share, (a, k) ->
              if(state.done[k] < a and (state.done[k] * bigint(period)) div a <= t,
                 (((state.done[k] + 1) * bigint(period) + a - 1) div a) * size(share) + k, null))) % size(share) as int))) as turns),
          state -> state.turns)"""))
    rows = one.select("period", "turns", "share", F.posexplode("s").alias("place", "of")).filter("period > 0").select(
        "period", F.col("of.key").alias("key"), F.col("of.blocks").alias("blocks"), F.expr("share[place]").alias("share"),
        F.expr("filter(sequence(0, period - 1), t -> turns[t] = place)").alias("times"))
    last = F.expr("((blocks - 1) div share) * period + times[cast((blocks - 1) % share as int)] + 1")
    table = rows.withColumn("last", last)
    whole = table.agg(F.collect_list(F.struct("key", "blocks", "share", "period", "times")).alias("s"), F.max("last").alias("length"))
    return whole.select("length", F.explode("s").alias("of")).select("of.*", "length")


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of `docs` placed in the mix, with slot, block, epoch, release and deadline (long) of each placing.

    Every row of a source that has a weight is placed at least once; sources that run out before the largest is
    through start again, as often as it takes to fill their slots. Rows of sources with weight 0 are left out. Weights
    that are negative (at once), of names that no source has, or all 0, and more than SLOTS sources (when run) are
    errors. Weights in ratios of whole numbers that add up to EXACT_SLOTS or less are met exactly; others, and those
    taken from the sizes without `weights`, are rounded to 1/SLOTS first and are one slot of the period at least. A
    null source is a source of its own; null ids and repeated rows are placed like any other. Columns of `docs` that
    are called like the new ones are replaced. An empty table gives no rows, whatever the weights.
    """
    docs = docs.drop(*PLACING)
    names = {n: fresh(n, docs.columns) for n in ("key", "code", "rank", "blocks", "share", "period", "times", "length", "epochs")}
    key, code, rank = (names[n] for n in ("key", "code", "rank"))
    rows = docs.withColumn(key, source_key(F.col("source"))).withColumn(
        code, F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col(code), F.col("doc_id")] + ([F.xxhash64("text")] if "text" in docs.columns else [])
    rows = ranked(rows, [key], F.substring(F.col(code), 1, BUCKET_DIGITS), order, rank)
    # At most SLOTS rows, which `plan` sees to, with one number for each slot of the period.
    table = F.broadcast(plan(docs, weights).select(*(F.col(n).alias(names[n]) for n in ("key", "blocks", "share", "period", "times", "length"))))
    # No turn is placed before its release, which bounds the turns of a source by its share of the length. A document
    # of a tiny source may have very many, so they are written out in two steps, each in short arrays.
    last = f"(({names['length']} * {names['share']}) div {names['period']}) div {names['blocks']}"
    placed = rows.join(table, key).withColumn(names["epochs"], F.expr(f"explode(sequence(0L, {last} div {EPOCHS_AT_ONCE}))"))
    start = f"{names['epochs']} * {EPOCHS_AT_ONCE}"
    placed = placed.withColumn("epoch", F.expr(f"explode(sequence({start}, least({last}, {start} + {EPOCHS_AT_ONCE - 1})))"))
    turn = f"(cast({rank} div {BLOCK_DOCS} as bigint) + epoch * {names['blocks']})"
    share, period = names["share"], names["period"]
    placed = placed.withColumn("slot", F.expr(
        f"({turn} div {share}) * {period} + {names['times']}[cast({turn} % {share} as int)]").cast("long"))
    placed = placed.filter(F.col("slot") < F.col(names["length"]))
    return placed.withColumns({
        "block": F.expr(f"{rank} div {BLOCK_DOCS}"), "release": F.expr(f"({turn} * {period}) div {share}"),
        "deadline": F.expr(f"(({turn} + 1) * {period} + {share} - 1) div {share}"),
    }).select(*docs.columns, *PLACING)


SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce('=' || source, 'none') AS key,
   md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
 sizes AS (SELECT key, CAST(ceil(count(*) / {BLOCK_DOCS}) AS BIGINT) AS blocks, pow(CAST(count(*) AS DOUBLE), {TEMPERATURE}) AS weight FROM docs GROUP BY key),
 shares AS (SELECT key, blocks, greatest(1, CAST(round({SLOTS} * weight / (SELECT sum(weight) FROM sizes)) AS BIGINT)) AS share,
   row_number() OVER (ORDER BY key) AS k FROM sizes),
 one AS (SELECT list(share ORDER BY k) AS a, CAST(sum(share) AS BIGINT) AS d, count(*) AS s FROM shares),
 edf(t, done, pick) AS (
   SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN a], CAST(0 AS BIGINT) FROM one
   UNION ALL
   SELECT t + 1, [CASE WHEN k = p THEN done[k] + 1 ELSE done[k] END FOR k IN range(1, s + 1)], p FROM (
     SELECT edf.t, edf.done, one.s, list_min([CASE WHEN done[k] < a[k] AND done[k] * d // a[k] <= t + 1
       THEN (((done[k] + 1) * d + a[k] - 1) // a[k]) * s + k - 1 END FOR k IN range(1, s + 1)]) % s + 1 AS p
     FROM edf, one WHERE t + 1 < d)),
 times AS (SELECT pick AS k, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf WHERE t >= 0),
 mixlen AS (SELECT max(((blocks - 1) // share) * d + t + 1) AS length FROM shares JOIN times USING (k), one WHERE j = (blocks - 1) % share),
 ranked AS (SELECT doc_id, source, key, (row_number() OVER (PARTITION BY key ORDER BY code, doc_id) - 1) // {BLOCK_DOCS} AS block FROM docs),
 turns AS (SELECT doc_id, source, share, k, block, e AS epoch, block + e * blocks AS g
   FROM (SELECT *, unnest(range((length * share // d) // blocks + 1)) AS e FROM ranked JOIN shares USING (key), one, mixlen))
SELECT doc_id, source, (g // share) * d + t AS slot, block, epoch, g * d // share AS release, ((g + 1) * d + share - 1) // share AS deadline
FROM turns JOIN times ON times.k = turns.k AND times.j = turns.g % turns.share, one, mixlen WHERE (g // share) * d + t < length
"""
