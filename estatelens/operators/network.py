"""Shortest walking distances over an edge table, by rounds of joins.

Streets are mostly chains of nodes with two neighbours. Those chains are contracted first, by pointers that double
their reach every round, so a chain of n nodes takes log(n) rounds and then is one edge. Distances spread over what is
left: each round joins only the nodes that came nearer with the edges, which lie bucketed by their start, and the
result with the state, which lies bucketed by label and node; neither is shuffled again. Improvements are kept apart and
merged into the state before they outgrow it. Nodes inside chains take their distance from the two ends at last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import bucket_order, bucketed, discard, discard_table, materialize

# Rounds whose improvements are kept apart at most before they are merged into the state.
MERGE_EVERY = 8


def contract(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`edges` (src, dst, length) without the chain nodes, and (node, start, length) into every chain node.

    A chain node has exactly two neighbours, the same ones in both directions, and is not in `kept` (node). Roads run
    between the other nodes; the entries of a chain node are its distances from the two ends of its chain. Closed
    rings without any other node are left out: nothing leads there. Both tables are materialised, roads in buckets of src.
    """
    arcs = materialize(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("length").alias("length")))
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("a"), F.max("src").alias("b"))
    chain = materialize(
        out.where("n = 2").join(into.where("n = 2"), ["node", "a", "b"]).select("node", "a", "b").join(kept.select("node").distinct(), "node", "left_anti")
    )
    # An arc out of a chain node follows the arc into that node from its other neighbour, `before` -> src.
    other = F.when(F.col("dst") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    arcs_before = arcs.join(chain.withColumnRenamed("node", "src"), "src", "left").select(
        "src", "dst", "length", F.col("src").alias("start"), F.when(F.col("a").isNotNull(), other).alias("before"), F.col("src").alias("via")
    )
    state, left = materialize(arcs_before), None
    done = [state.where("before is null")]
    open_, reach = state.where("before is not null"), state
    tables = [state]
    while True:
        now = open_.count()
        if not now or now == left:
            break
        left = now
        ahead = reach.select(
            F.col("src").alias("before"), F.col("dst").alias("via"), F.col("start").alias("far"), F.col("length").alias("more"),
            F.col("before").alias("next"), F.col("via").alias("next_via"),
        )
        step = materialize(open_.join(ahead, ["before", "via"]).select(
            "src", "dst", (F.col("length") + F.col("more")).alias("length"), F.col("far").alias("start"), F.col("next").alias("before"), F.col("next_via").alias("via")
        ))
        tables.append(step)
        done.append(step.where("before is null"))
        open_ = step.where("before is not null")
        # Arcs that are through stay as they are; the others reach twice as far as before.
        reach = step
        for finished in done[:-1]:
            reach = reach.unionByName(finished)
    through = done[0]
    for part in done[1:]:
        through = through.unionByName(part)
    inner = chain.select(F.col("node").alias("dst"))
    roads = through.join(inner, "dst", "left_anti").where("start <> dst")
    roads = bucketed(roads.groupBy(F.col("start").alias("src"), "dst").agg(F.min("length").alias("length")), ["src"])
    entries = materialize(through.join(inner, "dst").select(F.col("dst").alias("node"), "start", "length"))
    discard(arcs, chain, *tables)
    return roads, entries


def spread(edges: DataFrame, seeds: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Least distance from the seeds of each label to every node reached.

    `edges` has (src, dst, length), one row per direction, lengths not negative; `seeds` has (label, node, source_id).
    Returns label, node, dist and the source_id it is reached from, the lowest on equal distance. Seeds without
    source_id give rows without it, which are cheaper to find. Nothing beyond `cutoff` is kept.
    """
    named = [c for c in seeds.columns if c == "source_id"]
    seeds = materialize(seeds.groupBy("label", "node").agg(*[F.min(c).alias(c) for c in named]) if named else seeds.select("label", "node").distinct())
    roads, entries = contract(edges, seeds)
    reached = _spread(roads, seeds, cutoff)
    inner = reached.join(entries.select(F.col("node").alias("inner"), F.col("start").alias("node"), "length"), "node").select(
        "label", F.col("inner").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), *named
    )
    if cutoff is not None:
        inner = inner.where(F.col("dist") <= cutoff)
    found = materialize(reached.unionByName(_nearest(inner)))
    discard(seeds, entries, reached)
    discard_table(roads)
    return found


def _way(df: DataFrame) -> Column:
    """What is least on the best way to a node. A plain distance is aggregated by hashing, a struct by sorting."""
    return F.struct("dist", "source_id") if "source_id" in df.columns else F.col("dist")


def _unpacked(best: DataFrame, named: bool) -> DataFrame:
    return best.select("label", "node", "way.dist", "way.source_id") if named else best.select("label", "node", F.col("way").alias("dist"))


def _nearest(steps: DataFrame) -> DataFrame:
    best = steps.groupBy("label", "node").agg(F.min(_way(steps)).alias("way"))
    return _unpacked(best, "source_id" in steps.columns)


def _spread(roads: DataFrame, seeds: DataFrame, cutoff: float | None) -> DataFrame:
    """Rounds over contracted roads until nothing comes nearer; the result is materialised."""
    start = seeds.withColumn("dist", F.lit(0.0)).select("label", "node", "dist", *[c for c in seeds.columns if c == "source_id"])
    state, changes = bucketed(start, ["label", "node"]), []
    fresh, merged_already, held, apart = state, [], state.count(), 0
    while True:
        fresh = _relax(roads, state, changes, fresh, cutoff)
        discard(*merged_already)
        nearer, merged_already = fresh.count(), []
        if not nearer:
            discard(fresh)
            break
        changes.append(fresh)
        apart += nearer
        # Each round shuffles what is kept apart, so that must stay small beside the state, which none shuffles.
        if len(changes) == MERGE_EVERY or apart >= held:
            merged = bucketed(_merged(state, changes), ["label", "node"])
            discard_table(state)
            # The last round is still to be expanded.
            discard(*changes[:-1])
            state, changes, merged_already = merged, [], [fresh]
            held, apart = merged.count(), 0
    found = materialize(_merged(state, changes))
    discard(*changes)
    discard_table(state)
    return found


def _merged(state: DataFrame, changes: list[DataFrame]) -> DataFrame:
    for part in changes:
        state = state.unionByName(part)
    return _nearest(state)


def _relax(roads: DataFrame, state: DataFrame, changes: list[DataFrame], fresh: DataFrame, cutoff: float | None) -> DataFrame:
    """What comes nearer by one more road from the nodes of `fresh`; materialised."""
    named = [c for c in fresh.columns if c == "source_id"]
    steps = fresh.join(roads, F.col("node") == F.col("src")).select(
        "label", F.col("dst").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), *named
    )
    if cutoff is not None:
        steps = steps.where(F.col("dist") <= cutoff)
    # Steps and what is kept apart meet in one aggregation, not in one each and a join.
    rows = steps.select("label", "node", _way(steps).alias("way"))
    if changes:
        unknown = F.lit(None).cast(rows.schema["way"].dataType)
        rows = rows.withColumn("old", unknown)
        for part in changes:
            rows = rows.unionByName(part.select("label", "node", unknown.alias("way"), _way(part).alias("old")))
        best = rows.groupBy("label", "node").agg(F.min("way").alias("way"), F.min("old").alias("old"))
        best = best.where("old IS NULL OR way < old").drop("old")
    else:
        best = rows.groupBy("label", "node").agg(F.min("way").alias("way"))
    best = best.where("way IS NOT NULL")
    old = state.select("label", "node", _way(state).alias("old"))
    best = best.join(old, ["label", "node"], "left").where("old IS NULL OR way < old").drop("old")
    with bucket_order(fresh.sparkSession):
        return materialize(_unpacked(best, bool(named)))


def nearest_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, dist, source_id): the source nearest to each reachable node."""
    seeds = sources.select(F.lit(0).alias("label"), "node", "source_id")
    return spread(edges, seeds).drop("label")


def nearest_by_network(points: DataFrame, reached: DataFrame, straight: DataFrame, detour: float = 1.0) -> DataFrame:
    """Network distance of each point's node, else its straight-line nearest times the detour.

    `points` has (origin_id, node); `straight` comes from `nearest_k`.
    """
    near = straight.select("origin_id", F.col("target_id").alias("near_id"), F.col("distance").alias("near_m"))
    return points.select("origin_id", "node").join(reached, "node", "left").join(near, "origin_id", "left").select(
        "origin_id",
        F.coalesce("source_id", "near_id").alias("source_id"),
        F.coalesce(F.col("dist"), F.col("near_m") * detour).alias("walking_distance_m"),
        F.col("dist").isNotNull().alias("routed"),
    )


def sources_within(points: DataFrame, edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """Number of source points within the cutoff of each point; sources sharing a node count each."""
    per_node = sources.groupBy("node").agg(F.count("*").alias("sources_here"))
    seeds = per_node.select(F.col("node").alias("label"), "node")
    reach = spread(edges, seeds, cutoff).join(
        per_node.select(F.col("node").alias("label"), "sources_here"), "label"
    )
    counts = reach.groupBy("node").agg(F.sum("sources_here").alias("n"))
    return points.select("origin_id", "node").join(counts, "node", "left").select(
        "origin_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def lines_within_cutoff(points: DataFrame, edges: DataFrame, exits: DataFrame, cutoff: float) -> DataFrame:
    """Distinct lines over stations with an exit within the cutoff.

    `exits` has (station, node, lines): a station may have several exits, and all its
    lines count once any exit is in reach.
    """
    # Numbers go through the rounds in place of names, whose first letters are often equal.
    numbers = materialize(exits.select("station").distinct().withColumn("label", F.monotonically_increasing_id()))
    seeds = exits.join(numbers, "station").select("label", "node")
    lines = exits.join(numbers, "station").select("label", F.explode("lines").alias("line")).distinct()
    # Dealt by node before there is a row for each line, where `lines` is small enough to be sent to all tasks.
    at_node = spread(edges, seeds, cutoff).repartition("node").join(lines, "label").select("node", "line").distinct()
    counts = at_node.groupBy("node").agg(F.count("*").alias("n"))
    return points.select("origin_id", "node").join(counts, "node", "left").select(
        "origin_id", F.coalesce("n", F.lit(0)).cast("long").alias("unique_lines")
    )
