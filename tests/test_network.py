import heapq
import os

import numpy as np
from pyspark.sql import functions as F

from estatelens.operators import network as N


def shortest(edges, seeds, cutoff=None):
    out, heap = {}, [(0.0, s, n) for n, s in seeds]
    heapq.heapify(heap)
    while heap:
        d, s, n = heapq.heappop(heap)
        if n in out or (cutoff is not None and d > cutoff):
            continue
        out[n] = (d, s)
        for m, w in edges.get(n, ()):
            heapq.heappush(heap, (d + w, s, m))
    return out


def graph(seed=4, n=90):
    rng = np.random.default_rng(seed)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (170, 2)) if a != b}
    pairs |= {(0, int(b)) for b in range(1, 30)}  # one busy junction
    rows = [(a, b, float(rng.integers(50, 400))) for a, b in pairs]
    rows += [(b, a, w) for a, b, w in rows]
    adjacent = {}
    for a, b, w in rows:
        adjacent.setdefault(a, []).append((b, w))
    return rows, adjacent


def test_nearest_source(spark):
    rows, adjacent = graph()
    e = spark.createDataFrame(rows, "src long, dst long, length double")
    seeds = [(5, 1), (17, 2), (17, 3), (63, 4)]
    s = spark.createDataFrame(seeds, "node long, source_id long")
    got = {r.node: (r.dist, r.source_id) for r in N.nearest_source(e, s).collect()}
    assert got == shortest(adjacent, seeds)


def both_ways(rows):
    return rows + [(b, a, w) for a, b, w in rows]


def adjacency(rows):
    out = {}
    for a, b, w in rows:
        out.setdefault(a, []).append((b, w))
    return out


def test_chains_rings_and_tails(spark):
    # A long chain between two junctions, a dead end, a chain from a junction back to itself, a ring that nothing
    # leads to, seeds inside a chain, parallel edges, a loop, and a stretch with other lengths each way.
    rows = [(k, k + 1, float(k % 7 + 1)) for k in range(300)] + [(0, 1000, 5.0), (0, 1001, 5.0), (300, 1002, 2.0), (300, 1003, 2.0)]
    rows += [(300, 2000, 1.0), (2000, 2001, 1.0), (2001, 2002, 1.0), (2002, 300, 9.0)]
    rows += [(k, 3000 + (k + 1) % 5, 1.0) for k in range(3000, 3005)] + [(0, 300, 2000.0), (0, 300, 1500.0), (7, 7, 1.0)]
    rows = both_ways(rows) + [(4000, 1002, 3.0), (1002, 4000, 8.0), (4001, 4000, 1.0), (4000, 4001, 6.0)]
    e = spark.createDataFrame(rows, "src long, dst long, length double")
    seeds = [(1000, 1), (150, 2), (5000, 3)]
    s = spark.createDataFrame(seeds, "node long, source_id long")
    for cutoff in (None, 130.0):
        labelled = s.select(F.lit(0).alias("label"), "node", "source_id")
        got = {r.node: (r.dist, r.source_id) for r in N.spread(e, labelled, cutoff).collect()}
        assert got == shortest(adjacency(rows), seeds, cutoff)


def test_long_chain_ends_in_a_few_rounds(spark, monkeypatch):
    relax, rounds = N._relax, []
    monkeypatch.setattr(N, "_relax", lambda *a: rounds.append(1) or relax(*a))
    n = 10_000
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2.0).alias("length"))
    e = e.union(e.select("dst", "src", "length"))
    s = spark.createDataFrame([(0, 1)], "node long, source_id long")
    got = N.nearest_source(e, s)
    assert got.count() == n + 1 and got.where("dist <> 2.0 * node").isEmpty()
    assert len(rounds) <= 3


def test_state_stays_bucketed_and_old_states_go(spark, monkeypatch):
    monkeypatch.setattr(N, "MERGE_EVERY", 2)
    plans, relax = [], N._relax

    def seen(roads, state, changes, fresh, cutoff):
        steps = fresh.join(roads, F.col("node") == F.col("src")).groupBy("label", F.col("dst").alias("node")).agg(F.min("dist").alias("d"))
        plans.append(steps.join(state, ["label", "node"], "left")._jdf.queryExecution().executedPlan().toString())
        return relax(roads, state, changes, fresh, cutoff)

    monkeypatch.setattr(N, "_relax", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, adjacent = graph(6)
        e = spark.createDataFrame(rows, "src long, dst long, length double")
        s = spark.createDataFrame([(5, 1), (17, 2)], "node long, source_id long")
        out = N.nearest_source(e, s)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Fresh rows and steps are dealt out; roads and state are not.
    assert len(plans) > 3 and all(p.count("Exchange hashpartitioning") <= 2 for p in plans)
    folders = {f.rpartition("/")[0] for f in out.inputFiles()}
    assert len(folders) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("estatelens_")]
    around = folders.pop().removeprefix("file:").rpartition("/")[0]
    known = set(os.listdir(around))
    N.nearest_source(e, s)
    assert len(set(os.listdir(around)) - known) == 1


def test_counts_within_cutoff(spark):
    rows, adjacent = graph(5)
    e = spark.createDataFrame(rows, "src long, dst long, length double")
    seeds = [(5, 1), (17, 2), (17, 3), (63, 4), (500, 5)]
    s = spark.createDataFrame(seeds, "node long, source_id long")
    p = spark.range(95).select(F.col("id").alias("origin_id"), F.col("id").alias("node"))
    got = {r.origin_id: r.n for r in N.sources_within(p, e, s, 500.0).collect()}
    want = {i: sum(i in shortest(adjacent, [(n, k)], 500.0) for n, k in seeds) for i in range(95)}
    assert got == want
    exits = spark.createDataFrame(
        [("A", 5, ["red"]), ("A", 40, ["blue"]), ("B", 17, ["red"]), ("C", 63, ["green"])], "station string, node long, lines array<string>"
    )
    lines = {r.origin_id: r.unique_lines for r in N.lines_within_cutoff(p, e, exits, 500.0).collect()}
    of = {"A": ([5, 40], {"red", "blue"}), "B": ([17], {"red"}), "C": ([63], {"green"})}
    for i in range(95):
        near = set()
        for nodes, names in of.values():
            if i in shortest(adjacent, [(n, 0) for n in nodes], 500.0):
                near |= names
        assert lines[i] == len(near)


def test_distances_without_a_source_are_hashed(spark, monkeypatch):
    rows, adjacent = graph(8)
    e = spark.createDataFrame(rows, "src long, dst long, length double")
    seeds = [(1, 5), (1, 17), (2, 63), (2, 400)]
    plans, write = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    got = {(r.label, r.node): r.dist for r in N.spread(e, spark.createDataFrame(seeds, "label long, node long"), 900.0).collect()}
    want = {}
    for label in (1, 2):
        reached = shortest(adjacent, [(n, 0) for k, n in seeds if k == label], 900.0)
        want |= {(label, node): d for node, (d, _) in reached.items()}
    assert got == want
    # Sorting (label, node) for each aggregation of each round was most of the time.
    assert not any("SortAggregate" in p for p in plans)


def test_improvements_kept_apart_stay_smaller_than_the_state(spark, monkeypatch):
    sizes, relax = [], N._relax
    monkeypatch.setattr(N, "_relax", lambda *a: sizes.append((a[1].count(), sum(c.count() for c in a[2]))) or relax(*a))
    rows, _ = graph(9)
    e = spark.createDataFrame(rows, "src long, dst long, length double")
    N.nearest_source(e, spark.createDataFrame([(5, 1)], "node long, source_id long"))
    assert len(sizes) > 3 and all(apart < held for held, apart in sizes)


def test_buckets_have_one_file(spark):
    from estatelens.scratch import bucketed, discard_table

    table = bucketed(spark.range(5000).withColumn("k", F.col("id") % 700).repartition(5), ["k"])
    assert len(table.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    discard_table(table)
