import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from estatelens.operators import spatial as G


def layers(seed):
    """Spread origins, and targets of which a third sit in one small spot and a sixth on one point."""
    rng = np.random.default_rng(seed)
    o = pd.DataFrame({"origin_id": range(120), "x": rng.uniform(0, 1000, 120), "y": rng.uniform(-300, 700, 120)})
    n = 600
    x, y = rng.uniform(0, 1000, n), rng.uniform(0, 500, n)
    x[:200], y[:200] = 800 + rng.uniform(0, 1, 200), 300 + rng.uniform(0, 1, 200)
    x[200:300], y[200:300] = 10.0, 10.0
    t = pd.DataFrame({"target_id": range(n), "kind": rng.integers(0, 2, n), "x": x, "y": y})
    t.loc[n] = [n, 9, 5000.0, 5000.0]
    return o, t.astype({"target_id": int, "kind": int})


def brute(o, t):
    m = o.merge(t, how="cross", suffixes=("", "_t"))
    m["d"] = np.hypot(m["x"] - m["x_t"], m["y"] - m["y_t"])
    return m


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_nearest_k(spark, k):
    o, t = layers(k)
    got = G.nearest_k(spark.createDataFrame(o), spark.createDataFrame(t), k).toPandas()
    m = brute(o, t).sort_values(["origin_id", "kind", "d", "target_id"])
    want = m.groupby(["origin_id", "kind"]).head(k)
    assert set(zip(got.origin_id, got.kind, got.target_id)) == set(zip(want.origin_id, want.kind, want.target_id))
    ranks = dict(zip(zip(want.origin_id, want.kind, want.target_id), want.groupby(["origin_id", "kind"]).cumcount() + 1))
    assert {(a, b, c): r for a, b, c, r in zip(got.origin_id, got.kind, got.target_id, got["rank"])} == ranks


@pytest.mark.parametrize("radius", [0.5, 120.0, 5000.0])
def test_count_within(spark, radius):
    o, t = layers(3)
    got = G.count_within(spark.createDataFrame(o), spark.createDataFrame(t), radius).toPandas()
    m = brute(o, t)
    want = m[m["d"] <= radius].groupby(["origin_id", "kind"]).size()
    assert {(a, b): n for a, b, n in zip(got.origin_id, got.kind, got.n)} == want.to_dict()


def test_empty_targets(spark):
    o, t = layers(1)
    none = spark.createDataFrame(t).where("kind > 50")
    assert G.nearest_k(spark.createDataFrame(o), none, 1).count() == 0
    assert G.radius_counts(spark.createDataFrame(o), none.drop("kind"), 10).agg(F.sum("n")).first()[0] == 0


# A U-shaped polygon with a hole, and a thin triangle.
U = [(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
THIN = [(20, 0), (20.5, 30), (21, 0), (20, 0)]


def ring_edges(poly, ring):
    return [(poly, i, *a, *b) for i, (a, b) in enumerate(zip(ring, ring[1:]))]


def shapes(spark):
    rows = ring_edges(1, U) + ring_edges(1, HOLE) + ring_edges(2, THIN)
    return spark.createDataFrame(
        [(p, i, *map(float, c)) for p, i, *c in rows], "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double"
    ), [r for r in rows]


def inside(rows, poly, px, py):
    odd = False
    for p, _, x1, y1, x2, y2 in rows:
        if p == poly and (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def outline(rows, poly, px, py):
    best = math.inf
    for p, _, x1, y1, x2, y2 in rows:
        if p == poly:
            dx, dy = x2 - x1, y2 - y1
            t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(px - x1 - t * dx, py - y1 - t * dy))
    return best


def test_concave_polygon_hole_and_boundary(spark):
    e, rows = shapes(spark)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate((x / 2, y / 2) for x in range(-4, 48) for y in range(-4, 62))]
    p = spark.createDataFrame(pts, "point_id int, x double, y double")
    within = {tuple(r) for r in G.point_in_polygon(p, e, "within").collect()}
    covers = {tuple(r) for r in G.point_in_polygon(p, e, "intersects").collect()}
    for i, x, y in pts:
        for poly in (1, 2):
            edge = outline(rows, poly, x, y) == 0
            assert ((i, poly) in within) == (inside(rows, poly, x, y) and not edge)
            assert ((i, poly) in covers) == (inside(rows, poly, x, y) or edge)
    assert G.point_in_polygon(p, e, "contains").count() == 0


def test_signed_band(spark):
    e, rows = shapes(spark)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(-6, 30) for y in range(-6, 36))]
    p = spark.createDataFrame(pts, "point_id int, x double, y double")
    got = {(r.point_id, r.poly_id): r.signed_distance_m for r in G.signed_band(p, e, 3.0).collect()}
    want = {}
    for i, x, y in pts:
        for poly in (1, 2):
            d = outline(rows, poly, x, y)
            if d <= 3.0:
                want[i, poly] = -d if inside(rows, poly, x, y) or d == 0 else d
    assert got == pytest.approx(want)


def test_polygons_within_counts_containment(spark):
    small = spark.createDataFrame([(7, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(HOLE, HOLE[1:]))],
                                  "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    big = spark.createDataFrame(
        [(9, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip([(-50, -50), (60, -50), (60, 60), (-50, 60)], [(60, -50), (60, 60), (-50, 60), (-50, -50)]))],
        "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    assert G.polygons_within(small, big, 1.0).collect() == [(7, 9)]
    assert G.polygons_within(big, small, 1.0).collect() == [(9, 7)]
    assert G.polygon_area(shapes(spark)[0].where("poly_id = 2"), ["poly_id"]).first()["area"] == 15.0


def test_nearest_does_not_cross_join(spark):
    o, t = layers(2)
    plan = G.nearest_k(spark.createDataFrame(o), spark.createDataFrame(t), 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_deals_candidates_over_tasks(spark):
    o, t = layers(2)
    for k in (1, 3):
        plan = G.nearest_k(spark.createDataFrame(o), spark.createDataFrame(t), k)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan


EDGES = "poly_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def stars(seed, n, spread, size, first=0):
    """Ragged polygons around random centres; a third sit in one dense spot, one is wider than all others."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        cx, cy = (rng.uniform(0, spread / 50, 2) if k % 3 == 0 else rng.uniform(0, spread, 2))
        corners = int(rng.integers(3, 9)) if k else 80
        turn = np.sort(rng.uniform(0, 2 * math.pi, corners))
        r = rng.uniform(0.3, 1, corners) * (size if k else spread / 2)
        ring = list(zip(cx + r * np.cos(turn), cy + r * np.sin(turn)))
        rows += ring_edges(first + k, [tuple(map(float, v)) for v in [*ring, ring[0]]])
    return rows


def gap(a, b):
    """Least distance of two sets of segments, and whether one holds a vertex of the other."""
    def to(px, py, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = max(0, min(1, ((px - s[0]) * dx + (py - s[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - s[0] - t * dx, py - s[1] - t * dy)

    def side(s, x, y):
        return (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])

    best = math.inf
    for s in a:
        for t in b:
            if side(s, t[0], t[1]) * side(s, t[2], t[3]) < 0 and side(t, s[0], s[1]) * side(t, s[2], s[3]) < 0:
                return 0.0
            best = min(best, to(s[0], s[1], t), to(s[2], s[3], t), to(t[0], t[1], s), to(t[2], t[3], s))
    held = [(1, 0, *s) for s in a], [(1, 0, *t) for t in b]
    return 0.0 if inside(held[1], 1, a[0][0], a[0][1]) or inside(held[0], 1, b[0][0], b[0][1]) else best


@pytest.mark.parametrize("reach", [0.0, 0.05, 40.0])
def test_polygons_within_brute_force(spark, reach):
    a, b = stars(1, 30, 500.0, 12.0), stars(2, 24, 500.0, 20.0, 100)
    got = {tuple(r) for r in G.polygons_within(spark.createDataFrame(a, EDGES), spark.createDataFrame(b, EDGES), reach).collect()}
    held = [{p: [r[2:] for r in rows if r[0] == p] for p in {r[0] for r in rows}} for rows in (a, b)]
    assert got == {(p, q) for p, s in held[0].items() for q, t in held[1].items() if gap(s, t) <= reach}


def test_polygon_joins_compare_few_edges(spark):
    """A crowd of small squares around one ragged outline: its pairs are decided by boxes and outermost vertices."""
    rng = np.random.default_rng(5)
    rows = []
    for k, (x, y) in enumerate(rng.uniform(0, 100, (300, 2)).tolist()):
        rows += ring_edges(k, [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)])
    crowd = spark.createDataFrame([(p, i, *map(float, c)) for p, i, *c in rows], EDGES)
    turn = np.linspace(0, 2 * math.pi, 2001)
    r = 1000 + 20 * np.cos(40 * turn)
    big = spark.createDataFrame(ring_edges(900, list(zip((r * np.cos(turn)).tolist(), (r * np.sin(turn)).tolist()))), EDGES)

    def compared(left, right, reach):
        pairs = G.box_pairs(G._outlines(left, "left"), G._outlines(right, "right"), reach).withColumn("sure", G._sure(reach))
        assert pairs.count() == pairs.select("left_id", "right_id").distinct().count()
        return G.edge_pairs(pairs.where("NOT sure"), left, right, reach).count()

    # Every pair of squares is in reach: nothing is compared, of 4 x 4 edges of 90,000 pairs.
    assert compared(crowd, crowd, 200.0) == 0 and G.polygons_within(crowd, crowd, 200.0).count() == 300 * 300
    # The crowd lies in the box of the outline, but far from its edges: none of 2,000 x 1,200 pairs of edges is compared.
    assert compared(crowd, big, 5.0) == 0 and compared(big, crowd, 5.0) == 0
    assert G.polygons_within(crowd, big, 5.0).count() == 300
    # A band along the outline meets the edges nearby only.
    shifted = crowd.withColumns({c: F.col(c) + 930 for c in ("x1", "x2")})
    assert 0 < compared(shifted, big, 5.0) < 20 * 1200


def test_long_edges_are_cut(spark):
    """A slanting edge has cells along it, not all of its box; distances at reach 0 are those on the edge."""
    e = spark.createDataFrame([(1, 0, 0.0, 0.0, 100000.0, 99000.0)], EDGES)
    cells = G._edge_cells(e, F.lit(10.0), F.lit(10.0)).select("cx", "cy")
    assert cells.count() == cells.distinct().count() < 100000
    p = spark.createDataFrame([(1, 50000.0, 49500.0), (2, 50000.0, 49507.0), (3, 50000.0, 49520.0)], "point_id int, x double, y double")
    assert {r.point_id for r in G.edges_near_points(p, e, 10.0).collect()} == {1, 2}
    assert {r.point_id for r in G.edges_near_points(p, e, 0.0).collect()} == {1}


def test_dense_spot_opens_only_its_own_cells(spark):
    """300 places within a billionth of the extent, and 400 spread ones: the spread ones stay in shallow cells."""
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 1e6, 700), rng.uniform(0, 1e6, 700)
    x[:300], y[:300] = 250000 + rng.uniform(0, 1e-3, 300), 250000 + rng.uniform(0, 1e-3, 300)
    t = pd.DataFrame({"target_id": range(700), "kind": 0, "x": x, "y": y})
    ox, oy = rng.uniform(0, 1e6, 60), rng.uniform(0, 1e6, 60)
    ox[:20], oy[:20] = 250000 + rng.uniform(0, 1e-3, 20), 250000 + rng.uniform(0, 1e-3, 20)
    o = pd.DataFrame({"origin_id": range(60), "x": ox, "y": oy})
    left, right = spark.createDataFrame(o), spark.createDataFrame(t)
    seen = {}

    def prune(pairs, level):
        seen[level] = pairs.select("kind", "tx", "ty").distinct().count()
        return pairs.withColumn("whole", F.lit(False))

    found = G._descend(left, right.withColumns({"n": F.lit(1), "w": F.lit(1)}), G._grid_over(left, right), G.PLANE, prune)
    # Below the level of the spread places only cells of the spot are opened, far beyond 24 halvings.
    assert max(seen) > 24 and seen[max(seen)] <= 300 and all(seen[level] <= 32 for level in range(10, 30, 2))
    assert {level for level, met in found if met.count()} & {2, 4, 6}
    got = G.nearest_k(left, right, 2).toPandas()
    want = brute(o, t).sort_values(["origin_id", "d", "target_id"]).groupby("origin_id").head(2)
    assert set(zip(got.origin_id, got.target_id)) == set(zip(want.origin_id, want.target_id))
