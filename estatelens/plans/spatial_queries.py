"""Containment, nearest, radius, boundary and network queries over the sample layers."""

from pyspark.sql import functions as F

from ..functions.geo import plane_distance
from ..functions.scalar import parse_lines
from ..operators import network as N, spatial as G
from .registry import query, r6

_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_CROSS = "CASE WHEN (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END"
_ON = """((x2 - x1) * (py - y1) = (y2 - y1) * (px - x1) AND px BETWEEN least(x1, x2) AND greatest(x1, x2)
 AND py BETWEEN least(y1, y2) AND greatest(y1, y2))"""
_T = "greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
_SEG = f"sqrt(pow(px - x1 - {_T} * (x2 - x1), 2) + pow(py - y1 - {_T} * (y2 - y1), 2))"


def _sides(edges):
    """Every address against every area: crossings, edge hits and outline distance."""
    return f"""(SELECT ck, school_id, any_value(school_name) AS school_name, any_value(is_good_school) AS good, sum({_CROSS}) % 2 = 1 AS odd,
 bool_or({_ON}) AS on_edge, min({_SEG}) AS d FROM (SELECT ck, x AS px, y AS py FROM {{f_address}} a) p CROSS JOIN {edges} e GROUP BY 1, 2)"""


_AREA = _sides("{f_area_edge}")
_OUTLINE = _sides("{f_school_edge}")


def origins(t):
    return t.f_address.select(F.col("ck").alias("origin_id"), "x", "y", "latitude", "longitude")


def points(t):
    return t.f_address.select(F.col("ck").alias("point_id"), "address_key", "town", "x", "y")


def amenities(t):
    return t.f_amenity.withColumnRenamed("amenity_id", "target_id")


def edges(df):
    return df.withColumnRenamed("school_id", "poly_id")


def areas(t):
    """One row per 1 km area with its own attributes."""
    return t.f_school.select(
        F.col("school_id").alias("poly_id"), "school_name", "is_good_school",
        F.col("school_id").cast("string").alias("block_no"), (4 * (F.col("h") + 1000) * (F.col("h") + 1000)).alias("area"),
    )


# -- points in polygons -----------------------------------------------------------------------

@query("pip_join", f"""SELECT p.ck, s.school_name, s.good AS is_good_school FROM {{f_address}} p
 LEFT JOIN (SELECT * FROM {_AREA} q WHERE odd AND NOT on_edge) s ON p.ck = s.ck""")
def pip_join(t):
    out = G.join_polygons(points(t), edges(t.f_area_edge), areas(t), "within")
    return out.select(F.col("point_id").alias("ck"), "school_name", "is_good_school")


@query("pip_join_best", f"""SELECT ck, school_id FROM (SELECT p.ck, s.school_id, row_number() OVER (PARTITION BY p.ck ORDER BY
 CASE WHEN s.school_id IS NULL THEN 1 ELSE 0 END, CASE WHEN p.ck % 25 = s.school_id THEN 0 ELSE 1 END, s.school_id DESC) AS rn
 FROM {{f_address}} p LEFT JOIN (SELECT * FROM {_AREA} q WHERE odd AND NOT on_edge) s ON p.ck = s.ck) t WHERE rn = 1""")
def pip_join_best(t):
    joined = G.join_polygons(points(t), edges(t.f_area_edge), areas(t), "within")
    joined = joined.withColumn("block", (F.col("point_id") % 25).cast("string"))
    best = G.best_polygon(joined, "block", "block_no", "area")
    return best.select(F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id"))


@query("pip_join_predicate", f"""SELECT 'within' AS predicate, ck, school_id FROM {_AREA} q WHERE odd AND NOT on_edge
 UNION ALL SELECT 'intersects', ck, school_id FROM {_AREA} r WHERE odd OR on_edge""")
def pip_join_predicate(t):
    p, e = points(t), edges(t.f_area_edge)
    out = None
    for predicate in ("within", "intersects", "contains"):
        hits = G.point_in_polygon(p, e, predicate).select(
            F.lit(predicate).alias("predicate"), F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id")
        )
        out = hits if out is None else out.unionByName(hits)
    return out


@query("split_matched", f"""SELECT p.ck, CASE WHEN s.school_id IS NULL THEN 'unmatched' ELSE 'matched' END AS part FROM {{f_address}} p
 LEFT JOIN (SELECT * FROM {_AREA} q WHERE odd AND NOT on_edge) s ON p.ck = s.ck""")
def split_matched(t):
    hit, miss = G.split_matched(G.join_polygons(points(t), edges(t.f_area_edge), areas(t), "within"))
    return hit.select(F.col("point_id").alias("ck"), F.lit("matched").alias("part")).unionByName(
        miss.select(F.col("point_id").alias("ck"), F.lit("unmatched").alias("part"))
    )


@query("pip_names_1km", f"""SELECT p.ck, coalesce(s.names, '') AS names FROM {{f_address}} p LEFT JOIN
 (SELECT ck, string_agg(school_name, ', ' ORDER BY school_name) AS names FROM {_AREA} q WHERE good AND odd AND NOT on_edge GROUP BY ck) s ON p.ck = s.ck""")
def pip_names_1km(t):
    good = edges(t.f_area_edge).where("is_good_school")
    out = G.names_covering(points(t), good, areas(t).select("poly_id", F.col("school_name").alias("name")))
    return out.select(F.col("point_id").alias("ck"), "names")


@query("attach_polygon", f"""SELECT town, ck, school_id, area FROM (SELECT p.town, s.ck, s.school_id, 4.0 * (1060 + 5 * s.school_id) * (1060 + 5 * s.school_id) AS area,
 row_number() OVER (PARTITION BY p.town ORDER BY s.ck, s.school_id) AS rn FROM {{f_address}} p JOIN {_AREA} s ON p.ck = s.ck AND odd AND NOT on_edge) t WHERE rn = 1""")
def attach_polygon(t):
    from ..operators.ordering import first_per_key

    hits = G.point_in_polygon(points(t), edges(t.f_area_edge), "within")
    rows = points(t).join(hits, "point_id").join(areas(t).select("poly_id", "area"), "poly_id")
    first = first_per_key(rows, ["town"], [F.col("point_id"), F.col("poly_id")])
    return first.select("town", F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id"), "area")


@query("point_in_polygon", f"""SELECT ck, school_id, odd OR on_edge AS covers, odd AND NOT on_edge AS within FROM {_AREA} q WHERE odd OR on_edge""")
def point_in_polygon(t):
    p, e = points(t), edges(t.f_area_edge)
    boxes = G._boxes(e)
    sides = G.classify_points(G.points_in_boxes(p, boxes), e, boxes)
    return sides.where(F.col("odd") | F.col("on_edge")).select(
        F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id"),
        (F.col("odd") | F.col("on_edge")).alias("covers"), (F.col("odd") & ~F.col("on_edge")).alias("within"),
    )


# -- polygon measures -------------------------------------------------------------------------

@query("polygon_area", """SELECT building_id, (30.0 + 2 * (building_id % 21)) * (30.0 + 2 * (building_id % 21)) AS area FROM {f_building} t""")
def polygon_area(t):
    return G.polygon_area(t.f_building_edge, ["building_id"]).select("building_id", "area")


@query("ring_vertex_mean", """SELECT building_id, round((4 * cx + (cx - h)) / 5, 6) AS mean_x, round((4 * cy + (cy - h)) / 5, 6) AS mean_y FROM {f_building} t""")
def ring_vertex_mean(t):
    m = G.vertex_mean(t.f_building_edge, ["building_id"])
    return m.select("building_id", r6("mean_x", "mean_x"), r6("mean_y", "mean_y"))


@query("point_boundary_distance", f"""SELECT ck, school_id, round(d, 6) AS distance FROM {_OUTLINE} q WHERE ck % 25 = school_id""")
def point_boundary_distance(t):
    pairs = points(t).select("point_id", (F.col("point_id") % 25).cast("int").alias("poly_id"))
    out = G.boundary_distance(points(t), edges(t.f_school_edge), pairs)
    return out.select(F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id"), r6("distance", "distance"))


@query("school_component", """SELECT school_id, CASE WHEN school_id % 3 = 1 AND h < 400 - h / 2 THEN 1 ELSE 0 END AS part,
 CASE WHEN school_id % 3 = 1 AND h < 400 - h / 2 THEN h * h ELSE 4 * h * h END AS area FROM {f_school} t""")
def school_component(t):
    # A third of the schools lie in the eastern part, a third nearest to the main one, a third have no point.
    p = t.f_school.where(F.col("school_id") % 3 != 2).select(
        F.col("school_id").alias("poly_id"),
        F.when(F.col("school_id") % 3 == 1, F.col("cx") + 400).otherwise(F.col("cx") - 2 * F.col("h")).alias("x"),
        F.col("cy").alias("y"),
    )
    out = G.school_component(edges(t.f_parts_edge), p)
    return out.select(F.col("poly_id").alias("school_id"), "part", "area")


# -- polygons near polygons, points near boundaries ---------------------------------------------

_SQUARES = """(SELECT b.building_id, s.school_id, s.is_good_school, sqrt(pow(greatest(0, abs(b.cx - s.cx) - b.h - s.h), 2)
 + pow(greatest(0, abs(b.cy - s.cy) - b.h - s.h), 2)) AS d FROM {f_building} b CROSS JOIN {f_school} s)"""


@query("buffer_intersect_join", f"""SELECT building_id, school_id FROM {_SQUARES} t WHERE d <= 1000""")
def buffer_intersect_join(t):
    left = t.f_building_edge.withColumnRenamed("building_id", "poly_id")
    out = G.polygons_within(left, edges(t.f_school_edge), 1000)
    return out.select(F.col("left_id").alias("building_id"), F.col("right_id").alias("school_id"))


@query("school_counts", f"""SELECT building_id, count(*) FILTER (WHERE d <= 1000) AS school_count_1km, count(*) FILTER (WHERE d <= 1000 AND is_good_school) AS good_school_count_1km,
 count(*) FILTER (WHERE d <= 2000) AS school_count_2km, count(*) FILTER (WHERE d <= 2000 AND is_good_school) AS good_school_count_2km FROM {_SQUARES} t GROUP BY 1""")
def school_counts(t):
    left = t.f_building_edge.withColumnRenamed("building_id", "poly_id")
    good = areas(t).select("poly_id", "is_good_school")
    near, far = (G.school_counts(left, edges(t.f_school_edge), good, r) for r in (1000, 2000))
    return near.select(
        F.col("poly_id"), F.col("school_count").alias("school_count_1km"), F.col("good_school_count").alias("good_school_count_1km")
    ).join(
        far.select("poly_id", F.col("school_count").alias("school_count_2km"), F.col("good_school_count").alias("good_school_count_2km")), "poly_id"
    ).withColumnRenamed("poly_id", "building_id")


@query("signed_boundary_band", f"""SELECT ck, school_id, round(CASE WHEN odd OR on_edge THEN -d ELSE d END, 6) AS signed_distance_m,
 CAST(odd OR on_edge AS INTEGER) AS inside_good_school_1km FROM {_AREA} q WHERE d <= 500""")
def signed_boundary_band(t):
    out = G.signed_band(points(t), edges(t.f_area_edge), 500)
    return out.select(
        F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id"),
        r6("signed_distance_m", "signed_distance_m"), F.col("inside").alias("inside_good_school_1km"),
    )


@query("signed_radius_band", f"""SELECT ck, school_id, round(r, 6) AS signed_distance_m, CAST(r <= 0 AS INTEGER) AS inside_good_school_1km
 FROM (SELECT ck, school_id, CASE WHEN odd OR on_edge THEN 0 ELSE d END - 1000 AS r FROM {_OUTLINE} q) t WHERE abs(r) <= 500""")
def signed_radius_band(t):
    out = G.signed_band_of_radius(points(t), edges(t.f_school_edge), 1000, 500)
    return out.select(
        F.col("point_id").alias("ck"), F.col("poly_id").alias("school_id"),
        r6("signed_distance_m", "signed_distance_m"), F.col("inside").alias("inside_good_school_1km"),
    )


# -- nearest and radius -----------------------------------------------------------------------

@query("nearest_k1", f"""SELECT ck, amenity_id, amenity_name, round(d, 6) AS distance FROM (SELECT a.ck, b.amenity_id, b.amenity_name, {_DIST} AS d,
 row_number() OVER (PARTITION BY a.ck ORDER BY {_DIST}, b.amenity_id) AS rn FROM {{f_address}} a CROSS JOIN {{f_amenity}} b) t WHERE rn = 1""")
def nearest_k1(t):
    near = G.nearest_k(origins(t), amenities(t).withColumn("kind", F.lit(0)), 1, target_columns=["amenity_name"])
    return near.select(
        F.col("origin_id").alias("ck"), F.col("target_id").alias("amenity_id"), "amenity_name", r6("distance", "distance")
    )


@query("nearest_k", f"""SELECT ck, kind, amenity_id, CAST(rn AS INTEGER) AS rank FROM (SELECT a.ck, b.kind, b.amenity_id,
 row_number() OVER (PARTITION BY a.ck, b.kind ORDER BY {_DIST}, b.amenity_id) AS rn FROM {{f_address}} a CROSS JOIN {{f_amenity}} b) t WHERE rn <= 5""")
def nearest_k(t):
    near = G.nearest_k(origins(t), amenities(t), 5)
    return near.select(F.col("origin_id").alias("ck"), "kind", F.col("target_id").alias("amenity_id"), "rank")


@query("radius_count", f"""SELECT a.ck, count(b.amenity_id) AS n FROM {{f_address}} a LEFT JOIN {{f_amenity}} b ON {_DIST} <= 2000 / 1.25 GROUP BY 1""")
def radius_count(t):
    return G.radius_counts(origins(t), amenities(t), 2000, detour=1.25).withColumnRenamed("origin_id", "ck")


@query("unique_lines_in_radius", f"""SELECT a.ck, count(DISTINCT b.line) AS unique_lines FROM {{f_address}} a LEFT JOIN
 (SELECT x, y, unnest(CAST(lines_present_json AS JSON)::VARCHAR[]) AS line FROM {{f_amenity}} m) b ON {_DIST} <= 1600 GROUP BY 1""")
def unique_lines_in_radius(t):
    exits = t.f_amenity.select("x", "y", parse_lines(F.col("lines_present_json")).alias("lines"))
    return G.lines_within(origins(t), exits, 1600).withColumnRenamed("origin_id", "ck")


_KM = ("sqrt(pow((b.latitude - a.latitude) * 111.32, 2) + pow((b.longitude - a.longitude) * 111.32"
       " * cos(radians((a.latitude + b.latitude) / 2)), 2))")


@query("nearest_walk_features", f"""SELECT ck, kind, amenity_name, round(d, 4) AS straight_km, round(d * 1.2, 4) AS walking_km, round(d * 1.2 / 4.8 * 60, 2) AS walking_mins
 FROM (SELECT a.ck, b.kind, b.amenity_name, {_KM} AS d, row_number() OVER (PARTITION BY a.ck, b.kind ORDER BY {_KM}, b.amenity_id) AS rn
 FROM {{f_address}} a CROSS JOIN {{f_amenity}} b) t WHERE rn = 1""")
def nearest_walk_features(t):
    out = G.walk_features(origins(t), amenities(t), ["amenity_name"])
    return out.select(F.col("origin_id").alias("ck"), "kind", "amenity_name", "straight_km", "walking_km", "walking_mins")


_ROUTES = f"""(SELECT a.ck, b.amenity_id, {_DIST} * (1.1 + b.amenity_id % 5 / 10.0) AS metres FROM
 (SELECT DISTINCT o.o_custkey AS ck, l.l_suppkey AS s FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey) r
 JOIN {{f_address}} a ON a.ck = r.ck JOIN {{f_amenity}} b ON b.amenity_id = r.s)"""


def routes(t):
    """Routed distances between addresses and amenities that trade with each other."""
    pairs = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("origin_id"), F.col("l_suppkey").alias("target_id")
    ).distinct()
    a = origins(t).select("origin_id", "x", "y")
    b = amenities(t).select("target_id", F.col("x").alias("bx"), F.col("y").alias("by"))
    d = plane_distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))
    return pairs.join(a, "origin_id").join(b, "target_id").select(
        "origin_id", "target_id", (d * (1.1 + F.col("target_id") % 5 / 10)).alias("metres")
    )


@query("topk_rerank", f"""WITH c AS (SELECT ck, amenity_id, d, rn FROM (SELECT a.ck, b.amenity_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.ck ORDER BY {_DIST}, b.amenity_id) AS rn
 FROM {{f_address}} a CROSS JOIN {{f_amenity}} b) q WHERE rn <= 8),
 j AS (SELECT c.ck, c.amenity_id, c.d, c.rn, r.metres FROM c LEFT JOIN {_ROUTES} r ON c.ck = r.ck AND c.amenity_id = r.amenity_id)
 SELECT ck, amenity_id, round(coalesce(metres, d * 1.3), 6) AS walking_distance_m, metres IS NOT NULL AS routed FROM (SELECT *,
 row_number() OVER (PARTITION BY ck ORDER BY CASE WHEN metres IS NULL THEN 1 ELSE 0 END, coalesce(metres, d), rn) AS k FROM j) t WHERE k = 1""")
def topk_rerank(t):
    near = G.nearest_k(origins(t), amenities(t).withColumn("kind", F.lit(0)), 8)
    out = G.rerank(near, routes(t), detour=1.3)
    return out.select(
        F.col("origin_id").alias("ck"), F.col("target_id").alias("amenity_id"), r6("walking_distance_m", "walking_distance_m"), "routed"
    )


# -- network ----------------------------------------------------------------------------------

_NODE = "(SELECT c_custkey AS node, CAST((c_custkey * 7919) % 20000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 20000 AS DOUBLE) AS y FROM customer)"


def nodes(t):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("node"), ((k * 7919) % 20000).cast("double").alias("x"), ((k * 104729) % 20000).cast("double").alias("y")
    )


def network_points(t):
    """Addresses at their own node; every eleventh lies off the network."""
    ck = F.col("ck")
    return t.f_address.select(ck.alias("origin_id"), F.when(ck % 11 == 0, -ck - 1).otherwise(ck).alias("node"), "x", "y")


_POINT = "(SELECT ck, CASE WHEN ck % 11 = 0 THEN -ck - 1 ELSE ck END AS node, x, y FROM {f_address} a)"


@query("snap_to_node", f"""SELECT amenity_id, node FROM (SELECT a.amenity_id, b.node, row_number() OVER (PARTITION BY a.amenity_id ORDER BY {_DIST}, b.node) AS rn
 FROM {{f_amenity}} a CROSS JOIN {_NODE} b) t WHERE rn = 1""")
def snap_to_node(t):
    o = t.f_amenity.select(F.col("amenity_id").alias("origin_id"), "x", "y")
    targets = nodes(t).select(F.col("node").alias("target_id"), F.lit(0).alias("kind"), "x", "y")
    near = G.nearest_k(o, targets, 1)
    return near.select(F.col("origin_id").alias("amenity_id"), F.col("target_id").alias("node"))


def _rounds(n, seeds, cutoff=None):
    """n rounds of relaxation from `seeds` (label, node, source_id) as chained statements."""
    stop = f"WHERE d.v.d + e.length <= {cutoff}" if cutoff else ""
    text = f"e AS MATERIALIZED (SELECT src, dst, min(length) AS length FROM {{f_edge}} w GROUP BY 1, 2), d0 AS MATERIALIZED (SELECT label, node, min({{'d': 0.0::DOUBLE, 's': source_id}}) AS v FROM ({seeds}) q GROUP BY 1, 2)"
    for i in range(1, n + 1):
        text += f""", d{i} AS MATERIALIZED (SELECT label, node, min(v) AS v FROM (SELECT label, node, v FROM d{i - 1} UNION ALL
 SELECT d.label, e.dst, {{'d': d.v.d + e.length, 's': d.v.s}} FROM d{i - 1} d JOIN e ON d.node = e.src {stop}) q GROUP BY 1, 2)"""
    return text


@query("nearest_source_path", f"""WITH {_rounds(24, "SELECT 0 AS label, node, source_id FROM {f_source} s")},
 n AS (SELECT ck, source_id, d FROM (SELECT a.ck, b.source_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.ck ORDER BY {_DIST}, b.source_id) AS rn
  FROM {{f_address}} a CROSS JOIN (SELECT s.source_id, q.x, q.y FROM {{f_source}} s JOIN {_NODE} q ON q.node = s.node) b) u WHERE rn = 1)
 SELECT p.ck, CASE WHEN d24.node IS NULL THEN n.source_id ELSE d24.v.s END AS source_id, round(CASE WHEN d24.node IS NULL THEN n.d * 1.2 ELSE d24.v.d END, 6) AS walking_distance_m,
 d24.node IS NOT NULL AS routed FROM {_POINT} p LEFT JOIN d24 ON p.node = d24.node JOIN n ON n.ck = p.ck""")
def nearest_source_path(t):
    p, sources = network_points(t), t.f_source
    reached = N.nearest_source(t.f_edge, sources)
    at = sources.join(nodes(t), "node").select(F.col("source_id").alias("target_id"), F.lit(0).alias("kind"), "x", "y")
    straight = G.nearest_k(p, at, 1)
    out = N.nearest_by_network(p, reached, straight, detour=1.2)
    return out.select(F.col("origin_id").alias("ck"), "source_id", r6("walking_distance_m", "walking_distance_m"), "routed")


@query("sources_within_cutoff", f"""WITH {_rounds(16, "SELECT source_id AS label, node, source_id FROM {f_source} s", 800)}
 SELECT p.ck, count(d16.label) AS n FROM {_POINT} p LEFT JOIN d16 ON p.node = d16.node GROUP BY 1""")
def sources_within_cutoff(t):
    out = N.sources_within(network_points(t), t.f_edge, t.f_source, 800.0)
    return out.select(F.col("origin_id").alias("ck"), "n")


@query("lines_within_cutoff", f"""WITH {_rounds(16, "SELECT station AS label, node, source_id FROM {f_source} s", 800)},
 l AS (SELECT DISTINCT station, unnest(CAST(lines_present_json AS JSON)::VARCHAR[]) AS line FROM {{f_source}} s2)
 SELECT p.ck, count(DISTINCT l.line) AS unique_lines FROM {_POINT} p LEFT JOIN d16 ON p.node = d16.node LEFT JOIN l ON l.station = d16.label GROUP BY 1""")
def lines_within_cutoff(t):
    exits = t.f_source.select("station", "node", parse_lines(F.col("lines_present_json")).alias("lines"))
    out = N.lines_within_cutoff(network_points(t), t.f_edge, exits, 800.0)
    return out.select(F.col("origin_id").alias("ck"), "unique_lines")
