"""Containment, nearest, radius and boundary-distance joins as equi-joins on grid cells.

Nearest and radius searches descend a shared quadtree of cells on both sides at
once. Only cell pairs that can still matter are kept and only full cells are opened,
so dense spots are never paired point by point with everything around them and make
nothing else deeper, and no search radius or candidate number is capped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..scratch import materialize
from .ordering import first_per_key

# Places a cell may hold before it is opened, halvings from one level to the next, and levels whose cells are counted
# in one go. After 48 halvings of the extent doubles tell hardly any places apart.
LEAF_POINTS = 32
_STEP = 2
_BLOCK = 12
_FINEST = 48


@dataclass(frozen=True)
class Metric:
    """A distance and bounds on how the plane axes stretch under it.

    True distance lies between the plane distance with x scaled by `x_low` and by
    `x_high`, times `unit`.
    """

    distance: callable
    x_low: float = 1.0
    x_high: float = 1.0
    unit: float = 1.0


PLANE = Metric(geo.plane_distance)


def flat_metric(min_lat: float, max_lat: float) -> Metric:
    """Flat km distance of points given as (longitude, latitude) within a latitude range."""
    import math

    far, near = max(abs(min_lat), abs(max_lat)), 0.0 if min_lat < 0 < max_lat else min(abs(min_lat), abs(max_lat))
    return Metric(
        lambda x1, y1, x2, y2: geo.flat_distance_km(y1, x1, y2, x2),
        math.cos(math.radians(far)), math.cos(math.radians(near)), geo.KM_PER_DEGREE,
    )


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    size: float

    def cell(self, v: Column, origin: float, level: int) -> Column:
        n = 2**level
        at = F.floor((v - origin) / (self.size / n)).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), at))

    def placed(self, points: DataFrame, level: int, cx: str, cy: str) -> DataFrame:
        """The points with their cell at a level."""
        return points.withColumns({cx: self.cell(F.col("x"), self.x0, level), cy: self.cell(F.col("y"), self.y0, level)})

    def gaps(self, level: int, metric: Metric) -> tuple[Column, Column]:
        """Least and largest distance between points of cells (ox, oy) and (tx, ty)."""
        s = self.size / 2**level
        dx = F.abs(F.col("ox") - F.col("tx")).cast("double")
        dy = F.abs(F.col("oy") - F.col("ty")).cast("double")

        def length(a, b, stretch):
            return F.sqrt(a * a * stretch * stretch + b * b) * (s * metric.unit)

        near = length(F.greatest(dx - 1, F.lit(0)), F.greatest(dy - 1, F.lit(0)), metric.x_low)
        far = length(dx + 1, dy + 1, metric.x_high)
        # A hair of slack for rounding at cell borders.
        return near * (1 - 1e-9) - 1e-9 * s * metric.unit, far * (1 + 1e-9)


def _grid_over(origins: DataFrame, targets: DataFrame) -> Grid | None:
    both = origins.select("x", "y").unionByName(targets.select("x", "y"))
    b = both.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if b[0] is None:
        return None
    size = max(b[2] - b[0], b[3] - b[1]) or 1.0
    return Grid(b[0], b[1], size * (1 + 1e-9))


def _cells_below(points: DataFrame, grid: Grid, start: int, kinds: list[str]) -> DataFrame:
    """Occupied cells of the levels of one block with their sums of `n` and `w`, written once."""
    end = start + _BLOCK
    finest = grid.placed(points, end, "lx", "ly").groupBy(*kinds, "lx", "ly").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    up = finest.withColumn("level", F.explode(F.array(*[F.lit(level) for level in range(start + _STEP, end + 1, _STEP)])))
    width = F.pow(F.lit(2.0), F.lit(end) - F.col("level"))
    return materialize(up.select(
        *kinds, "level", F.floor(F.col("lx") / width).alias("cx"), F.floor(F.col("ly") / width).alias("cy"), "n", "w",
    ).groupBy(*kinds, "level", "cx", "cy").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))


def _descend(origins: DataFrame, targets: DataFrame, grid: Grid, metric: Metric, prune) -> list[tuple[int, DataFrame]]:
    """Cell pairs that matter, as (level, table of kind, ox, oy, tx, ty, w, whole).

    A target cell is opened only while it holds more than LEAF_POINTS places, and only for the origin cells that it
    still matters to: a dense spot makes nothing deeper but itself. Cells are counted a block of levels at a time, below
    those still open. `origins` has (x, y), `targets` (kind, x, y, n, w): n counts places, w is what pairs add up.
    `prune(pairs, level)` sees these columns with near, far and the bound of the pair above; it drops pairs, and sets
    the bound and whether a pair is `whole`, not to be opened or compared.
    """
    spots = origins.select("x", "y", F.lit(1).alias("n"), F.lit(1).alias("w"))
    root = F.lit(0).cast("long")
    pairs = targets.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).withColumns(
        {"ox": root, "oy": root, "tx": root, "ty": root, "bound": F.lit(float("inf"))}
    )
    found, level, cells = [], 0, None
    while True:
        near, far = grid.gaps(level, metric)
        done = F.col("whole") | (F.col("n") <= LEAF_POINTS) | F.lit(level >= _FINEST)
        pairs = prune(pairs.withColumn("near", near).withColumn("far", far), level).withColumn("done", done)
        pairs = materialize(pairs.select("kind", "ox", "oy", "tx", "ty", "n", "w", "bound", "whole", "done"))
        kept = {r.done for r in pairs.select("done").distinct().collect()}
        if True in kept or level == 0:
            found.append((level, pairs.where("done").select("kind", "ox", "oy", "tx", "ty", "w", "whole")))
        if False not in kept:
            return found
        pairs = pairs.where("NOT done").drop("n", "w", "whole", "done")
        if level % _BLOCK == 0:
            o, t = spots, targets
            if level:
                o = grid.placed(o, level, "ox", "oy").join(pairs.select("ox", "oy").distinct(), ["ox", "oy"], "left_semi")
                t = grid.placed(t, level, "tx", "ty").join(pairs.select("kind", "tx", "ty").distinct(), ["kind", "tx", "ty"], "left_semi")
            cells = _cells_below(o, grid, level, []), _cells_below(t, grid, level, ["kind"])
        level += _STEP
        span = 2**_STEP
        below = [
            c.where(F.col("level") == level).select(
                *[k for k in ("kind",) if k in c.columns], F.col("cx").alias(f"{tag}x2"), F.col("cy").alias(f"{tag}y2"),
                F.floor(F.col("cx") / span).alias(f"{tag}x"), F.floor(F.col("cy") / span).alias(f"{tag}y"),
                *(["n", "w"] if tag == "t" else []),
            ) for tag, c in zip("ot", cells)
        ]
        pairs = pairs.join(below[0], ["ox", "oy"]).join(below[1], ["kind", "tx", "ty"]).select(
            "kind", F.col("ox2").alias("ox"), F.col("oy2").alias("oy"), F.col("tx2").alias("tx"), F.col("ty2").alias("ty"), "n", "w", "bound"
        )


def _candidates(origins: DataFrame, targets: DataFrame, grid: Grid, pairs: list[tuple[int, DataFrame]]) -> DataFrame:
    """Origins (as __x, __y) beside the targets of the cells they are paired with; each target once per origin.

    A few cells make many rows, so all sides are dealt over the shuffle partitions, whichever of them a join reads through.
    """
    n = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    origins, targets = origins.repartition(n, "x", "y"), targets.repartition(n, "kind", "x", "y")
    parts = None
    for level, met in pairs:
        met = met.select("kind", "ox", "oy", "tx", "ty").repartition(n, "kind", "ox", "oy", "tx", "ty")
        t = grid.placed(targets, level, "tx", "ty").join(met, ["kind", "tx", "ty"]).drop("tx", "ty")
        o = grid.placed(origins, level, "ox", "oy").withColumnsRenamed({"x": "__x", "y": "__y"})
        part = o.join(t, ["ox", "oy"]).drop("ox", "oy")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def nearest_k(
    origins: DataFrame, targets: DataFrame, k: int = 1, metric: Metric = PLANE,
    target_columns: list[str] = (),
) -> DataFrame:
    """The k nearest targets of each kind for every origin, exactly.

    `origins` has (origin_id, x, y) and `targets` (target_id, kind, x, y, ...). Ties
    in distance go to the lower target_id. Returns origin_id, kind, target_id,
    distance, rank and `target_columns`; an origin gets fewer rows for a kind with
    fewer than k targets.
    """
    columns = list(target_columns)
    targets = targets.select("target_id", "kind", "x", "y", *columns)
    # Of targets at one place only the k lowest ids can be among the k nearest; `n` counts the place once.
    if k == 1:
        places = first_per_key(targets, ["kind", "x", "y"], [F.col("target_id")]).withColumn("n", F.lit(1))
    else:
        place = Window.partitionBy("kind", "x", "y").orderBy("target_id")
        places = targets.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k)
        places = places.withColumn("n", (F.col("__r") == 1).cast("int")).drop("__r")
    places = materialize(places.withColumn("w", F.lit(1)))
    tagged = materialize(origins.select("origin_id", "x", "y"))
    grid = _grid_over(tagged, places) or Grid(0.0, 0.0, 1.0)

    def prune(pairs: DataFrame, level: int) -> DataFrame:
        group = Window.partitionBy("ox", "oy", "kind")
        if k == 1:
            bound = F.min("far").over(group)
        else:
            upto = group.orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            pairs = pairs.withColumn("seen", F.sum("w").over(upto))
            bound = F.coalesce(F.min(F.when(F.col("seen") >= k, F.col("far"))).over(group), F.lit(float("inf")))
        # What bounded the cell above bounds this one too.
        pairs = pairs.withColumn("bound", F.least("bound", bound)).where(F.col("near") <= F.col("bound"))
        return pairs.withColumn("whole", F.lit(False))

    pairs = _descend(tagged, places, grid, metric, prune)
    near = (
        _candidates(tagged, places.drop("n", "w"), grid, pairs)
        .withColumn("distance", metric.distance(F.col("__x"), F.col("__y"), F.col("x"), F.col("y")))
        .select("origin_id", "kind", "target_id", "distance", *columns)
    )
    if k == 1:
        best = first_per_key(near, ["origin_id", "kind"], [F.col("distance"), F.col("target_id")])
        return best.withColumn("rank", F.lit(1))
    order = Window.partitionBy("origin_id", "kind").orderBy("distance", "target_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def count_within(origins: DataFrame, targets: DataFrame, radius: float, metric: Metric = PLANE) -> DataFrame:
    """Targets of each kind within `radius` of each origin: origin_id, kind, n (only n > 0).

    Cells wholly inside the radius add their counts unopened; only cells cut by it
    are compared point by point. Targets at one place are counted together.
    """
    places = materialize(
        targets.groupBy("kind", "x", "y").agg(F.lit(1).alias("n"), F.count("*").alias("w"))
    )
    origins = materialize(origins.select("origin_id", "x", "y"))
    grid = _grid_over(origins, places) or Grid(0.0, 0.0, 1.0)

    def prune(pairs: DataFrame, level: int) -> DataFrame:
        return pairs.where(F.col("near") <= radius).withColumn("whole", F.col("far") <= radius)

    pairs = _descend(origins, places, grid, metric, prune)
    parts = (
        _candidates(origins, places.drop("n"), grid, [(level, met.where("NOT whole")) for level, met in pairs])
        .where(metric.distance(F.col("__x"), F.col("__y"), F.col("x"), F.col("y")) <= radius)
        .select("origin_id", "kind", F.col("w").alias("n"))
    )
    for level, met in pairs:
        cells = met.where("whole").groupBy("ox", "oy", "kind").agg(F.sum("w").alias("n"))
        parts = parts.unionByName(grid.placed(origins, level, "ox", "oy").join(cells, ["ox", "oy"]).select("origin_id", "kind", "n"))
    return parts.groupBy("origin_id", "kind").agg(F.sum("n").alias("n"))


def radius_counts(origins: DataFrame, targets: DataFrame, radius: float, detour: float = 1.0) -> DataFrame:
    """Every origin with its number of targets whose walk (straight line x detour) is within `radius`."""
    counts = count_within(origins, targets.withColumn("kind", F.lit(0)), radius / detour)
    return origins.select("origin_id").join(counts.select("origin_id", "n"), "origin_id", "left").select(
        "origin_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def lines_within(origins: DataFrame, exits: DataFrame, radius: float) -> DataFrame:
    """Distinct lines over station exits within `radius`; exits carry an array `lines`."""
    by_line = exits.select("x", "y", F.explode("lines").alias("kind"))
    hits = count_within(origins, by_line, radius)
    counts = hits.groupBy("origin_id").agg(F.count("*").alias("n"))
    return origins.select("origin_id").join(counts, "origin_id", "left").select(
        "origin_id", F.coalesce("n", F.lit(0)).cast("long").alias("unique_lines")
    )


def rerank(candidates: DataFrame, distances: DataFrame, detour: float = 1.0) -> DataFrame:
    """Per origin the candidate of least routed distance, else the straight-line nearest.

    `candidates` comes from `nearest_k`; `distances` has (origin_id, target_id, metres).
    """
    joined = candidates.join(distances, ["origin_id", "target_id"], "left")
    routed = F.struct(F.col("metres").isNull().alias("missing"), F.coalesce("metres", "distance").alias("d"), F.col("rank"))
    best = F.min_by(F.struct("target_id", "distance", "metres"), routed)
    return joined.groupBy("origin_id", "kind").agg(best.alias("b")).select(
        "origin_id", "kind", "b.target_id",
        F.coalesce(F.col("b.metres"), F.col("b.distance") * detour).alias("walking_distance_m"),
        F.col("b.metres").isNotNull().alias("routed"),
    )


def walk_features(origins: DataFrame, amenities: DataFrame, columns: list[str] = ()) -> DataFrame:
    """Nearest amenity of each kind by flat distance, with walking km and minutes.

    Both sides carry latitude and longitude; rounding is 4, 4 and 2 places.
    """
    lat = origins.select("latitude").unionByName(amenities.select("latitude")).agg(
        F.min("latitude"), F.max("latitude")
    ).first()
    metric = flat_metric(lat[0] or 0.0, lat[1] or 0.0)

    def as_xy(df):
        return df.withColumns({"x": F.col("longitude"), "y": F.col("latitude")})

    near = nearest_k(as_xy(origins), as_xy(amenities), 1, metric, list(columns))
    walk = F.col("distance") * geo.WALK_DETOUR
    return near.select(
        "origin_id", "kind", "target_id", *columns,
        F.round("distance", 4).alias("straight_km"),
        F.round(walk, 4).alias("walking_km"),
        F.round(walk / geo.WALK_KMPH * 60, 2).alias("walking_mins"),
    )


# -- polygons as edge tables ----------------------------------------------------------------

EDGE = ("x1", "y1", "x2", "y2")


def polygon_area(edges: DataFrame, by: list[str]) -> DataFrame:
    """Shoelace area per polygon or part, however its rings run: ring 0 of a part adds, its other rings subtract.

    Edges without a column `ring` (or `part`) have one ring (or part).
    """
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = list(dict.fromkeys([*by, *[c for c in ("part", "ring") if c in edges.columns]]))
    sizes = edges.groupBy(*rings).agg((F.abs(F.sum(cross)) / 2).alias("size"))
    hole = F.col("ring") > 0 if "ring" in edges.columns else F.lit(False)
    return sizes.groupBy(*by).agg(F.sum(F.when(hole, -F.col("size")).otherwise(F.col("size"))).alias("area"))


def vertex_mean(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the vertices of a closed ring, its first vertex counted twice."""
    start = F.min_by(F.struct("x1", "y1"), F.col("seq"))
    sums = edges.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("x1").alias("sx"), F.sum("y1").alias("sy"), start.alias("s")
    )
    n = F.col("n") + 1
    return sums.select(*by, ((F.col("sx") + F.col("s.x1")) / n).alias("mean_x"), ((F.col("sy") + F.col("s.y1")) / n).alias("mean_y"))


def _boxes(edges: DataFrame) -> DataFrame:
    xs, ys = (F.least("x1", "x2"), F.greatest("x1", "x2")), (F.least("y1", "y2"), F.greatest("y1", "y2"))
    return edges.groupBy("poly_id").agg(
        F.min(xs[0]).alias("bx1"), F.max(xs[1]).alias("bx2"), F.min(ys[0]).alias("by1"), F.max(ys[1]).alias("by2"),
        F.count("*").alias("n_edges"),
    )


def _box_level(pad: float = 0.0) -> Column:
    """Power of two at which a box, padded, covers at most 2 x 2 cells."""
    span = F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")) + 2 * pad
    return F.ceil(F.log2(F.greatest(span, F.lit(1e-9)))).cast("int")


def _cells_of_box(boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("level"))

    def run(low, high):
        return F.sequence(F.floor((F.col(low) - pad) / size), F.floor((F.col(high) + pad) / size))

    return (
        boxes.withColumn("level", _box_level(pad))
        .withColumn("cx", F.explode(run("bx1", "bx2")))
        .withColumn("cy", F.explode(run("by1", "by2")))
    )


def _point_cells(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Each point once per box level in use (a few dozen at most), with its cell there."""
    levels = sorted(r.level for r in cells.select("level").distinct().collect())
    if not levels:
        levels = [0]
    at = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    size = F.pow(F.lit(2.0), F.col("level"))
    return at.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))


def points_in_boxes(points: DataFrame, boxes: DataFrame, pad: float = 0.0) -> DataFrame:
    """(point_id, poly_id, x, y, box) for points inside the padded bounding box of a polygon."""
    cells = _cells_of_box(boxes, pad)
    p = _point_cells(points.select("point_id", "x", "y"), cells)
    return p.join(cells, ["level", "cx", "cy"]).where(
        F.col("x").between(F.col("bx1") - pad, F.col("bx2") + pad)
        & F.col("y").between(F.col("by1") - pad, F.col("by2") + pad)
    ).drop("level", "cx", "cy")


def _strip(y: Column) -> Column:
    """Horizontal strip of a polygon; about eight edges start in each."""
    strips = F.greatest(F.lit(1), F.ceil(F.col("n_edges") / 8))
    height = (F.col("by2") - F.col("by1")) / strips
    at = F.when(height > 0, F.floor((y - F.col("by1")) / F.when(height > 0, height))).otherwise(0)
    return F.greatest(F.lit(0), F.least(strips - 1, at)).cast("int")


def classify_points(candidates: DataFrame, edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """For (point_id, poly_id, x, y) pairs: `odd` ray crossings and `on_edge`.

    A pair meets only the edges in its own horizontal strip of the polygon.
    """
    e = edges.select("poly_id", *EDGE).join(boxes.select("poly_id", "by1", "by2", "n_edges"), "poly_id")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("strip", F.explode(F.sequence(_strip(low), _strip(high)))).select("poly_id", "strip", *EDGE)
    c = candidates.withColumn("strip", _strip(F.col("y"))).select("point_id", "poly_id", "strip", "x", "y")
    seg = [F.col(k) for k in EDGE]
    hits = c.join(e, ["poly_id", "strip"]).groupBy("point_id", "poly_id").agg(
        F.sum(geo.crosses_ray(F.col("x"), F.col("y"), *seg).cast("int")).alias("crossings"),
        F.max(geo.on_segment(F.col("x"), F.col("y"), *seg)).alias("on_edge"),
    )
    return hits.select("point_id", "poly_id", (F.col("crossings") % 2 == 1).alias("odd"), "on_edge")


def point_in_polygon(points: DataFrame, edges: DataFrame, predicate: str = "within") -> DataFrame:
    """(point_id, poly_id) pairs. `within` leaves out the boundary, `intersects` takes it in;
    a point `contains` no polygon."""
    boxes = _boxes(edges)
    sides = classify_points(points_in_boxes(points, boxes), edges, boxes)
    tests = {
        "within": F.col("odd") & ~F.col("on_edge"),
        "intersects": F.col("odd") | F.col("on_edge"),
        "contains": F.lit(False),
    }
    return sides.where(tests[predicate]).select("point_id", "poly_id")


def join_polygons(points: DataFrame, edges: DataFrame, polygons: DataFrame, predicate: str = "within") -> DataFrame:
    """Left join of points to the polygons they lie in, polygon attributes attached, all hits kept."""
    hits = point_in_polygon(points, edges, predicate).join(polygons, "poly_id")
    return points.join(hits, "point_id", "left")


def best_polygon(joined: DataFrame, point_block: str, polygon_block: str, area: str) -> DataFrame:
    """One row per point: a matched polygon first, then the same block number, then the larger area."""
    same = F.coalesce(F.upper(F.col(point_block)) == F.upper(F.col(polygon_block)), F.lit(False))
    order = [
        F.col("poly_id").isNull().alias("a"), (~same).alias("b"),
        (-F.coalesce(F.col(area), F.lit(-1.0))).alias("c"), F.col("poly_id").alias("d"),
    ]
    return first_per_key(joined, ["point_id"], order)


def split_matched(joined: DataFrame, column: str = "poly_id") -> tuple[DataFrame, DataFrame]:
    return joined.where(F.col(column).isNotNull()), joined.where(F.col(column).isNull())


# An edge longer than this many reaches is cut by cells of this part of its own extent.
EDGE_CUTS = 16


def _slack(reach: Column, size: Column) -> Column:
    """The reach and a hair for rounding at cell borders."""
    return reach * (1 + 1e-9) + size * 1e-9


def _edge_cells(edges: DataFrame, size: Column, pad: Column, window: tuple[Column, ...] | None = None) -> DataFrame:
    """Each edge once per cell (cx, cy) that lies within `pad` of it, row by row, so that a slanting edge does not fill its box.

    `window` (x low, x high, y low, y high) leaves out cells beyond it.
    """
    low_y, high_y = F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad
    if window:
        low_y, high_y = F.greatest(low_y, window[2]), F.least(high_y, window[3])
    rows = edges.where(low_y <= high_y).withColumn("cy", F.explode(F.sequence(F.floor(low_y / size), F.floor(high_y / size))))
    dy = F.col("y2") - F.col("y1")

    def at(y: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / F.when(dy != 0, dy)))

    # The piece of the edge that can be within `pad` of this row.
    ends = [at(F.col("cy") * size - pad), at((F.col("cy") + 1) * size + pad)]
    x = [F.col("x1") + F.when(dy != 0, t).otherwise(F.lit(float(k))) * (F.col("x2") - F.col("x1")) for k, t in enumerate(ends)]
    low_x, high_x = F.least(*x) - pad, F.greatest(*x) + pad
    if window:
        low_x, high_x = F.greatest(low_x, window[0]), F.least(high_x, window[1])
    return rows.where(low_x <= high_x).withColumn("cx", F.explode(F.sequence(F.floor(low_x / size), F.floor(high_x / size))))


def edges_near_points(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(point_id, poly_id, distance): least distance to the outline, where at most `reach`.

    Cells are as wide as the reach; those of an edge over EDGE_CUTS times as long, and of any edge where the reach
    is 0, are powers of two of their own, so an edge never has more than some dozens of cells.
    """
    extent = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    least = F.greatest(F.lit(float(reach)), extent / EDGE_CUTS, F.lit(1e-9))
    e = edges.select("poly_id", *EDGE).withColumn("level", F.ceil(F.log2(least)).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))
    p = _point_cells(points.select("point_id", "x", "y"), e.where(F.col("level").isNotNull()))
    d = geo.point_segment_distance(F.col("x"), F.col("y"), *[F.col(k) for k in EDGE])
    return (
        p.join(_edge_cells(e, size, _slack(F.lit(float(reach)), size)), ["level", "cx", "cy"])
        .withColumn("distance", d).where(F.col("distance") <= reach)
        .groupBy("point_id", "poly_id").agg(F.min("distance").alias("distance"), F.first("x").alias("x"), F.first("y").alias("y"))
    )


def signed_band(points: DataFrame, edges: DataFrame, bandwidth: float) -> DataFrame:
    """Signed distance to the outline of every area within `bandwidth`: minus inside or on it."""
    boxes = _boxes(edges)
    band = edges_near_points(points, edges, bandwidth)
    inside = classify_points(
        band.select("point_id", "poly_id", "x", "y").join(boxes, "poly_id"), edges, boxes
    ).where(F.col("odd") | F.col("on_edge")).select("point_id", "poly_id", F.lit(1).alias("inside"))
    out = band.join(inside, ["point_id", "poly_id"], "left")
    is_in = F.coalesce("inside", F.lit(0))
    return out.select(
        "point_id", "poly_id",
        F.when(is_in == 1, -F.col("distance")).otherwise(F.col("distance")).alias("signed_distance_m"),
        is_in.alias("inside"),
    )


def signed_band_of_radius(points: DataFrame, edges: DataFrame, radius: float, bandwidth: float) -> DataFrame:
    """As `signed_band` for the ring at `radius` around a polygon: distance to the polygon minus radius."""
    boxes = _boxes(edges)
    near = edges_near_points(points, edges, radius + bandwidth)
    inside = classify_points(near.select("point_id", "poly_id", "x", "y").join(boxes, "poly_id"), edges, boxes)
    covered = inside.where(F.col("odd") | F.col("on_edge")).select("point_id", "poly_id", F.lit(True).alias("in_polygon"))
    d = F.when(F.coalesce("in_polygon", F.lit(False)), F.lit(0.0)).otherwise(F.col("distance")) - radius
    out = near.join(covered, ["point_id", "poly_id"], "left").withColumn("signed_distance_m", d)
    out = out.where(F.abs("signed_distance_m") <= bandwidth).select("point_id", "poly_id", "signed_distance_m")
    if radius <= bandwidth:
        # Points in the polygon are at -radius, however far from its outline.
        deep = point_in_polygon(points, edges, "intersects").select("point_id", "poly_id").join(
            near.select("point_id", "poly_id"), ["point_id", "poly_id"], "left_anti"
        )
        out = out.unionByName(deep.withColumn("signed_distance_m", F.lit(-float(radius))))
    return out.withColumn("inside", (F.col("signed_distance_m") <= 0).cast("int"))


def boundary_distance(points: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distance to the outline for given (point_id, poly_id) pairs."""
    d = geo.point_segment_distance(F.col("x"), F.col("y"), *[F.col(k) for k in EDGE])
    return (
        pairs.join(points.select("point_id", "x", "y"), "point_id").join(edges.select("poly_id", *EDGE), "poly_id")
        .groupBy("point_id", "poly_id").agg(F.min(d).alias("distance"))
    )


def _outlines(edges: DataFrame, tag: str) -> DataFrame:
    """Box, edge count, mean edge length and the four outermost vertices of each polygon, column names led by `tag`."""
    box = _boxes(edges)
    v, length = F.struct("x1", "y1"), geo.plane_distance(*[F.col(c) for c in EDGE])
    outer = [F.min_by(v, "x1"), F.max_by(v, "x1"), F.min_by(v, "y1"), F.max_by(v, "y1")]
    more = edges.groupBy("poly_id").agg(F.avg(length).alias("mean_edge"), F.array(*outer).alias("outer"))
    both = box.join(more, "poly_id")
    return both.withColumnsRenamed({c: f"{tag}_{c}" for c in both.columns}).withColumnRenamed(f"{tag}_poly_id", f"{tag}_id")


def box_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Pairs of `_outlines` (tags left and right) whose boxes are at most `reach` apart, each once.

    Two boxes meet at the level of the wider one, where both cover 2 x 2 cells at most, and are emitted in the cell
    that holds the lower corner of what they share.
    """
    pad = float(reach) * (1 + 1e-9)

    def level_of(tag, by):
        span = F.greatest(F.col(f"{tag}_bx2") - F.col(f"{tag}_bx1"), F.col(f"{tag}_by2") - F.col(f"{tag}_by1")) + 2 * by
        return F.ceil(F.log2(F.greatest(span, F.lit(1e-9)))).cast("int")

    sides = {"left": left.withColumn("own", level_of("left", pad)), "right": right.withColumn("own", level_of("right", 0.0))}
    used = {tag: sorted(r.own for r in df.where("own IS NOT NULL").select("own").distinct().collect()) for tag, df in sides.items()}
    size = F.pow(F.lit(2.0), F.col("level"))

    def cells(tag, levels):
        by = pad if tag == "left" else 0.0
        at = sides[tag].withColumn("level", F.explode(levels))
        for axis in "xy":
            run = F.sequence(F.floor((F.col(f"{tag}_b{axis}1") - by) / size), F.floor((F.col(f"{tag}_b{axis}2") + by) / size))
            at = at.withColumn(f"c{axis}", F.explode(run))
        return at.drop("own")

    def wider(levels, test):
        known = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
        return F.filter(known, test)

    own = F.array("own")
    key = ["level", "cx", "cy"]
    at_left = cells("left", own).join(cells("right", wider(used["left"], lambda v: v >= F.col("own"))), key)
    at_right = cells("left", wider(used["right"], lambda v: v > F.col("own"))).join(cells("right", own), key)
    met = at_left.unionByName(at_right)
    shared = {axis: F.greatest(F.col(f"left_b{axis}1") - pad, F.col(f"right_b{axis}1")) for axis in "xy"}
    gap = [
        F.greatest(F.lit(0.0), F.col(f"left_b{a}1") - F.col(f"right_b{a}2"), F.col(f"right_b{a}1") - F.col(f"left_b{a}2"))
        for a in "xy"
    ]
    first = (F.col("cx") == F.floor(shared["x"] / size)) & (F.col("cy") == F.floor(shared["y"] / size))
    return met.where(first & (F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]) <= pad)).drop(*key)


def _sure(reach: float) -> Column:
    """Whether two of the outermost vertices of a pair are within `reach`: no edge has to be looked at then."""
    def to(v, w):
        return geo.plane_distance(v["x1"], v["y1"], w["x1"], w["y1"])

    return F.least(*[to(F.col("left_outer")[i], F.col("right_outer")[j]) for i in range(4) for j in range(4)]) <= reach


def edge_pairs(undecided: DataFrame, left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Edges that have to be compared: (left_id, right_id, a.., b..) for pairs of polygons still undecided.

    The polygon with more edges lies in cells of its own, as wide as its mean edge or the reach, written once however
    many pairs it is in; the edges of the other one visit only those cells that lie within its box.
    """
    swap = F.col("left_n_edges") < F.col("right_n_edges")

    def pick(name, big):
        a, b = F.col(f"left_{name}"), F.col(f"right_{name}")
        return F.when(swap, b if big else a).otherwise(a if big else b)

    boxes = ["bx1", "bx2", "by1", "by2"]
    width = F.greatest(F.lit(float(reach)), pick("mean_edge", True))
    pairs = undecided.select(
        "left_id", "right_id", F.when(swap, "right").otherwise("left").alias("big_side"), pick("id", True).alias("big"),
        F.when(swap, "left").otherwise("right").alias("side"), pick("id", False).alias("poly_id"),
        *[pick(c, True).alias(c) for c in boxes], F.when(width > 0, width).otherwise(1.0).alias("size"),
    )
    both = left.select(F.lit("left").alias("side"), "poly_id", *EDGE).unionByName(right.select(F.lit("right").alias("side"), "poly_id", *EDGE))
    size = F.col("size")
    pad = _slack(F.lit(float(reach)), size)
    grids = pairs.select(F.col("big_side").alias("side"), F.col("big").alias("poly_id"), "size").distinct()
    held = _edge_cells(both.join(grids, ["side", "poly_id"]), size, pad).select(
        F.col("side").alias("big_side"), F.col("poly_id").alias("big"), "cx", "cy", *[F.col(c).alias(f"b{c}") for c in EDGE]
    )
    window = (F.col("bx1") - pad, F.col("bx2") + pad, F.col("by1") - pad, F.col("by2") + pad)
    visits = _edge_cells(both.join(pairs, ["side", "poly_id"]), size, size * 1e-9, window).select(
        "left_id", "right_id", "big_side", "big", "cx", "cy", *[F.col(c).alias(f"a{c}") for c in EDGE]
    )
    return visits.join(held, ["big_side", "big", "cx", "cy"]).drop("big_side", "big", "cx", "cy")


def polygons_within(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """(left_id, right_id) of polygons at most `reach` apart, containment included.

    Stands for the intersection of `left` with `right` buffered by `reach`. Pairs of boxes that are farther apart are
    dropped and pairs with two outermost vertices within reach are taken; only edges of the others are compared.
    """
    left, right = (
        materialize(df.select("poly_id", *[c for c in ("part", "ring") if c in df.columns], *EDGE)) for df in (left, right)
    )
    outlines = [materialize(_outlines(df, tag)) for df, tag in ((left, "left"), (right, "right"))]
    pairs = materialize(box_pairs(*outlines, reach).withColumn("sure", _sure(reach)))
    taken, undecided = pairs.where("sure").select("left_id", "right_id"), pairs.where("NOT sure")
    seg = [tuple(F.col(f"{tag}{k}") for k in EDGE) for tag in ("a", "b")]
    close = edge_pairs(undecided, left, right, reach).where(geo.segments_distance(*seg) <= reach).select("left_id", "right_id")

    def corner(df, tag):
        # One vertex of every ring of every part: a part inside the other polygon meets none of its edges.
        rings = [c for c in ("part", "ring") if c in df.columns]
        open_ids = undecided.select(F.col(f"{tag}_id").alias("poly_id")).distinct()
        return df.join(open_ids, "poly_id", "left_semi").groupBy("poly_id", *rings).agg(F.min(F.struct("x1", "y1")).alias("v")).select(
            F.struct("poly_id", *rings).alias("point_id"), F.col("v.x1").alias("x"), F.col("v.y1").alias("y")
        )

    left_in = point_in_polygon(corner(left, "left"), right, "intersects").select(
        F.col("point_id.poly_id").alias("left_id"), F.col("poly_id").alias("right_id")
    )
    right_in = point_in_polygon(corner(right, "right"), left, "intersects").select(
        F.col("poly_id").alias("left_id"), F.col("point_id.poly_id").alias("right_id")
    )
    found = close.unionByName(left_in).unionByName(right_in).unionByName(taken)
    return found.distinct()


def school_counts(buildings: DataFrame, schools: DataFrame, good: DataFrame, reach: float) -> DataFrame:
    """Distinct schools, and good ones, within `reach` of each building; 0 where none.

    `good` has (poly_id, is_good_school).
    """
    pairs = polygons_within(buildings, schools, reach).join(
        good.select(F.col("poly_id").alias("right_id"), "is_good_school"), "right_id"
    )
    counts = pairs.groupBy(F.col("left_id").alias("poly_id")).agg(
        F.count("*").alias("n"), F.sum(F.col("is_good_school").cast("int")).alias("g")
    )
    return buildings.select("poly_id").distinct().join(counts, "poly_id", "left").select(
        "poly_id", F.coalesce("n", F.lit(0)).cast("long").alias("school_count"),
        F.coalesce("g", F.lit(0)).cast("long").alias("good_school_count"),
    )


def school_component(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Of each multi-part polygon the part to keep: (poly_id, part).

    The part that covers the school point, the largest if several; else the nearest;
    without a point, the largest. `edges` has poly_id and part, `points` (poly_id, x, y).
    """
    parts = polygon_area(edges, ["poly_id", "part"])
    joined = edges.join(points.select("poly_id", "x", "y"), "poly_id")
    seg = [F.col(k) for k in EDGE]
    p = (F.col("x"), F.col("y"))
    facts = joined.groupBy("poly_id", "part").agg(
        (F.sum(geo.crosses_ray(*p, *seg).cast("int")) % 2 == 1).alias("odd"),
        F.max(geo.on_segment(*p, *seg)).alias("on_edge"),
        F.min(geo.point_segment_distance(*p, *seg)).alias("d"),
    )
    both = parts.join(facts, ["poly_id", "part"], "left")
    covers = F.coalesce(F.col("odd") | F.col("on_edge"), F.lit(False))
    order = [
        (~covers).alias("a"), F.when(covers, 0.0).otherwise(F.coalesce("d", F.lit(0.0))).alias("b"),
        (-F.col("area")).alias("c"), F.col("part").alias("e"),
    ]
    return first_per_key(both, ["poly_id"], order).select("poly_id", "part", "area")


def names_covering(points: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Sorted names of the areas each point lies within, joined by ', ' ('' when none)."""
    hits = point_in_polygon(points, edges, "within").join(names, "poly_id").select("point_id", "name").distinct()
    lists = hits.groupBy("point_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return points.select("point_id").join(lists, "point_id", "left").select(
        "point_id", F.coalesce("names", F.lit("")).alias("names")
    )
