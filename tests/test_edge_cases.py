"""Inputs that the sample views never produce."""

import math

import pytest
from pyspark.sql import functions as F

from estatelens import scratch
from estatelens.operators import gram as L, quantiles as Q, spatial as G
from estatelens.sources import files, html


def square(poly, cx, cy, h, part=0, ring=0, reverse=False):
    p = [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h), (cx - h, cy - h)]
    p = p[::-1] if reverse else p
    return [(poly, part, ring, k, *map(float, (*p[k - 1], *p[k]))) for k in range(1, 5)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "poly_id int, part int, ring int, seq int, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("hole_reversed", [False, True])
@pytest.mark.parametrize("part_reversed", [False, True])
def test_area_of_any_winding(spark, hole_reversed, part_reversed):
    e = edges(spark, square(1, 0, 0, 2) + square(1, 0, 0, 1, ring=1, reverse=hole_reversed) + square(1, 9, 9, 1, part=1, reverse=part_reversed))
    assert G.polygon_area(e, ["poly_id"]).first().area == 16 - 4 + 4
    assert {r.part: r.area for r in G.polygon_area(e, ["poly_id", "part"]).collect()} == {0: 12, 1: 4}


def test_contained_part_is_within(spark):
    left = edges(spark, square(1, 500, 500, 1) + square(1, 0, 0, 1, part=1))
    right = edges(spark, square(7, 0, 0, 50))
    got = [tuple(r) for r in G.polygons_within(left, right, 5).collect()]
    assert got == [(1, 7)]
    assert [tuple(r) for r in G.polygons_within(right, left, 5).collect()] == [(7, 1)]


def test_radius_band_holds_interior_points(spark):
    e = edges(spark, square(1, 0, 0, 2000))
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 2050.0, 0.0), (3, 1990.0, 0.0), (4, 2700.0, 0.0)], "point_id int, x double, y double")
    got = {r.point_id: (r.signed_distance_m, r.inside) for r in G.signed_band_of_radius(points, e, 100, 500).collect()}
    assert got == {1: (-100.0, 1), 2: (-50.0, 1), 3: (-100.0, 1)}
    assert {r.point_id for r in G.signed_band_of_radius(points, e, 100, 60).collect()} == {2}


def test_multipolygon_edges(spark, tmp_path):
    path = str(tmp_path / "m.json")
    ring = "[[0,0],[4,0],[4,4],[0,4],[0,0]]"
    text = f'{{"type":"Feature","properties":{{"name":"a"}},"geometry":{{"type":"MultiPolygon","coordinates":[[{ring},[[1,1],[1,2],[2,2],[2,1],[1,1]]],[{ring}]]}}}}'
    spark.createDataFrame([(text,)], "value string").write.text(path)
    e = files.multipolygon_edges(files.read_geojson(spark, path, "struct<name: string>", "MultiPolygon", True), ["name"])
    assert e.count() == 12 and {r.part: r.area for r in G.polygon_area(e, ["name", "part"]).collect()} == {0: 15, 1: 16}


def test_label_without_data_is_missing(spark):
    def item(title, data=None):
        return f'<p class="info-title">{title}</p>' + (f'<p class="info-data">{data}</p>' if data else "")

    page = spark.createDataFrame([(item("Applicants") + item("Vacancies", 30),)], "h string")
    got = page.select(html.label_value(F.col("h"), "Applicants"), html.label_value(F.col("h"), "Vacancies")).first()
    assert tuple(got) == (None, "30")


def test_summary_of_nothing_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (3.0,), (None,)], "x double")
    assert Q.summarize(df, [], "x", {"median": 0.5}).first()["count"] == 2
    none = df.where("x > 99 and x < 100")
    for quantiles in ({}, {"median": 0.5}):
        assert [r["count"] for r in Q.summarize(none, [], "x", quantiles).collect()] == [0]


def test_chunks_do_not_depend_on_row_order(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_CHUNK", 7)
    rows = [(k % 3, float(k), float(k * k)) for k in range(200)]
    deals = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "g int, a double, y double").repartition(2)
        dealt = L.chunked(df, ["g"], L.chunk_sizes(df, ["g"])).toPandas()
        deals.append(dealt.sort_values("a")["__chunk"].tolist())
    assert deals[0] == deals[1] and len(set(deals[0])) > 5


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        scratch.scratch_dir(Session())


def test_discard_deletes_only_scratch(spark, tmp_path):
    df = scratch.materialize(spark.range(10).toDF("x"))
    own = str(tmp_path / "own")
    df.write.parquet(own)
    scratch.discard(df, spark.read.parquet(own))
    assert spark.read.parquet(own).count() == 10
    with pytest.raises(Exception):
        df.count()


def test_large_groups_are_dealt_in_small_chunks(spark):
    sizes = L.chunk_sizes(spark.range(120_000).select(F.lit(1).alias("g")), ["g"])
    assert sizes.first()["__chunks"] >= 3


def test_cross_products_shuffle_sums_only(spark):
    from estatelens.plans.equations import cross_products, dummy, term

    rows = spark.createDataFrame([(1, 2.0, 3.0, "a"), (1, 5.0, -1.0, "b"), (1, 4.0, 2.0, None), (2, 1.0, 1.0, "a"), (3, 1.0, 1.0, "a")], "g int, y double, v double, c string")
    rows = rows.select("g", "y", F.lit(2.0).alias("w"), F.array(term("Intercept", F.lit(1.0)), term("v", F.col("v")), dummy("c")).alias("x"))
    coefs = spark.createDataFrame([(1, "Intercept", 1.0), (1, "v", 0.5), (1, "C(c)[T.b]", 2.0), (2, "v", 1.0), (2, "none", 1.0)], "g int, term string, coef double")
    out = cross_products(rows, ["g"], coefs)
    # Residuals of group 1: -0.5, 2.5 and 2; of group 2: 0.
    assert {(r.g, r.term): r.cross for r in out.collect()} == {(1, "Intercept"): 8.0, (1, "v"): 0.0, (1, "C(c)[T.b]"): 5.0, (2, "v"): 0.0}
    plan = cross_products(rows, ["g"], coefs)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") > plan.rindex("HashAggregate") and "Join" not in plan[:plan.index("Generate")]
