import json

from estatelens.sources import files, html
from pyspark.sql import functions as F


def test_feature_collection(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"BLK_NO": "12A", "OBJECTID": 7}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"BLK_NO": None, "OBJECTID": 8}, "geometry": {"type": "Point", "coordinates": [103.8, 1.3]}},
    ]}
    path = tmp_path / "layer.geojson"
    path.write_text(json.dumps(doc))
    props = "struct<BLK_NO: string, OBJECTID: long>"
    polygons = files.read_geojson(spark, str(path), props, "Polygon")
    assert [r.BLK_NO for r in polygons.collect()] == ["12A"]
    edges = files.polygon_edges(polygons, ["OBJECTID"])
    assert edges.count() == 7
    assert edges.where("ring = 0 and seq = 1").select("x1", "y1", "x2", "y2").first() == (0.0, 0.0, 4.0, 0.0)
    x, y = files.point_coordinates()
    assert files.read_geojson(spark, str(path), props, "Point").select(x, y).first() == (103.8, 1.3)


def test_description_field(spark):
    text = "<tr><th>LIC_NAME</th> <td><b>Shop A\\/B</b></td></tr><tr><th>POSTCODE</th><td> </td></tr>"
    row = spark.range(1).select(
        html.description_field(F.lit(text), "LIC_NAME").alias("a"), html.description_field(F.lit(text), "POSTCODE").alias("b")
    ).first()
    assert row == ("Shop A/B", None)


def test_csv_keeps_quotes_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1.5), (None, None)], "s string, v double")
    files.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "c"), "s string, v double").collect()} == {('a "b", c', 1.5), (None, None)}
