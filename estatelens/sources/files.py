"""Readers and writers for CSV, JSON and GeoJSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str, schema, columns: list[str] | None = None) -> DataFrame:
    """Headed CSV with a declared schema; only `columns` are parsed when given."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema=None, multiline: bool = True) -> DataFrame:
    """A JSON object, or a list of records, per file."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json_records(df: DataFrame, path: str) -> None:
    df.write.json(path)


# Coordinates keep their text form until the geometry type is known.
_FEATURE = "type string, properties {p}, geometry struct<type: string, coordinates: string>"


def read_geojson(
    spark: SparkSession, path: str, properties: str, geometry: str, one_per_line: bool = False
) -> DataFrame:
    """Features of one geometry type as rows of properties and `coordinates`.

    `properties` is a DDL struct. A FeatureCollection is read whole, file by file; large
    layers should be written with one feature per line and read with `one_per_line`.
    """
    feature = _FEATURE.format(p=properties)
    if one_per_line:
        rows = spark.read.schema(feature).json(path)
    else:
        rows = spark.read.schema(f"type string, features array<struct<{feature}>>").option("multiLine", True).json(path).select(
            F.explode("features").alias("f")
        ).select("f.*")
    shape = {
        "Point": "array<double>",
        "Polygon": "array<array<array<double>>>",
        "MultiPolygon": "array<array<array<array<double>>>>",
    }[geometry]
    return rows.where(F.col("geometry.type") == geometry).select(
        "properties.*", F.from_json("geometry.coordinates", shape).alias("coordinates")
    )


def write_geojson(df: DataFrame, path: str, properties: list[str], geometry_type: str, coordinates: str) -> None:
    """One feature per line; array properties stay JSON lists."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        F.struct(F.lit(geometry_type).alias("type"), F.col(coordinates).alias("coordinates")).alias("geometry"),
    )
    df.select(F.to_json(feature).alias("value")).write.text(path)


def point_coordinates(c: str = "coordinates") -> tuple[Column, Column]:
    """(longitude, latitude) of a Point."""
    return F.get(F.col(c), F.lit(0)), F.get(F.col(c), F.lit(1))


def multipolygon_edges(df: DataFrame, keys: list[str], coordinates: str = "coordinates") -> DataFrame:
    """MultiPolygon rows to an edge table: keys, part, ring, seq, x1, y1, x2, y2."""
    return polygon_edges(df.select(*keys, F.posexplode(coordinates).alias("part", "rings")), [*keys, "part"], "rings")


def polygon_edges(df: DataFrame, keys: list[str], coordinates: str = "coordinates") -> DataFrame:
    """Polygon rows to an edge table: keys, ring, seq, x1, y1, x2, y2. Ring 0 is the shell, others are holes."""
    rings = df.select(*keys, F.posexplode(coordinates).alias("ring", "r"))
    size = F.size("r")
    points = rings.where(size > 1).select(*keys, "ring", "r", F.explode(F.sequence(F.lit(1), size - 1)).alias("seq"))

    def at(offset: int, axis: int) -> Column:
        return F.get(F.get(F.col("r"), F.col("seq") + offset), F.lit(axis))

    return points.select(
        *keys, "ring", "seq", at(-1, 0).alias("x1"), at(-1, 1).alias("y1"), at(0, 0).alias("x2"), at(0, 1).alias("y2")
    )
