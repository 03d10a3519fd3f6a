"""Polygon layers from GeoJSON lines or Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.functions.geometry import EDGES, with_box

# GeoJSON nesting of a polygon and of a multi-part polygon.
_RINGS = "array<array<array<double>>>"
_PARTS = "array<array<array<array<double>>>>"


def _ring_edges(ring: Column) -> Column:
    """Edges of one ring; it is closed if its last corner does not repeat the first."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    closed = F.when(first == last, ring).otherwise(F.concat(ring, F.array(first)))
    count = F.size(closed) - 1

    def edge(i: Column) -> Column:
        a, b = F.get(closed, i), F.get(closed, i + 1)
        x1, y1, x2, y2 = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), edge)).otherwise(F.array().cast(EDGES))


def parse_geojson(features: DataFrame, properties: Mapping[str, str], text: str = "value") -> DataFrame:
    """Polygon table from one GeoJSON feature per row.

    ``properties`` maps attribute names to Spark types. Polygon and MultiPolygon are read; any
    other feature has no edges and is dropped.
    """
    props = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in properties.items()])

    def outline(coordinates: str) -> T.StructType:
        geometry = T.StructType(
            [T.StructField("type", T.StringType()), T.StructField("coordinates", T.DataType.fromDDL(coordinates))]
        )
        return T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])

    parsed = features.select(
        F.from_json(text, outline(_RINGS)).alias("one"), F.from_json(text, outline(_PARTS)).alias("many")
    )
    rings = F.when(F.col("one.geometry.type") == "Polygon", F.col("one.geometry.coordinates")).when(
        F.col("one.geometry.type") == "MultiPolygon", F.flatten("many.geometry.coordinates")
    )
    attributes = [F.coalesce(F.col(f"one.properties.`{n}`"), F.col(f"many.properties.`{n}`")).alias(n) for n in properties]
    rows = parsed.select(*attributes, rings.alias("_rings")).filter(F.size("_rings") > 0)
    edges = F.flatten(F.transform("_rings", _ring_edges)).cast(EDGES)
    return with_box(rows.select(*properties, edges.alias("edges")))


def read_geojson_lines(spark: SparkSession, path: str, properties: Mapping[str, str]) -> DataFrame:
    return parse_geojson(spark.read.text(path), properties)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon layer stored as Parquet with ``edges`` (and boxes, added if absent)."""
    layer = spark.read.parquet(path)
    return layer if "xmin" in layer.columns else with_box(layer)


def edge_rows(polygons: DataFrame, *key: str) -> DataFrame:
    """One row per edge with its position."""
    return polygons.select(*key, F.posexplode("edges").alias("edge", "_e")).select(*key, "edge", "_e.*")
