"""Point-in-polygon joins against brute force, and their plans."""

from __future__ import annotations

import contextlib
import io
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataweave.functions.geometry import EDGES, even_odd, inside, rectangle, with_box
from strataweave.operators.spatial import (
    Box,
    as_box,
    clip_points,
    crop_polygons,
    join_polygons,
    layer_bbox,
    make_points,
    reproject_box,
    reproject_polygons,
    within_any,
    zone_join,
)


def ring(*corners):
    closed = list(corners) + [corners[0]]
    return [(*map(float, a), *map(float, b)) for a, b in zip(closed, closed[1:])]


SHAPES = {
    "hole": ring((0, 0), (4, 0), (4, 4), (0, 4)) + ring((1, 1), (3, 1), (3, 3), (1, 3)),
    "parts": ring((10, 0), (12, 0), (12, 2), (10, 2)) + ring((14, 0), (16, 0), (16, 2), (14, 2)),
    "left": ring((0, 10), (2, 10), (2, 12), (0, 12)),
    "right": ring((2, 10), (4, 10), (4, 12), (2, 12)),
    "tri": ring((20, 0), (24, 0), (20, 4)),
    "bow": ring((30, 0), (36, 1), (31, 3), (38, 6), (29, 8), (33, 4)),
}


@pytest.fixture(scope="module")
def layer(spark):
    df = spark.createDataFrame(list(SHAPES.items()), f"name string, edges {EDGES.simpleString()}")
    return with_box(df)


def points(spark, coordinates):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(coordinates)], "id int, x double, y double")


def brute(spark, pts, layer, boundary=True):
    pairs = pts.crossJoin(layer)
    return rows(pairs.filter(inside("x", "y", "edges", boundary)), "id", "name")


KNOWN = [(0.5, 0.5), (2, 2), (1, 2), (4, 4), (11, 1), (13, 1), (15, 1), (2, 11), (1, 11), (20, 0), (22, 2), (21, 1), (23, 3), (50, 50)]


def test_known_answers(spark, layer):
    pts = points(spark, KNOWN)
    got = rows(zone_join(pts, layer), "id", "name")
    assert got == sorted(
        [(0, "hole"), (2, "hole"), (3, "hole"), (4, "parts"), (6, "parts"), (7, "left"), (7, "right"), (8, "left"), (9, "tri"), (10, "tri"), (11, "tri")],
        key=repr,
    )
    assert rows(within_any(pts, layer), "id") == sorted([(0,), (4,), (6,), (8,), (11,)], key=repr)
    assert rows(clip_points(pts, layer), "id") == sorted([(i,) for i in (0, 2, 3, 4, 6, 7, 8, 9, 10, 11)], key=repr)


@pytest.mark.parametrize("boundary", [True, False])
@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "hot_rows": 20}, {"bin_size": (0.3, 5.0)}])
def test_equals_brute_force(spark, layer, boundary, options):
    rng = random.Random(3)
    crowd = [(0.4 + rng.random() / 50, 0.4 + rng.random() / 50) for _ in range(300)]
    spread = [(rng.uniform(-2, 40), rng.uniform(-2, 14)) for _ in range(600)]
    lattice = [(x / 2, y / 2) for x in range(-1, 80) for y in range(-1, 26)]
    pts = points(spark, crowd + spread + lattice)
    want = brute(spark, pts, layer, boundary)
    assert rows(join_polygons(pts, layer, boundary=boundary, **options), "id", "name") == want
    ids = sorted({(i,) for i, _ in want}, key=repr)
    assert rows(join_polygons(pts, layer, "left_semi", boundary, **options), "id") == ids
    assert join_polygons(pts, layer, "left_anti", boundary, **options).count() == pts.count() - len(ids)
    assert join_polygons(pts, layer, "left", boundary, **options).count() == pts.count() - len(ids) + len(want)


def test_country_and_crop(spark, layer):
    country = with_box(spark.createDataFrame([("c",)], "state string").withColumn("edges", rectangle(0, 0, 13, 20)))
    pts = points(spark, KNOWN)
    assert rows(zone_join(pts, layer, country), "id", "name") == [(i, n) for i, n in brute(spark, pts, layer) if i not in (6, 9, 10, 11)]
    cropped = crop_polygons(layer, Box(0, 0, 11, 11))
    assert rows(cropped, "name") == [("hole",), ("left",), ("parts",), ("right",)]
    assert as_box(layer_bbox(cropped)) == Box(0, 0, 11, 11)
    assert rows(zone_join(pts, cropped), "id", "name") == [
        (i, n) for i, n in brute(spark, pts, layer) if KNOWN[i][0] <= 11 and KNOWN[i][1] <= 11
    ]


def test_empty_layer_and_missing_coordinates(spark, layer):
    pts = points(spark, KNOWN)
    assert zone_join(pts, layer.filter("false")).count() == 0
    assert join_polygons(pts, layer.filter("false"), "left_anti").count() == len(KNOWN)
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "k string, lon double, lat double")
    assert rows(make_points(df, "lon", "lat", "drop"), "k", "x") == [("a", 1.0)]
    with pytest.raises(Exception, match="missing coordinate"):
        make_points(df, "lon", "lat").collect()


def test_reproject_box(spark):
    box = reproject_box(spark, Box(-78.0, 37.8, -74.5, 44.5), "EPSG:4326", "EPSG:5070")
    assert box.xmin < 1600000 < box.xmax and box.ymin < 2000000 < box.ymax


def test_reproject_polygons_without_a_key(spark):
    twice = with_box(spark.createDataFrame([("a", 0), ("a", 5)], "code string, at int").withColumn("edges", rectangle(-100, 30, -99, 31)))
    got = reproject_polygons(twice, "EPSG:4326", "EPSG:5070").collect()
    assert [len(r["edges"]) for r in got] == [4, 4] and sorted(r["at"] for r in got) == [0, 5]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_plans(spark, layer, tmp_path):
    points(spark, KNOWN).write.parquet(str(tmp_path / "pts"))
    pts = spark.read.parquet(str(tmp_path / "pts"))
    broadcast = plan(zone_join(pts, layer))
    assert "BroadcastHashJoin" in broadcast and "NestedLoop" not in broadcast and "EvalPython" not in broadcast
    assert "PushedFilters" in broadcast and "GreaterThanOrEqual(x,0.0)" in broadcast and "LessThanOrEqual(y,12.0)" in broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = plan(zone_join(pts, layer, broadcast_limit=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in shuffled and "NestedLoop" not in shuffled and "Cartesian" not in shuffled


def test_stream_of_points(spark, layer, tmp_path):
    points(spark, KNOWN).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, x double, y double").parquet(str(tmp_path / "in"))
    query = zone_join(stream, layer).writeStream.format("memory").queryName("tagged").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.table("tagged"), "id", "name") == brute(spark, points(spark, KNOWN), layer)


def test_even_odd_is_half_open(spark, layer):
    pts = points(spark, [(20, 0), (22, 2)]).crossJoin(layer.filter("name = 'tri'"))
    assert [r[0] for r in pts.orderBy("id").select(F.expr(even_odd("x", "y", "edges"))).collect()] == [True, False]
