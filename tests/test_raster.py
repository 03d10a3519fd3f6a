"""Cell lookup, buffers, masks, zones and resampling against brute force."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataweave.functions.crs import ALBERS, reproject
from strataweave.functions.geometry import rectangle, with_box
from strataweave.operators.raster import (
    Grid,
    buffer_stats,
    crop_raster,
    extract_points,
    mask_raster,
    raster_rescale,
    read_grids,
    warp_bilinear,
    warp_grid,
    zone_values,
)
from strataweave.operators.spatial import Box
from strataweave.plans.climate import climate_by_site
from strataweave.sources.rasters import read_raster, write_raster

GRID = Grid("clay", 0.0, 2000.0, 250.0, 250.0, 8, 8, ALBERS)
MISSING = {(0, 0), (3, 3), (7, 7)}


def value(r, c):
    return None if (r, c) in MISSING else 10.0 * (r + c)


def centre(r, c):
    return c * 250.0 + 125.0, 2000.0 - r * 250.0 - 125.0


@pytest.fixture(scope="module")
def cells(spark):
    data = [("clay", r, c, *centre(r, c), value(r, c)) for r in range(8) for c in range(8)]
    return spark.createDataFrame(data, "raster_id string, row int, col int, x double, y double, value double")


def points(spark, coordinates):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(coordinates)], "id int, x double, y double")


EDGE_POINTS = [(0, 2000), (2000, 0), (2000, 2000), (250, 1750), (125, 125), (-1, 5), (5, 2001), (900, 1100), (1999, 1)]


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "hot_rows": 3}])
def test_extract(spark, cells, options):
    pts = points(spark, EDGE_POINTS + [(1500 + i, 300) for i in range(20)])

    def expected(x, y):
        if not (0 <= x <= 2000 and 0 <= y <= 2000):
            return None
        return value(min(int((2000 - y) // 250), 7), min(int(x // 250), 7))

    got = {r["id"]: r["value"] for r in extract_points(pts, cells, GRID, **options).collect()}
    assert got == {r["id"]: expected(r["x"], r["y"]) for r in pts.collect()}


def near(x, y, radius):
    return [(r, c) for r in range(8) for c in range(8) if math.dist((x, y), centre(r, c)) <= radius]


@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "hot_rows": 5}])
@pytest.mark.parametrize("radius", [130.0, 600.0, 1000.0])
def test_buffer(spark, cells, radius, options):
    rng = random.Random(1)
    crowd = [(1000 + rng.random(), 900 + rng.random()) for _ in range(40)]
    where = [(rng.uniform(-600, 2600), rng.uniform(-600, 2600)) for _ in range(60)] + crowd + [(500.0, 500.0)] * 3
    got = {r["id"]: r for r in buffer_stats(points(spark, where), cells, radius, **options).collect()}
    assert len(got) == len(where)
    for i, (x, y) in enumerate(where):
        found = [value(*rc) / 10 for rc in near(x, y, radius) if value(*rc) is not None]
        assert got[i]["sg_count"] == len(found)
        assert got[i]["sg_mean"] == (pytest.approx(statistics.fmean(found)) if found else None)
        assert got[i]["sg_sd"] == (pytest.approx(statistics.stdev(found), abs=1e-9) if len(found) > 1 else None)


def test_buffer_grows_with_radius_and_touched(spark, cells):
    pts = points(spark, [(1000.0, 1000.0)])
    counts = [buffer_stats(pts, cells, r).first()["sg_count"] for r in (100, 200, 500, 900, 3000)]
    assert counts == sorted(counts) and counts[0] == 0 and counts[-1] == 61
    touched = buffer_stats(pts, cells, 100, empty="touched", grid=GRID).first()
    assert touched["sg_count"] == 3 + (value(3, 3) is not None) and touched["sg_mean"] == pytest.approx(
        statistics.fmean(v / 10 for v in (value(3, 4), value(4, 3), value(4, 4)))
    )
    assert buffer_stats(pts, cells, 500, stat="median", scale=1).first()["sg_mean"] is not None


@pytest.fixture(scope="module")
def zones(spark):
    data = spark.createDataFrame([("a", 0.0, 0.0, 1000.0, 2000.0), ("b", 1000.0, 0.0, 2000.0, 600.0)], "code string, p double, q double, r double, s double")
    west = data.filter("code = 'a'").select("code").withColumn("edges", rectangle(0, 0, 1000, 2000))
    east = data.filter("code = 'b'").select("code").withColumn("edges", rectangle(1000, 0, 2000, 600))
    return with_box(west.unionByName(east))


def test_mask_and_crop(spark, cells, zones):
    east = zones.filter("code = 'b'")
    inside = {(r, c) for r in range(8) for c in range(8) if centre(r, c)[0] >= 1000 and centre(r, c)[1] <= 600}
    masked = {(r["row"], r["col"]): r["value"] for r in mask_raster(cells, east).collect()}
    assert len(masked) == 64 and all(masked[k] == (value(*k) if k in inside else None) for k in masked)
    assert rows(mask_raster(cells, east, keep_outside=False), "row", "col") == sorted(inside, key=repr)
    touched = {(r["row"], r["col"]) for r in mask_raster(cells, east, GRID, keep_outside=False).collect()}
    want = {(r, c) for r in range(8) for c in range(8) if centre(r, c)[0] + 125 >= 1000 and centre(r, c)[1] - 125 <= 600}
    assert touched == want
    assert crop_raster(cells, east).count() == len(inside)
    assert raster_rescale(cells).filter("row = 1 and col = 1").first()["value"] == 2.0


def test_zone_values(spark, cells, zones):
    want = {("a", value(r, c)) for r in range(8) for c in range(4) if value(r, c) is not None}
    want |= {("b", value(r, c)) for r in range(8) for c in range(4, 8) if centre(r, c)[1] <= 600 and value(r, c) is not None}
    assert rows(zone_values(cells, zones), "zone", "value") == sorted(want, key=repr)
    assert rows(zone_values(cells, zones, max_zones=1), "zone", "value") == sorted((w for w in want if w[0] == "a"), key=repr)
    assert zone_values(cells, zones, distinct=False).count() > len(want)


def test_warp_identity_and_shift(spark, cells):
    same = {(r["row"], r["col"]): r["value"] for r in warp_bilinear(cells, GRID, GRID).collect()}
    assert same == {(r, c): value(r, c) for r in range(8) for c in range(8) if value(r, c) is not None}
    half = Grid("half", 125.0, 1875.0, 250.0, 250.0, 7, 7, ALBERS)
    shifted = {(r["row"], r["col"]): r["value"] for r in warp_bilinear(cells, GRID, half).collect()}
    for r, c in shifted:
        known = [value(r + a, c + b) for a in (0, 1) for b in (0, 1) if value(r + a, c + b) is not None]
        assert shifted[r, c] == pytest.approx(statistics.fmean(known))


def test_store_and_window(spark, cells, tmp_path):
    path = str(tmp_path / "r")
    write_raster(cells, path, tile=4)
    assert read_raster(spark, path, "clay").count() == 64
    window = read_raster(spark, path, "clay", Box(0, 0, 500, 500))
    assert rows(window, "row", "col") == sorted([(r, c) for r in (6, 7) for c in (0, 1)], key=repr)
    header = spark.createDataFrame([("clay", 0.0, 2000.0, 250.0, 250.0, 8, 8, ALBERS)], "raster_id string, xmin double, ymax double, xres double, yres double, nrow int, ncol int, crs string")
    assert read_grids(header) == {"clay": GRID}


def test_climate(spark, cells):
    monthly = cells.select("row", "col", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).withColumn(
        "value", F.expr("case when row = 0 and month > 6 then null else row + month end").cast("double")
    )
    pts = points(spark, [(10.0, 1990.0), (10.0, 10.0), (-5.0, 0.0)]).withColumnRenamed("id", "site")
    got = climate_by_site(pts, "site", ALBERS, monthly, monthly, GRID)
    annual = {r["place"]: (r["MAT"], r["MAP"], r["ID"]) for r in got.annual.collect()}
    assert annual == {0: (3.5, 42.0, 1), 1: (13.5, 162.0, 2), 2: (None, None, 3)}
    assert got.monthly_prec.filter("place = 1").count() == 12


def test_climate_of_a_place_with_two_points(spark, cells):
    monthly = cells.select("raster_id", "row", "col", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), F.col("row").cast("double").alias("value"))
    pts = spark.createDataFrame([("p", 10.0, 1990.0), ("p", 10.0, 10.0)], "site string, x double, y double")
    got = climate_by_site(pts, "site", ALBERS, monthly, monthly, GRID)
    assert rows(got.annual, "place", "MAT", "MAP") == [("p", 0.0, 0.0), ("p", 7.0, 84.0)]
    assert rows(got.monthly_temp.select("ID", "raster_id").distinct(), "ID", "raster_id") == [(1, "clay"), (2, "clay")]


def test_layers_of_one_table(spark, cells):
    both = cells.unionByName(cells.withColumns({"raster_id": F.lit("other"), "value": F.col("value") + 1000}))
    pts = points(spark, [(900, 1100)])
    assert rows(extract_points(pts, both, GRID), "value") == rows(extract_points(pts, cells, GRID), "value")
    assert extract_points(pts, both, GRID, keep=["raster_id"]).count() == 2
    one = buffer_stats(pts, both, 400.0, layer="clay").first()
    assert one == buffer_stats(pts, cells, 400.0).first()
    with pytest.raises(Exception, match="several layers"):
        buffer_stats(pts, both, 400.0).collect()
    half = Grid("half", 125.0, 1875.0, 250.0, 250.0, 7, 7, ALBERS)
    near = lambda df: sorted((r["row"], r["col"], round(r["value"], 9)) for r in df.collect())
    assert near(warp_bilinear(both, GRID, half)) == near(warp_bilinear(cells, GRID, half))
    masked = mask_raster(both, with_box(spark.createDataFrame([("z",)], "z string").withColumn("edges", rectangle(0, 0, 1000, 1000))))
    assert masked.count() == 128 and masked.filter("value is not null").count() == 2 * 16


def test_warp_grid_covers_the_source(spark):
    source = Grid("g", -125.0, 49.0, 1.0, 1.0, 25, 59)
    box = warp_grid(spark, source, ALBERS).box
    centres = reproject(source.cells(spark), "EPSG:4326", ALBERS)
    assert centres.filter(~box.holds()).count() == 0


def test_touched_zone_cells(spark, cells):
    sliver = with_box(spark.createDataFrame([("s",)], "code string").withColumn("edges", rectangle(10, 10, 20, 1990)))
    assert zone_values(cells, sliver).count() == 0
    assert zone_values(cells, sliver, grid=GRID, distinct=False).count() == 7
