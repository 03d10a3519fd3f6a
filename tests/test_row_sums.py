"""Circle statistics from running sums against every cell, and against the joined cells."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strataweave.functions.crs import ALBERS
from strataweave.operators import row_sums
from strataweave.operators.raster import Grid, buffer_stats
from strataweave.plans.comparison import buffer_comparison

GRID = Grid("g", 100.0, 900.0, 7.0, 11.0, 40, 90, ALBERS)
WIDE = Grid("g", 100.0, 900.0, 7.0, 2.0, 40, 90, ALBERS)


def value(r, c):
    return None if (r * 7 + c * 3) % 11 == 0 or r == 9 else 1e6 + ((r * 31 + c * 17) % 101) / 100


@pytest.fixture(scope="module")
def cells(spark):
    """Some cells have no value, and some are not there at all."""
    at = GRID.cells(spark).filter("(row + col) % 13 <> 0").select(F.lit("g").alias("raster_id"), "*")
    rows = [(r, c, value(r, c)) for r in range(GRID.nrow) for c in range(GRID.ncol)]
    return at.join(spark.createDataFrame(rows, "row int, col int, value double"), ["row", "col"]).select("raster_id", "row", "col", "x", "y", "value")


@pytest.fixture(scope="module")
def where(spark):
    rng = random.Random(2)
    spots = [(rng.uniform(50, 800), rng.uniform(400, 950)) for _ in range(60)] + [(103.5, 894.5), (103.5, 894.5), (103.5 + 21, 894.5 - 22)]
    rows = [(i, x, y, "a" if i % 2 else "b") for i, (x, y) in enumerate(spots)] + [(97, None, 5.0, "a"), (98, 5.0, None, "a"), (99, -900.0, 0.0, "b")]
    return spark.createDataFrame(rows, "id int, x double, y double, kind string")


def expected(cells, x, y, radius, scale):
    if x is None or y is None:
        return None, 0, None
    near = [v / scale for cx, cy, v in cells if v is not None and (cx - x) * (cx - x) + (cy - y) * (cy - y) <= radius * radius]
    return (statistics.fmean(near) if near else None), len(near), (statistics.stdev(near) if len(near) > 1 else None)


@pytest.mark.parametrize("block", [1024, 16])
@pytest.mark.parametrize("radius", [3.0, 21.0, 22.0, 130.0, 5000.0])
def test_circles(cells, where, radius, block, monkeypatch):
    monkeypatch.setattr(row_sums, "SUM_BLOCK", block)
    raw = [(r.x, r.y, r.value) for r in cells.collect()]
    got = {r["id"]: r for r in buffer_stats(where, cells, radius, lattice=GRID, hot_rows=5 if block == 16 else None).collect()}
    assert len(got) == where.count()
    for p in where.collect():
        mean, n, sd = expected(raw, p.x, p.y, radius, 10.0)
        r = got[p["id"]]
        assert r["sg_count"] == n and r["kind"] == p["kind"]
        assert (r["sg_mean"] is None) == (mean is None) and (mean is None or math.isclose(r["sg_mean"], mean, rel_tol=1e-13))
        assert (r["sg_sd"] is None) == (sd is None) and (sd is None or math.isclose(r["sg_sd"], sd, rel_tol=1e-6, abs_tol=1e-9))


def test_cells_wider_than_high(cells, where):
    """The running sums go down the columns."""
    flat = cells.withColumn("y", WIDE.y_of())
    key = lambda df: sorted((r["id"], r["sg_count"], r["sg_mean"] and round(r["sg_mean"], 6)) for r in df.collect())
    one = key(buffer_stats(where, flat, 30.0, lattice=WIDE))
    assert one == key(buffer_stats(where, flat, 30.0)) and sum(r[1] for r in one) > 500


def test_sections_in_one_pass(spark, cells, where):
    other = cells.withColumns({"raster_id": F.lit("o"), "value": F.col("value") * 2})
    parts = {k: (where.filter(F.col("kind") == k), c) for k, c in (("a", cells), ("b", other))}
    key = lambda df: sorted((r["id"], r["sg_count"], r["sg_mean"] and round(r["sg_mean"], 6)) for r in df.collect())
    one = key(buffer_comparison(parts, 60.0, lattice=GRID))
    assert one == key(buffer_comparison(parts, 60.0)) and len(one) == where.count()


def test_nothing_to_sum(spark, cells, where):
    assert buffer_stats(where.filter("false"), cells, 60.0, lattice=GRID).count() == 0
    empty = buffer_stats(where, cells.filter("false"), 60.0, lattice=GRID)
    assert empty.filter("sg_count = 0 AND sg_mean IS NULL AND sg_sd IS NULL").count() == where.count()


def test_cells_are_not_paired_with_points(cells, where):
    """Only blocks of running sums meet the circles."""
    plan = buffer_stats(where, cells, 60.0, lattice=GRID)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan
    pieces = row_sums.circle_spans(where.select("x", "y").dropna(), GRID, 130.0)
    assert pieces.groupBy("x", "y").count().agg(F.max("count")).first()[0] <= 2 * 130 / GRID.yres + 1
