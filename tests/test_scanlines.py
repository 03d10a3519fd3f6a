"""Column spans of polygons against point tests of every cell."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataweave.functions.crs import ALBERS
from strataweave.functions.geometry import EDGES, box_meets_edge, even_odd, inside, rectangle, with_box
from strataweave.operators.raster import Grid, cells_in, mask_raster, zone_values
from strataweave.operators.scanlines import spans
from strataweave.operators.spatial import Box, crop_polygons

GRID = Grid("g", -3.0, 21.0, 0.1, 0.3, 70, 600, ALBERS)


def rings(rng, n):
    """Edges of random stars, some with a hole or a second part, and boxes along cell centres and cell sides."""
    out = []
    for i in range(n):
        edges = []
        for _ in range(rng.randint(1, 3)):
            cx, cy = rng.uniform(-5, 60), rng.uniform(-2, 24)
            corners = [(cx + rng.uniform(-8, 8), cy + rng.uniform(-4, 4)) for _ in range(rng.randint(3, 9))]
            edges += [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]
        out.append((f"p{i % 7}", edges))
    for k in range(6):  # level and upright edges on centres and sides
        x, y = GRID.xmin + (10 + k * 0.5) * GRID.xres, GRID.ymax - (4 + k * 0.5) * GRID.yres
        box = [(x, y), (x + 3.0, y), (x + 3.0, y - 1.5), (x, y - 1.5)]
        out.append((f"b{k}", [(*a, *b) for a, b in zip(box, box[1:] + box[:1])]))
    return out


@pytest.fixture(scope="module")
def layer(spark):
    data = spark.createDataFrame(rings(random.Random(11), 20), "code string, e array<struct<a:double,b:double,c:double,d:double>>")
    return with_box(data.select("code", F.col("e").cast(EDGES).alias("edges")))


@pytest.fixture(scope="module")
def cells(spark):
    return GRID.cells(spark).selectExpr("'g' as raster_id", "row", "col", "x", "y", "cast(row * 1000 + col as double) as value")


def pairs(cells, polygons, touched):
    """Every cell against every edge."""
    half = f"{GRID.xres / 2!r}D", f"{GRID.yres / 2!r}D"
    test = inside("x", "y", "edges") if not touched else f"{even_odd('x', 'y', 'edges')} or {box_meets_edge('x', 'y', *half, 'edges')}"
    mx, my = half if touched else ("0D", "0D")
    box = f"x between xmin - {mx} and xmax + {mx} and y between ymin - {my} and ymax + {my}"
    return sorted(tuple(r) for r in cells.join(F.broadcast(polygons), F.expr(f"({test}) and {box}")).select("code", "row", "col").collect())


@pytest.mark.parametrize("touched", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "hot_rows": 50}])
def test_spans_are_the_cells_of_point_tests(cells, layer, touched, options):
    grids = {"grid": GRID} if touched else {"lattice": GRID}
    got = sorted(tuple(r) for r in cells_in(cells, layer, how="inner", **grids, **options).select("code", "row", "col").collect())
    want = pairs(cells, layer, touched)
    assert got == want and len(want) > 3000
    held = sorted(tuple(r) for r in cells_in(cells, layer, **grids, **options).select("row", "col").collect())
    assert held == sorted({w[1:] for w in want})


@pytest.mark.parametrize("touched", [False, True])
def test_boxes_cut_spans(cells, layer, touched):
    cropped = crop_polygons(layer, Box(1.05, 3.0, 20.0, 12.15))
    grids = {"grid": GRID} if touched else {"lattice": GRID}
    got = sorted(tuple(r) for r in cells_in(cells, cropped, how="inner", **grids).select("code", "row", "col").collect())
    assert got == pairs(cells, cropped, touched) and got


def test_masks_and_zones_by_spans(cells, layer):
    plain, fast = (rows(mask_raster(cells, layer, lattice=g), "row", "col", "value") for g in (None, GRID))
    assert fast == plain
    assert rows(mask_raster(cells, layer, keep_outside=False, lattice=GRID), "row", "col") == rows(mask_raster(cells, layer, keep_outside=False), "row", "col")
    assert rows(zone_values(cells, layer, distinct=False, lattice=GRID), "zone", "value") == rows(zone_values(cells, layer, distinct=False), "zone", "value")


def test_no_polygons_and_no_rows(spark, cells, layer):
    none = layer.filter("false")
    assert cells_in(cells, none, lattice=GRID).count() == 0
    assert mask_raster(cells, none, lattice=GRID).filter("value is not null").count() == 0
    away = with_box(spark.createDataFrame([("far",)], "code string").withColumn("edges", rectangle(900, 900, 901, 901)))
    assert spans(away, GRID).count() == 0 and spans(away, GRID, touched=True).count() == 0


def test_cells_meet_no_edge(cells, layer):
    """The plan of the cells has no edge array: only rows, blocks and column ranges."""
    plan = cells_in(cells, layer, how="inner", lattice=GRID)._jdf.queryExecution().optimizedPlan().toString()
    assert "edges" not in plan and "x1" not in plan


def test_rows_of_a_tall_grid_are_found_by_many_tasks(layer, monkeypatch, capsys):
    """Few edges on many rows are dealt out before their crossings are computed, and give the same spans."""
    columns = ["code", "_polygon", "_row", "_block", "_a", "_b"]
    one = rows(spans(layer, GRID), *columns)
    monkeypatch.setattr("strataweave.operators.scanlines.TASK_ROWS", 10)
    dealt = spans(layer, GRID)
    dealt.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert rows(dealt, *columns) == one
