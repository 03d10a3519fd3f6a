"""Polygons as column spans on the rows of a grid.

A polygon is rasterised once: every edge is met only with the grid rows that it reaches, its crossings with a row's centre line are
sorted, and the columns between an odd crossing and the next are inside. Edges are rows of their own for this, so a polygon costs
one row for each of its edges and grid rows, not one test for each cell and edge. Cells then meet the spans by
row and block of columns and one range test.

A column is counted by the comparison that a point test of its centre makes, so the cells are the same to the last bit.
Cells whose centre lies on an edge count. With ``touched`` every cell whose square meets an edge counts as well.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.geometry import BOX, box_meets_edge, on_edge
from strataweave.session import stage

if TYPE_CHECKING:
    from strataweave.operators.raster import Grid

#: Grid rows whose crossings one task may find.
TASK_ROWS = 16_384
#: Columns of a block; a span within one is a single row of the span table.
BLOCK = 256


def _n(value: float) -> str:
    return f"({float(value)!r}D)"


def _x(grid: Grid, col: str) -> str:
    return f"({_n(grid.xmin)} + ({col} + 0.5D) * {_n(grid.xres)})"


def _near(grid: Grid, x: str) -> str:
    """A column at most one beside the one whose centre is next to ``x``."""
    return f"cast(round(({x} - {_n(grid.xmin)}) / {_n(grid.xres)} - 0.5D) as int)"


def _first(grid: Grid, x: str) -> str:
    """First column with its centre at or east of ``x``."""
    k = _near(grid, x)
    return f"case when {_x(grid, f'({k} - 1)')} >= {x} then {k} - 1 when {_x(grid, k)} >= {x} then {k} else {k} + 1 end"


def _last(grid: Grid, x: str, closed: bool = False) -> str:
    """Last column with its centre west of ``x``, or at it."""
    k, op = _near(grid, x), "<=" if closed else "<"
    return f"case when {_x(grid, f'({k} + 1)')} {op} {x} then {k} + 1 when {_x(grid, k)} {op} {x} then {k} else {k} - 1 end"


def _edge_rows(grid: Grid, reach: float) -> str:
    """Rows whose centre line may come within ``reach`` of an edge."""
    row = lambda y: f"({_n(grid.ymax)} - ({y})) / {_n(grid.yres)}"
    low, high = f"greatest(y1, y2) + {_n(reach)}", f"least(y1, y2) - {_n(reach)}"
    first, last = f"greatest(cast(floor({row(low)} - 0.5D) as int), 0)", f"least(cast(ceil({row(high)} - 0.5D) as int), {grid.nrow - 1})"
    return f"explode(if({first} <= {last}, sequence({first}, {last}), cast(array() as array<int>)))"


def _beside(grid: Grid, touched: bool) -> str:
    """Columns of a row that an edge itself covers: ``(first, last)``, or null."""
    if not touched:
        # centres exactly on the edge: at most the one next to the crossing, or a stretch of a level edge
        at = "if(y1 = y2, least(x1, x2), (x2 - x1) * (_y - y1) / (y2 - y1) + x1)"
        to = "if(y1 = y2, greatest(x1, x2), (x2 - x1) * (_y - y1) / (y2 - y1) + x1)"
        margin, meets = 1, on_edge(_x(grid, "c"), "_y", "array(named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2))")
        within = "_y between least(y1, y2) and greatest(y1, y2)"
    else:
        # the part of the edge within the row's band, then the exact test on the squares at both ends
        hx, hy = grid.xres / 2, grid.yres / 2
        clip = lambda y: f"if(y1 = y2, x1, (x2 - x1) * (greatest(least({y}, greatest(y1, y2)), least(y1, y2)) - y1) / (y2 - y1) + x1)"
        a, b = clip(f"_y - {_n(hy)}"), clip(f"_y + {_n(hy)}")
        at = f"if(y1 = y2, least(x1, x2), least({a}, {b})) - {_n(hx)}"
        to = f"if(y1 = y2, greatest(x1, x2), greatest({a}, {b})) + {_n(hx)}"
        margin, meets = 2, box_meets_edge(_x(grid, "c"), "_y", _n(hx), _n(hy), "array(named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2))")
        within = f"_y between least(y1, y2) - {_n(hy * 1.001)} and greatest(y1, y2) + {_n(hy * 1.001)}"
    low, high = _near(grid, at), _near(grid, to)
    first = f"array_min(filter(sequence({low} - {margin}, {low} + {margin}), c -> {meets}))"
    last = f"array_max(filter(sequence({high} - {margin}, {high} + {margin}), c -> {meets}))"
    # squares on both ends are met or none is: the columns that an edge meets in a row are one stretch
    return f"if({within}, named_struct('a', coalesce({first}, {last}), 'b', coalesce({last}, {first})), null)"


_MERGE = """aggregate({spans}, cast(array() as array<struct<a:int,b:int>>), (found, s) ->
  if(size(found) > 0 and s.a <= element_at(found, -1).b + 1,
    concat(slice(found, 1, size(found) - 1), array(named_struct('a', element_at(found, -1).a, 'b', greatest(element_at(found, -1).b, s.b)))),
    concat(found, array(s))))"""


def _merged(spans: str) -> str:
    """Disjoint spans in order."""
    return _MERGE.format(spans=f"array_sort({spans})")


def spans(polygons: DataFrame, grid: Grid, touched: bool = False) -> DataFrame:
    """``attributes, _polygon, _row, _block, _a, _b``: columns ``_a`` to ``_b`` of a row are in the polygon, within one block.

    Spans of one polygon are disjoint. Box columns cut the polygon, as everywhere. ``_polygon`` tells polygons apart.
    """
    attributes = [c for c in polygons.columns if c not in ("edges", *BOX)]
    named = [f"`{c}`" for c in attributes]
    polygons = stage(polygons.withColumn("_polygon", F.monotonically_increasing_id()))
    keys = ["_polygon", *named, *BOX]
    margin = (grid.xres / 2, grid.yres / 2) if touched else (0.0, 0.0)
    edges = polygons.selectExpr(*keys, "inline(edges)").selectExpr("*", f"{_edge_rows(grid, margin[1])} as _row")
    parts = min(grid.nrow // TASK_ROWS, int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts > 1:  # a few edges become very many rows
        edges = edges.repartition(parts, "_polygon", "_row")
    edges = edges.withColumn("_y", grid.y_of("_row")).filter(F.expr(f"_y between ymin - {_n(margin[1])} and ymax + {_n(margin[1])}"))
    met = edges.selectExpr(
        *keys, "_row", "if((y1 > _y) != (y2 > _y), (x2 - x1) * (_y - y1) / (y2 - y1) + x1, null) as _cross", f"{_beside(grid, touched)} as _beside"
    )
    rows = met.groupBy(*[k.strip("`") for k in keys], "_row").agg(
        F.sort_array(F.collect_list("_cross")).alias("_cross"), F.collect_list("_beside").alias("_beside")
    )
    pairs = f"""transform(filter(sequence(0, size(_cross)), i -> i % 2 = 0 and i + 1 < size(_cross)), i -> named_struct(
      'a', {_first(grid, "_cross[i]")}, 'b', {_last(grid, "_cross[i + 1]")}))"""
    west, east = _first(grid, f"(xmin - {_n(margin[0])})"), _last(grid, f"(xmax + {_n(margin[0])})", True)
    cut = f"""transform(filter(concat({pairs}, _beside), s -> s.a <= s.b),
      s -> named_struct('a', greatest(s.a, {west}, 0), 'b', least(s.b, {east}, {grid.ncol - 1})))"""
    found = rows.selectExpr("_polygon", *named, "_row", f"filter({cut}, s -> s.a <= s.b) as _spans")
    found = found.selectExpr("_polygon", *named, "_row", f"explode({_merged('_spans')}) as s")
    found = found.selectExpr("_polygon", *named, "_row", "s", f"explode(sequence(s.a div {BLOCK}, s.b div {BLOCK})) as _block")
    return found.selectExpr(
        *named, "_polygon", "_row", "cast(_block as int) as _block",
        f"cast(greatest(s.a, _block * {BLOCK}) as int) as _a", f"cast(least(s.b, _block * {BLOCK} + {BLOCK - 1}) as int) as _b",
    )


def union_spans(found: DataFrame) -> DataFrame:
    """``_row, _block, _a, _b``: disjoint spans of the columns that lie in any polygon."""
    # equal spans count once; a block of BLOCK columns has fewer than BLOCK * BLOCK different ones
    one = found.select("_row", "_block", F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")).alias("s"))
    all_ = one.groupBy("_row", "_block").agg(F.collect_set("s").alias("_all"))
    return all_.selectExpr("_row", "_block", f"explode({_merged('_all')}) as s").selectExpr("_row", "_block", "s.a as _a", "s.b as _b")
