"""Raster layers as cell tables ``raster_id, row, col, x, y, value``.

Cells are the large side and are never broadcast or collected. Regular geometry lives in a small
:class:`Grid` header on the driver. Points reach cells by an equi-join on row and column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.crs import GEOGRAPHIC, reproject
from strataweave.operators.joins import anti_join, equi_join, lookup_join, semi_join
from strataweave.operators.row_sums import circle_stats
from strataweave.operators.scanlines import BLOCK, spans, union_spans
from strataweave.operators.spatial import Box, as_box, join_polygons, layer_bbox, reproject_box
from strataweave.session import fits_broadcast, stage


def _n(value: float) -> str:
    return f"({float(value)!r}D)"


@dataclass(frozen=True)
class Grid:
    """Header of a raster: upper left corner, cell size, shape and reference system."""

    raster_id: str
    xmin: float
    ymax: float
    xres: float
    yres: float
    nrow: int
    ncol: int
    crs: str = GEOGRAPHIC

    @property
    def box(self) -> Box:
        return Box(self.xmin, self.ymax - self.nrow * self.yres, self.xmin + self.ncol * self.xres, self.ymax)

    def col_of(self, x: str = "x") -> Column:
        """Column holding ``x``; the right outer edge belongs to the last one, outside is NULL."""
        return self._index(f"floor((`{x}` - {_n(self.xmin)}) / {_n(self.xres)})", f"`{x}` = {_n(self.box.xmax)}", self.ncol)

    def row_of(self, y: str = "y") -> Column:
        """Row holding ``y``; the lower outer edge belongs to the last one, outside is NULL."""
        return self._index(f"floor(({_n(self.ymax)} - `{y}`) / {_n(self.yres)})", f"`{y}` = {_n(self.box.ymin)}", self.nrow)

    @staticmethod
    def _index(i: str, at_end: str, n: int) -> Column:
        return F.expr(f"case when {at_end} then {n - 1} when {i} between 0 and {n - 1} then cast({i} as int) end")

    def x_of(self, col: str = "col") -> Column:
        return F.expr(f"{_n(self.xmin)} + ({col} + 0.5D) * {_n(self.xres)}")

    def y_of(self, row: str = "row") -> Column:
        return F.expr(f"{_n(self.ymax)} - ({row} + 0.5D) * {_n(self.yres)}")

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cell positions, generated on the executors."""
        at = spark.range(self.nrow * self.ncol).selectExpr(
            f"cast(id div {self.ncol} as int) as row", f"cast(id % {self.ncol} as int) as col"
        )
        return at.select("row", "col", self.x_of().alias("x"), self.y_of().alias("y"))


def read_grids(headers: DataFrame) -> dict[str, Grid]:
    """Grid headers by raster name, from the header table (one row per raster)."""
    fields = ("raster_id", "xmin", "ymax", "xres", "yres", "nrow", "ncol", "crs")
    return {r["raster_id"]: Grid(*r) for r in headers.select(*fields).collect()}


def warp_grid(spark: SparkSession, source: Grid, crs: str, raster_id: str = "warped", unit: float = 1000.0) -> Grid:
    """Grid of the same shape in another reference system that covers the whole source.

    Its box is that of the transformed outline, widened to multiples of ``unit``.
    """
    b = reproject_box(spark, source.box, source.crs, crs)
    west, south = math.floor(b.xmin / unit) * unit, math.floor(b.ymin / unit) * unit
    east, north = math.ceil(b.xmax / unit) * unit, math.ceil(b.ymax / unit) * unit
    return Grid(raster_id, west, north, (east - west) / source.ncol, (north - south) / source.nrow, source.nrow, source.ncol, crs)


#: Columns that tell one cell from another in a table of several layers.
CELL_KEYS = ("raster_id", "month", "row", "col")


def layer_of(cells: DataFrame, raster_id: str, keep: Sequence[str] = ()) -> DataFrame:
    """The cells of one layer of a table, or all if the layer's name is kept with each cell."""
    if "raster_id" not in cells.columns or "raster_id" in keep:
        return cells
    return cells.filter(F.col("raster_id") == raster_id)


def raster_window(cells: DataFrame, box: Box) -> DataFrame:
    """Cells with their centre in a box; the range conditions are pushed to the scan."""
    return cells.filter(box.holds())


def crop_raster(cells: DataFrame, extent: Box | DataFrame) -> DataFrame:
    """Crop to a box or to the box of a polygon layer."""
    return raster_window(cells, extent if isinstance(extent, Box) else as_box(layer_bbox(extent)))


def raster_rescale(cells: DataFrame, divisor: float = 10.0) -> DataFrame:
    return cells.withColumn("value", F.col("value") / F.lit(float(divisor)))


def cells_in(
    cells: DataFrame,
    polygons: DataFrame,
    grid: Grid | None = None,
    how: str = "left_semi",
    lattice: Grid | None = None,
    broadcast_limit: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Cells inside the union of polygons (``left_semi``), or with the attributes of each polygon they are in (``inner``).

    With ``lattice``, the grid of the cells, polygons become column spans of its rows and no cell is tested against an edge;
    without it cell centres are joined as points. With ``grid``, the same, cells whose square meets an edge count as well.
    """
    on = grid if lattice is None else lattice
    if on is None:
        return join_polygons(cells, polygons, how)
    found = spans(polygons, on, touched=grid is not None)
    # spans of one polygon, and those of the union, are disjoint: a cell meets one at most
    found = found.drop("_polygon") if how == "inner" else union_spans(found)
    return _meet_spans(cells, found, "inner", broadcast_limit, hot_rows).drop("_a", "_b")


def _meet_spans(cells: DataFrame, found: DataFrame, how: str, broadcast_limit: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Join cells to column spans by row and block."""
    found = stage(found)
    small = fits_broadcast(found, limit=broadcast_limit)
    joined = equi_join(
        cells.withColumn("_block_", F.expr(f"cast(col div {BLOCK} as int)")), found,
        {"row": "_row", "_block_": "_block"}, how,
        where=F.expr("col between _a and _b"), null_safe=False, spread=not small, hot_rows=hot_rows, small=small,
    )
    return joined.drop("_block_")


def mask_raster(
    cells: DataFrame, polygons: DataFrame, grid: Grid | None = None, keep_outside: bool = True, lattice: Grid | None = None
) -> DataFrame:
    """Set cells outside the polygons to NULL, or leave them out.

    Cell centres decide; pass ``grid`` to count every cell that the polygons touch. With either ``grid`` or
    ``lattice``, the grid of the cells, the polygons are rasterised once and the cells pass through a single join.
    """
    if not keep_outside or (grid is None and lattice is None):
        kept = cells_in(cells, polygons, grid, lattice=lattice)
        if not keep_outside:
            return kept
        # The polygons are met once; what they hold is staged and told from the rest by its place.
        kept = stage(kept)
        keys = [c for c in CELL_KEYS if c in cells.columns]
        held = kept.select(*keys)
        outside = anti_join(cells, held, keys)
        return kept.unionByName(outside.withColumn("value", F.lit(None).cast("double")))
    found = union_spans(spans(polygons, grid or lattice, touched=grid is not None))
    joined = _meet_spans(cells, found, "left")
    return joined.withColumn("value", F.when(F.col("_a").isNotNull(), F.col("value"))).drop("_a", "_b")


def extract_points(
    points: DataFrame,
    cells: DataFrame,
    grid: Grid,
    x: str = "x",
    y: str = "y",
    out: str = "value",
    keep: Sequence[str] = (),
    hot_rows: int | None = None,
    broadcast_limit: int | None = None,
) -> DataFrame:
    """Value of the cell that holds each point; NULL outside. Point attributes are kept.

    Only the layer named by ``grid`` counts. ``keep`` names further cell columns, such as ``month``;
    with ``raster_id`` among them every layer counts. Points are staged, as they are read for the
    wanted cells and for the join. The wanted cells are counted first: if few, they are broadcast to
    the cell scan and the raster is not shuffled.
    """
    keyed = stage(points.select("*", grid.row_of(y).alias("_row"), grid.col_of(x).alias("_col")))
    values = layer_of(cells, grid.raster_id, keep).select("row", "col", *keep, F.col("value").alias(out))
    on = {"_row": "row", "_col": "col"}
    wanted = stage(keyed.select("_row", "_col").dropna().distinct())
    if fits_broadcast(wanted, limit=broadcast_limit):
        hits = semi_join(values, wanted, {"row": "_row", "col": "_col"}, null_safe=False, small=True)
        joined = lookup_join(keyed, hits, on, null_safe=False, hot_rows=hot_rows)
    else:
        joined = equi_join(keyed, values, on, null_safe=False, spread=True, hot_rows=hot_rows)
    return joined.drop("_row", "_col")


def _span(centre: str, reach: float, width: float) -> str:
    return f"explode(sequence(floor(({centre} - {reach!r}D) / {width!r}D), floor(({centre} + {reach!r}D) / {width!r}D)))"


def buffer_stats(
    points: DataFrame,
    cells: DataFrame,
    radius: float,
    scale: float = 10.0,
    names: tuple[str, str, str] = ("sg_mean", "sg_count", "sg_sd"),
    stat: str = "mean",
    empty: str = "null",
    grid: Grid | None = None,
    hot_rows: int | None = None,
    broadcast_limit: int | None = None,
    layer: str | None = None,
    lattice: Grid | None = None,
) -> DataFrame:
    """Mean, non-missing count and standard deviation of the cells around each point.

    A cell counts if its centre is within ``radius``. Values are divided by ``scale``. A point
    without cells keeps count 0 and NULL statistics; with ``empty="touched"`` (needs ``grid``) it
    takes the cells whose square reaches into the circle instead.

    ``layer`` names the layer of a table of several; with more than one in the table and none named,
    the run fails. Each distinct location is computed once. Bins are as wide as the circle, so a location has
    one to four of them; cells have exactly one. With ``lattice``, the grid of the cells, means over cell centres
    come from running sums along the rows instead (``row_sums``), and the lattice's layer is the one that counts.
    """
    if stat not in ("mean", "median") or empty not in ("null", "touched"):
        raise ValueError("stat is 'mean' or 'median', empty is 'null' or 'touched'")
    if lattice is not None and stat == "mean" and empty == "null":
        one = layer_of(cells, layer or lattice.raster_id)
        one = one.select("row", "col", (F.col("value") / F.lit(float(scale))).alias("value"))
        return circle_stats(points, one, lattice, radius, names, hot_rows=hot_rows)
    touched, radius = empty == "touched", float(radius)
    named = "raster_id" in cells.columns
    if layer is not None and named:
        cells = cells.filter(F.col("raster_id") == layer)
    cells = cells.withColumn("_layer", F.col("raster_id") if named else F.lit(""))
    half_x, half_y = (grid.xres / 2, grid.yres / 2) if touched else (0.0, 0.0)
    width = 2.0 * (radius + max(half_x, half_y))
    locations = points.selectExpr("x as _x", "y as _y").dropna().distinct()
    probes = stage(
        locations.selectExpr("*", f"{_span('_x', radius + half_x, width)} as _bx").selectExpr(
            "*", f"{_span('_y', radius + half_y, width)} as _by"
        )
    )
    binned = (cells if touched else cells.filter("value is not null")).selectExpr(
        f"floor(x / {width!r}D) as _cx", f"floor(y / {width!r}D) as _cy", "x", "y", "value", "_layer"
    )
    centred = F.expr(f"(x - _x) * (x - _x) + (y - _y) * (y - _y) <= {float(radius * radius)!r}D")
    where = centred
    if touched:
        ex, ey = f"greatest(abs(x - _x) - {half_x!r}D, 0D)", f"greatest(abs(y - _y) - {half_y!r}D, 0D)"
        where = F.expr(f"{ex} * {ex} + {ey} * {ey} <= {float(radius * radius)!r}D")
    if fits_broadcast(probes, limit=broadcast_limit):
        pairs = equi_join(
            binned, probes, {"_cx": "_bx", "_cy": "_by"}, "inner", where=where, null_safe=False, small=True
        )
    else:
        pairs = equi_join(
            probes, binned, {"_bx": "_cx", "_by": "_cy"}, "inner", where=where, null_safe=False, spread=True,
            hot_rows=hot_rows,
        )
    value = F.col("value") / F.lit(float(scale))

    def three(v: Column) -> list[Column]:
        return [F.avg(v) if stat == "mean" else F.median(v), F.count(v), F.stddev_samp(v)]

    if touched:
        any_centre = F.max(centred)
        aggs = [F.when(any_centre, c).otherwise(t) for c, t in zip(three(F.when(centred, value)), three(value))]
    else:
        aggs = three(value)
    stats = pairs.groupBy("_x", "_y").agg(*[a.alias(n) for a, n in zip(aggs, names)], F.min("_layer").alias("_a"), F.max("_layer").alias("_b"))
    several = F.raise_error(F.lit("the cells are of several layers: name one")).cast("long")
    stats = stats.withColumn(names[1], F.when(F.col("_a") == F.col("_b"), F.col(names[1])).otherwise(several)).drop("_a", "_b")
    joined = lookup_join(points, stats, {"x": "_x", "y": "_y"}, null_safe=False, hot_rows=hot_rows)
    return joined.withColumn(names[1], F.coalesce(names[1], F.lit(0)).cast("long"))


def zone_values(
    cells: DataFrame,
    zones: DataFrame,
    code: str = "code",
    max_zones: int | None = None,
    distinct: bool = True,
    country: DataFrame | None = None,
    grid: Grid | None = None,
    keep: Sequence[str] = (),
    lattice: Grid | None = None,
) -> DataFrame:
    """Values found in each zone, once per zone and value (``distinct=False``: once per cell).

    ``max_zones`` keeps the first zones in the order of their codes. ``keep`` names further cell
    columns, such as ``raster_id`` for a table of several layers. Cell centres decide; with ``grid``
    a zone also has the cells that it touches. With ``lattice``, the grid of the cells, zones are rasterised once.
    """
    if max_zones is not None:
        first = zones.select(code).distinct().orderBy(code).limit(max_zones)
        zones = semi_join(zones, first, code)
    place = ["row", "col"] if grid is not None or lattice is not None else []
    cells = cells.filter(F.col("value").isNotNull()).select(*{**dict.fromkeys(place), "x": 0, "y": 0, "value": 0, **dict.fromkeys(keep)})
    if country is not None:
        cells = cells_in(cells, country, grid, lattice=lattice)
    found = cells_in(cells, zones.select(code, "edges", "xmin", "ymin", "xmax", "ymax"), grid, "inner", lattice)
    found = found.select(F.col(code).alias("zone"), "value", *keep)
    return found.distinct() if distinct else found


def warp_bilinear(cells: DataFrame, source: Grid, target: Grid, keep: Sequence[str] = ()) -> DataFrame:
    """Resample a raster to another grid and reference system.

    Each target centre is carried back to the source grid and takes the weighted mean of its four
    neighbours. Missing neighbours are left out and the weights renormalised; a target without any
    neighbour has no row. Only the layer named by ``source`` counts; ``keep`` names columns, such as
    ``month``, whose values are resampled each by itself.

    The four values around each corner of the source are put into one row first: cells stored by
    tile meet their neighbours before the shuffle. Targets then take one row each.
    """
    at = target.cells(cells.sparkSession).selectExpr("row", "col", "x", "y", "x as _lx", "y as _ly")
    at = reproject(at, target.crs, source.crs, "_lx", "_ly")
    at = at.selectExpr(
        "row", "col", "x", "y",
        f"(_lx - {_n(source.xmin)}) / {_n(source.xres)} - 0.5D as _fx",
        f"({_n(source.ymax)} - _ly) / {_n(source.yres)} - 0.5D as _fy",
    ).filter(F.col("_fx").between(-1, source.ncol) & F.col("_fy").between(-1, source.nrow))
    at = at.selectExpr("row", "col", "x", "y", "_fx", "_fy", "cast(floor(_fx) as int) as _c", "cast(floor(_fy) as int) as _r")
    corners = [(dr, dc) for dr in (0, 1) for dc in (0, 1)]
    places = ", ".join(f"named_struct('r', row - {dr}, 'c', col - {dc}, 'k', {2 * dr + dc})" for dr, dc in corners)
    known = layer_of(cells, source.raster_id, keep).filter(F.col("value").isNotNull())
    spread = known.selectExpr("value", *keep, f"inline(array({places})) as (_sr, _sc, _k)")
    values = [F.max(F.when(F.col("_k") == k, F.col("value"))).alias(f"_v{k}") for k in range(4)]
    quads = spread.groupBy("_sr", "_sc", *keep).agg(*values)
    pairs = equi_join(at, quads, {"_r": "_sr", "_c": "_sc"}, "inner", null_safe=False, small=False)
    wx, wy = ("(1 - (_fx - _c))", "(_fx - _c)"), ("(1 - (_fy - _r))", "(_fy - _r)")
    weights = [f"if(_v{2 * dr + dc} is null, 0D, {wx[dc]} * {wy[dr]})" for dr, dc in corners]
    total = " + ".join(weights)
    mean = " + ".join(f"{w} * coalesce(_v{k}, 0D)" for k, w in enumerate(weights))
    pairs = pairs.withColumn("_w", F.expr(total)).filter("_w > 0")
    return pairs.select(
        F.lit(target.raster_id).alias("raster_id"), "row", "col", "x", "y", *keep, (F.expr(mean) / F.col("_w")).alias("value")
    )


def read_project_mask(
    cells: DataFrame,
    source: Grid,
    target: Grid,
    country_native: DataFrame,
    country: DataFrame,
    keep_outside: bool = False,
    touched: bool = False,
) -> DataFrame:
    """Crop a raster to a country in its own system, resample it to the working one, and mask it.

    ``country_native`` and ``country`` are the same polygons in the two systems. Cell centres decide;
    with ``touched`` every cell counts that the country touches.
    """
    warped = stage(warp_bilinear(crop_raster(cells, country_native), source, target))
    return mask_raster(warped, country, target if touched else None, keep_outside=keep_outside, lattice=target)
