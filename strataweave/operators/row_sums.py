"""Statistics of the cells within circles, from running sums along raster rows, or along columns where cells are wider than high.

A circle covers one stretch of columns in each row, so a row is two look-ups in its running count, sum and sum of squares, whatever
the number of cells between. The work of a circle grows with radius over cell size, not with its square. Rows are cut
into blocks of columns, which bounds the running sums held together; only blocks that some circle reaches are summed up. Sums are
taken about the mean of all cells, so large values with a small spread keep their digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.joins import equi_join, lookup_join, semi_join
from strataweave.session import stage

if TYPE_CHECKING:
    from strataweave.operators.raster import Grid

#: Columns of a block of running sums.
SUM_BLOCK = 1024


def _n(value: float) -> str:
    return f"({float(value)!r}D)"


def circle_spans(locations: DataFrame, grid: Grid, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """``by, x, y, _row, _block, _a, _b``: columns of each row with their centre within ``radius`` of a location."""
    row = lambda y: f"({_n(grid.ymax)} - ({y})) / {_n(grid.yres)} - 0.5D"
    top, low = f"greatest(cast(floor({row(f'y + {_n(radius)}')}) as int), 0)", f"least(cast(ceil({row(f'y - {_n(radius)}')}) as int), {grid.nrow - 1})"
    rows = locations.selectExpr("*", f"explode(if({top} <= {low}, sequence({top}, {low}), cast(array() as array<int>))) as _row")
    # ``inline`` keeps the steps apart; merged into one expression they would repeat each other many times over
    at = f"({_n(grid.ymax)} - (_row + 0.5D) * {_n(grid.yres)})"
    half = f"sqrt(greatest({_n(radius * radius)} - ({at} - y) * ({at} - y), 0D))"
    rows = rows.selectExpr(*by, "x", "y", "_row", f"inline(array(named_struct('_y', {at}, '_half', {half})))")
    near = lambda x: f"cast(round(({x} - {_n(grid.xmin)}) / {_n(grid.xres)} - 0.5D) as int)"
    rows = rows.selectExpr("*", f"inline(array(named_struct('_low', {near('x - _half')}, '_high', {near('x + _half')})))")

    def end(col: str, steps: tuple[int, ...]) -> str:
        """The first of the columns beside ``col`` that passes the test of a single cell."""
        tried = ""
        for step in steps:
            centre = f"({_n(grid.xmin)} + ({col} + {step + 0.5}D) * {_n(grid.xres)})"
            tried += f" when ({centre} - x) * ({centre} - x) + (_y - y) * (_y - y) <= {_n(radius * radius)} then {col} + {step}"
        return f"case{tried} end"

    ends = f"inline(array(named_struct('_f', {end('_low', (-1, 0, 1))}, '_t', {end('_high', (1, 0, -1))})))"
    cut = rows.selectExpr(*by, "x", "y", "_row", ends).filter(f"_f <= _t and _t >= 0 and _f < {grid.ncol}")
    cut = cut.selectExpr("*", "greatest(_f, 0) as _from", f"least(_t, {grid.ncol - 1}) as _to").selectExpr("*", f"explode(sequence(_from div {SUM_BLOCK}, _to div {SUM_BLOCK})) as _block")
    return cut.selectExpr(
        *by, "x", "y", "_row", "cast(_block as int) as _block",
        f"cast(greatest(_from, _block * {SUM_BLOCK}) as int) as _a", f"cast(least(_to, _block * {SUM_BLOCK} + {SUM_BLOCK - 1}) as int) as _b",
    )


def running_sums(cells: DataFrame, grid: Grid, centre: float, by: Sequence[str] = ()) -> DataFrame:
    """``by, _row, _block, _first, _at, _s, _q`` of ``cells(by, row, col, value)``, one row for each block of a row.

    ``_s`` and ``_q`` are the running sums of the differences to ``centre`` and of their squares over the cells that have a value,
    beginning with 0, and ``_at`` tells for the columns from ``_first`` on how many of them have been passed.
    """
    keys = [*by, "_row", "_block"]
    kept = cells.filter("value IS NOT NULL").selectExpr(
        *by, "row as _row", f"cast(col div {SUM_BLOCK} as int) as _block", "col", f"value - {_n(centre)} as _d"
    )
    so_far = Window.partitionBy(*keys).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_s", F.sum("_d").over(so_far)).withColumn("_q", F.sum(F.col("_d") * F.col("_d")).over(so_far))
    rows = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("col", "_s", "_q"))).alias("e"))
    steps = f"""flatten(transform(sequence(1, size(e)), i ->
      array_repeat(i, if(i < size(e), e[i].col, least((_block + 1) * {SUM_BLOCK}, {grid.ncol})) - e[i - 1].col)))"""
    return rows.selectExpr(*keys, "e[0].col as _first", f"{steps} as _at", "concat(array(0D), e._s) as _s", "concat(array(0D), e._q) as _q")


def circle_stats(
    points: DataFrame,
    cells: DataFrame,
    grid: Grid,
    radius: float,
    names: tuple[str, str, str],
    by: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Add mean, count and standard deviation of the cells of the point's ``by`` group within ``radius`` of each point."""
    by = list(by)
    flip = grid.yres < grid.xres
    if flip:  # sum along the side with more cells to a circle: rows become columns, x becomes -y and y becomes -x
        grid = replace(grid, xmin=-grid.ymax, ymax=-grid.xmin, xres=grid.yres, yres=grid.xres, nrow=grid.ncol, ncol=grid.nrow)
        cells = cells.select(*by, F.col("col").alias("row"), F.col("row").alias("col"), "value")
    locations = points.selectExpr(*by, *(("-y as x", "-x as y") if flip else ("x", "y"))).filter("x IS NOT NULL AND y IS NOT NULL").distinct()
    # a location becomes many pieces: few bytes of locations still want all tasks
    locations = locations.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "x", "y")
    pieces = stage(circle_spans(locations, grid, float(radius), by))
    keys = [*by, "_row", "_block"]
    reached = pieces.select(*keys).distinct()
    needed = cells.withColumn("_row", F.col("row")).withColumn("_block", F.expr(f"cast(col div {SUM_BLOCK} as int)"))
    centre = cells.agg(F.avg("value")).first()[0] or 0.0
    sums = running_sums(semi_join(needed, reached, keys, null_safe=False), grid, centre, by)
    met = equi_join(pieces, sums, keys, "inner", null_safe=False, spread=True, hot_rows=hot_rows)
    passed = lambda c: f"if({c} < _first, 0, _at[{c} - _first])"
    met = met.selectExpr(*by, "x", "y", "_s", "_q", f"{passed('_b')} as _j", f"{passed('(_a - 1)')} as _i").filter("_j > _i")
    met = met.selectExpr(*by, *(("-y as _x", "-x as _y") if flip else ("x as _x", "y as _y")), "cast(_j - _i as long) as n", "_s[_j] - _s[_i] as s", "_q[_j] - _q[_i] as q")
    stats = met.groupBy(*by, "_x", "_y").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    stats = stats.selectExpr(
        *by, "_x", "_y", f"{_n(centre)} + s / n as `{names[0]}`", f"n as `{names[1]}`",
        f"if(n > 1, sqrt(greatest(q - s * s / n, 0D) / (n - 1)), null) as `{names[2]}`",
    )
    joined = lookup_join(points, stats, {**{b: b for b in by}, "x": "_x", "y": "_y"}, null_safe=False, hot_rows=hot_rows)
    return joined.withColumn(names[1], F.coalesce(names[1], F.lit(0)).cast("long"))
