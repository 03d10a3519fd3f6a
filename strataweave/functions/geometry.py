"""Planar tests on polygons stored as edge arrays.

A polygon is one row with ``edges`` (all rings of all parts), and its box ``xmin, ymin, xmax, ymax``.
The even-odd rule over the edges covers holes and parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
EDGES = T.ArrayType(EDGE)
BOX = ("xmin", "ymin", "xmax", "ymax")


def on_edge(x: str, y: str, edges: str) -> str:
    """SQL test: the point lies exactly on one of the edges. Arguments are column names."""
    return (
        f"exists({edges}, e -> (e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1) = 0"
        f" and {x} between least(e.x1, e.x2) and greatest(e.x1, e.x2)"
        f" and {y} between least(e.y1, e.y2) and greatest(e.y1, e.y2))"
    )


def even_odd(x: str, y: str, edges: str) -> str:
    """SQL test by the even-odd rule with half-open edges: an odd number of edges lies to the right."""
    return (
        f"size(filter({edges}, e -> (e.y1 > {y}) != (e.y2 > {y})"
        f" and {x} < (e.x2 - e.x1) * ({y} - e.y1) / (e.y2 - e.y1) + e.x1)) % 2 = 1"
    )


def inside(x: str, y: str, edges: str, boundary: bool = True) -> str:
    """SQL test: point in polygon; points on the boundary count if ``boundary`` is set."""
    if boundary:
        return f"({even_odd(x, y, edges)} or {on_edge(x, y, edges)})"
    return f"({even_odd(x, y, edges)} and not {on_edge(x, y, edges)})"


def box_meets_edge(x: str, y: str, half_x: str, half_y: str, edges: str) -> str:
    """SQL test: a box around a centre meets one of the edges (separating axes of segment and box)."""
    mx, my = f"((e.x1 + e.x2) / 2 - {x})", f"((e.y1 + e.y2) / 2 - {y})"
    dx, dy = "((e.x2 - e.x1) / 2)", "((e.y2 - e.y1) / 2)"
    return (
        f"exists({edges}, e -> abs({mx}) <= {half_x} + abs({dx}) and abs({my}) <= {half_y} + abs({dy})"
        f" and abs({dx} * {my} - {dy} * {mx}) <= {half_x} * abs({dy}) + {half_y} * abs({dx}))"
    )


def ring_edges(corners: Sequence[tuple[str, str]]) -> Column:
    """Edge array of one closed ring given by corner expressions (SQL text)."""
    closed = [*corners, corners[0]]
    sides = ", ".join(
        f"named_struct('x1', {ax}, 'y1', {ay}, 'x2', {bx}, 'y2', {by})" for (ax, ay), (bx, by) in zip(closed, closed[1:])
    )
    return F.expr(f"array({sides})").cast(EDGES)


def rectangle(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Edge array of a box given by its corners."""
    a, b, c, d = (f"{float(v)!r}D" for v in (xmin, ymin, xmax, ymax))
    return ring_edges([(a, b), (c, b), (c, d), (a, d)])


def with_box(df: DataFrame) -> DataFrame:
    """Add the box columns from the edges. Every ring is closed, so first corners are enough."""
    return df.selectExpr(
        *[c for c in df.columns if c not in BOX],
        "array_min(edges.x1) as xmin",
        "array_min(edges.y1) as ymin",
        "array_max(edges.x1) as xmax",
        "array_max(edges.y1) as ymax",
    )
