"""Points and polygons.

The point side is the large one. A polygon layer is cut into rectangular bins, each row holding
only the edges that matter there, and points meet it by an equi-join on the bin. The bins are
measured: a layer that fits is broadcast, so points do not move; otherwise both sides are
shuffled by bin with crowded bins spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.crs import reproject
from strataweave.functions.geometry import BOX, EDGES, box_meets_edge, even_odd, inside, with_box
from strataweave.operators.joins import equi_join
from strataweave.session import BROADCAST_BYTES, fits_broadcast, row_bytes, stage

#: Bins per average polygon extent, and the most bins along the whole layer.
BINS_PER_POLYGON = 12
BINS_PER_LAYER = 512
_EPS = 1e-6


@dataclass(frozen=True)
class Box:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def holds(self, x="x", y="y") -> Column:
        """Plain range conditions, which reach the file scan."""
        return F.col(x).between(self.xmin, self.xmax) & F.col(y).between(self.ymin, self.ymax)


def make_points(df: DataFrame, lon: str, lat: str, on_missing: str = "error") -> DataFrame:
    """Turn two coordinate columns into point columns ``x`` and ``y``.

    A missing coordinate raises an error when the row is read, or drops the row (``"drop"``).
    """
    if on_missing not in ("error", "drop"):
        raise ValueError(f"on_missing must be 'error' or 'drop', not {on_missing!r}")
    missing = F.col(lon).isNull() | F.col(lat).isNull() | F.isnan(lon) | F.isnan(lat)
    if on_missing == "drop":
        df = df.filter(~missing)
        x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    else:
        fail = F.raise_error(F.lit("missing coordinate")).cast("double")
        x = F.when(missing, fail).otherwise(F.col(lon).cast("double"))
        y = F.when(missing, fail).otherwise(F.col(lat).cast("double"))
    return df.select(*[c for c in df.columns if c not in (lon, lat)], x.alias("x"), y.alias("y"))


def points_bbox(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Box of a point layer, or one per group."""
    aggs = [F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")]
    return df.groupBy(*by).agg(*aggs)


def layer_bbox(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Box of a polygon layer, or one per group."""
    return polygons.groupBy(*by).agg(
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")
    )


def as_box(row: DataFrame) -> Box:
    """Read a one-row box table."""
    return Box(*row.select(*BOX).first())


def reproject_polygons(polygons: DataFrame, source: str, target: str) -> DataFrame:
    """Transform the corners of every polygon; edges stay straight.

    Polygons are numbered in a staged copy, so they need no key of their own. Edges are transformed as
    rows and regrouped per polygon, whose edges formed one array before.
    """
    if source == target:
        return polygons
    attributes = [c for c in polygons.columns if c not in ("edges", *BOX)]
    polygons, key = stage(polygons.withColumn("_polygon", F.monotonically_increasing_id())), ["_polygon"]
    edges = polygons.select(*key, F.posexplode("edges").alias("_i", "_e"))
    flat = edges.select(*key, "_i", "_e.*")
    flat = reproject(reproject(flat, source, target, "x1", "y1"), source, target, "x2", "y2")
    grouped = flat.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_i", "x1", "y1", "x2", "y2"))).alias("_rows")
    )
    grouped = grouped.select(
        *key, F.transform("_rows", lambda r: F.struct(r.x1, r.y1, r.x2, r.y2)).cast(EDGES).alias("edges")
    )
    return with_box(equi_join(polygons.select(*attributes, *key), grouped, key, "inner", small=False).drop(*key))


def reproject_box(spark: SparkSession, box: Box, source: str, target: str, steps: int = 200) -> Box:
    """Box around the transformed outline, each side taken in ``steps`` parts.

    The extremes of a curved side need not lie at its ends.
    """
    xs = [box.xmin + (box.xmax - box.xmin) * i / steps for i in range(steps + 1)]
    ys = [box.ymin + (box.ymax - box.ymin) * i / steps for i in range(steps + 1)]
    outline = [(x, y) for x in xs for y in (box.ymin, box.ymax)] + [(x, y) for x in (box.xmin, box.xmax) for y in ys]
    moved = reproject(spark.createDataFrame(outline, "x double, y double"), source, target)
    return as_box(points_bbox(moved))


def crop_polygons(polygons: DataFrame, box: Box) -> DataFrame:
    """Polygons that meet a rectangle, cut down to it.

    The edges stay; the box columns shrink to the rectangle, and every point test honours them.
    """
    overlap = (
        (F.col("xmin") <= box.xmax) & (F.col("xmax") >= box.xmin) & (F.col("ymin") <= box.ymax) & (F.col("ymax") >= box.ymin)
    )
    return polygons.filter(overlap).withColumns(
        {
            "xmin": F.greatest("xmin", F.lit(box.xmin)),
            "ymin": F.greatest("ymin", F.lit(box.ymin)),
            "xmax": F.least("xmax", F.lit(box.xmax)),
            "ymax": F.least("ymax", F.lit(box.ymax)),
        }
    )


@dataclass(frozen=True)
class Layout:
    """Extent of a polygon layer, its bin size, and an upper bound on the bytes of all bins."""

    box: Box
    width: float
    height: float
    bound: float = 0.0


def bin_layout(
    polygons: DataFrame, bin_size: tuple[float, float] | None = None, margin: tuple[float, float] = (0.0, 0.0)
) -> Layout | None:
    """Measure a polygon layer in one small job; None if it is empty.

    A polygon covers at most (w / width + 3) * (h / height + 3) bins, each with at most its own
    edges and attributes; the sums behind that bound do not depend on the bin size chosen from the same job.
    """
    row = polygons.select(
        *BOX,
        F.expr(f"xmax - xmin + {2 * margin[0]!r}D as w"),
        F.expr(f"ymax - ymin + {2 * margin[1]!r}D as h"),
        (row_bytes(polygons) + 24).alias("a"),
    ).selectExpr(
        "min(xmin)", "min(ymin)", "max(xmax)", "max(ymax)", "avg(w)", "avg(h)",
        "sum(a * w * h)", "sum(a * w)", "sum(a * h)", "sum(a)",
    ).first()
    if row[0] is None:
        return None
    box = Box(*row[:4])
    if bin_size:
        width, height = map(float, bin_size)
    else:
        width = max(row[4] / BINS_PER_POLYGON, (box.xmax - box.xmin) / BINS_PER_LAYER) or 1.0
        height = max(row[5] / BINS_PER_POLYGON, (box.ymax - box.ymin) / BINS_PER_LAYER) or 1.0
    both, wide, high, plain = row[6:]
    bound = both / (width * height) + 3 * wide / width + 3 * high / height + 9 * plain
    return Layout(box, float(width), float(height), float(bound))


def polygon_bins(polygons: DataFrame, layout: Layout, margin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One row per polygon and bin it covers, with the edges that decide there.

    An eastward ray stays in its horizontal band, so only edges of the band count. Bins inside the
    polygon that no edge enters are marked ``_full`` and need no test at all. ``margin`` widens the
    bins for tests on objects around the point.
    """
    w, h, mx, my = (f"({float(v)!r}D)" for v in (layout.width, layout.height, *margin))
    eps = f"({_EPS!r}D)"
    keep = [f"`{c}`" for c in polygons.columns if c != "edges"]
    banded = polygons.selectExpr(
        *keep, "edges", f"explode(sequence(floor((ymin - {my}) / {h} - {eps}), floor((ymax + {my}) / {h} + {eps}))) as _by"
    )
    low, high = f"((_by - {eps}) * {h} - {my})", f"((_by + 1 + {eps}) * {h} + {my})"
    banded = banded.selectExpr(
        *keep, "_by", f"filter(edges, e -> greatest(e.y1, e.y2) >= {low} and least(e.y1, e.y2) <= {high}) as edges"
    ).filter("size(edges) > 0")
    first = "greatest(least(array_min(edges.x1), array_min(edges.x2)), xmin)"
    last = "least(greatest(array_max(edges.x1), array_max(edges.x2)), xmax)"
    spans = banded.selectExpr(
        *keep, "edges", "_by",
        f"floor(({first} - {mx}) / {w} - {eps}) as _first", f"floor(({last} + {mx}) / {w} + {eps}) as _last",
    ).filter("_first <= _last")
    bins = spans.selectExpr(*keep, "edges", "_by", "explode(sequence(_first, _last)) as _bx")
    # A bin that no edge enters is wholly inside or wholly outside; its centre tells.
    cx, cy = f"((_bx + 0.5D) * {w})", f"((_by + 0.5D) * {h})"
    half_x, half_y = f"({w} * (0.5D + {eps}) + {mx})", f"({h} * (0.5D + {eps}) + {my})"
    mixed = box_meets_edge(cx, cy, half_x, half_y, "edges")
    bins = bins.selectExpr("*", f"not {mixed} as _full").filter(f"not _full or {even_odd(cx, cy, 'edges')}")
    # Rays go east, so edges west of a bin cannot matter in it.
    east = f"filter(edges, e -> greatest(e.x1, e.x2) >= {cx} - {half_x})"
    return bins.selectExpr(*keep, "_bx", "_by", "_full", f"if(_full, filter(edges, e -> false), {east}) as edges")


def join_polygons(
    points: DataFrame,
    polygons: DataFrame,
    how: str = "inner",
    boundary: bool = True,
    x: str = "x",
    y: str = "y",
    test: str | None = None,
    margin: tuple[float, float] = (0.0, 0.0),
    bin_size: tuple[float, float] | None = None,
    broadcast_limit: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join points to the polygons that hold them (``inner``, ``left``, ``left_semi``, ``left_anti``).

    ``boundary=True`` is "intersects": a point on a shared border matches every polygon there.
    ``boundary=False`` is "within". ``test`` replaces the point test by SQL on ``_edges``, for
    objects reaching at most ``margin`` from the point.
    """
    attributes = [c for c in polygons.columns if c not in ("edges", *BOX)] if how in ("inner", "left") else []
    layout = bin_layout(polygons, bin_size, margin)
    if layout is None:
        layout = Layout(Box(0.0, 0.0, 0.0, 0.0), 1.0, 1.0)
    elif how in ("inner", "left_semi"):
        b = layout.box
        points = points.filter(
            Box(b.xmin - margin[0], b.ymin - margin[1], b.xmax + margin[0], b.ymax + margin[1]).holds(x, y)
        )
    bins = polygon_bins(polygons, layout, margin).select(
        *attributes, "_bx", "_by", "_full", F.col("edges").alias("_edges"), *[F.col(c).alias("_" + c) for c in BOX]
    )
    keyed = points.selectExpr(
        "*", f"floor(`{x}` / {layout.width!r}D) as _px", f"floor(`{y}` / {layout.height!r}D) as _py"
    )
    mx, my = (f"{float(m)!r}D" for m in margin)
    where = F.expr(
        f"`{x}` between _xmin - {mx} and _xmax + {mx} and `{y}` between _ymin - {my} and _ymax + {my} and "
        + f"(_full or {inside(f'`{x}`', f'`{y}`', '_edges', boundary) if test is None else test})"
    )
    # The bound usually settles it; otherwise the bins are measured.
    limit = BROADCAST_BYTES if broadcast_limit is None else broadcast_limit
    small = layout.bound <= limit or fits_broadcast(bins, limit)
    joined = equi_join(
        keyed,
        bins,
        {"_px": "_bx", "_py": "_by"},
        how,
        where=where,
        null_safe=False,
        spread=not small,
        hot_rows=hot_rows,
        small=small,
    )
    return joined.drop("_px", "_py", "_full", "_edges", *["_" + c for c in BOX])


def within_any(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """Points strictly inside at least one polygon."""
    return join_polygons(points, polygons, "left_semi", boundary=False, **options)


def clip_points(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """Points inside or on the border of the union of the polygons."""
    return join_polygons(points, polygons, "left_semi", boundary=True, **options)


def zone_join(points: DataFrame, zones: DataFrame, country: DataFrame | None = None, **options) -> DataFrame:
    """Attach the attributes of every zone a point meets; unmatched points are dropped.

    With ``country`` the zones count only inside the union of its polygons: a point must meet both.
    """
    if country is not None:
        points = clip_points(points, country)
    return join_polygons(points, zones, "inner", **options)
