"""Own samples against gridded values: by zone, by buffer and by basin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.clean import keep_present, rename_dynamic
from strataweave.operators.groups import describe, region_rollup
from strataweave.operators.joins import left_join, lookup_join, semi_join
from strataweave.operators.raster import Grid, buffer_stats
from strataweave.operators.reshape import sample_sizes, union_fill
from strataweave.operators.row_sums import circle_stats
from strataweave.operators.sampling import matched_resample, stratified_sample
from strataweave.operators.spatial import as_box, crop_polygons, layer_bbox, zone_join
from strataweave.session import stage
from strataweave.sources.lookups import BUFFER_RADIUS_M


def combine_sources(
    samples: DataFrame,
    section: str,
    value: str,
    grid_values: DataFrame,
    mapping: DataFrame,
    grid_column: str = "value",
    sources: tuple[str, str] = ("own", "grid"),
    scale: float = 10.0,
    key: Sequence[str] = (),
) -> DataFrame:
    """Own values of one core section stacked on the scaled grid values of the same climates.

    ``samples`` has ``climate`` and ``code``; ``mapping`` gives the climate of each code. ``key``
    keeps identifying columns, which sampling needs.
    """
    own = left_join(samples, mapping, ["climate", "code"]).filter(F.col("core_section") == section)
    # Used twice: as rows, and for the set of climates.
    own = stage(own.select("climate", value, *key, F.lit(sources[0]).alias("source")))
    grid = left_join(grid_values, mapping, {"zone": "code"})
    grid = semi_join(grid, own.select("climate").distinct(), "climate")
    grid = rename_dynamic(grid, grid_column, value).select(
        "climate", (F.col(value) / F.lit(float(scale))).alias(value), "zone", F.lit(sources[1]).alias("source")
    )
    return union_fill(own, grid if key else grid.drop("zone"))


def sample_with_labels(
    combined: DataFrame, key: Sequence[str], n: int = 1000, seed=1, own: str = "own", other: str = "grid"
) -> DataFrame:
    """Stratified sample with sample-size labels; climates with one own row or none get NULL labels."""
    sampled = stage(stratified_sample(stage(combined), ["climate", "source"], key, n, seed))
    return lookup_join(sampled, sample_sizes(sampled, "climate", "source", own, other), "climate")


def resample_labelled(
    combined: DataFrame, key: Sequence[str], seeds: Sequence[int] = (1, 5, 10), own: str = "own", other: str = "grid"
) -> DataFrame:
    """Matched resampling with labels; rows without a label are dropped."""
    combined = stage(combined)  # read by the draws and by the sizes
    drawn = matched_resample(combined, key, own, seeds)
    sizes = sample_sizes(combined, "climate", "source", own, other, shown=own)
    return keep_present(lookup_join(drawn, sizes, "climate"), "axis_label")


def buffer_comparison(
    sections: dict[str, tuple[DataFrame, DataFrame]],
    radius: float = BUFFER_RADIUS_M,
    lattice: Grid | None = None,
    scale: float = 10.0,
    names: tuple[str, str, str] = ("sg_mean", "sg_count", "sg_sd"),
    hot_rows: int | None = None,
    **options,
) -> DataFrame:
    """Buffer statistics of several sections, each with its own points and raster, stacked.

    With ``lattice``, a grid that all the rasters share, the sections are computed in one pass.
    """
    if lattice is None or options:
        parts = [
            buffer_stats(points, cells, radius, scale=scale, names=names, hot_rows=hot_rows, lattice=lattice, **options)
            for points, cells in sections.values()
        ]
        return union_fill(*parts)
    mark = lambda df, name: df.withColumn("_section", F.lit(name))
    points = union_fill(*[mark(points, name) for name, (points, _) in sections.items()])
    value = (F.col("value") / F.lit(float(scale))).alias("value")
    cells = union_fill(*[mark(cells, name).select("_section", "row", "col", value) for name, (_, cells) in sections.items()])
    return circle_stats(points, cells, lattice, radius, names, by=["_section"], hot_rows=hot_rows).drop("_section")


def respiration_buffer(
    samples: DataFrame, sites: DataFrame, cells: DataFrame, radius: float, site: str, scale: float = 10.0, **options
) -> DataFrame:
    """Sample rows with the buffer statistics of their site."""
    names = ("gridded_mean", "gridded_count", "gridded_sd")
    located = buffer_stats(sites, cells, radius, scale=scale, names=names, **options)
    # no count of the sites' samples first: it would compute them twice, and adaptive execution splits crowded sites
    return left_join(samples, stage(located.select(site, *names)), site)


def basin_summary(points: DataFrame, basins: DataFrame, value: str, country: DataFrame | None = None) -> DataFrame:
    """Mean, sd, extremes and count of a value per core section and basin.

    With ``country`` the basins are first cut to its bounding rectangle.
    """
    if country is not None:
        basins = crop_polygons(basins, as_box(layer_bbox(country)))
    joined = zone_join(points, basins)
    names = {"mean": f"{value}_mean", "sd": f"{value}_sd", "min": f"{value}_min", "max": f"{value}_max"}
    return describe(joined, ["core_section", "glu_id", "glu_nm"], value, names, count="n", na_rm=False)


def basin_compare(summary: DataFrame, statistics: DataFrame, iso: str, c_type: str) -> DataFrame:
    """Basin summaries beside the regional statistics of one country and content type."""
    chosen = statistics.filter((F.col("iso") == iso) & (F.col("c_type") == c_type))
    rolled = region_rollup(chosen, ["iso", "glu_code", "glu_name", "c_type"])
    return lookup_join(summary, rolled, {"glu_id": "glu_code"})


def basin_choropleth(basins: DataFrame, statistics: DataFrame) -> DataFrame:
    """Basins with regional statistics attached."""
    return lookup_join(basins, statistics, {"glu_id": "glu_code"})

