"""Raster cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.nulls import clean_double
from strataweave.operators.raster import raster_window
from strataweave.operators.spatial import Box


def read_raster(spark: SparkSession, path: str, raster_id: str | None = None, window: Box | None = None) -> DataFrame:
    """Cells of one raster, optionally within a window.

    The name prunes partitions and the window reaches the Parquet scan as range conditions.
    """
    cells = spark.read.parquet(path)
    if raster_id is not None:
        cells = cells.filter(F.col("raster_id") == raster_id)
    if window is not None:
        cells = raster_window(cells, window)
    return cells.withColumn("value", clean_double("value"))


def read_monthly_stack(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """Twelve monthly layers of one variable, with a ``month`` column."""
    return read_raster(spark, path, variable)


def write_raster(cells: DataFrame, path: str, tile: int = 256) -> None:
    """Write cells partitioned by raster and clustered by tile, so a window skips row groups.

    Fails if the target exists.
    """
    tiles = (F.floor(F.col("row") / tile), F.floor(F.col("col") / tile))
    spread = cells.repartitionByRange("raster_id", *tiles)
    spread.sortWithinPartitions("raster_id", *tiles, "row", "col").write.partitionBy("raster_id").parquet(path)
