"""Session defaults, staged tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes of a broadcast table. The driver holds it about four times over while it is built.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "strataweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables, taken from ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return os.path.join(folder, context.applicationId)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, outlives lost executors, and gives Spark a table of known size.
    """
    path = os.path.join(staging_dir(df.sparkSession), uuid.uuid4().hex)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    for scope in _SCOPES:
        scope.append(table)
    return table


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def staged_scope() -> Iterator[None]:
    """Delete the tables staged within the block when it ends; results must be stored or read by then."""
    scope: list[DataFrame] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES.remove(scope)
        release(*scope)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory: text by its length, arrays by their entries."""

    def width(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(kind, T.ArrayType):
            entry = kind.elementType
            return F.size(c) * (8 * len(entry.fields) if isinstance(entry, T.StructType) else 16)
        if isinstance(kind, T.StructType):
            return F.lit(16 * len(kind.fields))
        return F.lit(0)

    total = F.lit(16 + 8 * len(df.columns))
    for field in df.schema.fields:
        total = total + F.greatest(F.coalesce(width(field.dataType, F.col(f"`{field.name}`")), F.lit(0)), F.lit(0))
    return total.cast("long")


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Measure the bytes of ``df`` against the broadcast limit."""
    size = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return size <= (BROADCAST_BYTES if limit is None else limit)
