"""Sample tables from CSV or Parquet, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.functions.nulls import nan_to_null

# The text that marks a missing cell.
MISSING = "NA"


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType()}


def _schema(**types: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in types.items()])


# Column names of the input tables.
SCHEMAS = {
    "respiration_summary": _schema(
        Sample_Name="string",
        Sampling_Set="string",
        Proposal_ID="string",
        Core_Section="string",
        pH="double",
        Clay_percent="double",
        respiration_ppm_co2_c="double",
        respiration_mg_co2_c_g_soil_day_24hour="double",
        respiration_mg_co2_c_g_soil_day_96hour="double",
    ),
    "site_master": _schema(Site_Code="string", Lat="double", Long="double"),
    "literature_respiration": _schema(Record_number="bigint", Latitude="double", Longitude="double"),
    "ph_properties": _schema(Sample_Name="string", pH="double"),
    "clay_properties": _schema(Sample_Name="string", Clay_percent="double"),
    "coordinates": _schema(proposal_id="bigint", sampling_set="bigint", latitude="double", longitude="double"),
    "basin_statistics": _schema(
        iso="string",
        glu_code="bigint",
        GCAM_GLU_name="string",
        c_type="string",
        weighted_average="double",
        median_value="double",
        min_value="double",
        max_value="double",
        q1_value="double",
        q3_value="double",
    ),
}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    blank_strings: str = "keep",
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV with a header by column name; ``schema`` is a StructType or a name in SCHEMAS.

    Columns the schema does not name are ignored, whatever their position in the file. All files of
    a path must have the same header; one that differs fails the read. ``blank_strings="keep"`` reads
    an empty text cell as empty text, ``"null"`` as missing. Large files are split over tasks unless
    ``multi_line`` says that cells may hold line breaks.
    """
    if blank_strings not in ("keep", "null"):
        raise ValueError("blank_strings is 'keep' or 'null'")
    schema = SCHEMAS[schema] if isinstance(schema, str) else schema
    # All text first: numbers are then read leniently and NA is told apart from a blank.
    options = dict(header=header, multiLine=multi_line, escape='"', nullValue="\u0000")
    raw = spark.read.csv(path, **options)
    if header:  # with a given schema the reader compares every file's header with it
        text_columns = T.StructType([T.StructField(c, T.StringType()) for c in raw.columns])
        raw = spark.read.csv(path, schema=text_columns, enforceSchema=False, **options)
    if not header:
        raw = raw.toDF(*schema.fieldNames())
    columns = []
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            if blank_strings == "keep":
                text = F.coalesce(text, F.lit(""))
            else:
                text = F.nullif(text, F.lit(""))
            value = F.nullif(text, F.lit(MISSING))
        else:
            value = F.nullif(text, F.lit(MISSING)).try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return nan_to_null(raw.select(*columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))
