"""CSV scans of position messages, ship types and weather nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw message layout.
RAW_COLUMNS = ["timestamp", "mmsi_str", "lon_raw", "lat_raw", "heading_raw", "speed_raw", "course_raw"]
TEXT_COLUMNS = ("timestamp", "mmsi_str")
RAW_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.DoubleType()) for c in RAW_COLUMNS])
TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
BYTE_ORDER_MARK = "﻿"


def read_positions(spark: SparkSession, *paths: str) -> DataFrame:
    """Position CSV files of a known, uniform layout without header."""
    return spark.read.schema(RAW_SCHEMA).option("pathGlobFilter", "*.csv").csv(list(paths))


def typed_positions(text: DataFrame) -> DataFrame:
    """Drop header lines (a byte-order mark and letter case do not matter), then cast."""
    first = F.lower(F.regexp_replace(F.col("timestamp"), f"^{BYTE_ORDER_MARK}", ""))
    rows = text.where(~F.coalesce(first.rlike("^(timestamp|vessel_id)"), F.lit(False)))
    return rows.select(*TEXT_COLUMNS, *[F.col(c).try_cast("double").alias(c) for c in RAW_COLUMNS[2:]])


def read_mixed_positions(spark: SparkSession, *paths: str) -> DataFrame:
    """Position CSV files of which any may start with a header line."""
    return typed_positions(spark.read.schema(TEXT_SCHEMA).option("pathGlobFilter", "*.csv").csv(list(paths)))


def stream_positions(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same files as a stream, optionally a fixed number of files per micro-batch."""
    reader = spark.readStream.schema(TEXT_SCHEMA).option("pathGlobFilter", "*.csv")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return typed_positions(reader.csv(path))


def read_ship_types(spark: SparkSession, path: str) -> DataFrame:
    """Ship table: text id and type code, a missing code counts as 0."""
    rows = spark.read.schema("vessel_id string, shiptype int").option("header", "true").csv(path)
    return rows.select(
        F.col("vessel_id").alias("mmsi_str"), F.coalesce(F.col("shiptype").cast("bigint"), F.lit(0)).alias("shiptype"))


def read_weather(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Weather nodes in year/month folders; coordinates are rounded to six digits."""
    rows = spark.read.option("header", "true").option("inferSchema", str(kind == "csv")).format(kind).load(path)
    return rows.withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)})
