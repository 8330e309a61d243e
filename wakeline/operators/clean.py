"""Cleaning, conformance and dimension joins of raw position messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.functions import fields
from wakeline.registry import SUPERCLASS, taxonomy_frame

# The canonical track contract, in order.
CANONICAL = T.StructType([
    T.StructField("global_lsn", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("mmsi_str", T.StringType()),
    T.StructField("lon_raw", T.DoubleType()),
    T.StructField("lat_raw", T.DoubleType()),
    T.StructField("heading_raw", T.DoubleType()),
    T.StructField("speed_raw", T.DoubleType()),
    T.StructField("course_raw", T.DoubleType()),
    T.StructField("vessel_id_int", T.LongType()),
    T.StructField("vessel_bucket_id", T.IntegerType()),
    T.StructField("timestamp_sec", T.LongType()),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("flag_null_course", T.IntegerType()),
    T.StructField("course_sin", T.DoubleType()),
    T.StructField("course_cos", T.DoubleType()),
    T.StructField("shiptype", T.LongType()),
    T.StructField("vessel_superclass_id", T.ShortType()),
    T.StructField("vessel_behavior_id", T.ShortType()),
    T.StructField("distance_to_coast_nm", T.DoubleType()),
    T.StructField("distance_to_terminal_nm", T.DoubleType()),
    T.StructField("harbor_basin_proximity", T.DoubleType()),
    T.StructField("turn_rate_speed_ratio", T.DoubleType()),
    T.StructField("distance_to_land_raster", T.DoubleType()),
    T.StructField("flag_land_ingress", T.IntegerType()),
])


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """Fail before any job starts when a column is absent."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{what}: missing columns {absent}")
    return df


def conform(df: DataFrame, schema: T.StructType = CANONICAL) -> DataFrame:
    """Select and cast to a fixed schema; a column that is absent becomes null."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def parse_ids_and_times(df: DataFrame) -> DataFrame:
    """Add vessel id, hash bucket, epoch seconds and UTC time; drop rows without a time."""
    vessel = fields.vessel_id(F.col("mmsi_str"))
    return (
        df.withColumn("vessel_id_int", vessel)
        .withColumn("vessel_bucket_id", fields.hash_bucket(F.col("vessel_id_int")))
        .withColumn("timestamp_sec", fields.epoch_seconds(F.col("timestamp")))
        .where(F.col("timestamp_sec").isNotNull())
        .withColumn("datetime", fields.utc_timestamp(F.col("timestamp_sec")))
    )


def drop_missing_positions(df: DataFrame) -> DataFrame:
    return df.where(~fields.missing(F.col("lon_raw")) & ~fields.missing(F.col("lat_raw")))


def impute_motion(df: DataFrame) -> DataFrame:
    """Missing speed and course become 0, a missing course is flagged, course is encoded."""
    flag = fields.null_flag(F.col("course_raw"))
    course = fields.imputed(F.col("course_raw"))
    sin, cos = fields.circular(course)
    return df.withColumns({
        "flag_null_course": flag,
        "course_sin": sin,
        "course_cos": cos,
        "speed_raw": fields.imputed(F.col("speed_raw")),
        "course_raw": course,
    })


def with_ship_type(df: DataFrame, ships: DataFrame) -> DataFrame:
    """Left join on the text id.

    The ship table may be large, so no broadcast is forced: Spark broadcasts it
    only when its measured size allows, and splits skewed vessels otherwise.
    """
    return df.join(ships.select("mmsi_str", "shiptype"), "mmsi_str", "left")


def with_taxonomy(df: DataFrame, corrected: bool = False) -> DataFrame:
    """Decode the ship-type code; null, NaN and unknown codes give class 0, behaviour 0."""
    codes = taxonomy_frame(df.sparkSession, corrected).withColumnRenamed("shiptype", "_code")
    code = F.when(~F.isnan(F.col("shiptype").cast("double")), F.col("shiptype")).cast("bigint")
    return (
        df.withColumn("_type", code)
        .join(F.broadcast(codes), F.col("_type") == F.col("_code"), "left")
        .withColumns({
            c: F.coalesce(F.col(c), F.lit(0)) for c in ("vessel_superclass_id", "vessel_behavior_id")
        })
        .drop("_type", "_code")
    )


def resolve_cohort(typed: Column | None, text: Column | None) -> Column:
    """A positive typed class id wins, then the class named in the text, then 0."""
    names = F.create_map(*[F.lit(x) for name, i in SUPERCLASS.items() for x in (name.lower(), i)])
    options = []
    if typed is not None:
        options.append(F.when(typed > 0, typed.cast("int")))
    if text is not None:
        options.append(F.try_element_at(names, F.lower(F.trim(text))))
    return F.coalesce(*options, F.lit(0))


def ship_types_from(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("vessel_id").cast("string").alias("mmsi_str"),
        F.coalesce(F.col("shiptype").cast("bigint"), F.lit(0)).alias("shiptype"),
    )


def without_carried_rows(df: DataFrame) -> DataFrame:
    """Carried rows only feed the lag features; they leave before the sink."""
    return df.where(F.col("is_ghost") == 0).drop("is_ghost")
