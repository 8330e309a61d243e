"""Trips, static runs, first and last rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import segmentation
from wakeline.plans import views
from wakeline.plans.catalog.base import TRACKS, TRIPS, query, with_blocks

RUNS = [
    """limits AS (SELECT *, CASE vessel_superclass_id WHEN 3 THEN 0.2 WHEN 4 THEN 0.4 WHEN 11 THEN 1.0
     WHEN 12 THEN 1.0 ELSE 0.5 END AS floor_kn, CASE vessel_superclass_id WHEN 3 THEN 28800 WHEN 4 THEN 14400
     WHEN 11 THEN 7200 WHEN 12 THEN 7200 ELSE 14400 END AS anchor FROM tracks)""",
    """st AS (SELECT *, (speed_raw < floor_kn)::INT AS is_static FROM limits)""",
    """sh AS (SELECT *, CASE WHEN is_static = lag(is_static) OVER v THEN 0 ELSE 1 END AS shifted,
     coalesce(timestamp_sec - lag(timestamp_sec) OVER v, 0) AS step FROM st
     WINDOW v AS (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn))""",
    """runs AS (SELECT *, CAST(sum(shifted) OVER (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn
     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS static_run FROM sh)""",
    """durs AS (SELECT *, CASE WHEN is_static = 1 THEN CAST(sum(step) OVER (PARTITION BY vessel_id_int, static_run
     ORDER BY timestamp_sec, global_lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS static_seconds FROM runs)""",
    """cls AS (SELECT *, CAST(sum(CASE WHEN step > 1800 OR static_seconds > anchor THEN 1 ELSE 0 END)
     OVER (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_no
     FROM durs)""",
]


@query("w10_static_runs", with_blocks(TRACKS, "SELECT global_lsn, is_static, static_run FROM runs", extra=RUNS[:4]))
def w10(spark, sf):
    return segmentation.static_runs(views.tracks(spark, sf)).select("global_lsn", "is_static", "static_run")


@query("w11_static_duration", with_blocks(TRACKS, "SELECT global_lsn, static_seconds FROM durs", extra=RUNS[:5]))
def w11(spark, sf):
    return segmentation.static_runs(views.tracks(spark, sf)).select("global_lsn", "static_seconds")


@query("w12_class_trips", with_blocks(TRACKS, "SELECT global_lsn, vessel_superclass_id::INT AS vessel_superclass_id, trip_no FROM cls", extra=RUNS))
def w12(spark, sf):
    return segmentation.assign_class_trips(views.tracks(spark, sf)).select(
        "global_lsn", "vessel_superclass_id", "trip_no")


@query("w13_trip_assign", with_blocks(TRIPS, "SELECT global_lsn, is_static, trip_id FROM trips"))
def w13(spark, sf):
    return segmentation.assign_trips(views.tracks(spark, sf)).select("global_lsn", "is_static", "trip_id")


@query("w16_trip_stretches", with_blocks(TRIPS, """SELECT vessel_id_int, trip_id, count(*) AS points,
  min(timestamp_sec) AS start_sec, max(timestamp_sec) AS end_sec FROM trips GROUP BY 1, 2"""))
def w16(spark, sf):
    return segmentation.segment_keys(segmentation.assign_trips(views.tracks(spark, sf)))


@query("j4_trip_offset", with_blocks(TRIPS, """SELECT global_lsn, trip_no + coalesce(trip_offset, 0) AS trip_no
FROM trips LEFT JOIN (SELECT c_custkey * 2 AS vessel_id_int, c_custkey % 11 AS trip_offset FROM customer) USING (vessel_id_int)"""))
def j4(spark, sf):
    k = F.col("c_custkey")
    # vessels of odd id have no stored counter
    offsets = views.table(spark, sf, "customer").select(
        (k * 2).alias("vessel_id_int"), F.pmod(k, F.lit(11)).alias("trip_offset"))
    rows = segmentation.with_trip_offset(segmentation.assign_trips(views.tracks(spark, sf)), offsets)
    return rows.select("global_lsn", (F.col("trip_no") + F.col("trip_offset")).alias("trip_no"))


@query("a1_first_row", with_blocks(["raw"], """SELECT vessel_id_int, min(timestamp_sec) AS first_ts,
  arg_min(speed_raw, (timestamp_sec, global_lsn)) AS first_speed FROM raw GROUP BY 1"""))
def a1(spark, sf):
    rows = views.raw_tracks(spark, sf).select("vessel_id_int", "timestamp_sec", "global_lsn", "speed_raw")
    return segmentation.first_rows(rows).select(
        "vessel_id_int", F.col("timestamp_sec").alias("first_ts"), F.col("speed_raw").alias("first_speed"))


@query("a2_latest_row", with_blocks(["raw"], """SELECT vessel_id_int, global_lsn, timestamp_sec, lon_raw, lat_raw, speed_raw
FROM raw QUALIFY row_number() OVER (PARTITION BY vessel_id_int ORDER BY global_lsn DESC) = 1"""))
def a2(spark, sf):
    rows = views.raw_tracks(spark, sf).select(
        "vessel_id_int", "global_lsn", "timestamp_sec", "lon_raw", "lat_raw", "speed_raw")
    return segmentation.latest_rows(rows)


@query("w14_dedup_keep_first", """SELECT user_id AS vessel_id_int, day AS timestamp_sec, event_id AS global_lsn, value FROM
 (SELECT *, epoch_us(ts)//86400000000 AS day FROM events)
 QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) = 1""")
def w14(spark, sf):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000)).cast("bigint")
    rows = views.table(spark, sf, "events").select(
        F.col("user_id").alias("vessel_id_int"), day.alias("timestamp_sec"),
        F.col("event_id").alias("global_lsn"), "value")
    return segmentation.distinct_first(rows)


@query("t1_ordered_output", with_blocks(["raw"], """SELECT vessel_id_int, timestamp_sec, global_lsn,
  row_number() OVER (ORDER BY vessel_id_int, timestamp_sec, global_lsn) AS position FROM raw"""))
def t1(spark, sf):
    from wakeline.operators.slices import dense_sequence

    rows = views.raw_tracks(spark, sf).select("vessel_id_int", "timestamp_sec", "global_lsn")
    order = ["vessel_id_int", "timestamp_sec", "global_lsn"]
    hour = F.floor(F.col("timestamp_sec") / F.lit(3_600))
    numbered = dense_sequence(
        rows, order, "position", F.floor(F.col("vessel_id_int") / F.lit(16)), F.struct("vessel_id_int", hour), start=1)
    return numbered.orderBy(*order)
