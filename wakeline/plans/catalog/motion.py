"""Lag features of the motion plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import kinematics, quality
from wakeline.plans import ingest, views
from wakeline.plans.catalog.base import MOTION, TRACKS, query, r6, with_blocks


def _motion(spark, sf, columns):
    rows = kinematics.with_previous(views.tracks(spark, sf))
    made = kinematics.motion_columns(kinematics.current(), F.col("prev1"), F.col("prev2"))
    return rows.select("global_lsn", *[r6(made[c]).alias(c) for c in columns])


def _motion_sql(columns):
    picked = ", ".join(f"r6({c}) AS {c}" for c in columns)
    return with_blocks(MOTION, f"SELECT global_lsn, {picked} FROM motion")


def _register(name, columns):
    query(name, _motion_sql(columns))(lambda spark, sf: _motion(spark, sf, columns))


@query("w1_time_delta", with_blocks(MOTION, "SELECT global_lsn, dt, dts AS dt_safe FROM motion"))
def w1(spark, sf):
    rows = kinematics.with_previous(views.tracks(spark, sf), lags=1)
    cur, prev = kinematics.current(), F.col("prev1")
    return rows.select("global_lsn", kinematics.elapsed(cur, prev).alias("dt"),
                       kinematics.elapsed_floor(cur, prev).alias("dt_safe"))


_register("w2_log_time_delta", ["log_time_diff"])


@query("w3_fixed_point_deltas", with_blocks(MOTION, """SELECT global_lsn, round(dla, 7) AS d_lat,
  round(dlo, 7) AS d_lon, round(dsp, 4) AS d_speed, round(dco, 4) AS d_course FROM motion"""))
def w3(spark, sf):
    rows = kinematics.with_previous(views.tracks(spark, sf), lags=1)
    cur, prev = kinematics.current(), F.col("prev1")
    d = lambda n, s: kinematics.fixed_point_delta(cur, prev, n, s)
    return rows.select(
        "global_lsn",
        F.round(d("lat_raw", 1e7), 7).alias("d_lat"), F.round(d("lon_raw", 1e7), 7).alias("d_lon"),
        F.round(d("speed_raw", 1e4), 4).alias("d_speed"), F.round(d("course_raw", 1e4), 4).alias("d_course"))


_register("w4_course_change", ["course_change"])


@query("w5_gap_gate", with_blocks(MOTION, """SELECT global_lsn, (dt > 900)::INT AS gated,
  r6(acceleration) AS acceleration, r6(course_change) AS course_change FROM motion"""))
def w5(spark, sf):
    rows = kinematics.with_previous(views.tracks(spark, sf), lags=1)
    cur, prev = kinematics.current(), F.col("prev1")
    return rows.select(
        "global_lsn", (kinematics.elapsed(cur, prev) > kinematics.GAP_LIMIT_SEC).cast("int").alias("gated"),
        r6(kinematics.acceleration(cur, prev)).alias("acceleration"),
        r6(kinematics.course_change(cur, prev)).alias("course_change"))


_register("w6_planar_displacement", ["delta_x_nm", "delta_y_nm"])
_register("w7_great_circle_displacement", ["geodetic_distance_nm"])
_register("w8_acceleration_turn_jerk", ["acceleration", "turn_rate", "jerk", "turn_rate_speed_ratio"])

# the event positions hardly ever repeat, so every third position is pinned here
PINNED = """pinned AS (SELECT * REPLACE (CASE WHEN global_lsn % 3 = 0 THEN 23.5::DOUBLE ELSE lon_raw END AS lon_raw,
  CASE WHEN global_lsn % 3 = 0 THEN 37.9::DOUBLE ELSE lat_raw END AS lat_raw) FROM tracks)"""


@query("w9_frozen_position", with_blocks(TRACKS, """SELECT global_lsn, coalesce((lon_raw = lag(lon_raw) OVER v
   AND lat_raw = lag(lat_raw) OVER v AND speed_raw > 2.0)::INT, 0) AS flag_frozen_position
FROM pinned WINDOW v AS (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn)""", extra=[PINNED]))
def w9(spark, sf):
    pin = F.pmod(F.col("global_lsn"), F.lit(3)) == 0
    rows = views.tracks(spark, sf).withColumns({
        "lon_raw": F.when(pin, F.lit(23.5)).otherwise(F.col("lon_raw")),
        "lat_raw": F.when(pin, F.lit(37.9)).otherwise(F.col("lat_raw"))})
    return quality.frozen_positions(rows).select("global_lsn", "flag_frozen_position")


FLAGGED = """flagged AS (SELECT t.*, (speed_raw > 45.0)::INT AS f_speed,
  (speed_raw > 90.0 OR abs(acceleration) > 15.0)::INT AS f_jump,
  coalesce((lon_raw = plo AND lat_raw = pla AND speed_raw > 2.0)::INT, 0) AS f_frozen,
  {land} AS f_land FROM trips t)"""
LAND = "(38.1::DOUBLE - CAST(trunc((38.1::DOUBLE-lat_raw)/0.001::DOUBLE) AS INT)*0.001::DOUBLE > 38.05 AND 23.1::DOUBLE + CAST(trunc((lon_raw-23.1::DOUBLE)/0.001::DOUBLE) AS INT)*0.001::DOUBLE > 23.93 AND CAST(trunc((lon_raw-23.1::DOUBLE)/0.001::DOUBLE) AS INT) BETWEEN 0 AND 898)::INT"
REL = """rel AS (SELECT *, least(greatest(1.0 - 0.3*f_speed - 0.5*f_jump - 0.2*f_frozen - 0.05*flag_null_course
   - (CASE WHEN log_time_diff > 7.5 THEN 0.1 ELSE 0 END) - 0.8*f_land, 0.0), 1.0)::DOUBLE AS reliability_score FROM flagged)"""
FEATURE_BLOCKS = [*MOTION, "trips0", "trips"]
TIME_ORDER = "timestamp_sec, global_lsn"


def feature_sql(body: str, extra=()) -> str:
    """Reference SQL over the full feature plan, everything ordered by time."""
    return with_blocks(FEATURE_BLOCKS, body, order=TIME_ORDER, source="motion",
                       extra=[FLAGGED.replace("{land}", LAND), REL, *extra])


@query("entry_trip_summary", feature_sql("""SELECT vessel_id_int, trip_id, count(*) AS points,
  max(timestamp_sec) - min(timestamp_sec) AS duration_sec, r6(sum(geodetic_distance_nm)) AS distance_nm,
  r6(max(speed_raw)) AS max_speed, r6(avg(reliability_score)) AS mean_reliability
FROM rel GROUP BY 1, 2"""))
def trip_summary(spark, sf):
    trips = ingest.trip_summary(ingest.feature_table(views.tracks(spark, sf)))
    doubles = ("distance_nm", "max_speed", "mean_reliability")
    return trips.withColumns({c: r6(F.col(c)) for c in doubles})


@query("ingest_feature_rows", feature_sql("""SELECT global_lsn, trip_id, is_static, r6(jerk) AS jerk,
  r6(acceleration) AS acceleration, r6(delta_x_nm) AS delta_x_nm, r6(log_time_diff) AS log_time_diff,
  r6(turn_rate_speed_ratio) AS turn_rate_speed_ratio, r6(reliability_score) AS reliability_score FROM rel"""))
def feature_rows(spark, sf):
    names = ["jerk", "acceleration", "delta_x_nm", "log_time_diff", "turn_rate_speed_ratio", "reliability_score"]
    return ingest.feature_table(views.tracks(spark, sf)).select(
        "global_lsn", "trip_id", "is_static", *[r6(F.col(n)).alias(n) for n in names])
