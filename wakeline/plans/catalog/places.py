"""Distances to anchors, the coastal raster, hash groups and split labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import fields, geo, scoring
from wakeline.plans import views
from wakeline.plans.catalog.base import TRACKS, query, r6, with_blocks
from wakeline.registry import COASTLINE, PORT, TERMINAL


def _arc(lat, lon):
    return f"""2*asin(sqrt(least(greatest(pow(sin((radians({lat}::DOUBLE)-radians(lat_raw))/2),2)
    + cos(radians(lat_raw))*cos(radians({lat}::DOUBLE))*pow(sin((radians({lon}::DOUBLE)-radians(lon_raw))/2),2), 1e-9), 1.0-1e-9)))*3440.065"""


@query("f1_anchor_distance", with_blocks(["raw"], f"""SELECT global_lsn, r6({_arc(*PORT)}) AS distance_to_port_nm,
  r6({_arc(*TERMINAL)}) AS distance_to_terminal_nm FROM raw"""))
def f1(spark, sf):
    lat, lon = F.col("lat_raw"), F.col("lon_raw")
    return views.raw_tracks(spark, sf).select(
        "global_lsn", r6(geo.great_circle_nm(lat, lon, *PORT)).alias("distance_to_port_nm"),
        r6(geo.great_circle_nm(lat, lon, *TERMINAL)).alias("distance_to_terminal_nm"))


@query("f2_anchor_bearing", with_blocks(["raw"], f"""SELECT global_lsn, r6((degrees(atan2(
   sin(radians({PORT[1]}::DOUBLE)-radians(lon_raw))*cos(radians({PORT[0]}::DOUBLE)),
   cos(radians(lat_raw))*sin(radians({PORT[0]}::DOUBLE)) - sin(radians(lat_raw))*cos(radians({PORT[0]}::DOUBLE))*cos(radians({PORT[1]}::DOUBLE)-radians(lon_raw))
   )) + 360.0) % 360.0) AS bearing_to_port FROM raw"""))
def f2(spark, sf):
    bearing = geo.bearing_deg(F.col("lat_raw"), F.col("lon_raw"), *PORT)
    return views.raw_tracks(spark, sf).select("global_lsn", r6(bearing).alias("bearing_to_port"))


@query("f3_proximity_decay", with_blocks(["raw"], f"""SELECT global_lsn,
  r6(exp(-(({_arc(*TERMINAL)})/0.25)*ln(2.0::DOUBLE))) AS harbor_basin_proximity FROM raw"""))
def f3(spark, sf):
    nm = geo.great_circle_nm(F.col("lat_raw"), F.col("lon_raw"), *TERMINAL)
    return views.raw_tracks(spark, sf).select("global_lsn", r6(geo.proximity(nm)).alias("harbor_basin_proximity"))


_SQUARES = ", ".join(f"pow(la-{a}::DOUBLE,2)+pow(lo-{b}::DOUBLE,2)" for a, b in COASTLINE)
RASTER_BLOCKS = [
    """idx AS (SELECT *, CAST(trunc((38.1::DOUBLE-lat_raw)/0.001::DOUBLE) AS INT) AS rr,
      CAST(trunc((lon_raw-23.1::DOUBLE)/0.001::DOUBLE) AS INT) AS cc FROM raw)""",
    """corner AS (SELECT *, 38.1::DOUBLE - least(greatest(rr,0),599)*0.001::DOUBLE AS la,
      23.1::DOUBLE + least(greatest(cc,0),898)*0.001::DOUBLE AS lo FROM idx)""",
    f"""raster AS (SELECT *, CASE WHEN la > 38.05::DOUBLE AND lo > 23.93::DOUBLE THEN 0.0
      ELSE sqrt(least({_SQUARES}))*60.0 END AS cell FROM corner)""",
]


@query("f4_raster_distance", with_blocks(["raw"], """SELECT global_lsn, r6(CASE WHEN rr BETWEEN 0 AND 599
   AND cc BETWEEN 0 AND 898 THEN cell ELSE 5.0 END) AS point_form, r6(cell) AS edge_form FROM raster""", extra=RASTER_BLOCKS))
def f4(spark, sf):
    lat, lon = F.col("lat_raw"), F.col("lon_raw")
    return views.raw_tracks(spark, sf).select(
        "global_lsn", r6(geo.raster_distance(lat, lon)).alias("point_form"),
        r6(geo.raster_distance(lat, lon, nearest_edge=True)).alias("edge_form"))


@query("f5_land_ingress", with_blocks(["raw"], """SELECT global_lsn, (rr BETWEEN 0 AND 599 AND cc BETWEEN 0 AND 898
   AND cell = 0.0)::INT AS flag_land_ingress FROM raster""", extra=RASTER_BLOCKS))
def f5(spark, sf):
    raster = geo.raster_distance(F.col("lat_raw"), F.col("lon_raw"))
    return views.raw_tracks(spark, sf).select("global_lsn", (raster == 0.0).cast("int").alias("flag_land_ingress"))


@query("x1_raster_without_udf", with_blocks(["raw"], """SELECT rr AS grid_row, count(*) AS n, r6(min(cell)) AS nearest_nm
FROM raster GROUP BY 1""", extra=RASTER_BLOCKS))
def x1(spark, sf):
    lat, lon = F.col("lat_raw"), F.col("lon_raw")
    row, _ = geo.raster_cell(lat, lon)
    near = geo.raster_distance(lat, lon, nearest_edge=True)
    return views.raw_tracks(spark, sf).groupBy(row.alias("grid_row")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.min(near)).alias("nearest_nm"))


WIND = "SELECT global_lsn, course_raw, ((global_lsn*7)%11 - 5)::DOUBLE AS u, ((global_lsn*5)%13 - 6)::DOUBLE AS v FROM tracks"


def _wind(spark, sf):
    n = F.col("global_lsn")
    return views.tracks(spark, sf).select(
        "global_lsn", "course_raw", (F.pmod(n * 7, F.lit(11)) - 5).cast("double").alias("u"),
        (F.pmod(n * 5, F.lit(13)) - 6).cast("double").alias("v"))


@query("f6_wind_speed_direction", with_blocks(TRACKS, f"""SELECT global_lsn, r6(sqrt(u*u+v*v)) AS wind_speed,
  (sqrt(u*u+v*v) > 1e-6)::INT AS wind_dir_valid,
  CASE WHEN sqrt(u*u+v*v) > 1e-6 THEN r6((degrees(atan2(-u,-v)) + 360.0) % 360.0) END AS wind_direction FROM ({WIND})"""))
def f6(spark, sf):
    u, v = F.col("u"), F.col("v")
    direction = F.nanvl(geo.wind_direction(u, v), F.lit(None).cast("double"))
    return _wind(spark, sf).select(
        "global_lsn", r6(geo.wind_speed(u, v)).alias("wind_speed"),
        geo.wind_direction_valid(u, v).alias("wind_dir_valid"), r6(direction).alias("wind_direction"))


@query("f7_head_and_crosswind", with_blocks(TRACKS, f"""SELECT global_lsn,
  r6(-(u*sin(radians(course_raw)) + v*cos(radians(course_raw)))) AS headwind_component,
  r6(u*cos(radians(course_raw)) - v*sin(radians(course_raw))) AS crosswind_component FROM ({WIND})"""))
def f7(spark, sf):
    u, v, c = F.col("u"), F.col("v"), F.col("course_raw")
    return _wind(spark, sf).select(
        "global_lsn", r6(geo.headwind(u, v, c)).alias("headwind_component"),
        r6(geo.crosswind(u, v, c)).alias("crosswind_component"))


@query("f8_visibility_default", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 10000.0
  WHEN event_id % 3 = 1 THEN 10000.0 ELSE value END AS visibility FROM events""")
def f8(spark, sf):
    n = F.pmod(F.col("event_id"), F.lit(3))
    vis = F.when(n == 0, F.lit(None).cast("double")).when(n == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return views.table(spark, sf, "events").select("event_id", geo.visibility(vis).alias("visibility"))


@query("f9_limit_flags", """SELECT event_id, (value/5.0 > 45.0)::INT AS flag_speed_anomaly,
  (value/5.0 > 90.0 OR abs(value/10.0 - 10.0) > 15.0)::INT AS flag_position_jump FROM events""")
def f9(spark, sf):
    speed, acc = F.col("value") / 5.0, F.col("value") / 10.0 - 10.0
    return views.table(spark, sf, "events").select(
        "event_id", scoring.speed_flag(speed).alias("flag_speed_anomaly"),
        scoring.jump_flag(speed, acc).alias("flag_position_jump"))


@query("f10_reliability", """SELECT event_id, r6(least(greatest(1.0::DOUBLE - 0.30::DOUBLE*(event_id%2=0)::INT
  - 0.50::DOUBLE*(event_id%3=0)::INT - 0.20::DOUBLE*(event_id%5=0)::INT - 0.05::DOUBLE*(event_id%7=0)::INT
  - 0.10::DOUBLE*(value/10.0 > 7.5)::INT - 0.80::DOUBLE*(event_id%11=0)::INT, 0.0), 1.0)) AS reliability_score FROM events""")
def f10(spark, sf):
    n = F.col("event_id")
    bits = {"flag_speed_anomaly": 2, "flag_position_jump": 3, "flag_frozen_position": 5,
            "flag_null_course": 7, "flag_land_ingress": 11}
    flags = {name: (F.pmod(n, F.lit(m)) == 0).cast("int") for name, m in bits.items()}
    score = scoring.reliability(flags, F.col("value") / 10.0)
    return views.table(spark, sf, "events").select("event_id", r6(score).alias("reliability_score"))


@query("f16_hash_group", """SELECT event_id, ((('0x'||substr(h,1,8))::BIGINT + ('0x'||substr(h,9,8))::BIGINT
  + ('0x'||substr(h,17,8))::BIGINT + ('0x'||substr(h,25,8))::BIGINT) % 3)::INT AS grp,
  ['dead_reckoning','coastal_creep','loitering'][1 + ((('0x'||substr(h,1,8))::BIGINT + ('0x'||substr(h,9,8))::BIGINT
  + ('0x'||substr(h,17,8))::BIGINT + ('0x'||substr(h,25,8))::BIGINT) % 3)] AS scenario
FROM (SELECT event_id, md5(user_id || '_' || event_id) AS h FROM events)""")
def f16(spark, sf):
    text = F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return views.table(spark, sf, "events").select(
        "event_id", scoring.md5_mod(text).alias("grp"), scoring.scenario(text).alias("scenario"))


@query("f18_split_label", """SELECT o_orderkey, CASE WHEN year(o_orderdate)+21 < 2019 OR (year(o_orderdate)+21 = 2019
   AND month(o_orderdate) <= 6) THEN 'train' WHEN year(o_orderdate)+21 = 2019 AND month(o_orderdate) <= 9 THEN 'calibrate'
   WHEN year(o_orderdate)+21 = 2019 THEN 'test' END AS split FROM orders""")
def f18(spark, sf):
    d = F.col("o_orderdate")
    return views.table(spark, sf, "orders").select(
        "o_orderkey", fields.split_label(F.year(d) + 21, F.month(d)).alias("split"))
