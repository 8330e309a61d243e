"""Resampling, grid windows and row windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import kinematics, resample, segmentation, windows
from wakeline.operators.slices import Track
from wakeline.plans import ingest, views
from wakeline.plans.catalog.base import TRIPS, query, r6, with_blocks
from wakeline.plans.catalog.motion import feature_sql

DEDUP = """obs AS (SELECT * FROM trips QUALIFY row_number() OVER (PARTITION BY vessel_id_int, trip_id, timestamp_sec ORDER BY global_lsn) = 1)"""
SPAN = """span AS (SELECT vessel_id_int, trip_id, min(timestamp_sec) AS t0, max(timestamp_sec) AS tn, count(*) AS points FROM obs GROUP BY 1, 2)"""
OPEN_GRID = """grid AS (SELECT vessel_id_int, trip_id, unnest(range(t0, tn, 30)) AS grid_sec, t0, (tn - t0 + 29)//30 AS steps FROM span)"""
CLOSED_GRID = """grid AS (SELECT vessel_id_int, trip_id, unnest(range(t0, tn + 1, 30)) AS grid_sec, t0, tn FROM span)"""


def _observations(spark, sf):
    rows = segmentation.assign_trips(views.tracks(spark, sf)).select(
        "vessel_id_int", "trip_id", "timestamp_sec", "global_lsn", "speed_raw", "course_sin", "course_cos",
        "flag_null_course")
    return segmentation.distinct_first(rows, ("vessel_id_int", "trip_id", "timestamp_sec"))


@query("j14_hold_forward", with_blocks(TRIPS, """SELECT g.vessel_id_int, g.trip_id, (grid_sec - t0)//30 AS step, grid_sec,
  o.timestamp_sec AS obs_sec, r6(o.speed_raw) AS speed_raw FROM grid g ASOF JOIN obs o ON g.vessel_id_int = o.vessel_id_int
  AND g.trip_id = o.trip_id AND g.grid_sec >= o.timestamp_sec""", extra=[DEDUP, SPAN, OPEN_GRID]))
def j14(spark, sf):
    grid = resample.resample(_observations(spark, sf), hold=["speed_raw"])
    return grid.select("vessel_id_int", "trip_id", "step", "grid_sec", "obs_sec", r6(F.col("speed_raw")).alias("speed_raw"))


@query("j15_next_observation", with_blocks(TRIPS, """SELECT g.vessel_id_int, g.trip_id, (grid_sec - t0)//30 AS step,
  o.flag_null_course FROM grid g ASOF JOIN obs o ON g.vessel_id_int = o.vessel_id_int
  AND g.trip_id = o.trip_id AND g.grid_sec <= o.timestamp_sec""", extra=[DEDUP, SPAN, CLOSED_GRID]))
def j15(spark, sf):
    grid = resample.resample(_observations(spark, sf), upcoming=["flag_null_course"], closed=True)
    return grid.select("vessel_id_int", "trip_id", "step", "flag_null_course")


@query("j16_linear_grid", with_blocks(TRIPS, """SELECT g.vessel_id_int, g.trip_id, (grid_sec - g.t0)//30 AS step,
  r6(CASE WHEN b.timestamp_sec = a.timestamp_sec THEN a.speed_raw ELSE a.speed_raw + (b.speed_raw - a.speed_raw)*((grid_sec - a.timestamp_sec)/(b.timestamp_sec - a.timestamp_sec)::DOUBLE) END) AS speed_raw
  FROM grid g ASOF JOIN obs a ON g.vessel_id_int = a.vessel_id_int AND g.trip_id = a.trip_id AND g.grid_sec >= a.timestamp_sec
  ASOF JOIN obs b ON g.vessel_id_int = b.vessel_id_int AND g.trip_id = b.trip_id AND g.grid_sec <= b.timestamp_sec""",
  extra=[DEDUP, SPAN, CLOSED_GRID]))
def j16(spark, sf):
    grid = resample.resample(_observations(spark, sf), linear=["speed_raw"], closed=True)
    return grid.select("vessel_id_int", "trip_id", "step", r6(F.col("speed_raw")).alias("speed_raw"))


@query("w20_elapsed_on_grid", with_blocks(TRIPS, """SELECT g.vessel_id_int, g.trip_id, (grid_sec - t0)//30 AS step,
  r6(ln(1 + (grid_sec - o.timestamp_sec)::DOUBLE)) AS training, r6(ln(31::DOUBLE)) AS inference FROM grid g
  ASOF JOIN obs o ON g.vessel_id_int = o.vessel_id_int AND g.trip_id = o.trip_id AND g.grid_sec >= o.timestamp_sec""",
  extra=[DEDUP, SPAN, OPEN_GRID]))
def w20(spark, sf):
    grid = resample.resample(_observations(spark, sf))
    both = resample.elapsed_feature(resample.elapsed_feature(grid, name="training"), inference=True, name="inference")
    return both.select("vessel_id_int", "trip_id", "step", r6(F.col("training")).alias("training"),
                       r6(F.col("inference")).alias("inference"))


@query("w21_unit_circle", with_blocks(TRIPS, """SELECT vessel_id_int, trip_id, step, r6(s/(sqrt(s*s+c*c)+1e-8)) AS course_sin,
  r6(c/(sqrt(s*s+c*c)+1e-8)) AS course_cos FROM (SELECT g.vessel_id_int, g.trip_id, (grid_sec - g.t0)//30 AS step,
  CASE WHEN b.timestamp_sec = a.timestamp_sec THEN a.course_sin ELSE a.course_sin + (b.course_sin - a.course_sin)*((grid_sec - a.timestamp_sec)/(b.timestamp_sec - a.timestamp_sec)::DOUBLE) END AS s,
  CASE WHEN b.timestamp_sec = a.timestamp_sec THEN a.course_cos ELSE a.course_cos + (b.course_cos - a.course_cos)*((grid_sec - a.timestamp_sec)/(b.timestamp_sec - a.timestamp_sec)::DOUBLE) END AS c
  FROM grid g ASOF JOIN obs a ON g.vessel_id_int = a.vessel_id_int AND g.trip_id = a.trip_id AND g.grid_sec >= a.timestamp_sec
  ASOF JOIN obs b ON g.vessel_id_int = b.vessel_id_int AND g.trip_id = b.trip_id AND g.grid_sec <= b.timestamp_sec)""",
  extra=[DEDUP, SPAN, CLOSED_GRID]))
def w21(spark, sf):
    grid = resample.scoring_grid(_observations(spark, sf), ["course_sin", "course_cos"], [])
    return grid.select("vessel_id_int", "trip_id", "step", r6(F.col("course_sin")).alias("course_sin"),
                       r6(F.col("course_cos")).alias("course_cos"))


FOBS = """fobs AS (SELECT * FROM rel QUALIFY row_number() OVER (PARTITION BY vessel_id_int, trip_id, timestamp_sec ORDER BY global_lsn) = 1)"""
FSPAN = """fspan AS (SELECT vessel_id_int, trip_id, min(timestamp_sec) AS t0, max(timestamp_sec) AS tn FROM fobs GROUP BY 1, 2
  HAVING count(*) >= 5 AND max(timestamp_sec) - min(timestamp_sec) >= 1800)"""
FGRID = """fgrid AS (SELECT g.*, o.reliability_score, o.speed_raw FROM (SELECT vessel_id_int, trip_id, unnest(range(t0, tn, 30)) AS grid_sec, t0, (tn - t0 + 29)//30 AS steps FROM fspan) g
  ASOF JOIN fobs o ON g.vessel_id_int = o.vessel_id_int AND g.trip_id = o.trip_id AND g.grid_sec >= o.timestamp_sec)"""


@query("w17_grid_windows", feature_sql("""SELECT vessel_id_int || '_' || trip_id || '_' || w AS sequence_id, min(grid_sec) AS timestamp_sec,
  r6(avg(reliability_score)) AS reliability, r6(avg(speed_raw)) AS mean_speed, count(*) AS steps
FROM fgrid, (SELECT unnest(range(0, 100000, 30)) AS w) WHERE (grid_sec - t0)//30 >= w AND (grid_sec - t0)//30 < w + 60 AND w + 60 <= steps
GROUP BY vessel_id_int, trip_id, w HAVING avg(reliability_score) >= 0.40""", extra=[FOBS, FSPAN, FGRID]))
def w17(spark, sf):
    rows = ingest.feature_table(views.tracks(spark, sf)).select(
        "vessel_id_int", "trip_id", "timestamp_sec", "global_lsn", "speed_raw", "reliability_score")
    rows = segmentation.distinct_first(rows, ("vessel_id_int", "trip_id", "timestamp_sec"))
    grid = resample.training_grid(rows, ["speed_raw", "reliability_score"])
    out = windows.grid_windows(grid, ["speed_raw"])
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + s["speed_raw"])
    return out.select(
        "sequence_id", "timestamp_sec", r6(F.col("reliability")).alias("reliability"),
        r6(total / F.size("sequence")).alias("mean_speed"), F.size("sequence").cast("bigint").alias("steps"))


SERIES = """series AS (SELECT substr(o_orderpriority, 1, 1)::BIGINT AS vessel_id_int, o_orderkey AS global_lsn, o_totalprice AS price,
  (epoch_us(o_orderdate)//86400000000)::DOUBLE AS day, row_number() OVER (PARTITION BY substr(o_orderpriority, 1, 1) ORDER BY o_orderkey) - 1 AS row_no,
  count(*) OVER (PARTITION BY substr(o_orderpriority, 1, 1)) AS total FROM orders)"""
WINS = """wins AS (SELECT s.*, w AS start FROM series s, (SELECT unnest(range(0, 10000000, 100)) AS w) WHERE w <= row_no AND row_no < w + 200 AND w + 200 <= total
  UNION ALL SELECT s.*, total - 200 FROM series s WHERE total >= 200 AND (total - 200) % 100 <> 0 AND row_no >= total - 200)"""
BY_KEY = Track(key=("vessel_id_int",), order=("global_lsn",), width=2_000)


def _series(spark, sf):
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86_400_000_000)).cast("double")
    return views.table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("vessel_id_int"), F.col("o_orderkey").alias("global_lsn"),
        F.col("o_totalprice").alias("price"), day.alias("day"))


def _wins_sql(body):
    # the window list is cut at the longest series so that the SQL stays small
    return f"WITH {SERIES}, {WINS.replace('10000000', '400000')} {body}"


@query("w18_row_windows", _wins_sql("SELECT vessel_id_int, start, count(*) AS n, min(global_lsn) AS first_lsn, max(global_lsn) AS last_lsn FROM wins GROUP BY 1, 2"))
def w18(spark, sf):
    return windows.row_windows(_series(spark, sf), BY_KEY).groupBy("vessel_id_int", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("global_lsn").alias("first_lsn"), F.max("global_lsn").alias("last_lsn"))


@query("w19_short_chunks", f"WITH {SERIES} SELECT vessel_id_int, row_no//60 AS chunk, count(*) AS n, min(global_lsn) AS first_lsn FROM series GROUP BY 1, 2")
def w19(spark, sf):
    rows = windows.numbered(_series(spark, sf), BY_KEY)
    return rows.groupBy("vessel_id_int", windows.chunk(F.col("row_no")).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.min("global_lsn").alias("first_lsn"))


@query("a10_window_statistics", _wins_sql("""SELECT vessel_id_int, start, r6(avg(price)) AS mean_price, r6(stddev_pop(price)) AS std_price,
  r6(min(price)) AS min_price, r6(max(price)) AS max_price, r6(quantile_cont(price, 0.25)) AS p25_price, r6(quantile_cont(day, 0.75)) AS p75_day FROM wins GROUP BY 1, 2"""))
def a10(spark, sf):
    stats = windows.window_statistics(
        windows.row_windows(_series(spark, sf), BY_KEY), ["vessel_id_int", "start"], ["price", "day"])
    at = {"mean_price": 0, "std_price": 2, "min_price": 4, "max_price": 6, "p25_price": 8, "p75_day": 11}
    return stats.select("vessel_id_int", "start", *[r6(F.col("vector")[i]).alias(n) for n, i in at.items()])


@query("f20_time_cap", _wins_sql("""SELECT vessel_id_int, start FROM (SELECT vessel_id_int, start, max(late) OVER (PARTITION BY vessel_id_int ORDER BY start) AS stopped
  FROM (SELECT vessel_id_int, start, (arg_min(day, row_no) > 10500)::INT AS late FROM wins GROUP BY 1, 2)) WHERE stopped = 0"""))
def f20(spark, sf):
    wins = windows.row_windows(_series(spark, sf), BY_KEY).groupBy("vessel_id_int", "start").agg(
        F.min_by("day", "row_no").alias("first_day"))
    return windows.until_cutoff(wins, ["vessel_id_int"], "first_day", 10_500).select("vessel_id_int", "start")


@query("a32_context_means", feature_sql("""SELECT vessel_id_int, trip_id, count(*) AS n, r6(avg(distance_nm)) AS terminal_nm FROM (SELECT *,
  2*asin(sqrt(least(greatest(pow(sin((radians(37.9642::DOUBLE)-radians(lat_raw))/2),2)
    + cos(radians(lat_raw))*cos(radians(37.9642::DOUBLE))*pow(sin((radians(23.6105::DOUBLE)-radians(lon_raw))/2),2), 1e-9), 1.0-1e-9)))*3440.065 AS distance_nm FROM rel) GROUP BY 1, 2"""))
def a32(spark, sf):
    rows = kinematics.place_features(segmentation.assign_trips(views.tracks(spark, sf)))
    keys = ["vessel_id_int", "trip_id"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return windows.context_means(rows, keys).join(sizes, keys).select(*keys, "n", r6(F.col("terminal_nm")).alias("terminal_nm"))
