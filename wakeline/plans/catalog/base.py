"""Registry of queries and the shared building blocks of the reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.registry import taxonomy_rows

QUERIES: dict = {}
ORACLES: dict = {}


# Cut point for six decimals.  It lies off 0.5 because ratios of short decimals often end
# exactly there, and two engines that add in another order would fall on either side.
CUT = 0.50731


def r6(value):
    """Six decimals by plain arithmetic, which DuckDB repeats bit for bit."""
    return F.floor(value * F.lit(1e6) + F.lit(CUT)) / F.lit(1e6)


def sql_r6(sql: str) -> str:
    """Write every ``r6(expr)`` of a reference SQL out as the same arithmetic."""
    while (at := sql.find("r6(")) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(floor(({sql[at + 3:end - 1]})*1e6::DOUBLE + {CUT}::DOUBLE)/1e6::DOUBLE){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None):
    """Register a query and, unless the result cannot be said in SQL, its reference SQL."""
    sql = None if sql is None else sql_r6(sql)

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_TYPES = ", ".join(f"({c},{s},{b})" for c, s, b in taxonomy_rows())

BLOCKS = {
    "raw": """raw AS (SELECT event_id AS global_lsn, user_id AS vessel_id_int,
  CAST(user_id AS VARCHAR) AS mmsi_str, epoch_us(ts) // 30000000 AS timestamp_sec,
  23.1::DOUBLE + ((event_id*7919) % 9000)::DOUBLE/10000.0::DOUBLE AS lon_raw,
  37.5::DOUBLE + ((event_id*104729) % 6000)::DOUBLE/10000.0::DOUBLE AS lat_raw,
  ((event_id*37) % 360)::DOUBLE AS heading_raw, value/5.0::DOUBLE AS speed_raw,
  CASE WHEN event_id % 50 <> 0 THEN ((event_id*37) % 360)::DOUBLE END AS course_null,
  user_id % 100 AS shiptype FROM events)""",
    "types": f"types(code, sc, bh) AS (VALUES {_TYPES})",
    "tracks": """tracks AS (SELECT raw.*, coalesce(course_null, 0.0::DOUBLE) AS course_raw,
  CASE WHEN course_null IS NULL THEN 1 ELSE 0 END AS flag_null_course,
  sin(radians(coalesce(course_null, 0.0::DOUBLE))) AS course_sin,
  cos(radians(coalesce(course_null, 0.0::DOUBLE))) AS course_cos,
  coalesce(sc, 0) AS vessel_superclass_id, coalesce(bh, 0) AS vessel_behavior_id,
  make_timestamp(timestamp_sec*1000000) AS datetime
  FROM raw LEFT JOIN types ON code = shiptype)""",
    # previous two rows by sequence number
    "lagged": """lagged AS (SELECT *,
  lag(timestamp_sec) OVER w AS pt, lag(timestamp_sec, 2) OVER w AS pt2,
  lag(lat_raw) OVER w AS pla, lag(lon_raw) OVER w AS plo,
  trunc(lat_raw*1e7)::BIGINT AS ila, trunc(lon_raw*1e7)::BIGINT AS ilo,
  trunc(speed_raw*1e4)::BIGINT AS isp, trunc(course_raw*1e4)::BIGINT AS ico,
  lag(trunc(lat_raw*1e7)::BIGINT) OVER w AS pila, lag(trunc(lon_raw*1e7)::BIGINT) OVER w AS pilo,
  lag(trunc(speed_raw*1e4)::BIGINT) OVER w AS pisp, lag(trunc(course_raw*1e4)::BIGINT) OVER w AS pico
  FROM tracks WINDOW w AS (PARTITION BY vessel_id_int ORDER BY {order}))""",
    "steps": """steps AS (SELECT *, coalesce(timestamp_sec - pt, 1) AS dt,
  greatest(coalesce(timestamp_sec - pt, 1), 1) AS dts,
  ln(1 + (CASE WHEN timestamp_sec - pt < 0 THEN 0 ELSE coalesce(timestamp_sec - pt, 1) END)::DOUBLE) AS log_time_diff,
  coalesce(ila - pila, 0)/1e7 AS dla, coalesce(ilo - pilo, 0)/1e7 AS dlo,
  coalesce(isp - pisp, 0)/1e4 AS dsp, coalesce(ico - pico, 0)/1e4 AS dco FROM lagged)""",
    "motion0": """motion0 AS (SELECT *,
  (dco + 180.0) - 360.0*floor((dco + 180.0)/360.0) - 180.0 AS course_change,
  CASE WHEN dt > 900 THEN 0.0 ELSE dsp/dts END AS acceleration,
  CASE WHEN dt > 900 OR pla IS NULL THEN 0.0 ELSE (lat_raw - pla)*60.0 END AS delta_y_nm,
  CASE WHEN dt > 900 OR pla IS NULL THEN 0.0 ELSE (lon_raw - plo)*cos(radians(lat_raw))*60.0 END AS delta_x_nm,
  CASE WHEN dt > 900 OR pla IS NULL THEN 0.0 ELSE 2*asin(sqrt(least(greatest(
     pow(sin(radians(dla)/2),2) + cos(radians(pla))*cos(radians(lat_raw))*pow(sin(radians(dlo)/2),2), 1e-9), 1.0-1e-9)))*3440.065 END AS geodetic_distance_nm
  FROM steps)""",
    "motion1": """motion1 AS (SELECT *, CASE WHEN dt > 900 THEN 0.0 ELSE course_change/dts END AS turn_rate,
  lag(acceleration) OVER (PARTITION BY vessel_id_int ORDER BY {order}) AS pacc FROM motion0)""",
    "motion": """motion AS (SELECT *,
  CASE WHEN dt > 900 OR pacc IS NULL THEN 0.0 ELSE (acceleration - pacc)/dts END AS jerk,
  least(greatest(CASE WHEN speed_raw < 0.5 THEN 0.0 ELSE turn_rate/(speed_raw + 1e-4) END, -50.0), 50.0) AS turn_rate_speed_ratio
  FROM motion1)""",
    "trips0": """trips0 AS (SELECT *, CASE WHEN timestamp_sec - lag(timestamp_sec) OVER v > 1800
    OR (speed_raw < 1.0) <> (lag(speed_raw) OVER v < 1.0) THEN 1 ELSE 0 END AS brk
  FROM {source} WINDOW v AS (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn))""",
    "trips": """trips AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY vessel_id_int
    ORDER BY timestamp_sec, global_lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_no,
  CAST(vessel_id_int AS VARCHAR) || '_' || CAST(CAST(sum(brk) OVER (PARTITION BY vessel_id_int
    ORDER BY timestamp_sec, global_lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) AS trip_id,
  CASE WHEN speed_raw < 1.0 THEN 1 ELSE 0 END AS is_static FROM trips0)""",
}

TRACKS = ["raw", "types", "tracks"]
MOTION = [*TRACKS, "lagged", "steps", "motion0", "motion1", "motion"]
TRIPS = [*TRACKS, "trips0", "trips"]


def with_blocks(names, body: str, order: str = "global_lsn", source: str = "tracks", extra=()) -> str:
    """``WITH`` clause from named blocks, then the query body."""
    parts = [BLOCKS[n].replace("{order}", order).replace("{source}", source) for n in names]
    return "WITH " + ",\n".join([*parts, *extra]) + "\n" + body
