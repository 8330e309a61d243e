"""Field cleaning, dimension joins and registry audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import fields, scoring
from wakeline.operators import clean, slices
from wakeline.plans import views
from wakeline.plans.catalog.base import TRACKS, query, r6, with_blocks


ID_TEXT = """CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR)
  WHEN event_id % 4 = 1 THEN md5(CAST(user_id AS VARCHAR))
  WHEN event_id % 4 = 2 THEN CAST(user_id AS VARCHAR) || 'zz' ELSE md5(props) || '!' END"""


def _id_text():
    n, u = F.col("event_id"), F.col("user_id").cast("string")
    kind = F.pmod(n, F.lit(4))
    return (
        F.when(kind == 0, u).when(kind == 1, F.md5(u.cast("binary")))
        .when(kind == 2, F.concat(u, F.lit("zz")))
        .otherwise(F.concat(F.md5(F.col("props").cast("binary")), F.lit("!")))
    )


@query("p1_vessel_id", f"""SELECT event_id, id_text, CASE
  WHEN regexp_full_match(id_text, '[0-9]+') THEN coalesce(try_cast(id_text AS BIGINT), 0)
  ELSE coalesce(try_cast('0x' || right(id_text, 15) AS BIGINT), 0) END AS vessel_id_int
FROM (SELECT event_id, {ID_TEXT} AS id_text FROM events)""")
def p1(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", _id_text().alias("id_text"))
    return ev.withColumn("vessel_id_int", fields.vessel_id(F.col("id_text")))


@query("p2_hash_bucket", "SELECT user_id % 100 AS vessel_bucket_id, count(*) AS n FROM events GROUP BY 1")
def p2(spark, sf):
    bucket = fields.hash_bucket(F.col("user_id")).cast("bigint")
    return views.table(spark, sf, "events").groupBy(bucket.alias("vessel_bucket_id")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p3_epoch_units", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL
  ELSE epoch_us(ts) // 1000000 END AS timestamp_sec FROM events WHERE event_id % 5 <> 4""")
def p3(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    sec = F.floor(micros / F.lit(1_000_000)).cast("bigint")
    kind = F.pmod(F.col("event_id"), F.lit(5))
    text = (
        F.when(kind == 0, sec.cast("string"))
        .when(kind == 1, (sec * 1000 + 7).cast("string"))
        .when(kind == 2, micros.cast("string"))
        .when(kind == 3, (micros * 1000 + 999).cast("string"))
        .otherwise(F.concat(F.lit("t"), sec.cast("string")))
    )
    ev = views.table(spark, sf, "events").select("event_id", fields.epoch_seconds(text).alias("timestamp_sec"))
    return ev.where(F.col("timestamp_sec").isNotNull())


@query("p4_utc_time", with_blocks(["raw"], """SELECT global_lsn,
  strftime(make_timestamp(timestamp_sec*1000000), '%Y-%m-%d %H:%M:%S') AS utc FROM raw"""))
def p4(spark, sf):
    ts = fields.utc_timestamp(F.col("timestamp_sec"))
    return views.raw_tracks(spark, sf).select(
        "global_lsn", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("utc"))


NAN_RAW = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'nan'::DOUBLE
    ELSE value END AS lon_raw, CASE WHEN event_id % 23 = 0 THEN 'nan'::DOUBLE ELSE value END AS lat_raw FROM events"""


def _holes(spark, sf):
    n, v, nan = F.col("event_id"), F.col("value"), F.lit(float("nan"))
    return views.table(spark, sf, "events").select(
        "event_id",
        F.when(F.pmod(n, F.lit(17)) == 0, F.lit(None).cast("double"))
        .when(F.pmod(n, F.lit(19)) == 0, nan).otherwise(v).alias("lon_raw"),
        F.when(F.pmod(n, F.lit(23)) == 0, nan).otherwise(v).alias("lat_raw"),
    )


@query("p5_drop_missing_positions", f"""SELECT event_id, lon_raw, lat_raw FROM ({NAN_RAW})
WHERE lon_raw IS NOT NULL AND NOT isnan(lon_raw) AND lat_raw IS NOT NULL AND NOT isnan(lat_raw)""")
def p5(spark, sf):
    return clean.drop_missing_positions(_holes(spark, sf))


@query("p6_impute_motion", f"""SELECT event_id,
  CASE WHEN lon_raw IS NULL OR isnan(lon_raw) THEN 1 ELSE 0 END AS flag_null_course,
  CASE WHEN lon_raw IS NULL OR isnan(lon_raw) THEN 0.0 ELSE lon_raw END AS course_raw,
  CASE WHEN isnan(lat_raw) THEN 0.0 ELSE lat_raw END AS speed_raw FROM ({NAN_RAW})""")
def p6(spark, sf):
    rows = _holes(spark, sf).withColumnsRenamed({"lon_raw": "course_raw", "lat_raw": "speed_raw"})
    return clean.impute_motion(rows).select("event_id", "flag_null_course", "course_raw", "speed_raw")


@query("p7_circular_course", with_blocks(TRACKS, """SELECT global_lsn, r6(course_sin) AS course_sin,
  r6(course_cos) AS course_cos FROM tracks"""))
def p7(spark, sf):
    return views.tracks(spark, sf).select(
        "global_lsn", r6(F.col("course_sin")).alias("course_sin"), r6(F.col("course_cos")).alias("course_cos"))


@query("p8_cyclic_time", """SELECT event_id, r6(sin(hour(ts)/24.0::DOUBLE*2*pi())) AS hour_sin,
  r6(cos(hour(ts)/24.0::DOUBLE*2*pi())) AS hour_cos, r6(sin(isodow(ts)/7.0::DOUBLE*2*pi())) AS day_sin,
  r6(cos(isodow(ts)/7.0::DOUBLE*2*pi())) AS day_cos FROM events""")
def p8(spark, sf):
    ts = F.col("ts").cast("timestamp")
    (hs, hc), (ds, dc) = fields.hour_cycle(ts), fields.weekday_cycle(ts)
    return views.table(spark, sf, "events").select(
        "event_id", r6(hs).alias("hour_sin"), r6(hc).alias("hour_cos"),
        r6(ds).alias("day_sin"), r6(dc).alias("day_cos"))


@query("p9_phase_one_hot", """SELECT event_id, (value/5.0 < 1.0)::INT AS voyage_phase_anchoring,
  (value/5.0 >= 5.0)::INT AS voyage_phase_cruising, 0 AS voyage_phase_departure,
  (value/5.0 >= 1.0 AND value/5.0 < 5.0)::INT AS voyage_phase_maneuvering FROM events""")
def p9(spark, sf):
    ev = views.table(spark, sf, "events")
    return ev.select("event_id", *[c.alias(n) for n, c in fields.phases(F.col("value") / 5.0).items()])


@query("p10_moving_rows", "SELECT event_id, value FROM events WHERE value/5.0 > 0.5")
def p10(spark, sf):
    return views.table(spark, sf, "events").where(F.col("value") / 5.0 > 0.5).select("event_id", "value")


@query("p11_arrival_sequence", """SELECT event_id, 1000 - 1 + row_number() OVER (ORDER BY ts, event_id) AS global_lsn
FROM events""")
def p11(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", "ts")
    minutes = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)
    day, ten = F.floor(minutes / F.lit(1_440)), F.floor(minutes / F.lit(10))
    return slices.dense_sequence(ev, ["ts", "event_id"], "global_lsn", day, ten, start=1000).drop("ts")


@query("p12_weather_aliases", """SELECT event_id, value AS "TMP", value*2 AS "GUST",
  user_id AS timestamp_ FROM events""")
def p12(spark, sf):
    from wakeline.operators import mesh

    ev = views.table(spark, sf, "events").select(
        "event_id", F.col("value").alias("temperature"), F.col("value").alias("TMP"),
        (F.col("value") * 2).alias("gust_factor"), F.col("user_id").alias("timestamp_sec"))
    return mesh.normalise_names(ev)


@query("p13_required_columns", "SELECT count(*) AS n FROM events")
def p13(spark, sf):
    ev = clean.require_columns(views.table(spark, sf, "events"), ["event_id", "user_id", "ts"], "events")
    return ev.agg(F.count(F.lit(1)).alias("n"))


@query("p14_conform", with_blocks(TRACKS, """SELECT global_lsn, mmsi_str, lon_raw, lat_raw, heading_raw,
  speed_raw, course_raw, vessel_id_int, timestamp_sec, flag_null_course, shiptype,
  vessel_superclass_id::INT AS vessel_superclass_id, CAST(NULL AS DOUBLE) AS distance_to_coast_nm FROM tracks"""))
def p14(spark, sf):
    rows = clean.conform(views.tracks(spark, sf))
    return rows.select(
        "global_lsn", "mmsi_str", "lon_raw", "lat_raw", "heading_raw", "speed_raw", "course_raw",
        "vessel_id_int", "timestamp_sec", "flag_null_course", "shiptype",
        F.col("vessel_superclass_id").cast("int").alias("vessel_superclass_id"), "distance_to_coast_nm")


@query("p15_drop_carried_rows", """SELECT event_id FROM events WHERE event_type <> 'error'""")
def p15(spark, sf):
    ev = views.table(spark, sf, "events")
    flagged = ev.select("event_id", (F.col("event_type") == "error").cast("int").alias("is_ghost"))
    return clean.without_carried_rows(flagged)


@query("p18_sanitise", f"""SELECT event_id, CASE WHEN lon_raw IS NULL OR isnan(lon_raw) THEN 0.0
  ELSE least(greatest(lon_raw, -50.0), 50.0) END AS x FROM ({NAN_RAW})""")
def p18(spark, sf):
    return _holes(spark, sf).select("event_id", scoring.sanitised(F.col("lon_raw")).alias("x"))


COHORT_TEXT = """CASE user_id % 4 WHEN 0 THEN ' cargo ' WHEN 1 THEN 'TANKER' WHEN 2 THEN 'barge' END"""


@query("p20_resolve_cohort", f"""SELECT event_id, coalesce(CASE WHEN event_id % 14 > 0 AND event_id % 3 = 0
   THEN event_id % 14 END, CASE lower(trim({COHORT_TEXT})) WHEN 'cargo' THEN 11 WHEN 'tanker' THEN 12 END, 0)::INT AS cohort
FROM events""")
def p20(spark, sf):
    n, u = F.col("event_id"), F.col("user_id")
    typed = F.when(F.pmod(n, F.lit(3)) == 0, F.pmod(n, F.lit(14)))
    kind = F.pmod(u, F.lit(4))
    text = F.when(kind == 0, " cargo ").when(kind == 1, "TANKER").when(kind == 2, "barge")
    return views.table(spark, sf, "events").select("event_id", clean.resolve_cohort(typed, text).alias("cohort"))


@query("j1_ship_type_join", """SELECT e.event_id, s.shiptype FROM events e LEFT JOIN
 (SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 100 END, 0) AS shiptype
  FROM customer) s ON s.c_custkey = e.user_id * 20""")
def j1(spark, sf):
    k = F.col("c_custkey")
    ships = clean.ship_types_from(
        views.table(spark, sf, "customer").select(
            k.alias("vessel_id"), F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k, F.lit(100))).alias("shiptype")))
    # a part of these ids is beyond the customers: unmatched keys
    ev = views.table(spark, sf, "events").select("event_id", (F.col("user_id") * 20).cast("string").alias("mmsi_str"))
    return clean.with_ship_type(ev, ships).select("event_id", "shiptype")


@query("j2_taxonomy", with_blocks(TRACKS, """SELECT shiptype, vessel_superclass_id::INT AS vessel_superclass_id,
  vessel_behavior_id::INT AS vessel_behavior_id, count(*) AS n FROM tracks GROUP BY ALL"""))
def j2(spark, sf):
    return views.tracks(spark, sf).groupBy("shiptype", "vessel_superclass_id", "vessel_behavior_id").agg(
        F.count(F.lit(1)).alias("n"))
