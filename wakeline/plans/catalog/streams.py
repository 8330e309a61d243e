"""Micro-batch ingestion, state, online drift and sessions.

Each query lets its table arrive in three parts and runs the stream after each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.plans import views
from wakeline.plans.catalog.base import TRACKS, TRIPS, query, r6, with_blocks
from wakeline.plans.catalog.drift import ROLLING
from wakeline.session import shared_folder
from wakeline.streaming import drift, ingest, latest, sessions
from wakeline.streaming.state import StateTable

START, DAY = 56_802_240, 2_880  # first second and day length of the derived track time
CHUNK_SQL = f"least((timestamp_sec - {START})//{DAY}//10, 2)"


def _chunks(df, order=(0, 1, 2)):
    part = F.least(F.floor(F.floor((F.col("timestamp_sec") - START) / F.lit(DAY)) / F.lit(10)), F.lit(2))
    return [df.where(part == c) for c in order]


def _run(spark, sf, handle, order=(0, 1, 2), df=None):
    root = shared_folder(spark, "stream")
    df = views.tracks(spark, sf).drop("datetime") if df is None else df
    ingest.feed(spark, _chunks(df, order), f"{root}/in", lambda s: ingest.run_available(s, f"{root}/ckpt", handle(root)))
    return root


@query("m1_micro_batches", with_blocks(["raw"], f"SELECT {CHUNK_SQL}::INT AS batch_no, count(*) AS n, min(global_lsn) AS first_lsn FROM raw GROUP BY 1"))
def m1(spark, sf):
    root = _run(spark, sf, lambda r: ingest.numbered_batches(f"{r}/out"))
    return spark.read.parquet(f"{root}/out").groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("global_lsn").alias("first_lsn"))


@query("p11_csv_stream_sequence", "SELECT event_id, 1000 - 1 + row_number() OVER (ORDER BY ts, event_id) AS global_lsn FROM events")
def p11_stream(spark, sf):
    """Messages arrive as CSV files in three parts; numbers go on from part to part."""
    root = shared_folder(spark, "sequence")
    ev = views.table(spark, sf, "events")
    micros, zero = F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0.0)
    rows = ev.select(micros.cast("string").alias("timestamp"), F.col("event_id").cast("string").alias("mmsi_str"), F.col("value").alias("lon_raw"),
                     *[zero.alias(c) for c in ("lat_raw", "heading_raw", "speed_raw", "course_raw")], F.floor(micros / F.lit(864_000_000_000)).alias("part"))
    first = rows.agg(F.min("part")).scalar()
    part = F.least(F.col("part") - first, F.lit(2))
    at = F.col("timestamp").cast("bigint")
    number = ingest.sequenced(f"{root}/out", ["at", "event_id"], F.floor(F.col("at") / F.lit(86_400_000_000)), F.floor(F.col("at") / F.lit(600_000_000)), start=1000)

    def run(stream):
        ingest.run_available(stream.select(at.alias("at"), F.col("mmsi_str").cast("bigint").alias("event_id")), f"{root}/ckpt", number)

    ingest.feed_csv(spark, [rows.where(part == c) for c in range(3)], f"{root}/in", run)
    return spark.read.parquet(f"{root}/out/rows").select("event_id", "global_lsn")


LATEST = """SELECT vessel_id_int, timestamp_sec AS last_timestamp, r6(speed_raw) AS last_speed, global_lsn FROM raw
QUALIFY row_number() OVER (PARTITION BY vessel_id_int ORDER BY global_lsn DESC) = 1"""


def _state_columns(df):
    return df.select("vessel_id_int", "last_timestamp", r6(F.col("last_speed")).alias("last_speed"), "global_lsn")


def _run_gate(spark, sf, order=(0, 1, 2), retention=None):
    """Run the keyed state over the parts; verdicts go to ``gate``, the state stays in ``ckpt``."""
    root = shared_folder(spark, "latest")

    def run(stream):
        ingest.run_available(latest.gate_latest(stream, retention), f"{root}/ckpt", ingest.numbered_batches(f"{root}/gate"))

    ingest.feed(spark, _chunks(views.raw_tracks(spark, sf).drop("datetime"), order), f"{root}/in", run)
    return root


@query("m2_state_upsert", with_blocks(["raw"], LATEST))
def m2(spark, sf):
    return _state_columns(latest.stored_latest(spark, f"{_run_gate(spark, sf, (0, 2, 1))}/ckpt"))


@query("m3_out_of_order_gate", with_blocks(["raw"], """SELECT vessel_id_int, batch_no::INT AS batch_no, global_lsn,
  CASE WHEN global_lsn >= coalesce(max(global_lsn) OVER (PARTITION BY vessel_id_int ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS accepted
FROM batches""", extra=[f"""batches AS (SELECT vessel_id_int, CASE {CHUNK_SQL} WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS batch_no, max(global_lsn) AS global_lsn FROM raw GROUP BY 1, 2)"""]))
def m3(spark, sf):
    return spark.read.parquet(f"{_run_gate(spark, sf, (0, 2, 1))}/gate")


GHOSTS = [f"""ch AS (SELECT *, {CHUNK_SQL} AS c FROM tracks)""",
    "starts AS (SELECT c, min(timestamp_sec) AS t0 FROM ch GROUP BY 1)",
    """st AS (SELECT s.c, s.t0, h.vessel_id_int, max(h.global_lsn) AS global_lsn, arg_max(h.timestamp_sec, h.global_lsn) AS timestamp_sec, arg_max(h.speed_raw, h.global_lsn) AS speed_raw
       FROM starts s JOIN ch h ON h.c < s.c GROUP BY 1, 2, 3)""",
    """ghosts AS (SELECT st.* FROM st WHERE t0 - timestamp_sec > 0 AND t0 - timestamp_sec <= 3600
       AND EXISTS (SELECT 1 FROM ch WHERE ch.c = st.c AND ch.vessel_id_int = st.vessel_id_int))""",
    """allrows AS (SELECT c, vessel_id_int, global_lsn, timestamp_sec, speed_raw, 0 AS ghost FROM ch UNION ALL SELECT c, vessel_id_int, global_lsn, timestamp_sec, speed_raw, 1 FROM ghosts)""",
    """lg AS (SELECT *, timestamp_sec - lag(timestamp_sec) OVER w AS d, coalesce(trunc(speed_raw*1e4)::BIGINT - lag(trunc(speed_raw*1e4)::BIGINT) OVER w, 0)/1e4 AS ds FROM allrows WINDOW w AS (PARTITION BY c, vessel_id_int ORDER BY global_lsn))"""]


@query("m4_carried_rows", with_blocks(TRACKS, """SELECT global_lsn, c::INT AS batch_no, r6(ln(1 + (CASE WHEN d < 0 THEN 0 ELSE coalesce(d, 1) END)::DOUBLE)) AS log_time_diff,
  r6(CASE WHEN coalesce(d, 1) > 900 THEN 0.0 ELSE ds/greatest(coalesce(d, 1), 1) END) AS acceleration FROM lg WHERE ghost = 0""", extra=GHOSTS))
def m4(spark, sf):
    root = _run(spark, sf, lambda r: ingest.motion_with_carry(StateTable(spark, f"{r}/state"), f"{r}/out"))
    return spark.read.parquet(f"{root}/out").select(
        "global_lsn", "batch_no", r6(F.col("log_time_diff")).alias("log_time_diff"), r6(F.col("acceleration")).alias("acceleration"))


@query("m5_continued_trips", with_blocks(TRIPS, "SELECT global_lsn, trip_id FROM trips"))
def m5(spark, sf):
    root = _run(spark, sf, lambda r: ingest.trips_with_state(StateTable(spark, f"{r}/state"), f"{r}/out"))
    return spark.read.parquet(f"{root}/out").select("global_lsn", "trip_id")


@query("j3_state_lookup", with_blocks(["raw"], f"""SELECT DISTINCT b.vessel_id_int, s.timestamp_sec AS last_timestamp, r6(s.speed_raw) AS last_speed
FROM (SELECT * FROM raw WHERE {CHUNK_SQL} = 2) b LEFT JOIN (SELECT * FROM raw WHERE {CHUNK_SQL} < 2
  QUALIFY row_number() OVER (PARTITION BY vessel_id_int ORDER BY global_lsn DESC) = 1) s USING (vessel_id_int)"""))
def j3(spark, sf):
    """The third part looks up what the stream stored after the first two."""
    root = _run_gate(spark, sf)
    state = latest.stored_latest(spark, f"{root}/ckpt", batch=1)
    present = _chunks(views.raw_tracks(spark, sf))[2].select("vessel_id_int").distinct()
    return present.join(state, "vessel_id_int", "left").select(
        "vessel_id_int", "last_timestamp", r6(F.col("last_speed")).alias("last_speed"))


TTL = 2 * DAY


@query("m6_state_expiry", with_blocks(["raw"], f"SELECT * FROM ({LATEST}) WHERE last_timestamp >= (SELECT max(last_timestamp) FROM ({LATEST})) - {TTL}"))
def m6(spark, sf):
    return _state_columns(latest.stored_latest(spark, f"{_run_gate(spark, sf, retention=TTL)}/ckpt"))


@query("m7_cold_start", with_blocks(TRIPS, f"SELECT global_lsn, trip_id FROM trips WHERE {CHUNK_SQL} = 2"))
def m7(spark, sf):
    rows = views.tracks(spark, sf).drop("datetime")
    old = _run(spark, sf, lambda r: ingest.trips_with_state(StateTable(spark, f"{r}/state"), f"{r}/out"), (0, 1), rows)
    seed = StateTable(spark, f"{old}/state").version(1)
    # a new query with an empty checkpoint, seeded from the stored state
    new = _run(spark, sf, lambda r: ingest.trips_with_state(StateTable(spark, f"{r}/state", seed), f"{r}/out"), (2,), rows)
    return spark.read.parquet(f"{new}/out").select("global_lsn", "trip_id")


@query("m8_streaming_drift", ROLLING + """ SELECT id AS embedding_id, r6(drift) AS drift, r6(CASE WHEN m >= 4 THEN q ELSE 0.45 END) AS threshold,
  (drift > CASE WHEN m >= 4 THEN q ELSE 0.45 END)::INT AS outlier FROM s UNION ALL SELECT id, r6(0.0::DOUBLE), r6(0.45::DOUBLE), 0 FROM f WHERE n = 1""")
def m8(spark, sf):
    root, v = shared_folder(spark, "drift"), views.vectors(spark, sf)
    third = F.floor(F.col("embedding_id") * 3 / v.agg(F.max("embedding_id") + 1).scalar())

    def run(stream):
        writer = drift.streaming_drift(stream, buffer=6, min_seen=4).writeStream.format("parquet").outputMode("append")
        writer.option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out").awaitTermination()

    ingest.feed(spark, [v.where(third == c) for c in range(3)], f"{root}/in", run)
    out = spark.read.parquet(f"{root}/out")
    return out.select("embedding_id", *[r6(F.col(c)).alias(c) for c in ("drift", "threshold")], "outlier")


SESSION_SQL = """SELECT vessel_id_int, min(timestamp_sec) AS start_sec, max(timestamp_sec) AS end_sec, count(*) AS points FROM (
  SELECT *, sum(brk) OVER (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN timestamp_sec - lag(timestamp_sec) OVER (PARTITION BY vessel_id_int ORDER BY timestamp_sec, global_lsn) > 1800 THEN 1 ELSE 0 END AS brk FROM raw)) GROUP BY vessel_id_int, s"""


@query("m9_gap_sessions", with_blocks(["raw"], SESSION_SQL))
def m9(spark, sf):
    root = shared_folder(spark, "sessions")
    rows = views.raw_tracks(spark, sf).select("vessel_id_int", "timestamp_sec")
    # a last message far in the future moves the watermark past every open session
    closing = rows.agg(F.lit(-1).cast("bigint").alias("vessel_id_int"), (F.max("timestamp_sec") + 10 * 86_400).alias("timestamp_sec"))

    def run(stream):
        writer = sessions.gap_sessions(stream).writeStream.format("parquet").outputMode("append")
        writer.option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start(f"{root}/out").awaitTermination()

    ingest.feed(spark, [*_chunks(rows), closing], f"{root}/in", run)
    return spark.read.parquet(f"{root}/out").where("vessel_id_int >= 0")
