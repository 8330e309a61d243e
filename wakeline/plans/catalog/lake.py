"""Sources, sinks and layout checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.plans import ingest, views
from wakeline.plans.catalog.base import query, r6, with_blocks
from wakeline.plans.catalog.motion import feature_sql
from wakeline.plans.catalog.weather import MESH, _cell
from wakeline.session import shared_folder
from wakeline.sources import lake, positions


def _raw_messages(spark, sf):
    return views.raw_tracks(spark, sf).select(
        F.col("timestamp_sec").cast("string").alias("timestamp"), "mmsi_str", "lon_raw", "lat_raw",
        "heading_raw", "speed_raw", "course_raw")


RAW_SQL = """SELECT CAST(timestamp_sec AS VARCHAR) AS timestamp, mmsi_str, r6(lon_raw) AS lon_raw, r6(lat_raw) AS lat_raw,
  heading_raw, r6(speed_raw) AS speed_raw, course_null AS course_raw FROM raw"""


def _rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("lon_raw", "lat_raw", "speed_raw")})


@query("s1_position_scan", with_blocks(["raw"], RAW_SQL))
def s1(spark, sf):
    path = shared_folder(spark, "positions")
    _raw_messages(spark, sf).write.csv(path)
    return _rounded(positions.read_positions(spark, path))


@query("s2_header_probe", with_blocks(["raw"], RAW_SQL))
def s2(spark, sf):
    root = shared_folder(spark, "mixed")
    rows = _raw_messages(spark, sf)
    even = F.pmod(F.col("mmsi_str").cast("bigint"), F.lit(2)) == 0
    rows.where(even).write.option("header", "true").csv(f"{root}/with")
    rows.where(~even).write.csv(f"{root}/without")
    return _rounded(positions.read_mixed_positions(spark, f"{root}/with", f"{root}/without"))


@query("s3_ship_table", """SELECT CAST(c_custkey AS VARCHAR) AS mmsi_str, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 100 END, 0) AS shiptype FROM customer""")
def s3(spark, sf):
    path, k = shared_folder(spark, "ships"), F.col("c_custkey")
    ships = views.table(spark, sf, "customer").select(
        k.cast("string").alias("vessel_id"), F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k, F.lit(100))).cast("int").alias("shiptype"))
    ships.write.option("header", "true").csv(path)
    return positions.read_ship_types(spark, path)


@query("s4_weather_scan", with_blocks(["raw"], 'SELECT timestamp_, lon, lat, r6("GUST") AS gust FROM mesh', extra=[MESH]))
def s4(spark, sf):
    path = shared_folder(spark, "weather")
    ts = F.timestamp_seconds("timestamp_")
    nodes = views.mesh(spark, sf).withColumn("lon", F.col("lon") + 1e-9).withColumns({"year": F.year(ts), "month": F.month(ts)})
    nodes.write.partitionBy("year", "month").parquet(path)
    return positions.read_weather(spark, path).select("timestamp_", "lon", "lat", r6(F.col("GUST")).alias("gust"))


def _lake_rows(spark, sf):
    rows = views.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("datetime"),
        F.pmod("o_custkey", F.lit(2)).cast("int").alias("vessel_bucket_id"))
    return lake.with_partitions(rows)


def _lake(spark, sf):
    path = shared_folder(spark, "lake")
    lake.write_lake(_lake_rows(spark, sf), path)
    return path


@query("s5_partitioned_sink", """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, (o_custkey % 2)::INT AS vessel_bucket, count(*) AS n,
  sum(o_orderkey + CASE WHEN year(o_orderdate) = 1995 THEN 1 ELSE 0 END)::BIGINT AS keys FROM orders GROUP BY 1, 2, 3""")
def s5(spark, sf):
    path = _lake(spark, sf)
    again = _lake_rows(spark, sf).where("year = 1995").withColumn("o_orderkey", F.col("o_orderkey") + 1)
    lake.write_lake(again, path)  # replaces the 1995 partitions only
    return lake.read_lake(spark, path).groupBy("year", "month", "vessel_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s6_pruned_months", """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n FROM orders
WHERE year(o_orderdate) < 1996 OR (year(o_orderdate) = 1996 AND month(o_orderdate) <= 6) GROUP BY 1, 2""")
def s6(spark, sf):
    rows = lake.read_lake(spark, _lake(spark, sf), lake.up_to(1996, 6))
    return rows.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("s7_multi_file_filter", with_blocks(["raw"], "SELECT global_lsn, r6(speed_raw) AS speed_raw FROM raw WHERE speed_raw > 0.5"))
def s7(spark, sf):
    root = shared_folder(spark, "multi")
    rows = views.raw_tracks(spark, sf).select("global_lsn", "vessel_id_int", "speed_raw")
    odd = F.pmod("vessel_id_int", F.lit(2)) == 1
    rows.where(odd).write.parquet(f"{root}/a")
    rows.where(~odd).write.parquet(f"{root}/b")
    return lake.read_moving(spark, f"{root}/a", f"{root}/b").select("global_lsn", r6(F.col("speed_raw")).alias("speed_raw"))


@query("s8_pruned_columns", "SELECT count(*) AS n_rows, max(epoch_us(o_orderdate)//1000000) AS last_sec FROM orders")
def s8(spark, sf):
    rows = lake.read_lake(spark, _lake(spark, sf), columns=["datetime"])
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.unix_seconds("datetime")).alias("last_sec"))


@query("s9_row_slice", with_blocks(["raw"], "SELECT global_lsn, vessel_id_int, r6(speed_raw) AS speed_raw FROM raw WHERE global_lsn BETWEEN 100 AND 299"))
def s9(spark, sf):
    rows = lake.read_slice(views.raw_tracks(spark, sf), 100, 200)
    return rows.select("global_lsn", "vessel_id_int", r6(F.col("speed_raw")).alias("speed_raw"))


@query("s10_embedding_sink", """SELECT label AS superclass_id, count(*) AS n, r6(sum(embedding[1]::DOUBLE)) AS first FROM embeddings GROUP BY 1""")
def s10(spark, sf):
    path = shared_folder(spark, "shards")
    v = views.vectors(spark, sf)
    half = F.pmod("embedding_id", F.lit(2)) == 0
    lake.append_embeddings(v.where(half), path, 64, shard_rows=100)
    lake.append_embeddings(v.where(~half), path, 64, shard_rows=100)
    return spark.read.parquet(path).groupBy("superclass_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.get("embedding", F.lit(0)).cast("double"))).alias("first"))


@query("s11_tolerant_scan", "SELECT event_id, value FROM events")
def s11(spark, sf):
    root = shared_folder(spark, "tolerant")
    ev = views.table(spark, sf, "events").select("event_id", "value")
    ev.write.parquet(f"{root}/good")
    ev.select(F.col("value").cast("string")).write.text(f"{root}/broken")  # no Parquet at all
    return lake.read_tolerant(spark, ev.schema, f"{root}/good", f"{root}/broken")


@query("a33_shard_leaks", """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, (o_custkey % 2)::INT AS vessel_bucket,
  max(epoch_us(o_orderdate)//1000000) AS max_sec FROM orders GROUP BY 1, 2, 3 HAVING max(epoch_us(o_orderdate)//1000000) >= 870000000""")
def a33(spark, sf):
    rows = lake.read_lake(spark, _lake(spark, sf), columns=["datetime"])
    leaks = lake.shard_leaks(rows.select(F.unix_seconds("datetime").alias("sec")), "sec", 870_000_000)
    part = lambda n: F.regexp_extract("file", f"{n}=(\\d+)", 1).cast("int").alias(n)
    return leaks.select(part("year"), part("month"), part("vessel_bucket"), F.col("max_ts").alias("max_sec"))


@query("a34_partition_inventory", """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(DISTINCT o_custkey % 2) AS files FROM orders
WHERE year(o_orderdate) < 1997 GROUP BY 1, 2""")
def a34(spark, sf):
    return lake.partition_inventory(lake.read_lake(spark, _lake(spark, sf), lake.up_to(1996, 12)))


# Whole weather steps, so that the mesh keeps its slots; the times gain the ten digits of epoch seconds.
SHIFT = 70_000 * views.MESH_STEP_SEC
_ARRIVAL = """row_number() OVER (ORDER BY epoch_us(ts) // 30000000, user_id, 23.1::DOUBLE + ((event_id*7919) % 9000)::DOUBLE/10000.0::DOUBLE,
  37.5::DOUBLE + ((event_id*104729) % 6000)::DOUBLE/10000.0::DOUBLE) AS global_lsn"""


@query("ingest_messages_to_lake", feature_sql(f"""SELECT rel.global_lsn, mmsi_str, timestamp_sec + {SHIFT} AS timestamp_sec,
  year(make_timestamp((timestamp_sec + {SHIFT})*1000000))::INT AS year, month(make_timestamp((timestamp_sec + {SHIFT})*1000000))::INT AS month,
  trip_id, is_static, vessel_superclass_id::INT AS vessel_superclass_id, r6(jerk) AS jerk, r6(geodetic_distance_nm) AS geodetic_distance_nm,
  r6(reliability_score) AS reliability_score, r6(temperature) AS temperature, r6(sqrt(u*u+v*v)) AS wind_speed, out_of_mesh_flag
FROM rel JOIN (SELECT * EXCLUDE (course_raw) FROM wsum) w USING (global_lsn)""",
    extra=[MESH, *_cell(False)]).replace("event_id AS global_lsn", _ARRIVAL, 1))
def to_lake(spark, sf):
    """CSV messages, ship table and weather nodes through the whole ingestion; the lake is read back."""
    folder, path = shared_folder(spark, "messages"), shared_folder(spark, "lake")
    raw = views.raw_tracks(spark, sf)
    _raw_messages(spark, sf).withColumn("timestamp", (F.col("timestamp").cast("bigint") + SHIFT).cast("string")).write.csv(folder)
    ships = raw.select("mmsi_str", "shiptype").distinct()
    nodes = views.mesh(spark, sf).withColumn("timestamp_", F.col("timestamp_") + SHIFT)
    ingest.to_lake(positions.read_mixed_positions(spark, folder), ships, nodes, path, start=1)
    names = ["jerk", "geodetic_distance_nm", "reliability_score", "temperature", "wind_speed"]
    return lake.read_lake(spark, path).select(
        "global_lsn", "mmsi_str", "timestamp_sec", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
        "trip_id", "is_static", F.col("vessel_superclass_id").cast("int").alias("vessel_superclass_id"), "out_of_mesh_flag",
        *[r6(F.col(n)).alias(n) for n in names])
