"""Track, mesh, vector and score views over the driver's tables.

The tables hold no ship tracks, so positions are derived from ``events`` with
integer arithmetic; every view keeps one row per source row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import clean
from wakeline.session import prepare

TIME_DIVISOR = 30
MESH_STEP_SEC = 21_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as positions; one course in fifty is missing."""
    n = F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        n.alias("global_lsn"),
        F.col("user_id").alias("vessel_id_int"),
        F.col("user_id").cast("string").alias("mmsi_str"),
        F.floor(micros / F.lit(TIME_DIVISOR * 1_000_000)).cast("bigint").alias("timestamp_sec"),
        (F.lit(23.1) + F.pmod(n * 7919, F.lit(9000)) / F.lit(10000.0)).alias("lon_raw"),
        (F.lit(37.5) + F.pmod(n * 104729, F.lit(6000)) / F.lit(10000.0)).alias("lat_raw"),
        F.pmod(n * 37, F.lit(360)).cast("double").alias("heading_raw"),
        (F.col("value") / F.lit(5.0)).alias("speed_raw"),
        F.when(F.pmod(n, F.lit(50)) != 0, F.pmod(n * 37, F.lit(360)).cast("double")).alias("course_raw"),
        F.pmod(F.col("user_id"), F.lit(100)).alias("shiptype"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned positions with class and UTC time."""
    rows = clean.impute_motion(clean.drop_missing_positions(raw_tracks(spark, sf_dir)))
    rows = rows.withColumn("datetime", F.timestamp_seconds("timestamp_sec"))
    return clean.with_taxonomy(rows)


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather nodes on a 6 h x 0.15 degree lattice over the days the events cover.

    TMP, PRMSL and RH are linear in the axes, UGRD and VGRD are not, and GUST
    follows the event values of the time slot.
    """
    slot = F.floor(F.col("timestamp_sec") / F.lit(MESH_STEP_SEC)).cast("bigint")
    slots = raw_tracks(spark, sf_dir).groupBy(slot.alias("k")).agg(F.avg("speed_raw").alias("g"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    nodes = slots.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    rel = F.pmod(k, F.lit(1000))
    return nodes.select(
        (k * MESH_STEP_SEC).alias("timestamp_"),
        F.round(F.lit(23.1) + i * 0.15, 6).alias("lon"),
        F.round(F.lit(37.5) + j * 0.15, 6).alias("lat"),
        (F.lit(280.0) + i * 0.5 + j * 0.25 + rel * 0.01).alias("TMP"),
        (F.col("g") + i * 0.1).alias("GUST"),
        (F.lit(101000.0) + i * 10.0 - j * 5.0).alias("PRMSL"),
        (F.lit(60.0) + i * 1.0 + j * 2.0).alias("RH"),
        (F.pmod(i * 7 + j * 3 + k * 5, F.lit(11)) - 5).cast("double").alias("UGRD"),
        (F.pmod(i * 5 + j * 9 + k * 2, F.lit(13)) - 6).cast("double").alias("VGRD"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as window embeddings: cohort = label, 50 vessels, ts = id."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("embedding_id"),
        F.pmod(v, F.lit(50)).alias("vessel_id_int"),
        v.alias("timestamp_sec"),
        F.col("label").alias("superclass_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled decisions: toxic documents are positives, scores come from the text size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    n, d = F.col("n_chars"), F.col("doc_id")
    return labels.join(docs, "doc_id").select(
        d.alias("vessel_id_int"),
        F.col("toxic").cast("int").alias("label"),
        (F.pmod(n * 31 + d * 17, F.lit(997)) / F.lit(1000.0) + F.col("toxic") * 0.2).alias("recon"),
        (F.pmod(n * 13 + d * 7, F.lit(499)) / F.lit(500.0) + F.col("toxic") * 0.1).alias("ann"),
        (F.pmod(d, F.lit(9)) / F.lit(10.0) + 0.1).alias("severity"),
        F.col("lang"),
    )
