"""Micro-batch ingestion: sequence gate, carried rows, continuing trip counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import kinematics, segmentation, slices
from wakeline.operators.clean import without_carried_rows
from wakeline.sources import positions
from wakeline.streaming import state as states
from wakeline.streaming.state import StateTable

CARRY_LIMIT_SEC = 3_600


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has arrived since the last run, then stop."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()


def numbered_batches(out: str) -> Callable[[DataFrame, int], None]:
    """Store each micro-batch with its number; a replay overwrites only its own folder."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    return handle


def with_carried_rows(batch: DataFrame, state: DataFrame, limit: int = CARRY_LIMIT_SEC) -> DataFrame:
    """Add the last known row of each vessel in the batch if it is recent enough.

    Recent means more than zero and at most ``limit`` seconds before the earliest
    row of the batch.  Columns the state does not hold stay null.
    """
    start = batch.agg(F.min("timestamp_sec")).scalar()
    present = batch.select("vessel_id_int").distinct()
    gap = F.col("_start") - F.col("last_timestamp")
    carried = state.join(present, "vessel_id_int", "left_semi").withColumn("_start", start).where((gap > 0) & (gap <= limit)).select(
        "vessel_id_int", "global_lsn", F.col("last_timestamp").alias("timestamp_sec"), F.col("last_speed").alias("speed_raw"),
        F.col("last_lon").alias("lon_raw"), F.col("last_lat").alias("lat_raw"), F.lit(0.0).alias("course_raw"),
        F.lit(1).alias("is_ghost"))
    return batch.withColumn("is_ghost", F.lit(0)).unionByName(carried, allowMissingColumns=True)


def motion_with_carry(table: StateTable, out: str) -> Callable[[DataFrame, int], None]:
    """Lag features per batch that reach back into the state."""

    def handle(batch: DataFrame, number: int) -> None:
        old = table.before(number)
        features = kinematics.motion_features(with_carried_rows(batch, old))
        without_carried_rows(features).write.mode("overwrite").parquet(f"{out}/batch_no={number}")
        table.save(states.merged(old, states.tails(batch)), number)

    return handle


def continued_trips(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Trip numbers that go on from the state: a break at the seam adds one."""
    heads = batch.groupBy("vessel_id_int").agg(
        F.min(F.struct("timestamp_sec", "global_lsn", "speed_raw")).alias("head"))
    seam = segmentation.trip_break(
        F.col("head"), {"timestamp_sec": F.col("last_timestamp"), "speed_raw": F.col("last_speed")})
    offset = F.coalesce(F.col("trip_id_offset") + seam.cast("bigint"), F.lit(0))
    offsets = heads.join(state, "vessel_id_int", "left").select("vessel_id_int", offset.alias("trip_offset"))
    rows = segmentation.with_trip_offset(segmentation.assign_trips(batch, slices.BY_TIME), offsets)
    rows = rows.withColumn("trip_no", F.col("trip_no") + F.col("trip_offset")).drop("trip_offset")
    return rows.withColumn("trip_id", segmentation.trip_label(F.col("trip_no")))


def trips_with_state(table: StateTable, out: str) -> Callable[[DataFrame, int], None]:
    """Segment each batch and keep the counters going.

    The seam compares neighbouring rows in time, so the tail is the last row by
    (time, sequence), the same order the counter uses inside a batch.
    """

    def handle(batch: DataFrame, number: int) -> None:
        old = table.before(number)
        path = f"{out}/batch_no={number}"
        continued_trips(batch, old).write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.parquet(path)
        last = segmentation.edge_row(rows, ["vessel_id_int"], ["timestamp_sec", "global_lsn"], last=True)
        table.save(states.merged(old, states.tails(last, offsets=True), by="last_timestamp"), number)

    return handle


def feed(spark: SparkSession, chunks: list[DataFrame], folder: str, run: Callable[[DataFrame], None]) -> None:
    """Let chunks arrive one after another and process each as it lands."""
    for chunk in chunks:
        chunk.write.mode("append").parquet(folder)
        run(spark.readStream.schema(chunk.schema).parquet(folder))


def feed_csv(spark: SparkSession, chunks: list[DataFrame], folder: str, run: Callable[[DataFrame], None]) -> None:
    """The same for position messages that arrive as CSV files."""
    for chunk in chunks:
        chunk.select(*positions.RAW_COLUMNS).write.mode("append").csv(folder)
        run(positions.stream_positions(spark, folder))


def sequenced(out: str, order: Sequence[str], coarse: Column, fine: Column, start: int = 1) -> Callable[[DataFrame, int], None]:
    """Give each arriving row a gap-free number that continues from batch to batch.

    A batch is numbered by prefix counts of its slices (see ``slices.dense_sequence``) from
    the total that the batch before it stored, and stores its own: a replayed batch reads the
    same total and rewrites the same numbers, whatever came after.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows, totals = f"{out}/rows/batch_no={number}", f"{out}/totals"
        base = start if number == 0 else spark.read.parquet(f"{totals}/batch_no={number - 1}").first()["next"]
        slices.dense_sequence(batch, order, "global_lsn", coarse, fine, start=base).write.mode("overwrite").parquet(rows)
        written = spark.read.parquet(rows).agg((F.lit(base) + F.count(F.lit(1))).cast("bigint").alias("next"))
        written.write.mode("overwrite").parquet(f"{totals}/batch_no={number}")

    return handle
