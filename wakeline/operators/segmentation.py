"""Cutting tracks into trips, static runs, first and last rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.slices import BY_TIME, Stitch, Track, fitted, running_sum, stitch
from wakeline.registry import CLASS_LIMITS, DEFAULT_LIMITS
from wakeline.session import stored

TRIP_GAP_SEC = 1800
STATIC_SPEED = 1.0


def trip_break(cur, prev, gap: int = TRIP_GAP_SEC) -> Column:
    """A long silence, or a change between static and under way."""
    flipped = (cur["speed_raw"] < STATIC_SPEED) != (prev["speed_raw"] < STATIC_SPEED)
    return (cur["timestamp_sec"] - prev["timestamp_sec"] > gap) | flipped


def trip_label(counter: Column) -> Column:
    return F.concat_ws("_", F.col("vessel_id_int").cast("string"), counter.cast("string"))


def assign_trips(df: DataFrame, track: Track | None = None, gap: int = TRIP_GAP_SEC,
                 offset: Column | None = None) -> DataFrame:
    """Add ``is_static``, ``trip_no`` and ``trip_id`` = vessel, underscore, counter.

    Without a ``track`` its slices are fitted to the busiest vessels, here and below.
    """
    rows = stitch(df, track or fitted(df, BY_TIME), Stitch(
        carry=["timestamp_sec", "speed_raw"], lags=0,
        counters={"trip_no": lambda cur, prev: trip_break(cur, prev, gap)}))
    counter = F.col("trip_no") if offset is None else F.col("trip_no") + offset
    return (
        rows.withColumn("trip_no", counter.cast("bigint"))
        .withColumn("is_static", (F.col("speed_raw") < STATIC_SPEED).cast("int"))
        .withColumn("trip_id", trip_label(F.col("trip_no")))
    )


def class_limit(which: int) -> Column:
    cohort = F.col("vessel_superclass_id")
    chosen = F.lit(DEFAULT_LIMITS[which])
    for cls, limits in CLASS_LIMITS.items():
        chosen = F.when(cohort == cls, F.lit(limits[which])).otherwise(chosen)
    return chosen


def static_runs(df: DataFrame, track: Track | None = None, by_class: bool = True) -> DataFrame:
    """Add ``is_static``, the run number and the seconds spent static in the run.

    The run's seconds are the sum of its time steps, the step into the run
    included.  That sum telescopes to "now minus the row before the run", so one
    remembered timestamp per run replaces a second window.
    """
    floor = class_limit(0) if by_class else F.lit(STATIC_SPEED)
    marked = df.withColumn("is_static", (F.col("speed_raw") < floor).cast("int"))
    changed = lambda cur, prev: F.coalesce(cur["is_static"] != prev["is_static"], F.lit(True))
    start = lambda cur, prev: F.coalesce(prev["timestamp_sec"], cur["timestamp_sec"])
    rows = stitch(marked, track or fitted(df, BY_TIME), Stitch(
        carry=["timestamp_sec", "is_static"], lags=1,
        counters={"static_run": changed}, fills={"_run_start": (changed, start)}))
    seconds = F.when(F.col("is_static") == 1, F.col("timestamp_sec") - F.col("_run_start")).otherwise(F.lit(0))
    step = F.coalesce(F.col("timestamp_sec") - F.col("prev1.timestamp_sec"), F.lit(0))
    return (
        rows.withColumn("static_seconds", seconds.cast("bigint"))
        .withColumn("time_step", step)
        .drop("_run_start", "prev1")
    )


def assign_class_trips(df: DataFrame, track: Track | None = None, gap: int = TRIP_GAP_SEC,
                       offsets: DataFrame | None = None) -> DataFrame:
    """Class-aware trips: a gap, or a static run longer than the class allows.

    Every row past the limit breaks again, as published.
    """
    track = track or fitted(df, BY_TIME)
    # the second stitch reads its input twice: the first one runs once
    runs = stored(static_runs(df, track), "static-runs")
    late = (F.col("time_step") > gap) | (F.col("static_seconds") > class_limit(1))
    counted = running_sum(runs.withColumn("break_flag", late.cast("bigint")), track, "break_flag", "trip_no")
    if offsets is not None:
        counted = with_trip_offset(counted, offsets)
        counted = counted.withColumn("trip_no", F.col("trip_no") + F.col("trip_offset"))
    return counted


def with_trip_offset(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Stored counters by vessel; a vessel without one starts at 0."""
    joined = df.join(offsets.select("vessel_id_int", "trip_offset"), "vessel_id_int", "left")
    return joined.withColumn("trip_offset", F.coalesce(F.col("trip_offset"), F.lit(0)).cast("bigint"))


def edge_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """The whole first or last row per key; null order values come first.

    Spark keeps one candidate per key and task before the shuffle (window group limit).
    """
    rest = [c for c in df.columns if c not in keys and c not in order and _sortable(df, c)]
    by = [F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_first() for c in (*order, *rest)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def _sortable(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType.simpleString()
    return "map<" not in kind and "variant" not in kind


def first_rows(df: DataFrame, keys=("vessel_id_int",), order=("timestamp_sec", "global_lsn")) -> DataFrame:
    return edge_row(df, keys, order, last=False)


def latest_rows(df: DataFrame, keys=("vessel_id_int",), order=("global_lsn",)) -> DataFrame:
    return edge_row(df, keys, order, last=True)


def distinct_first(df: DataFrame, keys=("vessel_id_int", "timestamp_sec"), order=("global_lsn",)) -> DataFrame:
    """Deduplicate, keeping the row that arrived first."""
    return edge_row(df, keys, order, last=False)


def segment_keys(df: DataFrame) -> DataFrame:
    """Per (vessel, trip) stretch: size and time span."""
    return df.groupBy("vessel_id_int", "trip_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("timestamp_sec").alias("start_sec"),
        F.max("timestamp_sec").alias("end_sec"),
    )
