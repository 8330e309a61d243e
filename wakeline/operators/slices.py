"""Previous/next rows and running values that survive one huge key.

A plain ``Window.partitionBy(vessel)`` sends every row of a vessel to one task.
Here a track is cut into slices of its order column, the window runs inside a
slice, and the slice edges are stitched through a small table that holds one
row per (key, slice).  Only that summary is ever gathered by key, so a vessel
that holds a third of all rows is spread over as many tasks as it has slices.

The wide rows are shuffled once, on (key, slice).  The summary comes from a
second, column-pruned read of the same input, and joins back without moving the
wide side again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.session import stored

Trigger = Callable[[Column, Column], Column]

# Six hours of one vessel, or its rows within five million arrivals: what one task sorts.
# The summary keeps one row for each of these.  ``fitted`` cuts crowded slices further.
TIME_SLICE_SEC = 21_600
SEQUENCE_SLICE = 5_000_000
ROWS_PER_SLICE = 2_000_000
MOST_PARTS = 1 << 20


@dataclass(frozen=True)
class Track:
    """What identifies a track and how its rows are ordered.

    ``order[0]`` is the numeric column that is cut into slices of ``width``; the
    other order columns break ties and must make the order unique.
    """

    key: Sequence[str] = ("vessel_id_int",)
    order: Sequence[str] = ("timestamp_sec", "global_lsn")
    width: float = TIME_SLICE_SEC
    # ``key, _even, _parts`` of the slices that are cut further; see ``fitted``
    dense: DataFrame | None = None

    def sliced(self, df: DataFrame) -> DataFrame:
        """Add ``_slice``, which never falls along the order."""
        at = F.col(self.order[0])
        even = F.floor(at / F.lit(self.width)).cast("bigint")
        if self.dense is None:
            return df.withColumn("_slice", even)
        rows = df.withColumn("_even", even).join(F.broadcast(self.dense), [*self.key, "_even"], "left")
        part = F.floor((at - F.col("_even") * F.lit(self.width)) * F.col("_parts") / F.lit(self.width)).cast("bigint")
        return rows.withColumn("_slice", F.col("_even") * F.lit(MOST_PARTS) + F.coalesce(part, F.lit(0))).drop("_even", "_parts")


def fitted(df: DataFrame, track: Track, rows_per_slice: int | None = None) -> Track:
    """The track with its crowded slices cut into parts of about ``rows_per_slice`` (``ROWS_PER_SLICE``) rows.

    One column-pruned count, combined before the shuffle.  Only slices above the
    limit are listed, at most one for every ``rows_per_slice`` rows of the table, so
    the list is a few megabytes even for a trillion rows.  Other vessels keep their
    slices.  The result never depends on the cut, only the size of the tasks does.
    """
    rows_per_slice = rows_per_slice or ROWS_PER_SLICE
    even = replace(track, dense=None)
    sizes = even.sliced(df.select(*track.key, track.order[0])).groupBy(*track.key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.least(F.ceil(F.col("_n") / F.lit(rows_per_slice)), F.lit(MOST_PARTS)).cast("bigint")
    dense = stored(sizes.where(F.col("_n") > rows_per_slice).select(
        *track.key, F.col("_slice").alias("_even"), parts.alias("_parts")), "dense-slices")
    return replace(track, dense=dense)


BY_TIME = Track()
BY_SEQUENCE = Track(order=("global_lsn",), width=SEQUENCE_SLICE)


@dataclass(frozen=True)
class Stitch:
    """What to carry along a track.

    ``lags``/``leads`` give structs ``prev1``, ``prev2``, ``next1`` holding
    ``carry``.  A counter adds 1 whenever its trigger holds for (row, previous
    row).  A fill remembers the value of the latest row whose trigger held.  On
    the very first row of a key the previous row is a null struct.
    """

    carry: Sequence[str]
    lags: int = 1
    leads: int = 0
    counters: dict[str, Trigger] = field(default_factory=dict)
    fills: dict[str, tuple[Trigger, Trigger]] = field(default_factory=dict)


def stitch(df: DataFrame, track: Track, what: Stitch) -> DataFrame:
    key = [*track.key, "_slice"]
    carry = list(dict.fromkeys([*track.order, *what.carry]))
    inside = Window.partitionBy(*key).orderBy(*track.order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*track.key).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)

    def in_slice(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("_cur", F.struct(*carry))
        frame = frame.withColumn("_l1", F.lag("_cur", 1).over(inside))
        hits = {n: F.coalesce(t(F.col("_cur"), F.col("_l1")), F.lit(False)) & F.col("_l1").isNotNull()
                for n, t in what.counters.items()}
        marks = {n: F.when(F.col("_l1").isNotNull() & F.coalesce(t(F.col("_cur"), F.col("_l1")), F.lit(False)),
                           F.struct(F.col("_cur").alias("at"), v(F.col("_cur"), F.col("_l1")).alias("value")))
                 for n, (t, v) in what.fills.items()}
        return frame.withColumns(
            {f"_hit_{n}": c.cast("bigint") for n, c in hits.items()}
            | {f"_mark_{n}": c for n, c in marks.items()}
        )

    # one small row per (key, slice)
    narrow = df.select(*track.key, *[c for c in carry if c not in track.key])
    narrow = track.sliced(narrow)
    needs_rows = what.lags > 1 or what.counters or what.fills
    if needs_rows:
        narrow = in_slice(narrow)
        if what.lags > 1:
            narrow = narrow.withColumn("_is_last", F.lead("_slice", 1).over(inside).isNull())
    else:
        narrow = narrow.withColumn("_cur", F.struct(*carry))
    edges = [F.min("_cur").alias("_first"), F.max("_cur").alias("_last")]
    if what.lags > 1:
        edges.append(F.max(F.when(~F.col("_is_last"), F.col("_cur"))).alias("_last2"))
    edges += [F.sum(f"_hit_{n}").alias(f"_in_{n}") for n in what.counters]
    edges += [F.max(f"_mark_{n}").alias(f"_lastmark_{n}") for n in what.fills]
    summary = narrow.groupBy(*key).agg(*edges)

    summary = summary.withColumn("_p1", F.lag("_last", 1).over(along))
    added = []
    if what.lags > 1:
        summary = summary.withColumn(
            "_p2", F.coalesce(F.lag("_last2", 1).over(along), F.lag("_last", 2).over(along)))
        added.append("_p2")
    if what.leads:
        summary = summary.withColumn("_nx", F.lead("_first", 1).over(along))
        added.append("_nx")
    for n, trigger in what.counters.items():
        first_hit = F.coalesce(trigger(F.col("_first"), F.col("_p1")), F.lit(False)).cast("bigint")
        summary = summary.withColumn(f"_firsthit_{n}", first_hit)
        earlier = F.sum(F.col(f"_in_{n}") + F.col(f"_firsthit_{n}")).over(before)
        summary = summary.withColumn(f"_base_{n}", F.coalesce(earlier, F.lit(0)) + F.col(f"_firsthit_{n}"))
        added.append(f"_base_{n}")
    for n, (trigger, value) in what.fills.items():
        first_value = F.when(
            F.coalesce(trigger(F.col("_first"), F.col("_p1")), F.lit(False)),
            F.struct(value(F.col("_first"), F.col("_p1")).alias("value")))
        summary = summary.withColumn(f"_firstfill_{n}", first_value)
        latest = F.coalesce(
            F.when(F.col(f"_lastmark_{n}").isNotNull(), F.struct(F.col(f"_lastmark_{n}.value").alias("value"))),
            F.col(f"_firstfill_{n}"))
        summary = summary.withColumn(f"_latest_{n}", latest)
        carried = F.coalesce(F.col(f"_firstfill_{n}"), F.last(f"_latest_{n}", ignorenulls=True).over(before))
        summary = summary.withColumn(f"_carried_{n}", carried)
        added.append(f"_carried_{n}")
    summary = summary.select(*key, "_p1", *added)

    # the wide rows: one shuffle, one sort
    wide = in_slice(track.sliced(df))
    if what.lags > 1:
        wide = wide.withColumn("_l2", F.lag("_cur", 2).over(inside))
    if what.leads:
        wide = wide.withColumn("_n1", F.lead("_cur", 1).over(inside))
    wide = wide.withColumns(
        {f"_run_{n}": F.sum(f"_hit_{n}").over(so_far) for n in what.counters}
        | {f"_fill_{n}": F.last(f"_mark_{n}", ignorenulls=True).over(so_far) for n in what.fills}
    )
    out = wide.join(summary, key, "left")

    columns: dict[str, Column] = {}
    if what.lags:
        columns["prev1"] = F.coalesce(F.col("_l1"), F.col("_p1"))
    if what.lags > 1:
        columns["prev2"] = F.coalesce(
            F.col("_l2"), F.when(F.col("_l1").isNull(), F.col("_p2")).otherwise(F.col("_p1")))
    if what.leads:
        columns["next1"] = F.coalesce(F.col("_n1"), F.col("_nx"))
    for n in what.counters:
        columns[n] = F.col(f"_base_{n}") + F.col(f"_run_{n}")
    for n in what.fills:
        columns[n] = F.coalesce(F.col(f"_fill_{n}.value"), F.col(f"_carried_{n}.value"))
    return out.select(*df.columns, *[c.alias(n) for n, c in columns.items()])


def running_sum(df: DataFrame, track: Track, value: str, out: str) -> DataFrame:
    """Cumulative sum along a track, current row included."""
    key = [*track.key, "_slice"]
    inside = Window.partitionBy(*key).orderBy(*track.order)
    along = Window.partitionBy(*track.key).orderBy("_slice")
    sliced = track.sliced(df)
    totals = sliced.groupBy(*key).agg(F.sum(value).alias("_total"))
    base = F.sum("_total").over(along.rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*key, F.coalesce(base, F.lit(0)).alias("_base"))
    running = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        sliced.withColumn("_running", running)
        .join(totals, key, "left")
        .select(*df.columns, (F.col("_base") + F.col("_running")).alias(out))
    )


def dense_sequence(df: DataFrame, order: Sequence[str], out: str, coarse: Column, fine: Column,
                   start: int = 0) -> DataFrame:
    """Gap-free sequence number over a total order, without one global sort task.

    Both slice columns must rise with ``order``, ``fine`` within ``coarse``.  Rows
    are numbered inside a fine slice and shifted by the rows of all earlier ones;
    the shift itself is summed in two steps, so only coarse totals meet in one
    task.
    """
    sliced = df.withColumns({"_coarse": coarse, "_fine": fine})
    counts = sliced.groupBy("_coarse", "_fine").agg(F.count(F.lit(1)).alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    within = earlier(Window.partitionBy("_coarse").orderBy("_fine"))
    inner = counts.withColumn("_before", F.coalesce(F.sum("_n").over(within), zero))
    across = earlier(Window.partitionBy("_all").orderBy("_coarse"))
    outer = counts.groupBy("_coarse").agg(F.sum("_n").alias("_n")).withColumn("_all", zero)
    outer = outer.select("_coarse", F.coalesce(F.sum("_n").over(across), zero).alias("_base"))
    offsets = inner.join(outer, "_coarse").select(
        "_coarse", "_fine", (F.col("_base") + F.col("_before")).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_coarse", "_fine").orderBy(*order))
    return (
        sliced.withColumn("_rn", number)
        .join(offsets, ["_coarse", "_fine"])
        .select(*df.columns, (F.lit(start) + F.col("_offset") + F.col("_rn") - 1).cast("bigint").alias(out))
    )


def ranged_sum(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Cumulative sum over one total order of all rows, current row included.

    Rows are range-partitioned by ``order`` and stored with their partition; the totals of the
    partitions before, one number each, shift the sums within.  ``order`` must be unique.
    """
    rows = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("_all").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_total")).withColumn("_all", F.lit(0))
    base = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("_running", F.sum(value).over(inside)).join(base, "_part")
    return running.select(*df.columns, (F.col("_base") + F.col("_running")).alias(out))
