"""Last known row of each vessel as keyed streaming state, with the sequence gate and expiry inside.

The engine's state store holds one value per vessel; a batch touches only the vessels in it,
so its cost follows the batch and not the fleet.  Versions, replay and recovery are those of
the checkpoint.  The stored values can be read as a table (``stored_latest``) and given to a
new query as its first state (``initial``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wakeline.streaming.state import STATE

VALUES = [c for c in STATE.names if c != "vessel_id_int"]
VALUE_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STATE.fields if f.name != "vessel_id_int")
KINDS = [float if f.dataType.simpleString() == "double" else int for f in STATE.fields if f.name != "vessel_id_int"]
GATE = "vessel_id_int bigint, global_lsn bigint, accepted int"


def _last_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a vessel and Arrow batch: a busy vessel sends few rows to its task."""
    for batch in batches:
        yield batch.sort_values("global_lsn", kind="stable").groupby("vessel_id_int", sort=False).tail(1)


def _value(rows: pd.DataFrame, at: int) -> tuple:
    """One row's values, each in its own type (a row taken as a series would turn longs into doubles)."""
    held = (rows[c].iat[at] for c in VALUES)
    return tuple(None if pd.isna(v) else kind(v) for v, kind in zip(held, KINDS, strict=True))


class LatestProcessor(StatefulProcessor):
    """Value state per vessel: its row of the highest sequence number.

    A batch whose last row is older than the stored one is rejected and changes nothing; an
    equal one is taken.  With ``retention`` (seconds of event time) a timer forgets a vessel
    that was not seen for so long when the watermark passes.
    """

    def __init__(self, retention: int | None = None):
        self._retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._latest = handle.getValueState("latest", VALUE_SCHEMA)

    def _expiry(self, value: tuple) -> int:
        return (value[VALUES.index("last_seen_epoch")] + self._retention) * 1000 + 500

    def _keep(self, value: tuple, old: tuple | None) -> None:
        self._latest.update(value)
        if self._retention is not None:
            if old is not None:
                self._handle.deleteTimer(self._expiry(old))
            self._handle.registerTimer(self._expiry(value))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, value = VALUES.index("global_lsn"), None
        for part in rows:
            best = _value(part, int(part["global_lsn"].to_numpy().argmax()))
            value = best if value is None or best[at] > value[at] else value
        old = tuple(self._latest.get()) if self._latest.exists() else None
        accepted = old is None or value[at] >= old[at]
        if accepted:
            self._keep(value, old)
        yield pd.DataFrame({"vessel_id_int": [key[0]], "global_lsn": [value[at]], "accepted": pd.array([int(accepted)], "int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._latest.clear()
        return iter([])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(_value(initialState, 0), None)

    def close(self) -> None:
        pass


def gate_latest(stream: DataFrame, retention: int | None = None, lateness: str = "0 seconds",
                initial: DataFrame | None = None) -> DataFrame:
    """``vessel_id_int, global_lsn, accepted``: the verdict on each vessel's last row of a batch.

    ``initial`` is a table in state layout that a query with an empty checkpoint starts from.
    """
    rows = stream.select(
        "vessel_id_int", "global_lsn", F.col("timestamp_sec").alias("last_timestamp"), F.col("speed_raw").alias("last_speed"),
        F.col("lon_raw").alias("last_lon"), F.col("lat_raw").alias("last_lat"), (F.col("speed_raw") < 1.0).cast("int").alias("last_is_static"),
        F.lit(0).cast("bigint").alias("trip_id_offset"), F.col("timestamp_sec").alias("last_seen_epoch")).select(*STATE.names)
    rows = rows.mapInPandas(_last_of_each, rows.schema)
    if retention is not None:
        rows = rows.withColumn("event_time", F.timestamp_seconds("last_seen_epoch")).withWatermark("event_time", lateness)
    return rows.groupBy("vessel_id_int").transformWithStateInPandas(
        statefulProcessor=LatestProcessor(retention), outputStructType=GATE, outputMode="append",
        timeMode="none" if retention is None else "eventtime",
        initialState=None if initial is None else initial.select(*STATE.names).groupBy("vessel_id_int"))


def stored_latest(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The state of a query as a table in state layout, after its last batch or a given one."""
    reader = spark.read.format("statestore").option("stateVarName", "latest")
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load(checkpoint).select("key.vessel_id_int", "value.*").select(*STATE.names)
