"""Online prototype drift with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wakeline.operators.drift import ALPHA, BUFFER, MIN_SEEN, Chain

OUT = "embedding_id bigint, vessel_id_int bigint, timestamp_sec bigint, drift double, threshold double, outlier int"
STATE = StructType([StructField(n, ArrayType(DoubleType())) for n in ("prototype", "recent")])


class PrototypeProcessor(StatefulProcessor):
    """State per vessel: the prototype vector and the recent drifts.  Rows of a batch are taken in time order."""

    def __init__(self, buffer: int = BUFFER, min_seen: int = MIN_SEEN):
        self._buffer, self._min_seen = buffer, min_seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("chain", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._state.get() if self._state.exists() else (None, ())
        chain = Chain(ALPHA, self._buffer, self._min_seen, *known)
        batch = pd.concat(list(rows)).sort_values(["timestamp_sec", "embedding_id"])
        drift, threshold, outlier = zip(*map(chain.take, batch["embedding"]), strict=True)
        self._state.update(chain.state())
        yield batch[["embedding_id", "vessel_id_int", "timestamp_sec"]].assign(
            drift=drift, threshold=threshold, outlier=outlier)

    def close(self) -> None:
        pass


def streaming_drift(stream: DataFrame, buffer: int = BUFFER, min_seen: int = MIN_SEEN) -> DataFrame:
    """Drift, threshold and outlier flag of each arriving embedding.

    State survives restarts through the checkpoint.
    """
    return stream.select("embedding_id", "vessel_id_int", "timestamp_sec", "embedding").groupBy(
        "vessel_id_int").transformWithStateInPandas(
        statefulProcessor=PrototypeProcessor(buffer, min_seen), outputStructType=OUT, outputMode="append", timeMode="none")
