"""Running behaviour prototype per vessel and its drift score.

The prototype is an order-dependent fold: every step renormalises, so no partial sums exist.
A history is cut into pieces of ``piece_rows``, and the pieces are folded in passes over all
vessels: a pass takes one piece of every vessel that still has rows and begins where the
state stored by the pass before ends.  The chain is exact at any piece size, a task holds no
more than a piece, and a lost pass is repeated from the stored state.  The rows are stored by
piece, so a pass reads the folder of its piece and nothing else.

The threshold looks back over the vessel's own drifts or, with ``shared``, over the drifts of
all vessels of a file in order of time.  That order is cut into slices which also receive the
values before them, as many as the buffer holds.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.slices import Track, ranged_sum
from wakeline.operators.windows import numbered
from wakeline.session import stored

ALPHA, BASE_THRESHOLD, PERCENTILE = 0.1, 0.45, 0.95
BUFFER, MIN_SEEN = 10_000, 1_000
PIECE_ROWS = 200_000
SHARED_SLICE = 100_000
BY_EMBEDDING = Track(order=("timestamp_sec", "embedding_id"))
IDS = ["embedding_id", "vessel_id_int", "timestamp_sec"]
STATE = ["prototype", "recent"]
OUT = ("embedding_id bigint, vessel_id_int bigint, timestamp_sec bigint, row_no bigint, drift double, threshold double, outlier int, "
       "prototype array<double>, recent array<double>")


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(v @ v)
    return v / (norm if norm > 1e-8 else 1.0)


def step(prototype: np.ndarray | None, vector: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(drift, next prototype); the first observation only sets the prototype."""
    e = unit(vector)
    if prototype is None:
        return 0.0, e
    moved = alpha * e + (1.0 - alpha) * prototype
    return 1.0 - float(prototype @ e), moved / max(np.sqrt(moved @ moved), 1e-8)


class RollingPercentile:
    """Percentile of the last ``size`` values, linear between ranks."""

    def __init__(self, size: int, p: float):
        self.size, self.p, self.recent, self.ordered = size, p, deque(), []

    def add(self, value: float) -> None:
        if len(self.recent) == self.size:
            self.ordered.pop(bisect_left(self.ordered, self.recent.popleft()))
        self.recent.append(value)
        insort(self.ordered, value)

    def value(self) -> float:
        at = self.p * (len(self.ordered) - 1)
        k = int(at)
        low = self.ordered[k]
        return low if at == k else low + (self.ordered[k + 1] - low) * (at - k)


class Chain:
    """One vessel's prototype and drift buffer; ``take`` returns drift, threshold and outlier flag."""

    def __init__(self, alpha: float, buffer: int, min_seen: int, prototype=None, recent=()):
        self.alpha, self.min_seen, self.seen = alpha, min_seen, RollingPercentile(buffer, PERCENTILE)
        self.prototype = None if prototype is None else np.asarray(prototype, float)
        for value in recent:
            self.seen.add(value)

    def take(self, vector) -> tuple[float, float, int]:
        before = self.prototype
        drift, self.prototype = step(before, np.asarray(vector, float), self.alpha)
        if before is not None:
            self.seen.add(drift)
        threshold = self.seen.value() if len(self.seen.recent) >= max(self.min_seen, 1) else BASE_THRESHOLD
        return drift, threshold, int(before is not None and drift > threshold)

    def state(self) -> tuple[list, list]:
        return [float(x) for x in self.prototype], list(self.seen.recent)


def _folder(alpha: float, buffer: int, min_seen: int):
    """Fold rows sorted by vessel and row number.  A vessel's stored state comes first, as row -1."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vessel_at, chain = None, None

        def closing() -> pd.DataFrame:
            prototype, recent = chain.state()
            return pd.DataFrame({
                "embedding_id": pd.array([None], "Int64"), "vessel_id_int": [vessel_at], "timestamp_sec": pd.array([None], "Int64"),
                "row_no": pd.array([None], "Int64"), "drift": [None], "threshold": [None], "outlier": pd.array([None], "Int32"), "prototype": [prototype], "recent": [recent]})

        for pdf in batches:
            out = []
            for i, (vessel, row_no, vector) in enumerate(zip(pdf["vessel_id_int"], pdf["row_no"], pdf["embedding"])):
                if vessel != vessel_at:
                    if chain is not None:
                        yield closing()
                    vessel_at, chain = vessel, Chain(alpha, buffer, min_seen)
                if row_no < 0:
                    chain = Chain(alpha, buffer, min_seen, pdf["prototype"].iloc[i], pdf["recent"].iloc[i])
                else:
                    out.append((i, *chain.take(vector)))
            if out:
                at, drift, threshold, outlier = zip(*out)
                yield pdf.iloc[list(at)][[*IDS, "row_no"]].assign(
                    drift=drift, threshold=threshold, outlier=outlier, prototype=None, recent=None)
        if chain is not None:
            yield closing()

    return fold


def prototype_drift(df: DataFrame, alpha: float = ALPHA, buffer: int = BUFFER, min_seen: int = MIN_SEEN,
                    piece_rows: int = PIECE_ROWS, shared: bool = False) -> DataFrame:
    """Drift of each embedding from its vessel's prototype, threshold and outlier flag.

    The threshold is the 95th percentile of the vessel's last ``buffer`` drifts
    once ``min_seen`` were seen, and a constant before; with ``shared`` of the last
    drifts of all vessels in order of (timestamp_sec, embedding_id).
    """
    own = (buffer, min_seen) if not shared else (1, 1)
    rows = numbered(df.select(*IDS, "embedding"), BY_EMBEDDING)
    rows = stored(rows.withColumn("piece", F.floor(F.col("row_no") / piece_rows).cast("bigint")), "drift-rows", ["piece"])
    last = rows.agg(F.max("piece")).first()[0]
    empty = {c: F.lit(None).cast("array<double>") for c in STATE}
    fold, state, folded = _folder(alpha, *own), None, []
    for piece in range((last or 0) + 1):
        chunk = rows.where(F.col("piece") == piece).drop("piece").withColumns(empty)
        if state is not None:
            going_on = chunk.select("vessel_id_int").distinct()
            known = state.join(going_on, "vessel_id_int", "left_semi").withColumn("row_no", F.lit(-1).cast("bigint"))
            chunk = chunk.unionByName(known, allowMissingColumns=True)
        ordered = chunk.repartition("vessel_id_int").sortWithinPartitions("vessel_id_int", "row_no")
        done = stored(ordered.mapInPandas(fold, OUT), "drift")
        folded.append(done.where(F.col("embedding_id").isNotNull()))
        state = done.where(F.col("prototype").isNotNull()).select("vessel_id_int", *STATE)
    out = folded[0]
    for more in folded[1:]:
        out = out.unionByName(more)
    if shared:
        return shared_threshold(out.select(*IDS, "row_no", "drift"), buffer, min_seen)
    return out.select(*IDS, "drift", "threshold", "outlier")


def shared_threshold(drifts: DataFrame, buffer: int = BUFFER, min_seen: int = MIN_SEEN,
                     slice_rows: int = SHARED_SLICE) -> DataFrame:
    """Threshold and outlier flag from one buffer over all vessels, in order of (timestamp_sec, embedding_id).

    A vessel's first row (``row_no`` 0) adds nothing and takes the threshold that stands.  Slices
    of the order receive the ``buffer - 1`` values before them, so a task holds one slice and
    one buffer however many rows there are.
    """
    size = max(slice_rows, buffer)
    rows = ranged_sum(drifts.withColumn("_adds", (F.col("row_no") > 0).cast("bigint")), list(BY_EMBEDDING.order), "_adds", "seen")
    home = F.floor((F.col("seen") - 1) / F.lit(size)).cast("bigint")
    halo = F.when(F.col("seen") > (home + 1) * size - (buffer - 1), F.array(home, home + 1)).otherwise(F.array(home))
    dealt = rows.where("_adds = 1").select("seen", "drift", home.alias("home"), F.explode(halo).alias("slice"))

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seen")
        window, threshold = RollingPercentile(buffer, PERCENTILE), []
        for drift in pdf["drift"]:
            window.add(drift)
            threshold.append(window.value() if len(window.recent) >= max(min_seen, 1) else BASE_THRESHOLD)
        own = (pdf["home"] == pdf["slice"]).to_numpy()
        return pdf[["seen"]].assign(threshold=threshold)[own]

    stands = dealt.groupBy("slice").applyInPandas(slide, "seen bigint, threshold double")
    out = rows.join(stands, "seen", "left").withColumn("threshold", F.coalesce("threshold", F.lit(BASE_THRESHOLD)))
    outlier = ((F.col("_adds") == 1) & (F.col("drift") > F.col("threshold"))).cast("int")
    return out.select(*IDS, "drift", "threshold", outlier.alias("outlier"))
