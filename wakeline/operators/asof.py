"""As-of joins: the latest right-hand row not after the left-hand time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.operators.slices import TIME_SLICE_SEC, Stitch, Track, stitch


def asof_backward(left: DataFrame, right: DataFrame, key: Sequence[str], time: str,
                  values: Sequence[str], tie: str, width: float = TIME_SLICE_SEC) -> DataFrame:
    """Left rows with ``values`` of the latest right row at or before ``time``.

    Both sides are stacked on one time line and the last right-hand values are
    carried forward, slice by slice, so neither side is replicated.
    """
    a = left.select(*left.columns, F.lit(1).alias("_side"))
    b = right.select(*key, time, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(0).alias("_side"), tie)
    stacked = a.unionByName(b, allowMissingColumns=True)
    track = Track(key=tuple(key), order=(time, "_side", tie), width=width)
    payload = [f"_r_{v}" for v in values]
    filled = stitch(stacked, track, Stitch(carry=["_side", *payload], lags=0, fills={
        "_asof": (lambda cur, prev: cur["_side"] == 0, lambda cur, prev: F.struct(*[cur[p].alias(p) for p in payload]))}))
    return filled.where(F.col("_side") == 1).select(
        *left.columns, *[F.col(f"_asof._r_{v}").alias(v) for v in values])
