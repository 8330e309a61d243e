"""Cleaning and encoding of raw message fields."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BUCKETS = 100


def missing(value: Column) -> Column:
    """Null and NaN both count as missing."""
    return value.isNull() | F.isnan(value)


def vessel_id(text: Column) -> Column:
    """Text id to bigint: all digits are decimal, otherwise the last 15 characters are hex.

    Fifteen hex digits are 60 bits, so the sign bit is never set.  Text that is
    neither parses to 0; ``conv`` alone would accept a valid prefix.
    """
    tail = F.when(F.length(text) > 15, F.substring(text, -15, 15)).otherwise(text)
    return (
        F.when(text.rlike(r"^\d+$"), F.coalesce(text.try_cast("bigint"), F.lit(0)))
        .when(tail.rlike("^[0-9a-fA-F]+$"), F.conv(tail, 16, 10).cast("bigint"))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def hash_bucket(vessel: Column, buckets: int = HASH_BUCKETS) -> Column:
    return F.pmod(vessel, F.lit(buckets)).cast("int")


def epoch_seconds(text: Column) -> Column:
    """Epoch text in s, ms, us or ns to seconds; text that is no integer gives null."""
    t = text.try_cast("bigint")
    return (
        F.when(t > 10**18, _idiv(t, 10**9))
        .when(t > 10**15, _idiv(t, 10**6))
        .when(t > 10**12, _idiv(t, 10**3))
        .otherwise(t)
    )


def _idiv(value: Column, by: int) -> Column:
    """Whole-number division; a double quotient would lose digits of a ns epoch."""
    return F.call_function("div", value, F.lit(by))


def utc_timestamp(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def imputed(value: Column, default: float = 0.0) -> Column:
    return F.when(missing(value), F.lit(default)).otherwise(value)


def null_flag(value: Column) -> Column:
    return missing(value).cast("int")


def circular(degrees: Column) -> tuple[Column, Column]:
    rad = F.radians(degrees)
    return F.sin(rad), F.cos(rad)


def hour_cycle(ts: Column) -> tuple[Column, Column]:
    angle = F.hour(ts) / F.lit(24.0) * F.lit(2 * math.pi)
    return F.sin(angle), F.cos(angle)


def weekday_cycle(ts: Column) -> tuple[Column, Column]:
    """ISO weekday, Monday = 1."""
    angle = (F.weekday(ts) + F.lit(1)) / F.lit(7.0) * F.lit(2 * math.pi)
    return F.sin(angle), F.cos(angle)


def phases(speed: Column) -> dict[str, Column]:
    """Phase one-hot columns; departure is never raised."""
    return {
        "voyage_phase_anchoring": (speed < 1.0).cast("int"),
        "voyage_phase_cruising": (speed >= 5.0).cast("int"),
        "voyage_phase_departure": F.lit(0),
        "voyage_phase_maneuvering": ((speed >= 1.0) & (speed < 5.0)).cast("int"),
    }


def split_label(year: Column, month: Column) -> Column:
    """Chronological split: train up to 2019-06, calibrate 7-9, test 10-12."""
    return (
        F.when((year < 2019) | ((year == 2019) & (month <= 6)), "train")
        .when((year == 2019) & month.between(7, 9), "calibrate")
        .when((year == 2019) & month.between(10, 12), "test")
    )
