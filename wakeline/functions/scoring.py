"""Reliability, scaling, fusion, gate and presentation expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.registry import PENALTIES, SCENARIOS

SPEED_LIMIT, JUMP_SPEED, JUMP_ACCELERATION, LONG_GAP_LOG = 45.0, 90.0, 15.0, 7.5
JOINT_FACTOR = 0.95


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def speed_flag(speed: Column) -> Column:
    return F.coalesce(speed > SPEED_LIMIT, F.lit(False)).cast("int")


def jump_flag(speed: Column, acceleration: Column) -> Column:
    jump = (speed > JUMP_SPEED) | (F.abs(acceleration) > JUMP_ACCELERATION)
    return F.coalesce(jump, F.lit(False)).cast("int")


def reliability(flags: dict[str, Column], log_gap: Column) -> Column:
    """1 minus the penalties of the raised flags, kept in [0, 1]."""
    raised = {name: flag == 1 for name, flag in flags.items()} | {"long_gap": log_gap > LONG_GAP_LOG}
    terms = [F.when(raised[name], F.lit(-p)).otherwise(F.lit(0.0)) for name, p in PENALTIES.items()]
    return clip(reduce(add, terms, F.lit(1.0)), 0.0, 1.0)


def robust_scaled(value: Column, center: Column, scale: Column) -> Column:
    """A scale that is (almost) zero counts as 1; no ledger entry leaves the value alone."""
    divisor = F.when(F.abs(scale) > 1e-6, scale).otherwise(F.lit(1.0))
    return F.when(center.isNull(), value).otherwise((value - center) / divisor)


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / (high - low + 1e-7)


def sanitised(value: Column, bound: float = 50.0) -> Column:
    """NaN to 0, infinities and outliers to the bound."""
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(clip(value, -bound, bound))


def unit_circle(sin: Column, cos: Column) -> tuple[Column, Column]:
    norm = F.sqrt(sin * sin + cos * cos) + 1e-8
    return sin / norm, cos / norm


def fused(reconstruction: Column, distance: Column) -> Column:
    """The larger channel plus a boost where both are high."""
    boosted = F.greatest(reconstruction, distance) + 0.15 * (reconstruction * distance)
    return clip(boosted, 0.0, 1.0)


def risk_class(mean_fused: Column) -> Column:
    return F.when(mean_fused > 0.75, "Anomaly Detected").otherwise("Normal Operations")


def rescaled_distance(distance: Column, p50: Column, p99: Column) -> Column:
    """Anchored to calibration percentiles: floor 0, no upper bound."""
    return F.greatest(F.lit(0.0), (distance - p50) / (p99 - p50 + 1e-8))


def log_compressed(error: Column, divisor: float) -> Column:
    return clip(F.log1p(error) / F.lit(divisor), 0.0, 1.0)


def gates(r: Column, a: Column, tr: Column, ta: Column) -> dict[str, Column]:
    """Alert bits of the two channels, their combinations and the continuous ratio."""
    ar, aa = r >= tr, a >= ta
    joint = (r >= JOINT_FACTOR * tr) & (a >= JOINT_FACTOR * ta)
    return {
        "alert_recon": ar.cast("int"),
        "alert_ann": aa.cast("int"),
        "gate_or": (ar | aa).cast("int"),
        "gate_and": (ar & aa).cast("int"),
        "gate_joint": (ar | aa | joint).cast("int"),
        "combined_ratio": F.greatest(r / (tr + 1e-8), a / (ta + 1e-8)),
    }


def alert_tier(alert_recon: Column, alert_ann: Column) -> Column:
    return (
        F.when((alert_recon == 1) & (alert_ann == 1), "critical")
        .when(alert_recon == 1, "reconstruction")
        .when(alert_ann == 1, "manifold")
        .otherwise("normal")
    )


def presentation(r: Column, a: Column, tr: Column, ta: Column) -> tuple[Column, Column]:
    """Status text and the piecewise display score of one decision."""
    ar, aa = r >= tr, a >= ta
    joint = (r >= JOINT_FACTOR * tr) & (a >= JOINT_FACTOR * ta)
    top = F.greatest(r / (tr + 1e-8), a / (ta + 1e-8))
    breach = F.when(ar, r / tr).otherwise(a / ta)
    status = (
        F.when(ar & aa, "CRITICAL")
        .when(ar | aa, "WARNING")
        .when(joint, "JOINT")
        .otherwise("NOMINAL")
    )
    score = (
        F.when(ar & aa, clip(0.75 + (top - 1.0) * 0.25, 0.75, 1.0))
        .when(ar | aa, clip(0.50 + (breach - 1.0) * 0.24, 0.50, 0.74))
        .when(joint, F.lit(min(max(JOINT_FACTOR * 0.55, 0.50), 0.74)))
        .otherwise(clip(top * 0.49, 0.0, 0.49))
    )
    return status, score


def baseline_display(r: Column, a: Column, tr: Column, ta: Column) -> Column:
    """Display score of the unperturbed run, the reference point of a scenario delta."""
    ratio = F.greatest(r / (tr + 1e-8), a / (ta + 1e-8))
    return F.when((r < tr) & (a < ta), ratio * 0.49).otherwise(0.50 + (ratio - 1.0) * 0.24)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def md5_mod(text: Column, modulus: int = 3) -> Column:
    """md5 read as one 128-bit number, modulo 3.

    2^32 leaves remainder 1 modulo 3, so the four 32-bit words just add up; a
    single conversion of 32 hex digits would overflow.
    """
    if modulus != 3:
        raise ValueError("the word sum is only valid modulo 3")
    digest = F.md5(text.cast("binary"))
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return F.pmod(reduce(add, words), F.lit(3)).cast("int")


def scenario(text: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), md5_mod(text) + 1)


def l2_norm(vector: Column) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def l2_normalised(vector: Column) -> Column:
    norm = l2_norm(vector)
    divisor = F.when(norm > 1e-8, norm).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: x.cast("double") / divisor)
