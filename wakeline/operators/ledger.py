"""Robust scale ledgers, scaling, audits and simple fitted scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import scoring
from wakeline.operators.quantiles import wide_percentiles
from wakeline.registry import (
    DERIVED_TARGETS,
    MIN_TARGET_SCALE,
    SUPERCLASS,
    TARGETS,
    WEATHER,
    WEATHER_DEFAULTS,
    features_frame,
    inline,
)

MOVING_SPEED = 0.5
MIN_COHORT_ROWS = 50
QUARTILES = [0.25, 0.5, 0.75]


def moving(df: DataFrame) -> DataFrame:
    return df.where(F.col("speed_raw") > MOVING_SPEED)


def envelope(df: DataFrame, pad: float = 0.05, per_degree: int = 20) -> DataFrame:
    """Padded bounds, snapped outward to a twentieth of a degree; one row."""
    low = lambda c: F.floor((F.min(c) - pad) * per_degree) / F.lit(float(per_degree))
    high = lambda c: F.ceil((F.max(c) + pad) * per_degree) / F.lit(float(per_degree))
    return df.agg(
        low("lon_raw").alias("lon_min"), high("lon_raw").alias("lon_max"),
        low("lat_raw").alias("lat_min"), high("lat_raw").alias("lat_max"))


def long_form(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids, feature, value): an expand inside the scan stage, no shuffle."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in dict.fromkeys(features)])
    return wide.unpivot(list(ids), list(dict.fromkeys(features)), "feature", "value")


def _center_scale(floor: float) -> list[Column]:
    iqr = F.col("q")[2] - F.col("q")[0]
    return [F.col("q")[1].alias("center"), F.when(iqr > floor, iqr).otherwise(F.lit(1.0)).alias("scale")]


def global_scales(df: DataFrame, features: Sequence[str], iqr_floor: float = 1e-5) -> DataFrame:
    """Median and interquartile range per feature over all rows."""
    stats = wide_percentiles(df.withColumn("_all", F.lit(0)), "_all", features, QUARTILES)
    return stats.select("feature", *_center_scale(iqr_floor))


def cohort_scales(df: DataFrame, features: Sequence[str], cohort: str = "vessel_superclass_id") -> DataFrame:
    """Scales for cohort 0 (everyone) and cohorts 1-13.

    A cohort with fewer than 50 rows, and a feature without values in its
    cohort, copy the entry of everyone.  Both levels come from one pass: each
    row counts under its own cohort and under 0.
    """
    own = F.col(cohort).cast("int")
    known = F.col("_own").between(1, max(SUPERCLASS.values()))
    rows = df.select(own.alias("_own"), *dict.fromkeys(features))
    both = rows.withColumn("cohort", F.when(known, F.array(F.col("_own"), F.lit(0))).otherwise(F.array(F.lit(0))))
    stats = wide_percentiles(both, "cohort", features, QUARTILES).select(
        "cohort", "feature", *_center_scale(1e-5))
    sizes = df.groupBy(own.alias("cohort")).agg(F.count(F.lit(1)).alias("rows"))
    large = stats.join(sizes.where(F.col("rows") >= MIN_COHORT_ROWS).select("cohort").unionByName(
        inline(df.sparkSession, [(0,)], "cohort int")), "cohort", "left_semi")
    # one row per feature with its entries by cohort (at most 14), then fill the gaps from entry 0
    entry = F.struct("cohort", F.struct("center", "scale").alias("s"))
    by_feature = large.groupBy("feature").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    cohorts = by_feature.withColumn("cohort", F.explode(F.sequence(F.lit(0), F.lit(max(SUPERCLASS.values())))))
    own_entry = F.coalesce(F.try_element_at("_m", F.col("cohort")), F.try_element_at("_m", F.lit(0)))
    return cohorts.withColumn("_s", own_entry).select("cohort", "feature", "_s.center", "_s.scale")


def weather_scales(df: DataFrame) -> DataFrame:
    """Scales of the weather features that are present, defaults for the rest."""
    present = [f for f in WEATHER if f in df.columns]
    defaults = inline(
        df.sparkSession, [(f, *cs) for f, cs in WEATHER_DEFAULTS.items()], "feature string, _c0 double, _s0 double")
    measured = global_scales(df, present, iqr_floor=1e-4) if present else defaults.select(
        "feature", F.lit(None).cast("double").alias("center"), F.lit(None).cast("double").alias("scale")).limit(0)
    return defaults.join(measured, "feature", "left").select(
        "feature", F.coalesce("center", "_c0").alias("center"), F.coalesce("scale", "_s0").alias("scale"))


def as_map(ledger: DataFrame) -> DataFrame:
    """One row: feature -> {center, scale}.  A ledger has one entry per feature."""
    entry = F.struct("feature", F.struct("center", "scale").alias("s"))
    return ledger.agg(F.map_from_entries(F.collect_list(entry)).alias("scales"))


def scaled(df: DataFrame, cohort_ledger: DataFrame, features: Sequence[str], weather_ledger: DataFrame | None = None,
           bounds: DataFrame | None = None, cohort: str = "vessel_superclass_id") -> DataFrame:
    """Scale features by cohort, weather by its own ledger, positions by the bounds.

    A cohort without a ledger falls back to cohort 0; a cohort that lacks a
    feature leaves it unscaled; a weather feature without an entry uses {0, 1}.
    """
    entry = F.struct("feature", F.struct("center", "scale").alias("s"))
    wanted = list(dict.fromkeys(features))
    # entries are looked up once a ledger: rows read them by place, not by name
    placed = lambda entries: F.struct(*[F.try_element_at(entries, F.lit(f)).alias(f"_{j}") for j, f in enumerate(wanted)])
    per_cohort = cohort_ledger.groupBy(F.col("cohort").cast("int").alias("_cohort")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_own")).select("_cohort", placed("_own").alias("_own"))
    everyone = as_map(cohort_ledger.where("cohort = 0")).select(placed("scales")).scalar()
    out = df.withColumn("_key", F.col(cohort).cast("int")).join(
        F.broadcast(per_cohort), F.col("_key") == F.col("_cohort"), "left")
    out = out.withColumn("_scales", F.coalesce("_own", everyone))
    changes = {}
    if weather_ledger is not None:
        out = out.withColumn("_weather", as_map(weather_ledger).select(placed("scales")).scalar())
    for j, f in enumerate(wanted):
        if f in WEATHER:
            if weather_ledger is None:
                continue
            s = F.col("_weather")[f"_{j}"]
            changes[f] = scoring.robust_scaled(
                F.col(f), F.coalesce(s["center"], F.lit(0.0)), F.coalesce(s["scale"], F.lit(1.0)))
        else:
            s = F.col("_scales")[f"_{j}"]
            changes[f] = scoring.robust_scaled(F.col(f), s["center"], s["scale"])
    if bounds is not None:
        out = out.withColumn("_bounds", bounds.select(F.struct("*")).scalar())
        for c, axis in (("lon_raw", "lon"), ("lat_raw", "lat")):
            changes[c] = scoring.min_max_scaled(
                F.col(c), F.col(f"_bounds.{axis}_min"), F.col(f"_bounds.{axis}_max"))
    return out.withColumns(changes).select(*df.columns)


def neutralised(df: DataFrame, weather_ledger: DataFrame, features: Sequence[str] = tuple(WEATHER)) -> DataFrame:
    """Overwrite weather columns with their ledger centres (0 without an entry)."""
    scales = as_map(weather_ledger).scalar()
    rows = df.withColumn("_weather", scales)
    present = [f for f in features if f in df.columns]
    return rows.withColumns({
        f: F.coalesce(F.try_element_at("_weather", F.lit(f))["center"], F.lit(0.0)) for f in present
    }).drop("_weather")


def audit(ledger: DataFrame, weather_ledger: DataFrame) -> DataFrame:
    """Every registry feature and every ledger entry: where it is scaled, or what is wrong."""
    features = features_frame(ledger.sparkSession)
    own = ledger.where("cohort = 0").select("feature", F.lit("cohort").alias("place"))
    entries = own.unionByName(weather_ledger.select("feature", F.lit("weather").alias("place")))
    entries = entries.groupBy("feature").agg(F.min("place").alias("place"))
    joined = features.join(entries, "feature", "full_outer")
    state = (
        F.when(F.col("ordinal").isNull(), "orphan")
        .when(F.col("place").isNotNull(), "scaled")
        .when(F.col("target"), "unscaled target")
        .otherwise("unscaled")
    )
    return joined.select("feature", F.coalesce("place", F.lit("missing")).alias("place"), state.alias("state"))


def phase_weights(df: DataFrame) -> DataFrame:
    """Phase counts and inverse-frequency weights."""
    names = ("anchoring", "cruising", "departure", "maneuvering")
    counts = df.agg(*[F.count(F.when(F.col(f"voyage_phase_{n}") > 0.5, 1)).alias(n) for n in names])
    long = counts.unpivot([], list(names), "phase", "count")
    total = F.greatest(sum((F.col(n) for n in names), F.lit(0)), F.lit(1)).alias("total")
    return long.withColumn("total", counts.select(total).scalar()).select(
        "phase", "count", (F.col("total") / (F.col("count") + 1e-5)).alias("weight"))


def active_targets(ledger: DataFrame, weather_ledger: DataFrame) -> DataFrame:
    """Reconstruction targets whose largest scale over cohorts is not near zero."""
    spark = ledger.sparkSession
    wanted = inline(spark, [(t, t in WEATHER) for t in TARGETS], "feature string, is_weather boolean")
    derived = inline(spark, [(d,) for d in DERIVED_TARGETS], "feature string")
    cohort_max = ledger.groupBy("feature").agg(F.max("scale").alias("_c"))
    weather_max = weather_ledger.groupBy("feature").agg(F.max("scale").alias("_w"))
    scale = F.when(F.col("is_weather"), F.coalesce("_w", F.lit(1.0))).otherwise(F.coalesce("_c", F.lit(0.0)))
    return (
        wanted.join(derived, "feature", "left_anti").join(cohort_max, "feature", "left")
        .join(weather_max, "feature", "left")
        .select("feature", scale.alias("max_scale")).where(F.col("max_scale") >= MIN_TARGET_SCALE)
    )


def fit_standard(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature; a zero deviation counts as 1."""
    stats = long_form(train, features).groupBy("feature").agg(
        F.avg("value").alias("center"), F.stddev_pop("value").alias("_sd"))
    return stats.select("feature", "center", F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd")).alias("scale"))


def fit_robust(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Median and IQR per feature; a zero IQR counts as 1."""
    return global_scales(train, features, iqr_floor=0.0)


def transform(df: DataFrame, fitted: DataFrame, features: Sequence[str]) -> DataFrame:
    """Apply a fitted ledger to other rows."""
    rows = df.withColumn("_scales", as_map(fitted).scalar())
    value = lambda f: F.try_element_at("_scales", F.lit(f))
    return rows.withColumns({
        f: (F.col(f) - value(f)["center"]) / value(f)["scale"] for f in features
    }).drop("_scales")
