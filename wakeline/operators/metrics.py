"""Calibration, gates and detection metrics over scored decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import scoring
from wakeline.operators.quantiles import exact_percentiles
from wakeline.registry import FRONTIER_PERCENTILES, SCENARIOS, TIERS, inline
from wakeline.session import stored

CALIBRATION_PERCENTILE = 0.995
CHANNELS = ("recon", "ann")


def aggregated(df: DataFrame, keys: Sequence[str], score: str, mean_weight: float = 0.7, peak: float = 0.95,
               out: str = "score") -> DataFrame:
    """Mean and peak percentile of a key's window scores, blended; 0 without scores."""
    means = df.groupBy(*keys).agg(F.avg(score).alias("_m"))
    if mean_weight == 1.0:
        return means.select(*keys, F.coalesce("_m", F.lit(0.0)).alias(out))
    peaks = exact_percentiles(df, keys, score, [peak], few_groups=False)
    blend = F.lit(mean_weight) * F.col("_m") + F.lit(1.0 - mean_weight) * F.col("q")[0]
    return means.join(peaks, list(keys), "left").select(*keys, F.coalesce(blend, F.lit(0.0)).alias(out))


def distance_anchors(df: DataFrame, distance: str = "ann") -> DataFrame:
    """p50 and p99 of the raw neighbour distances; one row."""
    q = exact_percentiles(df, [], distance, [0.5, 0.99])
    return q.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"))


def rescaled(df: DataFrame, anchors: DataFrame, distance: str = "ann") -> DataFrame:
    a = anchors.select(F.struct("p50", "p99")).scalar()
    rows = df.withColumn("_a", a)
    return rows.withColumn(
        distance, scoring.rescaled_distance(F.col(distance), F.col("_a.p50"), F.col("_a.p99"))).drop("_a")


def thresholds(per_vessel: DataFrame, channels: Sequence[str], percentile: float = CALIBRATION_PERCENTILE) -> DataFrame:
    """Per channel: cutoff percentile, mean and population deviation of the vessel scores."""
    long = per_vessel.select(*[F.col(c).cast("double").alias(c) for c in channels]).unpivot(
        [], list(channels), "channel", "value")
    moments = long.groupBy("channel").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    cut = exact_percentiles(long, ["channel"], "value", [percentile])
    return moments.join(cut, "channel").select("channel", "mu", "sigma", F.col("q")[0].alias("threshold"))


def threshold_of(limits: DataFrame, channel: str) -> Column:
    return limits.where(F.col("channel") == channel).select("threshold").scalar()


def decided(df: DataFrame, limits: DataFrame, recon: str = "recon", ann: str = "ann") -> DataFrame:
    """Alert bits, gates and combined ratio of every decision."""
    rows = df.withColumns({"_tr": threshold_of(limits, recon), "_ta": threshold_of(limits, ann)})
    bits = scoring.gates(F.col(recon), F.col(ann), F.col("_tr"), F.col("_ta"))
    return rows.withColumns(bits).drop("_tr", "_ta")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where undefined."""
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion(df: DataFrame, label: str, predicted: Column, keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, predicted
    counts = df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    return counts.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def score_curve(df: DataFrame, label: str, score: str, ranges: int | None = None) -> DataFrame:
    """Distinct scores with their positives, negatives and the counts at or above them.

    The table is scanned once, to count per distinct score.  The distinct scores are dealt to
    partitions by range and stored with the number of theirs; counts run inside a partition
    and the totals of the partitions above shift them, so no task sorts all scores and no
    quantile passes through the driver.  ``ranges`` fixes the number of partitions.
    """
    rows = df.select(F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("score"))
    counts = stored(rows.groupBy("score").agg(F.sum("_y").alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")), "scores")
    dealt = counts.repartitionByRange(*([ranges] if ranges else []), "score")
    # stored, because a range partitioning that is computed again may cut elsewhere
    counts = stored(dealt.withColumn("_slice", F.spark_partition_id()), "score-ranges")
    inside = Window.partitionBy("_slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumns({"_tp": F.sum("pos").over(inside), "_fp": F.sum("neg").over(inside)})
    totals = counts.groupBy("_slice").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).withColumn("_all", F.lit(0))
    above = Window.partitionBy("_all").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("_all")
    zero = F.lit(0)
    totals = totals.select(
        "_slice", F.coalesce(F.sum("_p").over(above), zero).alias("_tp0"),
        F.coalesce(F.sum("_n").over(above), zero).alias("_fp0"),
        F.sum("_p").over(everything).alias("positives"), F.sum("_n").over(everything).alias("negatives"))
    return running.join(totals, "_slice").select(
        "score", "pos", "neg", (F.col("_tp") + F.col("_tp0")).alias("tp"),
        (F.col("_fp") + F.col("_fp0")).alias("fp"), "positives", "negatives")


def auroc(curve: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; 0.5 for one class."""
    won = F.sum(F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") * 0.5))
    pairs = F.max(F.col("positives").cast("double") * F.col("negatives"))
    return curve.agg(F.coalesce(F.try_divide(won, pairs), F.lit(0.5)).alias("auroc"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of recall steps times precision over distinct scores."""
    step = F.try_divide(F.col("pos").cast("double"), F.col("positives").cast("double"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve.agg(F.coalesce(F.sum(step * precision), F.lit(0.0)).alias("average_precision"))


def best_f1(curve: DataFrame, points: int = 200, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Threshold with the best F1 among evenly spaced percentiles of the scores.

    ``score >= threshold`` counts as positive, the first best point wins, and
    without any positive F1 the threshold is 0.  Every candidate is read off the
    curve: it lies on one distinct score or between two.
    """
    total = F.col("positives") + F.col("negatives")
    below = total - F.col("tp") - F.col("fp")  # scores smaller than this one
    share = lambda j: (F.lit(low) + F.lit(high - low) * j / F.lit(points - 1)) / F.lit(100.0)
    rank = lambda j: share(j) * (total - 1)
    mine = lambda k: (k >= below) & (k < below + F.col("pos") + F.col("neg"))
    # only points whose rank falls here can be mine; one more on either side for rounding
    step = (points - 1) / (high - low)
    point = lambda r: (r / F.greatest(total - 1, F.lit(1)) * 100.0 - F.lit(low)) * F.lit(step)
    least = F.greatest(F.floor(point(below - 1)) - 1, F.lit(0)).cast("int")
    most = F.least(F.ceil(point(below + F.col("pos") + F.col("neg"))) + 1, F.lit(points - 1)).cast("int")
    js = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    at = F.filter(js, lambda j: mine(F.floor(rank(j))) | mine(F.floor(rank(j)) + 1))
    seen = curve.withColumn("j", F.explode(at)).withColumn("_k", F.floor(rank(F.col("j"))))
    seen = seen.withColumn("_frac", rank(F.col("j")) - F.col("_k"))
    own, nxt = mine(F.col("_k")), mine(F.col("_k") + 1)
    here = F.struct("score", "tp", "fp")
    points_ = seen.groupBy("j", "_frac", "positives").agg(
        F.max(F.when(own, here)).alias("a"), F.max(F.when(nxt, here)).alias("b"))
    exact = (F.col("_frac") == 0) | F.col("b").isNull() | (F.col("a.score") == F.col("b.score"))
    cut = F.when(exact, F.col("a.score")).otherwise(
        F.col("a.score") + (F.col("b.score") - F.col("a.score")) * F.col("_frac"))
    hit = F.when(exact, F.col("a")).otherwise(F.col("b"))
    f1 = rates(hit["tp"], hit["fp"], F.col("positives") - hit["tp"])["f1"]
    scored = points_.select("j", cut.alias("threshold"), f1.alias("f1")).where(F.col("f1") > 0)
    best = scored.agg(F.max(F.struct("f1", (-F.col("j")).alias("_order"), "threshold")).alias("best"))
    return best.select(
        F.coalesce("best.threshold", F.lit(0.0)).alias("threshold"), F.coalesce("best.f1", F.lit(0.0)).alias("f1"))


def frontier(df: DataFrame, label: str = "label", channels: Sequence[str] = CHANNELS,
             percentiles: Sequence[float] = FRONTIER_PERCENTILES) -> DataFrame:
    """Precision, recall and F1 of two channels and their OR at percentiles of the normal scores."""
    normal = df.where(F.col(label) == 0).select(*[F.col(c).cast("double").alias(c) for c in channels])
    cuts = exact_percentiles(
        normal.unpivot([], list(channels), "channel", "value"), ["channel"], "value", [p / 100.0 for p in percentiles])
    rows = df.withColumns({f"_cut_{c}": cuts.where(F.col("channel") == c).select("q").scalar() for c in channels})
    y = F.col(label) == 1
    aggs = []
    for i, _ in enumerate(percentiles):
        hits = {c: F.col(c) >= F.col(f"_cut_{c}")[i] for c in channels}
        hits["or_fusion"] = hits[channels[0]] | hits[channels[1]]
        for name, p in hits.items():
            aggs += [F.count_if(y & p).alias(f"{name}_{i}_tp"), F.count_if(~y & p).alias(f"{name}_{i}_fp"),
                     F.count_if(y & ~p).alias(f"{name}_{i}_fn")]
    names = [*channels, "or_fusion"]
    counts = rows.agg(*aggs, *[F.max(f"_cut_{c}").alias(f"_cut_{c}") for c in channels])
    entries = []
    for i, p in enumerate(percentiles):
        for n in names:
            cut = F.col(f"_cut_{n}")[i] if n in channels else F.lit(None).cast("double")
            entries.append(F.struct(
                F.lit(n).alias("channel"), F.lit(p).alias("percentile"), cut.alias("threshold"),
                *[F.col(f"{n}_{i}_{k}").alias(k) for k in ("tp", "fp", "fn")]))
    flat = counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return flat.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"))).drop("tp", "fp", "fn")


def score_percentiles(df: DataFrame, label: str, score: str) -> DataFrame:
    """p50, p90, p95 and p99 by label, rounded to four digits."""
    q = exact_percentiles(df, [label], score, [0.5, 0.9, 0.95, 0.99])
    names = ("p50", "p90", "p95", "p99")
    return q.select(label, *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(names)])


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation, 0 when a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))


def scenario_breakdown(df: DataFrame, channels: Sequence[str], severity: str = "severity", mode: str = "mode") -> DataFrame:
    """Per scenario: count, mean of each channel, correlation with the severity."""
    known = inline(df.sparkSession, [(s,) for s in SCENARIOS], f"{mode} string")
    stats = df.groupBy(mode).agg(
        F.count(F.lit(1)).alias("samples"), *[F.avg(c).alias(f"mean_{c}") for c in channels],
        *[_correlation(c, severity).alias(f"corr_{c}") for c in channels])
    joined = known.join(stats, mode, "left")
    return joined.select(mode, F.coalesce("samples", F.lit(0)).alias("samples"), *[
        F.coalesce(n, F.lit(0.0)).alias(n) for c in channels for n in (f"mean_{c}", f"corr_{c}")])


def tier_counts(df: DataFrame) -> DataFrame:
    """Decisions per alert tier, tiers without any included."""
    known = inline(df.sparkSession, [(t,) for t in TIERS], "tier string")
    tier = scoring.alert_tier(F.col("alert_recon"), F.col("alert_ann"))
    counts = df.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def vessel_split(df: DataFrame, vessel: str, share: int = 80, seed: int = 42) -> DataFrame:
    """Whole vessels go to one side; the side depends only on vessel and seed."""
    digest = F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(vessel).cast("string")).cast("binary"))
    side = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100)) < share
    return df.withColumn("split", F.when(side, "train").otherwise("validate"))


def scenario_delta(df: DataFrame, limits: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Display score of the perturbed run minus that of the normal run of the same key."""
    rows = df.withColumns({"_tr": threshold_of(limits, "recon"), "_ta": threshold_of(limits, "ann")})
    args = (F.col("recon"), F.col("ann"), F.col("_tr"), F.col("_ta"))
    _, shown = scoring.presentation(*args)
    value = F.when(F.col(label) == 1, shown).otherwise(scoring.baseline_display(*args))
    sides = rows.withColumn("_v", value).groupBy(key).agg(
        F.max(F.when(F.col(label) == 1, F.col("_v"))).alias("active"),
        F.max(F.when(F.col(label) == 0, F.col("_v"))).alias("baseline"))
    return sides.where(F.col("active").isNotNull() & F.col("baseline").isNotNull()).select(
        key, (F.col("active") - F.col("baseline")).alias("delta"))


def first_entities(df: DataFrame, entity: str, limit: int = 150) -> DataFrame:
    """The sampling cap of the baseline suite: rows of the first ``limit`` entities in order."""
    chosen = df.select(entity).distinct().orderBy(entity).limit(limit)
    return df.join(chosen, entity, "left_semi")


def track_rollup(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk scores to one verdict per track."""
    mean = chunks.groupBy(*keys).agg(
        F.avg("fused").alias("fused_risk_score"), F.avg("recon").alias("reconstruction_score"),
        F.avg("ann").alias("_d"), F.stddev_pop("fused").alias("_sd"))
    return mean.select(
        *keys, "fused_risk_score", "reconstruction_score",
        scoring.clip(F.exp(-3.0 * F.col("_sd")), 0.0, 1.0).alias("confidence"),
        scoring.clip(F.col("_d"), 0.0, 1.0).alias("ood_score"),
        scoring.risk_class(F.col("fused_risk_score")).alias("classification"))
