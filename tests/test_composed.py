"""Wide percentiles, window stores and the evaluation against plain Python."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tests.helpers import plan_text
from wakeline.operators import neighbours, scorers
from wakeline.operators.quantiles import wide_percentiles
from wakeline.operators.slices import BY_TIME
from wakeline.plans import evaluation, window_store
from wakeline.plans.catalog import evaluation as queries
from wakeline.registry import FEATURES
from wakeline.session import shared_folder

PROBS = [0.25, 0.5, 0.75]


def test_wide_percentiles_of_large_small_and_hollow_groups(spark):
    rng = random.Random(5)
    rows = []
    for i in range(14_000):
        g = 0 if i % 3 else (1 if i % 2 else 2)  # two thirds in one group
        tied = float(rng.randrange(4))
        rows.append((g, rng.gauss(0, 1) ** 3, tied, None if i % 5 else float("nan") if i % 7 == 0 else rng.random(), None))
    rows += [(3, 1.5, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double")
    got = {(r.g, r.feature): (r.n, list(r.q)) for r in wide_percentiles(df, "g", ["a", "b", "c", "d", "a"], PROBS).collect()}
    want = {}
    for g in range(4):
        for j, f in enumerate("abcd", start=1):
            v = [r[j] for r in rows if r[0] == g and r[j] is not None and not math.isnan(r[j])]
            if v:
                want[g, f] = (len(v), list(np.percentile(v, [25, 50, 75])))
    assert got.keys() == want.keys()
    for k, (n, q) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], q, rtol=0, atol=1e-12), k
    assert wide_percentiles(df.limit(0), "g", ["a"], PROBS).count() == 0


def _rows_of_generates(df):
    """Output rows of every explode after a run."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name == "GenerateExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def test_wide_percentiles_make_rows_of_few_values(spark):
    """Of a large group only what lies inside a bracket becomes a row."""
    df = spark.range(60_000).select(F.lit(1).alias("g"), F.hash("id").cast("double").alias("a"), F.xxhash64("id").cast("double").alias("b"))
    out = wide_percentiles(df, "g", ["a", "b"], PROBS)
    assert "unpivot" not in plan_text(out).lower()
    made = _rows_of_generates(out)
    assert 0 < max(made) < 0.02 * 120_000


def test_wide_percentiles_of_flags_and_rows_of_several_groups(spark):
    """Values that many rows share are counted where they are read; a row counts in each of its groups."""
    n = 20_000
    df = spark.range(n, numPartitions=3).select(
        F.when(F.col("id") % 4 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(7), F.lit(0))).alias("g"),
        (F.col("id") % 10 == 0).cast("int").alias("flag"), F.lit(-0.0).alias("still"),
        (F.col("id") % 3).cast("double").alias("steps"))
    out = wide_percentiles(df, "g", ["flag", "still", "steps"], PROBS)
    assert max(_rows_of_generates(out), default=0) < 100
    got = {(r.g, r.feature): (r.n, list(r.q)) for r in out.collect()}
    for g in (0, 7):
        ids = [i for i in range(n) if g == 0 or i % 4]
        for f, of in (("flag", lambda i: i % 10 == 0), ("still", lambda i: 0.0), ("steps", lambda i: i % 3)):
            v = sorted(float(of(i)) for i in ids)
            ends = [(v[math.floor(p * (len(v) - 1))], v[math.ceil(p * (len(v) - 1))]) for p in PROBS]
            assert got[g, f][0] == len(v) and all(a <= q <= b for q, (a, b) in zip(got[g, f][1], ends, strict=True)), (g, f)


def _features(spark, rows):
    """Positions (vessel, trip, time, number, cohort, speed, reliability); other features are 0 but the two of the course."""
    base = spark.createDataFrame(rows, "vessel_id_int bigint, trip_id string, timestamp_sec bigint, global_lsn bigint, vessel_superclass_id int, speed_raw double, reliability_score double")
    rest = [f for f in FEATURES if f not in base.columns]
    return base.withColumns({f: F.lit(0.6 if f == "course_sin" else 0.8 if f == "course_cos" else 0.0) for f in rest})


def _ledgers(spark):
    own = spark.createDataFrame([(0, "speed_raw", 10.0, 2.0), (3, "speed_raw", 4.0, 1.0)], "cohort int, feature string, center double, scale double")
    return own, own.where("false").select("feature", "center", "scale")


def test_training_windows_scale_hold_and_gate(spark):
    rows = [(1, "1_0", 1000 + 45 * i, i, 3, 4.0 + i, 1.0) for i in range(60)]
    rows += [(1, "1_0", 1000, 900, 3, 99.0, 1.0)]  # the same time again: the lower number counts
    rows += [(2, "2_0", 45 * i, 100 + i, 5, 10.0, 0.1) for i in range(60)]  # not reliable
    rows += [(3, "3_0", 600 * i, 200 + i, 3, 4.0, 1.0) for i in range(4)]  # too few observations
    out = window_store.training_windows(_features(spark, rows), *_ledgers(spark)).orderBy("start").collect()
    steps = (59 * 45 + 29) // 30
    assert [r.sequence_id for r in out] == [f"1_1_0_{s}" for s in range(0, steps - 59, 30)]
    first = np.asarray(out[0].features)
    assert first.shape == (60, len(FEATURES)) and out[0].superclass_id == 3 and out[0].timestamp_sec == 1000
    at = [30 * k // 45 for k in range(60)]
    assert np.allclose(first[:, FEATURES.index("speed_raw")], at)
    assert np.allclose(first[:, FEATURES.index("log_time_diff")], [math.log1p(30 * k - 45 * (30 * k // 45)) for k in range(60)])
    assert np.allclose(first[:, FEATURES.index("course_sin")], 0.6, atol=1e-6)


def test_scoring_windows_interpolate_and_leave_short_chunks(spark):
    rows = [(1, "1_0", 45 * i, i, 3, 4.0 + i, 1.0) for i in range(50)]
    out = window_store.scoring_windows(_features(spark, rows), *_ledgers(spark), BY_TIME, 40, 20).orderBy("start", "chunk").collect()
    assert [(r.start, r.chunk, len(r.features)) for r in out] == [(0, 0, 59), (10, 0, 59)]
    speed = np.asarray(out[1].features)[:, FEATURES.index("speed_raw")]
    assert np.allclose(speed, [10 + 30 * k / 45 for k in range(59)])
    assert np.allclose(np.asarray(out[0].features)[:, FEATURES.index("log_time_diff")], math.log(31))


def test_evaluation_finds_planted_anomalies(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for part, vessels in (("history", range(8)), ("calibrate", range(8, 20)), ("test", range(20, 32))):
        for v in vessels:
            for _ in range(6):
                x = np.concatenate([rng.normal(1.0, 0.05, 2), rng.normal(0.0, 0.05, 2)])
                rows.append((n, part, 0, v, 1, "loitering", 0.5, x.tolist()))
                if part == "test":
                    rows.append((n + 1, part, 1, v, 1, "loitering", 0.5, (x + np.asarray([-2.0, 0.0, 3.0, -3.0])).tolist()))
                n += 2
    df = spark.createDataFrame(rows, "window_id bigint, part string, label int, vessel_id_int bigint, cohort int, mode string, severity double, vector array<double>")
    axes = np.zeros((4, 2))
    axes[0, 0] = axes[1, 1] = 1.0
    result = evaluation.evaluate(df, scorers.linear_scorer(np.zeros(4), np.ones(4), axes))
    got = {(r.section, r.item, r.metric): r.value for r in evaluation.report(result).collect()}
    for channel in (*evaluation.CHANNELS, "combined_ratio"):
        assert got["auroc", channel, "auroc"] == 1.0
    assert got["rates", "gate_and", "tp"] == 12 and got["rates", "gate_and", "fn"] == 0
    assert got["tiers", "critical", "n"] >= 12 and sum(got["tiers", t, "n"] for t in ("critical", "reconstruction", "manifold", "normal")) == 24
    assert got["scenarios", "loitering", "samples"] == 72 and got["scenarios", "coastal_creep", "samples"] == 0
    assert got["windows", "calibrate", "windows"] == 72 and got["windows", "test", "windows"] == 72
    raw = [r for r in result.windows.where("part = 'calibrate'").collect()]
    per = {}
    for r in raw:
        per.setdefault(r.vessel_id_int, []).append(r.recon)
    means = [np.mean(v) for v in per.values()]
    assert np.isclose(got["limits", "recon", "mu"], np.mean(means))
    assert np.isclose(got["limits", "recon", "threshold"], np.percentile(means, 99.5))


def test_windows_shuffle_observations_instead_of_steps(spark):
    """Sparse observations: rows follow observations and blocks of windows, not the 20 steps between two observations."""
    rows = [(1, "1_0", 600 * i, i, 3, 4.0 + i, 1.0) for i in range(60)]
    features = _features(spark, rows).withColumn("humidity", F.when(F.col("global_lsn") % 7 > 0, F.col("speed_raw")))
    steps = 59 * 20
    for out in (window_store.training_windows(features, *_ledgers(spark)),
                window_store.scoring_windows(features, *_ledgers(spark), BY_TIME, 40, 20)):
        assert 0 < sum(_rows_of_generates(out)) < steps / 4
    at = ("start", "chunk")
    matrix = window_store.scoring_windows(features, *_ledgers(spark), BY_TIME, 40, 20).withColumn("features", window_store.step_means(F.col("features")))
    means = window_store.scoring_windows(features, *_ledgers(spark), BY_TIME, 40, 20, means=True)
    a, b = matrix.orderBy(*at).collect(), means.orderBy(*at).collect()
    assert len(a) == len(b) == 2 * 14 and [r.steps for r in a] == [r.steps for r in b] == ([60] * 13 + [1]) * 2
    assert np.allclose([r.features for r in a], [r.features for r in b], rtol=0, atol=1e-9)


def _tables(spark):
    """Stored tables on disk, by purpose."""
    folder = Path(shared_folder(spark, "any").removeprefix("file:")).parent
    return Counter(p.name.rsplit("-", 1)[0] for p in folder.glob("*")) if folder.exists() else Counter()


def test_scored_windows_leave_one_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ("history", "calibrate", "test")[i % 3], 0, i % 7, 1, "loitering", 0.5, rng.normal(0, 1, 4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "window_id bigint, part string, label int, vessel_id_int bigint, cohort int, mode string, severity double, vector array<double>")
    before = _tables(spark)
    out = evaluation.scored_windows(df, scorers.linear_scorer(np.zeros(4), np.ones(4), np.eye(4)[:, :2]))
    assert _tables(spark) - before == {"scored-windows": 1}
    assert out.count() == 40


def test_neighbours_in_turns_never_store_all_hits(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, i // 2 % 2, i % 5, rng.normal(0, 1, 2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, cohort int, vessel bigint, vector array<double>")
    asked, corpus = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    stored, sizes, kept = neighbours.stored, [], []

    def watched(frame, purpose, by=()):
        out = stored(frame, purpose, by)
        if purpose == "neighbours-best":
            sizes.append(out.count())
            kept.append(_tables(spark)["neighbours-best"] - before)
        return out

    monkeypatch.setattr(neighbours, "stored", watched)
    before = _tables(spark)["neighbours-best"]
    finish = lambda hits: hits.groupBy("query_id").agg(F.collect_list(F.struct("rank", "neighbour_id", "distance")).alias("h"))
    got = {r.query_id: sorted(r.h) for r in neighbours.nearest_in_turns(asked, corpus, 4, finish, "euclidean", cell_rows=20, at_once=60).collect()}
    assert len(sizes) >= 4 and max(sizes) < 0.6 * 200 * 4  # four turns of some fifty queries
    assert max(kept) <= 2 and _tables(spark)["neighbours-best"] == before
    want = {r.query_id: sorted(r.h) for r in finish(neighbours.nearest(asked, corpus, 4, "euclidean", cell_rows=20)).collect()}
    assert got == want and len(got) == 200


def test_labelled_windows_in_turns_are_the_same(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted((r.window_id, r.part, r.mode, r.cohort, tuple(round(x, 9) for x in r.vector)) for r in df.collect())
    want = rows(queries._labelled(queries._store(spark, sf)))
    before = _tables(spark)
    out = queries._labelled_in_turns(spark, sf, at_once=400)
    left = _tables(spark) - before
    assert left["labelled"] == 1 and not {"features", "observations"} & set(left)
    assert rows(out) == want and len(want) > 20
