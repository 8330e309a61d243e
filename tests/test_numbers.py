"""Percentiles, ledgers, metrics and neighbours against numpy."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, values
from wakeline.operators import ledger, metrics, neighbours
from wakeline.operators.quantiles import exact_percentiles
from wakeline.registry import FRONTIER_PERCENTILES


@pytest.mark.parametrize("accuracy", [10, 100, 20_000])
@pytest.mark.parametrize("few", [True, False])
def test_exact_percentiles(spark, accuracy, few):
    rng = np.random.default_rng(accuracy)
    data = {"hot": np.exp(rng.normal(0, 4, 9_000)), "ties": rng.integers(0, 5, 700).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 0.995, 1.0]
    out = exact_percentiles(frame(spark, rows, "g string, v double"), ["g"], "v", probs, accuracy, few)
    got = {r["g"]: (r["n"], r["q"]) for r in out.collect()}
    for g, vs in data.items():
        assert got[g][0] == len(vs)
        assert got[g][1] == pytest.approx(np.percentile(vs, [p * 100 for p in probs]))


def test_cohort_ledger_fallbacks(spark):
    rng = random.Random(1)
    rows = [(3, rng.random(), None) for _ in range(60)] + [(5, rng.random() * 9, 1.0) for _ in range(10)] + [(0, rng.random(), 2.0) for _ in range(5)]
    df = frame(spark, rows, "vessel_superclass_id int, a double, b double")
    got = {(r["cohort"], r["feature"]): (r["center"], r["scale"]) for r in ledger.cohort_scales(df, ["a", "b"]).collect()}
    assert len(got) == 14 * 2
    everyone = np.percentile([r[1] for r in rows], [25, 50, 75])
    assert got[(0, "a")] == pytest.approx((everyone[1], everyone[2] - everyone[0]))
    assert got[(5, "a")] == got[(0, "a")]  # ten rows only
    own = np.percentile([r[1] for r in rows[:60]], [25, 50, 75])
    assert got[(3, "a")] == pytest.approx((own[1], own[2] - own[0]))
    assert got[(3, "b")] == got[(0, "b")] == (1.0, 1.0)  # no values in the cohort; IQR 1 -> kept


def test_scaling_fallbacks(spark):
    led = frame(spark, [(0, "a", 1.0, 2.0), (4, "b", 1.0, 2.0)], "cohort int, feature string, center double, scale double")
    rows = frame(spark, [(4, 5.0, 5.0), (9, 5.0, 5.0)], "vessel_superclass_id int, a double, b double")
    # cohort 4 exists but lacks a: unscaled; cohort 9 falls back to 0, which lacks b
    assert values(ledger.scaled(rows, led, ["a", "b"]), "vessel_superclass_id") == [(4, 5.0, 2.0), (9, 2.0, 5.0)]


def _scores(spark, labels, scores):
    return frame(spark, [(int(y), float(s)) for y, s in zip(labels, scores)], "label int, s double")


def test_auroc_and_average_precision_fixture(spark):
    curve = metrics.score_curve(_scores(spark, [0, 0, 1, 1, 1, 0], [.1, .4, .4, .8, .9, .2]), "label", "s")
    assert metrics.auroc(curve).collect()[0][0] == pytest.approx(0.944444, abs=1e-6)
    assert metrics.average_precision(curve).collect()[0][0] == pytest.approx(0.916667, abs=1e-6)


def _brute_auroc(y, s):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()) / (len(p) * len(n))


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_curve_properties(spark, slices):
    rng = np.random.default_rng(4)
    s = np.round(rng.normal(0, 1, 400), 1)
    y = (rng.random(400) < 0.3).astype(int)
    curve = metrics.score_curve(_scores(spark, y, s), "label", "s", slices)
    up = metrics.auroc(curve).collect()[0][0]
    assert up == pytest.approx(_brute_auroc(y, s))
    down = metrics.auroc(metrics.score_curve(_scores(spark, y, -s), "label", "s", slices)).collect()[0][0]
    assert up + down == pytest.approx(1.0)
    best = (0.0, 0.0)
    for th in np.percentile(s, np.linspace(1, 99, 200)):
        tp, fp, fn = ((s >= th) & (y == 1)).sum(), ((s >= th) & (y == 0)).sum(), ((s < th) & (y == 1)).sum()
        f1 = 2 * tp / (2 * tp + fp + fn)
        best = (th, f1) if f1 > best[1] else best
    assert tuple(metrics.best_f1(curve).collect()[0]) == pytest.approx(best)


def test_single_class_is_half(spark):
    assert metrics.auroc(metrics.score_curve(_scores(spark, [1, 1], [.1, .2]), "label", "s")).collect()[0][0] == 0.5


def test_best_f1_without_positives(spark):
    assert tuple(metrics.best_f1(metrics.score_curve(_scores(spark, [0, 0, 0], [.1, .2, .3]), "label", "s")).collect()[0]) == (0.0, 0.0)


def test_score_aggregation(spark):
    df = frame(spark, [(1, s) for s in (.1, .2, .3, 1.0)], "v long, s double")
    assert metrics.aggregated(df, ["v"], "s", mean_weight=0.4).collect()[0]["score"] == pytest.approx(0.697)
    assert metrics.aggregated(df, ["v"], "s", mean_weight=1.0).collect()[0]["score"] == pytest.approx(0.4)


def test_rates_are_zero_when_undefined(spark):
    row = metrics.confusion(_scores(spark, [0, 0], [.1, .2]), "label", F.col("s") > 1).collect()[0]
    assert (row["precision"], row["recall"], row["f1"], row["tn"]) == (0.0, 0.0, 0.0, 2)


def test_correlation_of_a_constant_is_zero(spark):
    df = frame(spark, [("loitering", 1.0, 2.0), ("loitering", 1.0, 3.0)], "mode string, r double, severity double")
    got = {r["mode"]: r for r in metrics.scenario_breakdown(df, ["r"]).collect()}
    assert got["loitering"]["corr_r"] == 0.0 and got["coastal_creep"]["samples"] == 0


def test_frontier_has_every_percentile(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, [(int(i % 3 == 0), float(a), float(b)) for i, (a, b) in enumerate(rng.random((300, 2)))], "label int, recon double, ann double")
    rows = metrics.frontier(df).collect()
    assert len(rows) == 3 * len(FRONTIER_PERCENTILES)
    pool = [r["recon"] for r in df.where("label = 0").collect()]
    cut = next(r for r in rows if r["channel"] == "recon" and r["percentile"] == 97.5)
    assert cut["threshold"] == pytest.approx(np.percentile(pool, 97.5))


def _points(spark, n, d, seed, cohorts=2, copies=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (6, d))
    m = centres[rng.integers(0, 6, n)] + rng.normal(0, .3, (n, d))
    if copies:
        m[: n // 3] = m[0]
    c, v = rng.integers(0, cohorts, n), rng.integers(0, 9, n)
    df = frame(spark, [(i, int(c[i]), int(v[i]), [float(x) for x in m[i]]) for i in range(n)], "id long, cohort int, vessel long, vector array<double>")
    return df, m, c, v


@pytest.mark.parametrize("metric,copies,fan", [("cosine", False, 256), ("euclidean", False, 4), ("cosine", True, 4)])
def test_neighbours_equal_brute_force(spark, monkeypatch, metric, copies, fan):
    """Trees of one and of two levels, cells and groups cut small."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neighbours, "FAN", fan)
    monkeypatch.setattr(neighbours, "FIRST_ROUND", 1)
    df, m, c, v = _points(spark, 120, 8, 11, copies=copies)
    got = {}
    for r in neighbours.nearest(df, df, 4, metric, other_vessel=True, cell_rows=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["neighbour_id"], r["distance"])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(len(m)):
        d = 1 - unit @ unit[i] if metric == "cosine" else np.linalg.norm(m - m[i], axis=1)
        ok = np.flatnonzero((c == c[i]) & (v != v[i]))
        want = sorted((round(d[j], 7), j) for j in ok)[:4]
        have = [got[i][k] for k in sorted(got.get(i, {}))]
        assert [round(x[1], 6) for x in have] == pytest.approx([w[0] for w in want], abs=2e-6)
        if not copies:
            assert [x[0] for x in have] == [w[1] for w in want]


def test_visited_share_of_pairs_falls_as_rows_grow(spark, monkeypatch):
    """Points of two dimensions: a query meets a bounded number of leaves, so the share of all pairs shrinks."""
    visit, met = neighbours._visit, []

    def counting(visits, corpus, search, out=neighbours.HIT):
        if out == neighbours.HIT and "vessel" in corpus.columns:
            size = lambda df, n: df.groupBy("cohort", "cell").agg(F.count(F.lit(1)).alias(n))
            pairs = size(visits, "q").join(size(corpus, "c"), ["cohort", "cell"]).agg(F.sum(F.col("q") * F.col("c"))).first()[0]
            met.append(pairs or 0)
        return visit(visits, corpus, search, out)

    monkeypatch.setattr(neighbours, "_visit", counting)
    shares = []
    for n in (256, 1_024, 4_096):
        met.clear()
        m = np.random.default_rng(n).uniform(0, 1, (n, 2))
        df = frame(spark, [(i, 0, i, [float(x) for x in m[i]]) for i in range(n)], "id long, cohort int, vessel long, vector array<double>")
        got = neighbours.nearest(df.where("id % 8 = 0"), df, 3, "euclidean", other_id=True, cell_rows=40)
        assert got.groupBy("query_id").count().where("count = 3").count() == n // 8
        shares.append(sum(met) / (n * n / 8))
    assert shares[0] > 2 * shares[1] and shares[1] > 2 * shares[2]


def test_neighbours_without_a_cohort_or_rows(spark):
    schema = "id long, cohort int, vessel long, vector array<double>"
    some = frame(spark, [(i, 0, i, [1.0, float(i)]) for i in range(30)], schema)
    other = frame(spark, [(99, 7, 1, [1.0, 1.0])], schema)
    for cell_rows in (5, 100):
        assert neighbours.nearest(other, some, 2, cell_rows=cell_rows).count() == 0
        assert neighbours.nearest(some, some.limit(0), 2, cell_rows=cell_rows).count() == 0
        assert neighbours.nearest(some, some, 40, cell_rows=cell_rows).count() == 900


def test_neighbours_tie_goes_to_lower_id(spark):
    df = frame(spark, [(i, 0, i, [1.0, 0.0]) for i in range(6)], "id long, cohort int, vessel long, vector array<double>")
    got = values(neighbours.nearest(df, df, 2, other_id=True).select("query_id", "rank", "neighbour_id"), "query_id", "rank")
    assert got[:4] == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2)]


def test_pairwise_summary_and_effective_rank(spark):
    tiny = frame(spark, [([1.0, 0.0],), ([0.0, 1.0],), ([1.0, 0.0],)], "embedding array<double>")
    assert neighbours.pairwise_summary(tiny).collect()[0]["mean_cosine"] == pytest.approx(1 / 3)
    m = np.random.default_rng(0).normal(size=(60, 5))
    df = frame(spark, [([float(x) for x in r],) for r in m], "embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sv = np.linalg.svd(u - u.mean(0), compute_uv=False)
    share = sv / (sv.sum() + 1e-8)
    expected = np.exp(-(share * np.log(share + 1e-10)).sum())
    assert neighbours.effective_rank(df).collect()[0]["effective_rank"] == pytest.approx(expected, rel=1e-6)


def _hits_of_one_block(n, k, limit=None):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"id": np.arange(n), "vessel": 0, "vector": list(rng.normal(size=(n, 8)))})
    asked = rows if limit is None else rows.assign(limit=limit)
    return neighbours._block_search(k, False, False, True)(asked, rows)


def test_a_block_search_holds_few_distances_at_once():
    tracemalloc.start()
    hits = _hits_of_one_block(2_500, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hits) == 2_500 * 5
    assert peak < 60e6  # all distances of the block are 50 MB, and several matrices of that size were held


def test_a_block_search_returns_nothing_beyond_the_distance_reached():
    every = _hits_of_one_block(300, 5)
    limit = float(every["distance"].median())
    within = _hits_of_one_block(300, 5, limit)
    assert 0 < len(within) < len(every)
    assert within.reset_index(drop=True).equals(every[every["distance"] <= limit].reset_index(drop=True))
