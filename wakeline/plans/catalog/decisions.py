"""Calibration, gates and detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import scoring
from wakeline.operators import metrics
from wakeline.plans import views
from wakeline.plans.catalog.base import query, r6
from wakeline.registry import FRONTIER_PERCENTILES, SCENARIOS

SCORED = """scored AS (SELECT l.doc_id AS vessel_id_int, l.toxic AS label,
  ((d.n_chars*31 + l.doc_id*17) % 997)::DOUBLE/1000.0 + l.toxic*0.2::DOUBLE AS recon,
  ((d.n_chars*13 + l.doc_id*7) % 499)::DOUBLE/500.0 + l.toxic*0.1::DOUBLE AS ann,
  (l.doc_id % 9)::DOUBLE/10.0 + 0.1::DOUBLE AS severity, d.lang FROM labels l JOIN documents d USING (doc_id))"""
WINDOWS = """win AS (SELECT o_custkey AS vessel_id_int, o_orderkey AS window_no, (o_orderstatus = 'F')::INT AS label,
  ((o_orderkey*31) % 997)::DOUBLE/1000.0 AS recon, ((o_orderkey*17) % 499)::DOUBLE/500.0 AS ann FROM orders)"""
LIMITS = """pv AS (SELECT vessel_id_int, avg(recon) AS recon, avg(ann) AS ann FROM win GROUP BY 1),
  limits AS (SELECT quantile_cont(recon, 0.995) AS tr, quantile_cont(ann, 0.995) AS ta FROM pv)"""
RATES = """coalesce(tp::DOUBLE/nullif(tp+fp, 0), 0) AS precision, coalesce(tp::DOUBLE/nullif(tp+fn, 0), 0) AS recall,
  coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn, 0), 0) AS f1"""
R3 = "r6(coalesce(tp::DOUBLE/nullif(tp+fp, 0), 0)) AS precision, r6(coalesce(tp::DOUBLE/nullif(tp+fn, 0), 0)) AS recall, r6(coalesce(2*tp::DOUBLE/nullif(2*tp+fp+fn, 0), 0)) AS f1"
LIT = {"recon": 0.9, "ann": 0.85}


def _windows(spark, sf):
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("vessel_id_int"), k.alias("window_no"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.pmod(k * 31, F.lit(997)) / 1000.0).alias("recon"), (F.pmod(k * 17, F.lit(499)) / 500.0).alias("ann"))


def _limits(spark, sf):
    w = _windows(spark, sf)
    per = w.groupBy("vessel_id_int").agg(F.avg("recon").alias("recon"), F.avg("ann").alias("ann"))
    return metrics.thresholds(per, ["recon", "ann"])


def _round(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query("a11_score_aggregation", f"""WITH {WINDOWS} SELECT vessel_id_int, r6(0.4::DOUBLE*avg(recon) + 0.6::DOUBLE*quantile_cont(recon, 0.95)) AS score
FROM win GROUP BY 1""")
def a11(spark, sf):
    return _round(metrics.aggregated(_windows(spark, sf), ["vessel_id_int"], "recon", mean_weight=0.4), "score")


@query("a12_distance_anchors", f"""WITH {WINDOWS}, a AS (SELECT quantile_cont(ann, 0.5) AS p50, quantile_cont(ann, 0.99) AS p99 FROM win)
SELECT window_no, r6(greatest(0.0, (ann - p50)/(p99 - p50 + 1e-8))) AS ann FROM win, a""")
def a12(spark, sf):
    w = _windows(spark, sf)
    return _round(metrics.rescaled(w, metrics.distance_anchors(w)).select("window_no", "ann"), "ann")


@query("a13_threshold_calibration", f"""WITH {WINDOWS}, {LIMITS} SELECT 'recon' AS channel, r6(avg(recon)) AS mu, r6(stddev_pop(recon)) AS sigma,
  r6(quantile_cont(recon, 0.995)) AS threshold FROM pv UNION ALL SELECT 'ann', r6(avg(ann)), r6(stddev_pop(ann)), r6(quantile_cont(ann, 0.995)) FROM pv""")
def a13(spark, sf):
    return _round(_limits(spark, sf), "mu", "sigma", "threshold")


@query("a14_confusion_rates", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (label=1 AND recon>=0.9) AS tp, count(*) FILTER (label=0 AND recon>=0.9) AS fp,
  count(*) FILTER (label=0 AND recon<0.9) AS tn, count(*) FILTER (label=1 AND recon<0.9) AS fn FROM scored) SELECT tp, fp, tn, fn, {R3} FROM c""")
def a14(spark, sf):
    return _round(metrics.confusion(views.scored(spark, sf), "label", F.col("recon") >= LIT["recon"]), "precision", "recall", "f1")


AUC = """(SELECT coalesce((sum(CASE WHEN label = 1 THEN r END) - p*(p+1)/2)/(p*n), 0.5) FROM (SELECT label, rank() OVER (ORDER BY {s})
  + (count(*) OVER (PARTITION BY {s}) - 1)/2.0 AS r, sum(label) OVER ()::DOUBLE AS p, sum(1-label) OVER ()::DOUBLE AS n FROM scored) GROUP BY p, n)"""


@query("a15_auroc", f"WITH {SCORED} SELECT r6({AUC.replace('{s}', 'recon')}) AS auroc_recon, r6({AUC.replace('{s}', 'ann')}) AS auroc_ann")
def a15(spark, sf):
    df = views.scored(spark, sf)
    one = {c: metrics.auroc(metrics.score_curve(df, "label", c)).select(r6(F.col("auroc")).alias(f"auroc_{c}")) for c in ("recon", "ann")}
    return one["recon"].withColumn("auroc_ann", one["ann"].scalar())


@query("a16_average_precision", f"""WITH {SCORED}, d AS (SELECT recon, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1),
c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER () AS total FROM d WINDOW w AS (ORDER BY recon DESC ROWS UNBOUNDED PRECEDING))
SELECT r6(sum(pos::DOUBLE/total*tp/seen)) AS average_precision FROM c""")
def a16(spark, sf):
    return _round(metrics.average_precision(metrics.score_curve(views.scored(spark, sf), "label", "recon")), "average_precision")


@query("a17_score_percentiles", f"""WITH {SCORED} SELECT label, floor(quantile_cont(recon, 0.5)*1e4+0.5)/1e4 AS p50, floor(quantile_cont(recon, 0.9)*1e4+0.5)/1e4 AS p90,
  floor(quantile_cont(recon, 0.95)*1e4+0.5)/1e4 AS p95, floor(quantile_cont(recon, 0.99)*1e4+0.5)/1e4 AS p99 FROM scored GROUP BY 1""")
def a17(spark, sf):
    return metrics.score_percentiles(views.scored(spark, sf), "label", "recon")


MODE = "['dead_reckoning','coastal_creep','loitering'][1 + vessel_id_int % 3]"


@query("a18_scenario_breakdown", f"""WITH {SCORED} SELECT {MODE} AS mode, count(*) AS samples, r6(avg(recon)) AS mean_recon, r6(coalesce(corr(recon, severity), 0)) AS corr_recon,
  r6(avg(ann)) AS mean_ann, r6(coalesce(corr(ann, severity), 0)) AS corr_ann FROM scored GROUP BY 1""")
def a18(spark, sf):
    names = F.array(*[F.lit(s) for s in SCENARIOS])
    mode = F.element_at(names, (F.pmod("vessel_id_int", F.lit(3)) + 1).cast("int"))
    out = metrics.scenario_breakdown(views.scored(spark, sf).withColumn("mode", mode), ["recon", "ann"])
    return _round(out, "mean_recon", "corr_recon", "mean_ann", "corr_ann")


DECIDED = f"""WITH {WINDOWS}, {LIMITS}, d AS (SELECT win.*, (recon >= tr)::INT AS alert_recon, (ann >= ta)::INT AS alert_ann,
  (recon >= tr OR ann >= ta)::INT AS gate_or, (recon >= tr AND ann >= ta)::INT AS gate_and,
  (recon >= tr OR ann >= ta OR (recon >= 0.95::DOUBLE*tr AND ann >= 0.95::DOUBLE*ta))::INT AS gate_joint,
  greatest(recon/(tr + 1e-8), ann/(ta + 1e-8)) AS combined_ratio FROM win, limits)"""


@query("f13_gates", DECIDED + """ SELECT window_no, alert_recon, alert_ann, gate_or, gate_and, gate_joint, r6(combined_ratio) AS combined_ratio FROM d""")
def f13(spark, sf):
    out = metrics.decided(_windows(spark, sf), _limits(spark, sf))
    return _round(out.drop("vessel_id_int", "label", "recon", "ann"), "combined_ratio")


@query("a14_gate_rates", DECIDED + f""", c AS (SELECT count(*) FILTER (label=1 AND gate_or=1) AS tp, count(*) FILTER (label=0 AND gate_or=1) AS fp,
  count(*) FILTER (label=0 AND gate_or=0) AS tn, count(*) FILTER (label=1 AND gate_or=0) AS fn FROM d) SELECT tp, fp, tn, fn, {R3} FROM c""")
def a14_gates(spark, sf):
    out = metrics.decided(_windows(spark, sf), _limits(spark, sf))
    return _round(metrics.confusion(out, "label", F.col("gate_or") == 1), "precision", "recall", "f1")


@query("a19_alert_tiers", DECIDED + """ SELECT tier, coalesce(n, 0) AS n FROM (VALUES ('critical'), ('reconstruction'), ('manifold'), ('normal')) t(tier)
LEFT JOIN (SELECT CASE WHEN alert_recon=1 AND alert_ann=1 THEN 'critical' WHEN alert_recon=1 THEN 'reconstruction' WHEN alert_ann=1 THEN 'manifold' ELSE 'normal' END AS tier,
  count(*) AS n FROM d GROUP BY 1) USING (tier)""")
def a19(spark, sf):
    return metrics.tier_counts(metrics.decided(_windows(spark, sf), _limits(spark, sf)))


_P = ", ".join(f"({p})" for p in FRONTIER_PERCENTILES)
_CUTS = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS percentile, quantile_cont(recon, {p / 100:.6g}) AS tr, quantile_cont(ann, {p / 100:.6g}) AS ta FROM scored WHERE label = 0" for p in FRONTIER_PERCENTILES)


@query("a20_threshold_frontier", f"""WITH {SCORED}, cuts AS ({_CUTS}), hit AS (
  SELECT 'recon' AS channel, percentile, tr AS threshold, label, recon >= tr AS p FROM scored, cuts UNION ALL SELECT 'ann', percentile, ta, label, ann >= ta FROM scored, cuts
  UNION ALL SELECT 'or_fusion', percentile, NULL, label, recon >= tr OR ann >= ta FROM scored, cuts),
c AS (SELECT channel, percentile, max(threshold) AS threshold, count(*) FILTER (label=1 AND p) AS tp, count(*) FILTER (label=0 AND p) AS fp, count(*) FILTER (label=1 AND NOT p) AS fn FROM hit GROUP BY 1, 2)
SELECT channel, percentile, r6(threshold) AS threshold, {R3} FROM c""")
def a20(spark, sf):
    return _round(metrics.frontier(views.scored(spark, sf)), "threshold", "precision", "recall", "f1")


@query("a21_best_f1_threshold", f"""WITH {SCORED}, n AS (SELECT list_sort(list(recon)) AS xs, count(*) AS m FROM scored),
ranks AS (SELECT j, (1.0::DOUBLE + 98.0::DOUBLE*j/199.0::DOUBLE)/100.0::DOUBLE*(m-1) AS pos, xs, m FROM n, range(0, 200) r(j)),
th AS (SELECT j, CASE WHEN pos = floor(pos) THEN xs[floor(pos)::INT+1] ELSE xs[floor(pos)::INT+1] + (xs[floor(pos)::INT+2]-xs[floor(pos)::INT+1])*(pos-floor(pos)) END AS threshold FROM ranks),
c AS (SELECT j, threshold, count(*) FILTER (label=1 AND recon>=threshold) AS tp, count(*) FILTER (label=0 AND recon>=threshold) AS fp, count(*) FILTER (label=1 AND recon<threshold) AS fn FROM scored, th GROUP BY 1, 2)
SELECT r6(threshold) AS threshold, r6(f1) AS f1 FROM (SELECT j, threshold, {RATES} FROM c) ORDER BY f1 DESC, j LIMIT 1""")
def a21(spark, sf):
    return _round(metrics.best_f1(metrics.score_curve(views.scored(spark, sf), "label", "recon")), "threshold", "f1")


@query("f11_channel_fusion", f"""WITH {WINDOWS} SELECT window_no, r6(f) AS fused, CASE WHEN f > 0.75 THEN 'Anomaly Detected' ELSE 'Normal Operations' END AS classification
FROM (SELECT window_no, least(greatest(greatest(recon, ann) + 0.15::DOUBLE*(recon*ann), 0.0), 1.0) AS f FROM win)""")
def f11(spark, sf):
    f = scoring.fused(F.col("recon"), F.col("ann"))
    return _windows(spark, sf).select("window_no", r6(f).alias("fused"), scoring.risk_class(f).alias("classification"))


SHOWN = """shown AS (SELECT *, CASE WHEN recon >= tr AND ann >= ta THEN 'CRITICAL' WHEN recon >= tr OR ann >= ta THEN 'WARNING'
   WHEN recon >= 0.95::DOUBLE*tr AND ann >= 0.95::DOUBLE*ta THEN 'JOINT' ELSE 'NOMINAL' END AS status,
  CASE WHEN recon >= tr AND ann >= ta THEN least(greatest(0.75 + (top-1.0)*0.25, 0.75), 1.0)
   WHEN recon >= tr THEN least(greatest(0.5 + (recon/tr - 1.0)*0.24::DOUBLE, 0.5), 0.74)
   WHEN ann >= ta THEN least(greatest(0.5 + (ann/ta - 1.0)*0.24::DOUBLE, 0.5), 0.74)
   WHEN recon >= 0.95::DOUBLE*tr AND ann >= 0.95::DOUBLE*ta THEN 0.5225 ELSE least(greatest(top*0.49::DOUBLE, 0.0), 0.49) END AS display,
  CASE WHEN recon < tr AND ann < ta THEN top*0.49::DOUBLE ELSE 0.5 + (top-1.0)*0.24::DOUBLE END AS base
  FROM (SELECT s.*, {tr} AS tr, {ta} AS ta, greatest(recon/({tr} + 1e-8), ann/({ta} + 1e-8)) AS top FROM {src} s {lim}))"""


@query("f14_presentation", f"WITH {SCORED}, " + SHOWN.replace("{tr}", "0.9::DOUBLE").replace("{ta}", "0.85::DOUBLE").replace("{src}", "scored").replace("{lim}", "") +
       " SELECT vessel_id_int, status, r6(display) AS display FROM shown")
def f14(spark, sf):
    status, shown = scoring.presentation(F.col("recon"), F.col("ann"), F.lit(0.9), F.lit(0.85))
    return views.scored(spark, sf).select("vessel_id_int", status.alias("status"), r6(shown).alias("display"))


@query("f15_scenario_delta", f"WITH {WINDOWS}, {LIMITS}, pairs AS (SELECT vessel_id_int, label, avg(recon) AS recon, avg(ann) AS ann FROM win GROUP BY 1, 2), " +
       SHOWN.replace("{tr}", "l.tr").replace("{ta}", "l.ta").replace("{src}", "pairs").replace("{lim}", ", limits l") +
       " SELECT a.vessel_id_int, r6(a.display - b.base) AS delta FROM shown a JOIN shown b USING (vessel_id_int) WHERE a.label = 1 AND b.label = 0")
def f15(spark, sf):
    pairs = _windows(spark, sf).groupBy("vessel_id_int", "label").agg(F.avg("recon").alias("recon"), F.avg("ann").alias("ann"))
    return _round(metrics.scenario_delta(pairs, _limits(spark, sf), "vessel_id_int"), "delta")


@query("f17_vessel_split", f"""WITH {WINDOWS} SELECT DISTINCT vessel_id_int, CASE WHEN ('0x' || substr(md5('42_' || vessel_id_int), 1, 8))::BIGINT % 100 < 80
  THEN 'train' ELSE 'validate' END AS split, 1::BIGINT AS sides FROM win""")
def f17(spark, sf):
    return metrics.vessel_split(_windows(spark, sf), "vessel_id_int").groupBy("vessel_id_int").agg(
        F.min("split").alias("split"), F.count_distinct("split").alias("sides"))


@query("t7_entity_cap", f"WITH {WINDOWS} SELECT window_no FROM win WHERE vessel_id_int IN (SELECT DISTINCT vessel_id_int FROM win ORDER BY 1 LIMIT 150)")
def t7(spark, sf):
    return metrics.first_entities(_windows(spark, sf), "vessel_id_int").select("window_no")


@query("a22_track_rollup", f"""WITH {WINDOWS}, f AS (SELECT *, least(greatest(greatest(recon, ann) + 0.15::DOUBLE*(recon*ann), 0.0), 1.0) AS fused FROM win)
SELECT vessel_id_int, r6(avg(fused)) AS fused_risk_score, r6(avg(recon)) AS reconstruction_score, r6(exp(-3*stddev_pop(fused))) AS confidence,
  r6(least(greatest(avg(ann), 0.0), 1.0)) AS ood_score, CASE WHEN avg(fused) > 0.75 THEN 'Anomaly Detected' ELSE 'Normal Operations' END AS classification FROM f GROUP BY 1""")
def a22(spark, sf):
    w = _windows(spark, sf).withColumn("fused", scoring.fused(F.col("recon"), F.col("ann")))
    return _round(metrics.track_rollup(w, ["vessel_id_int"]), "fused_risk_score", "reconstruction_score", "confidence", "ood_score")


@query("s13_report_sinks", f"""WITH {WINDOWS}, {LIMITS} SELECT 'json' AS kind, channel, r6(threshold) AS threshold FROM (SELECT 'recon' AS channel, tr AS threshold FROM limits UNION ALL SELECT 'ann', ta FROM limits)
 UNION ALL SELECT 'csv', channel, r6(threshold) FROM (SELECT 'recon' AS channel, tr AS threshold FROM limits UNION ALL SELECT 'ann', ta FROM limits)""")
def s13(spark, sf):
    from wakeline.session import shared_folder
    from wakeline.sources import lake

    root = shared_folder(spark, "reports")
    report = _limits(spark, sf).select("channel", "threshold")
    lake.write_report(report, f"{root}/json")
    lake.write_report(spark.read.schema("channel string, threshold double").json(f"{root}/json"), f"{root}/csv", "csv")
    js = spark.read.schema("channel string, threshold double").json(f"{root}/json")
    cs = spark.read.schema("channel string, threshold double").option("header", "true").csv(f"{root}/csv")
    both = js.withColumn("kind", F.lit("json")).unionByName(cs.withColumn("kind", F.lit("csv")))
    return _round(both, "threshold")
