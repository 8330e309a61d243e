"""Reconstruction scores, attribution and window scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import scorers, windows
from wakeline.plans import views
from wakeline.plans.catalog.base import query, r6
from wakeline.plans.catalog.grids import BY_KEY, _series

CELLS = """cells AS (SELECT l_suppkey AS track, l_linenumber AS chunk, mask, attended, rel, feature, actual, predicted FROM
 (SELECT *, (l_partkey % 3 = 0)::INT AS mask, (l_partkey % 5 <> 0)::INT AS attended, l_discount*8 AS rel FROM lineitem), LATERAL (
  SELECT 'quantity' AS feature, l_quantity/10.0 AS actual, l_extendedprice/20000.0 AS predicted UNION ALL SELECT 'discount', l_discount*10.0, l_tax*10.0
  UNION ALL SELECT 'size', (l_partkey % 7)::DOUBLE, (l_orderkey % 5)::DOUBLE))"""


def _cells(spark, sf):
    li, part = views.table(spark, sf, "lineitem"), F.col("l_partkey")
    pair = lambda n, a, p: F.struct(F.lit(n).alias("feature"), a.alias("actual"), p.alias("predicted"))
    cell = F.explode(F.array(
        pair("quantity", F.col("l_quantity") / 10.0, F.col("l_extendedprice") / 20000.0),
        pair("discount", F.col("l_discount") * 10.0, F.col("l_tax") * 10.0),
        pair("size", F.pmod(part, F.lit(7)).cast("double"), F.pmod("l_orderkey", F.lit(5)).cast("double"))))
    return li.select(
        F.col("l_suppkey").alias("track"), F.col("l_linenumber").alias("chunk"), (F.pmod(part, F.lit(3)) == 0).cast("int").alias("mask"),
        (F.pmod(part, F.lit(5)) != 0).cast("int").alias("attended"), (F.col("l_discount") * 8).alias("reliability"), cell.alias("c"),
    ).select("track", "chunk", "mask", "attended", "reliability", "c.*")


def _round(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query("a24_reconstruction_score", f"""WITH {CELLS}, m AS (SELECT track, chunk, feature, avg((actual-predicted)*(actual-predicted)) AS mse FROM cells GROUP BY 1, 2, 3)
SELECT track, chunk, r6(sqrt(sum(mse*mse))) AS error, r6(least(greatest(ln(1+sqrt(sum(mse*mse)))/5.0, 0.0), 1.0)) AS recon FROM m GROUP BY 1, 2""")
def a24(spark, sf):
    return _round(scorers.reconstruction_score(_cells(spark, sf), ["track", "chunk"]), "error", "recon")


@query("a25_masked_score", f"""WITH {CELLS}, e AS (SELECT track, chunk, sum((actual-predicted)*(actual-predicted)*mask)/(sum(mask) + 1e-8) AS error FROM cells GROUP BY 1, 2)
SELECT track, chunk, r6(error) AS error, r6(least(greatest(ln(1+error)/15.0, 0.0), 1.0)) AS recon FROM e""")
def a25(spark, sf):
    return _round(scorers.masked_score(_cells(spark, sf), ["track", "chunk"]), "error", "recon")


@query("a26_weighted_loss", f"""WITH {CELLS} SELECT r6(sum(pow(least(greatest(predicted,-10.0),10.0)-least(greatest(actual,-10.0),10.0), 2)*least(greatest(rel,1e-5),1.0)*mask*attended)
  /(sum(mask*attended) + 1e-8)) AS loss FROM cells""")
def a26(spark, sf):
    return _round(scorers.weighted_loss(_cells(spark, sf)), "loss")


@query("a23_attribution", f"""WITH {CELLS}, m AS (SELECT track, feature, avg((actual-predicted)*(actual-predicted)) AS e FROM cells GROUP BY 1, 2)
SELECT track, feature, r6(e/sum(e) OVER (PARTITION BY track)) AS share, row_number() OVER (PARTITION BY track ORDER BY e DESC, feature)::INT AS rank FROM m""")
def a23(spark, sf):
    return _round(scorers.attribution(_cells(spark, sf), ["track"]), "share")


@query("t4_ranked_contributors", f"""WITH {CELLS}, m AS (SELECT track, feature, avg((actual-predicted)*(actual-predicted)) AS e FROM cells GROUP BY 1, 2)
SELECT track, feature FROM m QUALIFY row_number() OVER (PARTITION BY track ORDER BY e DESC, feature) = 1""")
def t4(spark, sf):
    return scorers.attribution(_cells(spark, sf), ["track"]).where("rank = 1").select("track", "feature")


@query("x2_pluggable_scorer", """SELECT CAST(vec_id AS VARCHAR) AS window_id, r6(list_sum(embedding::DOUBLE[])) AS total, r6(embedding[1]::DOUBLE*2) AS first FROM embeddings""")
def x2(spark, sf):
    rows = views.vectors(spark, sf).select(F.col("embedding_id").alias("window_id"), F.col("embedding").alias("vector"))
    out = scorers.score_windows(rows, lambda m: (m.sum(1, keepdims=True), m * 2))
    return out.select("window_id", r6(F.get("embedding", F.lit(0))).alias("total"), r6(F.get("reconstruction", F.lit(0))).alias("first"))


@query("x3_linear_encoder")
def x3(spark, sf):
    rows = windows.row_windows(_series(spark, sf), BY_KEY)
    stats = windows.window_statistics(rows, ["vessel_id_int", "start"], ["price", "day"])
    wins = stats.select(F.concat_ws("_", "vessel_id_int", "start").alias("window_id"), "vector")
    scored = scorers.score_windows(wins, scorers.fit_linear_encoder(wins, 4))
    return scorers.reconstruction_score(scorers.reconstruction_cells(wins, scored), ["window_id"])


# Two fixed axes over the first four entries: SQL can repeat projection, norm, back-projection and error.
AXES_TABLE = [(0.5, 0.5), (0.5, -0.5), (0.5, 0.5), (0.5, -0.5)]


@query("x3_fixed_projection", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT vec_id, v, 0.5*v[1] + 0.5*v[2] + 0.5*v[3] + 0.5*v[4] AS p0, 0.5*v[1] - 0.5*v[2] + 0.5*v[3] - 0.5*v[4] AS p1 FROM e)
SELECT CAST(vec_id AS VARCHAR) AS window_id, r6(p0/greatest(sqrt(p0*p0+p1*p1), 1e-8)) AS first, r6(p1/greatest(sqrt(p0*p0+p1*p1), 1e-8)) AS second,
  r6((pow(v[1] - 0.5*(p0+p1), 2) + pow(v[2] - 0.5*(p0-p1), 2) + pow(v[3] - 0.5*(p0+p1), 2) + pow(v[4] - 0.5*(p0-p1), 2))/4) AS mse FROM p""")
def x3_fixed(spark, sf):
    """The linear scorer with axes from a table instead of a fit."""
    import numpy as np

    rows = views.vectors(spark, sf).select(
        F.col("embedding_id").cast("string").alias("window_id"), F.slice("embedding", 1, 4).alias("vector"))
    scorer = scorers.linear_scorer(np.zeros(4), np.ones(4), np.asarray(AXES_TABLE))
    both = rows.join(scorers.score_windows(rows, scorer), "window_id")
    squares = F.zip_with("vector", "reconstruction", lambda a, b: (a - b) * (a - b))
    mse = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size("vector")
    return both.select("window_id", r6(F.get("embedding", F.lit(0))).alias("first"), r6(F.get("embedding", F.lit(1))).alias("second"),
                       r6(mse).alias("mse"))


@query("x4_enrichment_chain", """SELECT event_id, round(value*2, 4) AS value, CASE WHEN round(value*2, 4) > 20 THEN 'late' ELSE 'early' END AS tag FROM events""")
def x4(spark, sf):
    double = lambda df: df.withColumn("value", F.round(F.col("value") * 2, 4))
    tag = lambda df: df.withColumn("tag", F.when(F.col("value") > 20, "late").otherwise("early"))
    ev = views.table(spark, sf, "events").select("event_id", "value")
    return ev.transform(double).transform(tag)
