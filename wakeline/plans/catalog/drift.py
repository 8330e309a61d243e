"""Prototype drift per vessel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.operators import drift
from wakeline.plans import views
from wakeline.plans.catalog.base import query, r6

FOLD = """WITH RECURSIVE o AS (SELECT vec_id AS id, vec_id % 50 AS vessel, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS n,
  list_transform(embedding::DOUBLE[], lambda x: x/sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
f(id, vessel, n, p, drift) AS (SELECT id, vessel, n, e, 0.0::DOUBLE FROM o WHERE n = 1 UNION ALL
  SELECT id, vessel, n, list_transform(m, lambda x: x/sqrt(list_inner_product(m, m))), drift FROM (
    SELECT o.id, o.vessel, o.n, 1.0 - list_inner_product(f.p, o.e) AS drift,
      list_transform(list_zip(o.e, f.p), lambda z: 0.1::DOUBLE*z[1] + 0.9::DOUBLE*z[2]) AS m
    FROM f JOIN o ON o.vessel = f.vessel AND o.n = f.n + 1))"""


@query("w22_prototype_drift", FOLD + " SELECT id AS embedding_id, vessel AS vessel_id_int, r6(drift) AS drift FROM f")
def w22(spark, sf):
    out = drift.prototype_drift(views.vectors(spark, sf))
    return out.select("embedding_id", "vessel_id_int", r6(F.col("drift")).alias("drift"))


# a small buffer, so that the rolling percentile is reached within a vessel's few vectors
ROLLING = FOLD + """, d AS (SELECT *, count(*) OVER w AS seen, quantile_cont(drift, 0.95) OVER w AS q FROM f WHERE n > 1
  WINDOW w AS (PARTITION BY vessel ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, row_number() OVER (PARTITION BY vessel ORDER BY n) AS m FROM d)"""


@query("w23_rolling_threshold", ROLLING + """ SELECT id AS embedding_id, r6(CASE WHEN m >= 4 THEN q ELSE 0.45 END) AS threshold,
  (drift > CASE WHEN m >= 4 THEN q ELSE 0.45 END)::INT AS outlier FROM s
UNION ALL SELECT id, r6(0.45::DOUBLE), 0 FROM f WHERE n = 1""")
def w23(spark, sf):
    out = drift.prototype_drift(views.vectors(spark, sf), buffer=6, min_seen=4)
    return out.select("embedding_id", r6(F.col("threshold")).alias("threshold"), "outlier")


SHARED = FOLD + """, d AS (SELECT id, drift, row_number() OVER (ORDER BY id) AS m, quantile_cont(drift, 0.95) OVER w AS q FROM f WHERE n > 1
  WINDOW w AS (ORDER BY id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
s AS (SELECT id, CASE WHEN m >= 20 THEN q ELSE 0.45 END AS threshold FROM d)"""


@query("w23_shared_threshold", SHARED + """ SELECT f.id AS embedding_id, r6(coalesce(s.threshold, 0.45::DOUBLE)) AS threshold,
  (f.n > 1 AND f.drift > coalesce(s.threshold, 0.45))::INT AS outlier FROM f ASOF LEFT JOIN s ON f.id >= s.id""")
def w23_shared(spark, sf):
    out = drift.prototype_drift(views.vectors(spark, sf), buffer=100, min_seen=20, shared=True)
    return out.select("embedding_id", r6(F.col("threshold")).alias("threshold"), "outlier")
