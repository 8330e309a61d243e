"""Cohort neighbours, registry checks and embedding diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import scoring
from wakeline.operators import diagnostics, neighbours
from wakeline.plans import views
from wakeline.plans.catalog.base import query, r6

V = """v AS (SELECT vec_id AS id, label AS cohort, vec_id % 50 AS vessel, embedding::DOUBLE[] AS e,
  sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings)"""
PAIRS = """pairs AS (SELECT q.id AS query_id, q.cohort, q.vessel AS query_vessel, c.id AS neighbour_id, c.vessel AS peer_vessel,
  round(1.0 - list_inner_product(q.e, c.e)/(q.nrm*c.nrm), 12) AS distance FROM v q JOIN v c ON q.cohort = c.cohort)"""
TOP = """top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs {where}
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) <= {k})"""


def _sql(body, k, where="", extra=""):
    return f"WITH {V}, {PAIRS}, {TOP.replace('{k}', str(k)).replace('{where}', where)}{extra} {body}"


def _vectors(spark, sf):
    return views.vectors(spark, sf).select(
        F.col("embedding_id").alias("id"), F.col("superclass_id").alias("cohort"),
        F.col("vessel_id_int").alias("vessel"), F.col("embedding").alias("vector"))


@query("t2_cohort_neighbours", _sql("SELECT query_id, neighbour_id, r6(distance) AS distance, rank::INT AS rank FROM top", 3, "WHERE query_vessel <> peer_vessel"))
def t2(spark, sf):
    v = _vectors(spark, sf)
    hits = neighbours.nearest(v, v, 3, other_vessel=True)
    return hits.select("query_id", "neighbour_id", r6(F.col("distance")).alias("distance"), "rank")


def _raw_hits(spark, sf, k=100):
    v = _vectors(spark, sf)
    hits = neighbours.nearest(v, v, k)
    who = v.select(F.col("id").alias("query_id"), F.col("vessel").alias("query_vessel"), F.col("cohort").alias("superclass_id"))
    registry = views.vectors(spark, sf).select("embedding_id", "superclass_id", F.col("vessel_id_int").alias("peer_vessel"), "timestamp_sec")
    return v, neighbours.with_metadata(hits.join(who, "query_id"), registry)


@query("t3_distinct_peers", _sql("""SELECT v.id AS query_id, r6(coalesce(avg(m.distance), 1.0)) AS mean_distance FROM v LEFT JOIN
 (SELECT query_id, peer_vessel, min(distance) AS distance FROM top WHERE peer_vessel <> query_vessel GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(distance), peer_vessel) <= 3) m ON m.query_id = v.id GROUP BY 1""", 100))
def t3(spark, sf):
    v, hits = _raw_hits(spark, sf)
    out = neighbours.peer_distance(v, neighbours.distinct_peers(hits))
    return out.select("query_id", r6(F.col("mean_distance")).alias("mean_distance"))


@query("j17_neighbour_metadata", _sql("SELECT query_id, neighbour_id, peer_vessel, neighbour_id AS timestamp_sec, r6(distance) AS distance FROM top", 5))
def j17(spark, sf):
    _, hits = _raw_hits(spark, sf, 5)
    return hits.select("query_id", "neighbour_id", "peer_vessel", "timestamp_sec", r6(F.col("distance")).alias("distance"))


@query("f12_unit_vectors", f"""WITH {V} SELECT id AS embedding_id, r6(e[1]/nrm) AS first, r6(e[64]/nrm) AS last, r6(nrm) AS norm FROM v""")
def f12(spark, sf):
    u = scoring.l2_normalised(F.col("embedding"))
    return views.vectors(spark, sf).select(
        "embedding_id", r6(F.get(u, F.lit(0))).alias("first"), r6(F.get(u, F.lit(63))).alias("last"),
        r6(scoring.l2_norm(F.col("embedding"))).alias("norm"))


@query("f19_similarity", _sql("SELECT query_id, r6(1.0 - distance) AS similarity FROM top", 1, "WHERE query_id <> neighbour_id"))
def f19(spark, sf):
    v = _vectors(spark, sf)
    hits = neighbours.nearest(v, v, 1, other_id=True)
    return hits.select("query_id", r6(scoring.similarity(F.col("distance"))).alias("similarity"))


LOF = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), tr AS (SELECT * FROM v WHERE id % 5 <> 0), qs AS (SELECT * FROM v WHERE id % 5 = 0),
nt AS (SELECT q.id AS query_id, c.id AS neighbour_id, list_distance(q.e, c.e) AS d FROM tr q JOIN tr c ON q.id <> c.id
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, c.e), c.id) <= 20),
kd AS (SELECT query_id AS id, max(d) AS kdist FROM nt GROUP BY 1),
lt AS (SELECT query_id AS id, 1/(avg(greatest(d, kdist)) + 1e-10) AS lrd FROM nt JOIN kd ON kd.id = neighbour_id GROUP BY 1),
nq AS (SELECT q.id AS query_id, c.id AS neighbour_id, list_distance(q.e, c.e) AS d FROM qs q, tr c
  QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, c.e), c.id) <= 20),
lq AS (SELECT query_id AS id, 1/(avg(greatest(d, kdist)) + 1e-10) AS lrd FROM nq JOIN kd ON kd.id = neighbour_id GROUP BY 1)
SELECT nq.query_id, r6(avg(lt.lrd)/max(lq.lrd)) AS lof FROM nq JOIN lt ON lt.id = nq.neighbour_id JOIN lq ON lq.id = nq.query_id GROUP BY 1"""


@query("t6_local_outlier_factor", LOF)
def t6(spark, sf):
    v = _vectors(spark, sf).withColumn("cohort", F.lit(0))
    held = F.pmod(F.col("id"), F.lit(5)) == 0
    out = neighbours.local_outlier_factor(v.where(held), v.where(~held), 20)
    return out.select("query_id", r6(F.col("lof")).alias("lof"))


@query("t5_sample_ids", "SELECT DISTINCT vec_id % 50 AS vessel_id_int FROM embeddings WHERE label = 0 ORDER BY 1 LIMIT 20")
def t5(spark, sf):
    return diagnostics.sample_ids(views.vectors(spark, sf), 0)


@query("a8_cohort_counts", "SELECT label AS superclass_id, count(*) AS n_rows, count(DISTINCT vec_id % 50) AS vessels FROM embeddings GROUP BY 1")
def a8(spark, sf):
    return diagnostics.per_cohort(views.vectors(spark, sf))


@query("j18_registry_reconcile", """SELECT 'shard_rows' AS item, count(*) AS n FROM embeddings UNION ALL
SELECT 'registry_rows', count(*) FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT 'missing_rows', count(*) FROM embeddings WHERE vec_id % 7 = 0""")
def j18(spark, sf):
    v = views.vectors(spark, sf).select("embedding_id", "superclass_id")
    return diagnostics.reconcile(v, v.where(F.pmod(F.col("embedding_id"), F.lit(7)) != 0))


@query("a30_pairwise_summary", f"""WITH {V}, u AS (SELECT id, unnest(range(64)) AS dim, unnest(e)/nrm AS x FROM v),
d AS (SELECT dim, sum(x) AS s, sum(x*x) AS ss, var_samp(x) AS vs, count(*) AS n FROM u GROUP BY 1)
SELECT max(n) AS n, r6((sum(s*s) - sum(ss))/(max(n)*(max(n)-1))) AS mean_cosine, r6(avg(vs)) AS mean_variance FROM d""")
def a30(spark, sf):
    out = neighbours.pairwise_summary(views.vectors(spark, sf))
    return out.select("n", r6(F.col("mean_cosine")).alias("mean_cosine"), r6(F.col("mean_variance")).alias("mean_variance"))


@query("a31_effective_rank")
def a31(spark, sf):
    return neighbours.effective_rank(views.vectors(spark, sf)).select("n", "effective_rank")


@query("a31_scatter_moments", f"""WITH {V}, u AS (SELECT id, unnest(range(64)) AS dim, unnest(e)/nrm AS x FROM v),
c AS (SELECT id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM u),
g AS (SELECT a.dim AS i, b.dim AS j, sum(a.x*b.x) AS s FROM c a JOIN c b USING (id) GROUP BY 1, 2),
m AS (SELECT sum(CASE WHEN i = j THEN s END) AS t, sum(s*s) AS f FROM g)
SELECT (SELECT count(*) FROM v) AS n, r6(t) AS trace, r6(f) AS frobenius, r6(t*t/f) AS order_two_rank FROM m""")
def a31_moments(spark, sf):
    out = neighbours.effective_rank(views.vectors(spark, sf))
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("trace", "frobenius", "order_two_rank")])
