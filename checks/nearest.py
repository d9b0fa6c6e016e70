"""Approximate neighbours and lookups in a stored index, over embeddings (B2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import VECTOR_SNAPSHOTS, rounded, scratch, vector_snapshots
from checks.registry import check
from checks.vector import _TOPK, _TOPK_SQL, _sides
from tidemark.operators import approximate, neighbors, vector_index

TABLES, BITS, PROBES, CELLS = 3, 5, 16, 12

#: the hyperplanes, sign patterns and probes in SQL: every pattern is priced for every query
_LSH = f"""planes AS (
  SELECT r // {BITS} AS t, r % {BITS} AS b, list(CAST((n * n * 2654435761 + n * 40503) % 4294967296 AS DOUBLE) / 2147483648 - 1 ORDER BY i) AS plane
  FROM (SELECT r, i, CAST(r * 65537 + i + 1 AS HUGEINT) AS n FROM range({TABLES * BITS}) a(r), range((SELECT max(len(vec)) FROM v)) c(i)) GROUP BY r),
signs AS (SELECT snapshot_date, job_id, t, sum(CASE WHEN d >= 0 THEN 1 << CAST(b AS INT) ELSE 0 END) AS own, list(abs(d) ORDER BY b) AS cost
  FROM (SELECT snapshot_date, job_id, t, b, list_dot_product(vec, plane) AS d FROM v, planes) GROUP BY 1, 2, 3),
probed AS (SELECT job_id, t, xor(CAST(own AS BIGINT), m) AS cell FROM signs, range({1 << BITS}) f(m) WHERE snapshot_date = 's2'
  QUALIFY row_number() OVER (PARTITION BY job_id, t ORDER BY list_sum(list_transform(range({BITS}),
    lambda i: CASE WHEN (m >> CAST(i AS INT)) & 1 = 1 THEN cost[i + 1] ELSE 0 END)), m) <= {PROBES}),
met AS (SELECT DISTINCT q.job_id AS query_id, s.job_id AS neighbor_id
  FROM probed q JOIN signs s ON s.snapshot_date = 's1' AND s.t = q.t AND s.own = q.cell),
lsh AS (SELECT query_id, neighbor_id, p.cluster_id AS neighbor_label, round(list_dot_product(q.vec, p.vec), 9) AS sim,
    row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q.vec, p.vec), 9) DESC, neighbor_id) AS rank
  FROM met JOIN v q ON q.job_id = query_id AND q.snapshot_date = 's2' JOIN v p ON p.job_id = neighbor_id AND p.snapshot_date = 's1'
  QUALIFY rank <= 15)"""


def _approximate(spark, folder):
    late, early = _sides(spark, folder)
    return approximate.knn_approximate(late, early, tables=TABLES, bits=BITS, probes=PROBES, label="cluster_id")


@check("knn_topk_lsh", f"""WITH {VECTOR_SNAPSHOTS}, {_LSH}
SELECT query_id, neighbor_id, neighbor_label, sim, rank FROM lsh""")
def knn_topk_lsh(spark, folder):
    return rounded(_approximate(spark, folder).withColumn("rank", F.col("rank").cast("long")), 9)


@check("knn_topk_lsh_recall", f"""WITH {VECTOR_SNAPSHOTS}, {_TOPK}
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbors, TRUE AS recall_holds FROM top""")
def knn_topk_lsh_recall(spark, folder):
    """Of the exact neighbours at least 95 in 100 are found."""
    late, early = _sides(spark, folder)
    exact = neighbors.knn_join(late, early).select("query_id", "neighbor_id")
    met = exact.join(_approximate(spark, folder).select("query_id", "neighbor_id", F.lit(1).alias("hit")), ["query_id", "neighbor_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_neighbors"),
                   (F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recall_holds"))


def _index(spark, folder):
    path = scratch(spark)
    vector_index.build_index(vector_snapshots(spark, folder), path, CELLS, columns=["bucket", "cluster_id"])
    return path


@check("similar_indexed", f"""WITH {VECTOR_SNAPSHOTS}, src AS (SELECT vec FROM v WHERE job_id = 7 ORDER BY snapshot_date DESC LIMIT 1)
SELECT snapshot_date, job_id, round(list_dot_product(v.vec, src.vec), 9) AS similarity,
       row_number() OVER (ORDER BY round(list_dot_product(v.vec, src.vec), 9) DESC, job_id) AS rank, bucket
FROM v, src WHERE snapshot_date = 's1' AND job_id <> 7 QUALIFY rank <= 10""")
def similar_indexed(spark, folder):
    hits = vector_index.similar_indexed(spark, _index(spark, folder), 7, "s1", 10).drop("cluster_id")
    return rounded(hits.withColumn("rank", F.col("rank").cast("long")), 9)


@check("knn_topk_indexed", _TOPK_SQL)
def knn_topk_indexed(spark, folder):
    late, _ = _sides(spark, folder)
    found = vector_index.knn_indexed(late, _index(spark, folder), "s1", label="cluster_id")
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), 9)
