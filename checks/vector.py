"""Vectors, neighbours, clustering and labelling over embeddings (B2), parts (B4) and documents (B5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import (
    DOCUMENTS, PARTS, VECTOR_SNAPSHOTS, YEARLY, documents, parts, rounded, scratch, table, vector_snapshots, yearly)
from checks.registry import check
from tidemark import settings as S
from tidemark.functions.vectors import l2_normalize, norm
from tidemark.operators import clusters, encode, neighbors, snapshots, textfeatures
from tidemark.operators.ranking import modal_value
from tidemark.plans.analysis import Options, reference_labels, run_analysis
from tidemark.session import cut
from tidemark.sources.tables import read_table, replace_table

VOTE, FLOOR = 0.20, 0.25

_TOPK = """pairs AS (
  SELECT q.job_id AS query_id, p.job_id AS neighbor_id, p.cluster_id AS neighbor_label,
         round(list_dot_product(q.vec, p.vec), 9) AS sim
  FROM v q, v p WHERE q.snapshot_date = 's2' AND p.snapshot_date = 's1'),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbor_id) AS rank FROM pairs
        QUALIFY rank <= 15)"""
_TOPK_SQL = f"""WITH {VECTOR_SNAPSHOTS}, {_TOPK}
SELECT query_id, neighbor_id, neighbor_label, sim, rank FROM top"""


def _sides(spark, folder):
    v = vector_snapshots(spark, folder)
    return v.where("snapshot_date = 's2'"), v.where("snapshot_date = 's1'")


@check("knn_topk", _TOPK_SQL)
def knn_topk(spark, folder):
    late, early = _sides(spark, folder)
    found = neighbors.knn_join(late, early, label="cluster_id")
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), 9)


@check("knn_topk_cells", _TOPK_SQL)
def knn_topk_cells(spark, folder):
    """The same join through 12 cells and small blocks: both rounds, several blocks per cell."""
    late, early = _sides(spark, folder)
    found = neighbors.knn_join(late, early, label="cluster_id", cells=12, block_rows=64)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), 9)


@check("knn_vote", f"""WITH {VECTOR_SNAPSHOTS}, {_TOPK},
tally AS (SELECT query_id, neighbor_label, count(*) AS votes, avg(sim) AS mean_sim FROM top WHERE neighbor_label <> -1 GROUP BY 1, 2),
won AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, neighbor_label) = 1)
SELECT q.query_id, CASE WHEN votes / 15.0 >= {VOTE} AND mean_sim >= {FLOOR} THEN neighbor_label ELSE -1 END AS cluster_id,
       round(coalesce(mean_sim, 0), 12) AS sim, coalesce(neighbor_label, -1) AS winner, coalesce(votes, 0) AS votes
FROM (SELECT DISTINCT query_id FROM top) q LEFT JOIN won USING (query_id)""")
def knn_vote(spark, folder):
    late, early = _sides(spark, folder)
    return rounded(neighbors.knn_vote(neighbors.knn_join(late, early, label="cluster_id"), S.KNN_K, VOTE, FLOOR), 12)


@check("similar", f"""WITH {VECTOR_SNAPSHOTS}, src AS (SELECT vec FROM v WHERE job_id = 7 ORDER BY snapshot_date DESC LIMIT 1)
SELECT snapshot_date, job_id, round(list_dot_product(v.vec, src.vec), 9) AS similarity,
       row_number() OVER (ORDER BY round(list_dot_product(v.vec, src.vec), 9) DESC, job_id) AS rank, bucket
FROM v, src WHERE snapshot_date = 's1' AND job_id <> 7 QUALIFY rank <= 10""")
def similar(spark, folder):
    v = vector_snapshots(spark, folder)
    hits = neighbors.similar(v, 7, "s1", 10, v.select("snapshot_date", "job_id", "bucket"))
    return rounded(hits.withColumn("rank", F.col("rank").cast("long")), 9)


@check("l2_normalize", """
WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) * 3 AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 9) AS value FROM u""")
def l2(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("_v", F.transform("embedding", lambda x: x.cast("double") * 3))
    parts_of = rows.select("vec_id", F.posexplode(l2_normalize(F.col("_v"))).alias("_i", "value"))
    return rounded(parts_of.select("vec_id", (F.col("_i") + 1).cast("long").alias("i"), "value"), 9)


@check("company_shift", f"""WITH {VECTOR_SNAPSHOTS},
u AS (SELECT snapshot_date, company_id, job_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
means AS (SELECT snapshot_date, company_id, list(x ORDER BY i) AS mean FROM (
            SELECT snapshot_date, company_id, i, avg(x) AS x FROM u GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT snapshot_date, company_id, count(*) AS n, arg_min(bucket, job_id) AS bucket FROM v GROUP BY 1, 2 HAVING count(*) >= 3),
modes AS (SELECT snapshot_date, company_id, cluster_id AS mode FROM v WHERE cluster_id <> -1 GROUP BY 1, 2, 3
          QUALIFY row_number() OVER (PARTITION BY snapshot_date, company_id ORDER BY count(*) DESC, cluster_id) = 1),
f AS (SELECT * FROM g JOIN means USING (snapshot_date, company_id) LEFT JOIN modes USING (snapshot_date, company_id))
SELECT 's1' AS from_snapshot, 's2' AS to_snapshot, b.company_id, b.bucket, a.n AS n_from, b.n AS n_to,
       round(list_cosine_similarity(a.mean, b.mean), 6) AS cos_similarity,
       round(1 - list_cosine_similarity(a.mean, b.mean), 6) AS shift_score,
       coalesce(a.mode, -1) AS from_cluster, coalesce(b.mode, -1) AS to_cluster
FROM f a JOIN f b ON a.company_id = b.company_id AND a.snapshot_date = 's1' AND b.snapshot_date = 's2'""")
def company_shift(spark, folder):
    return rounded(snapshots.company_shift(vector_snapshots(spark, folder), ["s1", "s2"], ["bucket"]))


_NEAREST = """u AS (SELECT cluster_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM p WHERE cluster_id <> -1),
c AS (SELECT cluster_id, list(x ORDER BY i) AS raw, sqrt(sum(x * x)) AS len
      FROM (SELECT cluster_id, i, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY 1),
near AS (SELECT cluster_id, job_id, job_title, round(list_dot_product(vec, list_transform(raw, lambda y: y / len)), 9) AS sim,
  row_number() OVER (PARTITION BY cluster_id ORDER BY
    round(list_dot_product(vec, list_transform(raw, lambda y: y / len)), 9) DESC, job_id) AS rank
  FROM p JOIN c USING (cluster_id) QUALIFY rank <= 8),
titles AS (SELECT cluster_id, list(job_title ORDER BY r) AS titles
           FROM (SELECT cluster_id, job_title, min(rank) AS r FROM near GROUP BY 1, 2) GROUP BY 1)"""


@check("centroid_nearest", f"""WITH {PARTS}, {_NEAREST}
SELECT cluster_id, job_id, job_title, sim, rank FROM near""")
def centroid_nearest(spark, folder):
    near = clusters.nearest_to_centroid(parts(spark, folder, vectors=True), columns=["job_title"])
    return rounded(near.withColumn("rank", F.col("rank").cast("long")), 9)


@check("centroid_titles", f"""WITH {PARTS}, {_NEAREST}
SELECT cluster_id, array_to_string(titles[1:5], ' / ') AS top_titles FROM titles""")
def centroid_titles(spark, folder):
    near = clusters.near_titles(clusters.nearest_to_centroid(parts(spark, folder, vectors=True), columns=["job_title"]))
    return near.select("cluster_id", F.array_join(F.slice("titles", 1, 5), " / ").alias("top_titles"))


@check("modal_title", f"""WITH {PARTS}
SELECT cluster_id, job_title AS title, count(*) AS times FROM p GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, job_title) = 1""")
def modal_title(spark, folder):
    return modal_value(parts(spark, folder, vectors=True), ["cluster_id"], "job_title", "title", "times")


def _tfidf(group: str) -> str:
    return f"""size AS (SELECT count(*) AS total FROM p),
docs AS (SELECT {group} AS g, job_title AS title, count(*) AS n FROM p GROUP BY 1, 2),
words AS (SELECT g, title, n, ' ' || unnest(list_filter(string_split(lower(title), ' '), lambda w: w <> '')) || ' ' AS w FROM docs),
grams AS (SELECT g, title, n, unnest(list_concat(
    list_transform(range(1, length(w)), lambda i: substr(w, i, 2)),
    list_concat(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)),
                list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4))))) AS term FROM words),
tf AS (SELECT g, title, n, term, count(*) AS tf FROM grams GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY 1 HAVING sum(n) >= (SELECT greatest(2, total // 5000) FROM size)),
wt AS (SELECT g, title, n, term, tf * (ln((1.0 + total) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), size),
tfidf AS (SELECT g, title, n, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, title)) AS weight FROM wt)"""


@check("char_ngram_tfidf", f"""WITH {PARTS}, {_tfidf("category")}
SELECT g AS category, title, n, term, round(weight, 6) AS weight FROM tfidf""")
def char_ngram_tfidf(spark, folder):
    return rounded(textfeatures.title_tfidf(parts(spark, folder), "category", "job_title"))


_TERMS = f"""{_tfidf("cluster_id")},
sums AS (SELECT g, term, sum(n * weight) AS s FROM tfidf GROUP BY 1, 2),
sizes AS (SELECT cluster_id AS g, count(*) AS m FROM p GROUP BY 1),
lift AS (SELECT g, term, round(s / m - sum(s) OVER (PARTITION BY term) / total, 9) AS lift FROM sums JOIN sizes USING (g), size),
best AS (SELECT g, trim(term) AS term, row_number() OVER (PARTITION BY g ORDER BY lift DESC, lift.term) AS rank FROM lift
         QUALIFY rank <= 12),
terms AS (SELECT g AS cluster_id, array_to_string((list(term ORDER BY rank) FILTER (length(term) >= 2))[1:6], ' ') AS top_terms
          FROM best GROUP BY 1)"""


@check("cluster_terms", f"WITH {PARTS}, {_TERMS} SELECT cluster_id, top_terms FROM terms")
def cluster_terms(spark, folder):
    return textfeatures.distinctive_terms(parts(spark, folder, vectors=True))


@check("cluster_catalog", f"""WITH {PARTS}, {_NEAREST}, {_TERMS},
modal AS (SELECT cluster_id, job_title AS title, count(*) AS times FROM p GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, job_title) = 1)
SELECT cluster_id, 'reference' AS kind, '1996' AS first_seen, array_to_string(titles[1:5], ' / ') AS top_titles, top_terms,
  substr(CASE WHEN times > 1 THEN title ELSE list_sort(list_transform(titles, lambda t: [lpad(CAST(length(t) AS VARCHAR), 4, '0'), t]))[1][2] END, 1, 16) AS label
FROM titles JOIN terms USING (cluster_id) JOIN modal USING (cluster_id)""")
def cluster_catalog(spark, folder):
    return clusters.cluster_catalog(parts(spark, folder, vectors=True), "reference", "1996")


# --- clustering -------------------------------------------------------------------------------
def _keyed(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("job_id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("cluster_id"))


def _density_sql(source: str, eps: float, samples: int, size: str) -> str:
    return f"""WITH RECURSIVE e AS ({source}),
sims AS (SELECT a.job_id AS q, b.job_id AS p, round(list_dot_product(a.vec, b.vec), 9) AS sim FROM e a, e b),
core AS (SELECT q AS id FROM sims WHERE sim >= {eps} GROUP BY 1 HAVING count(*) >= {samples}),
edge AS (SELECT q, p FROM sims WHERE sim >= {eps} AND q <> p AND q IN (FROM core) AND p IN (FROM core)),
reach(a, b) AS (SELECT job_id, job_id FROM e UNION SELECT r.a, x.p FROM reach r JOIN edge x ON r.b = x.q),
part AS (SELECT a AS job_id, min(b) AS component FROM reach GROUP BY 1),
big AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS no FROM part GROUP BY 1
        HAVING count(*) >= {size})
SELECT job_id, coalesce(no, -1) AS cluster_id FROM part LEFT JOIN big USING (component)"""


_ALL_VECTORS = "SELECT vec_id AS job_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"


@check("density_cluster", _density_sql(_ALL_VECTORS, 0.28, 5, "25"))
def density_cluster(spark, folder):
    return clusters.density_clusters(_keyed(spark, folder), 25, 5, 0.28)


@check("discover_residue", _density_sql(
    f"SELECT * FROM ({_ALL_VECTORS}) JOIN embeddings ON vec_id = job_id WHERE label IN (7, 8, 9)", 0.20, 5,
    "(SELECT greatest(25, CAST(floor(count(*) * 0.02) AS BIGINT)) FROM e)"))
def discover_residue(spark, folder):
    """Structure among the rows whose label the early snapshot does not know."""
    residue = _keyed(spark, folder).where("cluster_id IN (7, 8, 9)").select("job_id", "vec")
    return clusters.discover_residue(residue, 0.20)


_COPIES = """SELECT vec_id * 100 + i AS job_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings,
  (SELECT unnest(range(4)) AS i) WHERE i < 1 + vec_id % 4"""


@check("density_duplicates", _density_sql(_COPIES, 0.34, 8, "10"))
def density_duplicates(spark, folder):
    """Every vector one to four times: copies count, and do not hide the neighbours behind them."""
    copies = table(spark, folder, "embeddings").select(
        F.col("vec_id"), F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))).alias("i"), F.col("embedding").alias("vec"))
    return clusters.density_clusters(copies.select((F.col("vec_id") * 100 + F.col("i")).alias("job_id"), "vec"), 10, 8, 0.34)


@check("emergent_renumber", f"""WITH {YEARLY}
SELECT snapshot_date, job_id, CASE WHEN cluster_id = -1 THEN -1 ELSE
  99 + dense_rank() OVER (PARTITION BY cluster_id <> -1 ORDER BY cluster_id) END AS cluster_id FROM b1""")
def emergent_renumber(spark, folder):
    labels = yearly(spark, folder).select("snapshot_date", "job_id", "cluster_id")
    return clusters.renumber_from(labels, 100)


@check("fallback_gate", f"""WITH {YEARLY}, q AS (
  SELECT count(*) AS n, avg(CASE WHEN cluster_id = -1 THEN 1.0 ELSE 0 END) AS noise_ratio,
         count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS n_clusters FROM b1)
SELECT n, round(noise_ratio, 6) AS noise_ratio, n_clusters, noise_ratio > 0.40 OR n_clusters < 8 AS fallback FROM q""")
def fallback_gate(spark, folder):
    quality = clusters.cluster_quality(yearly(spark, folder))
    found = quality.head()
    return rounded(quality.withColumn("fallback", F.lit(clusters.needs_fallback(found["noise_ratio"], found["n_clusters"]))))


@check("pca_explained")
def pca_explained(spark, folder):
    _, ratios = clusters.pca_project(_keyed(spark, folder))
    return spark.createDataFrame([(i, x) for i, x in enumerate(ratios)], "component int, explained double")


@check("kmeans_labels")
def kmeans_labels(spark, folder):
    low, _ = clusters.pca_project(_keyed(spark, folder).drop("cluster_id"))
    return clusters.kmeans_labels(low, 10).select("job_id", "cluster_id")


@check("silhouette_sweep")
def silhouette_sweep(spark, folder):
    low, _ = clusters.pca_project(_keyed(spark, folder).drop("cluster_id"))
    scores = clusters.silhouette_sweep(cut(low.select("job_id", "low")))
    return spark.createDataFrame(scores, "k int, silhouette double")


# --- encoding ---------------------------------------------------------------------------------
@check("encode_vectors", """
SELECT doc_id, CAST(256 AS BIGINT) AS dim,
       CAST(CASE WHEN length(trim(text, ' ' || chr(10))) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length FROM documents""")
def encode_vectors(spark, folder):
    """Whole documents through the offline encoder; every non-blank text gets a unit vector."""
    rows = encode.hashed_ngram_vectors(table(spark, folder, "documents"), "text")
    return rows.select("doc_id", F.size("vec").cast("long").alias("dim"), F.round(norm(F.col("vec")), 4).alias("length"))


@check("freshness_antijoin", f"""WITH {DOCUMENTS} SELECT job_id FROM d WHERE industry_bucket = 'de' OR company_name = 'src3'""")
def freshness_antijoin(spark, folder):
    """Stored hashes lack the German texts; texts of one source have changed since."""
    rows = documents(spark, folder)
    stored = encode.with_text_hash(rows.where("industry_bucket <> 'de'"), "description")
    now = rows.withColumn("description", F.when(F.col("company_name") == "src3", F.concat("description", F.lit("+")))
                          .otherwise(F.col("description")))
    return encode.needs_encoding(now, stored, ["job_id"], "description").select("job_id")


@check("vector_coverage", """
SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM labels) AS n_vectors,
       (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS n_matched,
       (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_without_vector,
       (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_without_row,
       (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS n_repeated_keys""")
def vector_coverage(spark, folder):
    return encode.vector_coverage(table(spark, folder, "documents"), table(spark, folder, "labels"), ["doc_id"])


# --- the loop ---------------------------------------------------------------------------------
def loop_inputs(spark, folder):
    """Postings and vectors of both snapshots, with part names as titles."""
    v = vector_snapshots(spark, folder).withColumn("job_id", F.col("job_id").cast("string"))
    names = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.col("p_name").alias("job_title"))
    rows = v.join(names, F.col("job_id") == F.col("_id"), "left").select(
        "snapshot_date", "job_id", F.coalesce("job_title", F.lit("item")).alias("job_title"),
        F.col("company_id").cast("string").alias("company_id"),
        F.concat(F.lit("company "), F.col("company_id").cast("string")).alias("company_name"),
        F.col("bucket").alias("bucket_label"), (F.col("company_id") % 5).cast("string").alias("industry_class"))
    return rows, v.select("snapshot_date", "job_id", "vec")


#: fewer counts and starts of the K-means fallback than the defaults, whose fits take minutes on one machine
QUICK = {"grid": [8, 12], "n_init": 1}


def loop_options(**changes) -> Options:
    return Options("s1", vote_ratio=VOTE, sim_floor=FLOOR, eps=0.28, residue_eps=0.20, **changes)


@check("snapshot_loop")
def snapshot_loop(spark, folder):
    rows, vectors = loop_inputs(spark, folder)
    base = scratch(spark)
    run_analysis(rows, vectors, base, loop_options(**QUICK))
    return read_table(spark, f"{base}/job_cluster")


@check("reference_reuse", """
WITH r AS (SELECT vec_id FROM embeddings WHERE label <= 6)
SELECT CAST(vec_id AS VARCHAR) AS job_id, vec_id % 10 = 3 AS moved_once, vec_id % 10 = 3 AS moved_again FROM r
WHERE vec_id <> (SELECT max(vec_id) FROM r)""")
def reference_reuse(spark, folder):
    """Labels set by hand are reused while the ids are the same, and fitted anew once an id is gone."""
    _, vectors = loop_inputs(spark, folder)
    base = scratch(spark)
    early = cut(vectors.where("snapshot_date = 's1'").select("job_id", "vec"))
    marked = early.select("job_id", F.when(F.col("job_id").cast("int") % 10 == 3, 77).otherwise(0).cast("long").alias("cluster_id"))
    replace_table(marked, f"{base}/reference_labels")
    again, _ = reference_labels(early, base, loop_options(**QUICK))
    reused = cut(again.select("job_id", (F.col("cluster_id") == 77).alias("moved_once"), F.col("cluster_id").alias("_was")))
    last = early.orderBy(F.col("job_id").cast("int").desc()).head()["job_id"]
    fitted, _ = reference_labels(early.where(F.col("job_id") != last), base, loop_options(**QUICK))
    fresh = fitted.where("cluster_id <> 77").select("job_id")
    return reused.where(F.col("job_id") != last).join(fresh, "job_id").select(
        "job_id", "moved_once", (F.col("_was") == 77).alias("moved_again"))
