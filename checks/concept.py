"""Concept detection over parts (B4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.bindings import (
    ANCHORS, CONCEPTS, PART_CONCEPTS, PART_FLAGGED, PARTS, parts, r6, rounded, table, yearly, SERIES, YEARLY)
from checks.registry import check
from tidemark.operators import concepts, dictionary, snapshots
from tidemark.session import cut
from tidemark.sources import export

_ALL = f"WITH {PARTS}, {CONCEPTS}, {ANCHORS}"
_FLAGGED = ", ".join(f"'{c}'" for c in PART_FLAGGED)


def anchor_table(spark, folder):
    names = F.array(*[F.lit(c) for c in PART_CONCEPTS])
    sentences = table(spark, folder, "embeddings").where(F.col("label") < len(PART_CONCEPTS)).select(
        F.element_at(names, F.col("label") + 1).alias("concept"), F.col("embedding").alias("vec"))
    return concepts.anchor_vectors(sentences)


def tagged(spark, folder):
    rows = parts(spark, folder, vectors=True)
    anchors = concepts.collect_anchors(anchor_table(spark, folder), PART_CONCEPTS)
    return cut(concepts.tag_concepts(rows, F.col("job_title"), PART_CONCEPTS, anchors).drop("vec"))


def plain_hits(spark, folder):
    rows = parts(spark, folder)
    return concepts.concept_hits(concepts.tag_concepts(rows, F.col("job_title"), PART_CONCEPTS), ["job_id"])


@check("anchor_similarity", f"{_ALL} SELECT job_id, concept, round(sim, 6) AS sim FROM cells")
def anchor_similarity(spark, folder):
    return tagged(spark, folder).select("job_id", F.inline("cells")).select("job_id", "concept", r6("sim"))


@check("concept_scores", f"{_ALL} SELECT job_id, concept, round(sim, 6) AS anchor_similarity FROM cells WHERE hit")
def concept_scores(spark, folder):
    return rounded(concepts.concept_hits(tagged(spark, folder), ["job_id"]))


@check("concept_summary", f"""{_ALL}, base AS (SELECT median(salary_month_min) AS b FROM p),
s AS (SELECT concept, count(*) FILTER (hit) AS n, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS share,
  median(salary_month_min) FILTER (hit) AS median_salary, count(salary_month_min) FILTER (hit) AS paid,
  median(description_len) FILTER (hit) AS median_desc_len, median(sim) FILTER (hit) AS anchor_sim_median,
  quantile_cont(sim, 0.99) AS anchor_sim_p99_all, avg(sim) AS mean_all, stddev_pop(sim) AS std_all FROM cells GROUP BY 1)
SELECT concept, concept IN ({_FLAGGED}) AS is_ai, n, round(share, 6) AS share, round(median_salary, 6) AS median_salary,
  round(median_salary / b, 6) AS salary_premium, round(paid / greatest(n, 1), 6) AS salary_coverage,
  round(median_desc_len, 6) AS median_desc_len, round(anchor_sim_median, 6) AS anchor_sim_median,
  round(anchor_sim_p99_all, 6) AS anchor_sim_p99_all,
  round((anchor_sim_median - mean_all) / (std_all + 1e-9), 6) AS separation_sigma FROM s, base""")
def concept_summary(spark, folder):
    return rounded(concepts.concept_summary(tagged(spark, folder), PART_FLAGGED))


_RANKED = """r AS (SELECT job_id, job_title, category, concept, hit, round(sim, 9) AS s,
  row_number() OVER (PARTITION BY concept, hit ORDER BY round(sim, 9) DESC, job_id) AS rn FROM cells)"""


@check("concept_examples", f"""{_ALL}, {_RANKED}
SELECT concept, job_id, job_title, category, s AS anchor_similarity FROM r WHERE hit AND rn <= 10""")
def concept_examples(spark, folder):
    return rounded(concepts.concept_examples(tagged(spark, folder), ["job_title", "category"], "job_id"), 9)


@check("concept_candidates", f"""{_ALL}, {_RANKED}
SELECT concept, job_id, job_title, s AS anchor_similarity FROM r WHERE NOT hit AND rn <= 30""")
def concept_candidates(spark, folder):
    return rounded(concepts.concept_candidates(tagged(spark, folder), ["job_title"], "job_id"), 9)


@check("concept_counts", f"""WITH {PARTS}, {CONCEPTS} SELECT count(DISTINCT job_id) AS n_digital_jobs,
  count(DISTINCT job_id) FILTER (concept IN ({_FLAGGED})) AS n_ai_jobs FROM hits""")
def concept_counts(spark, folder):
    return concepts.concept_counts(plain_hits(spark, folder), PART_FLAGGED)


_CROSS = """h AS (SELECT concept, category, count(*) AS n FROM hits GROUP BY 1, 2),
tot AS (SELECT category, count(*) AS n_category FROM p GROUP BY 1),
crossed AS (SELECT concept, category, n, n_category, n / sum(n) OVER (PARTITION BY concept) AS share_in_concept,
  n / n_category AS share_in_category FROM h JOIN tot USING (category) WHERE n >= 20)"""


@check("concept_cross", f"""WITH {PARTS}, {CONCEPTS}, {_CROSS} SELECT concept, category, n, n_category,
  round(share_in_concept, 6) AS share_in_concept, round(share_in_category, 6) AS share_in_category FROM crossed""")
def concept_cross(spark, folder):
    return rounded(concepts.concept_cross(plain_hits(spark, folder), parts(spark, folder), "category", 20))


@check("concept_pivot", f"""WITH {PARTS}, {CONCEPTS}, {_CROSS}
SELECT category, {", ".join(f"coalesce(max(n) FILTER (concept = '{c}'), 0) AS {c}" for c in PART_CONCEPTS)}
FROM crossed GROUP BY 1""")
def concept_pivot(spark, folder):
    cross = concepts.concept_cross(plain_hits(spark, folder), parts(spark, folder), "category", 20)
    return concepts.concept_pivot(cross, list(PART_CONCEPTS))


@check("concept_pay", f"""WITH {PARTS}, {CONCEPTS}
SELECT concept, count(*) AS n, round(median(salary_month_min), 6) AS p50,
  round(quantile_cont(salary_month_min, 0.25), 6) AS p25, round(quantile_cont(salary_month_min, 0.75), 6) AS p75
FROM hits WHERE salary_month_min IS NOT NULL GROUP BY 1""")
def concept_pay(spark, folder):
    return rounded(concepts.concept_pay(plain_hits(spark, folder), parts(spark, folder)))


@check("concept_members", f"""{_ALL}, g AS (SELECT *, round(sim, 9) AS s FROM cells WHERE hit AND concept = 'gears')
SELECT job_id, job_title, salary_month_min, s AS anchor_similarity FROM g ORDER BY s DESC, job_id LIMIT 100""")
def concept_members(spark, folder):
    scores = concepts.concept_hits(tagged(spark, folder), ["job_id"])
    members = concepts.concept_members(scores, parts(spark, folder), "gears", ["job_title", "salary_month_min"])
    return rounded(members, 9)


@check("concept_list", f"""WITH {PARTS}, {CONCEPTS}
SELECT concept, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, concept) AS place FROM hits GROUP BY 1""")
def concept_list(spark, folder):
    counts = plain_hits(spark, folder).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("n").desc(), "concept")).cast("long")
    return counts.withColumn("place", place)


@check("keyword_vs_vector_eval", f"""{_ALL},
r AS (SELECT concept, hit, sim, row_number() OVER (PARTITION BY concept ORDER BY round(sim, 9) DESC, job_id) AS rn FROM cells),
e AS (SELECT concept, count(*) FILTER (hit) AS n_hits, count(*) FILTER (hit AND rn <= 500) AS n_found,
  median(round(sim, 9)) FILTER (hit) AS median_hits, quantile_cont(round(sim, 9), 0.99) AS p99_all FROM r GROUP BY 1)
SELECT concept, n_hits, n_found, round(n_found / NULLIF(n_hits, 0), 12) AS recall_at_top, round(median_hits, 12) AS median_hits,
  round(p99_all, 12) AS p99_all, p99_all > median_hits AS p99_beats_hits FROM e""")
def keyword_vs_vector_eval(spark, folder):
    return rounded(concepts.keyword_vs_vector(tagged(spark, folder), "job_id"), 12)


@check("headline_metrics", f"""{_ALL}, {YEARLY}, {SERIES},
ten AS (SELECT share FROM series WHERE snapshot_date = '1997' AND cluster_id <> -1 ORDER BY share DESC, cluster_id LIMIT 10),
base AS (SELECT median(salary_month_min) AS b FROM p),
prem AS (SELECT concept, median(salary_month_min) FILTER (hit) / any_value(b) AS x FROM cells, base
         WHERE concept IN ({_FLAGGED}) GROUP BY 1)
SELECT round(max(share), 6) AS max_share, round(sum(share), 6) AS top10_share,
       round((SELECT avg(x) FROM prem), 6) AS mean_ai_premium FROM ten""")
def headline_metrics(spark, folder):
    series = snapshots.cluster_timeseries(yearly(spark, folder))
    return rounded(concepts.headline_metrics(series, concepts.concept_summary(tagged(spark, folder), PART_FLAGGED), "1997"))


@check("export_nested", f"""{_ALL}, {_RANKED}
SELECT 'by_concept' AS name, concept AS group_key, rn AS rank, job_id, job_title, s AS anchor_similarity
FROM r WHERE hit AND rn <= 100""")
def export_nested(spark, folder):
    """The nested per-concept documents, opened again into rows."""
    hits = concepts.concept_hits(tagged(spark, folder), ["job_id", "job_title"])
    nested = export.nest_top(hits, "concept", [F.round("anchor_similarity", concepts.TIE_DIGITS).desc(), F.col("job_id")],
                             export.TOP_PER_CONCEPT, "by_concept")
    body = "array<struct<rank:bigint,job_id:bigint,job_title:string,anchor_similarity:double>>"
    return rounded(nested.select("name", "group_key", F.inline(F.from_json("document", body))), 9)


@check("concept_scores_dictionary", """
WITH names AS (SELECT DISTINCT lower(p_name) AS name FROM part),
terms AS (SELECT DISTINCT substr(name, 1, 1) AS concept, substr(name, CAST(i AS INT), 3) AS term FROM names, range(1, length(name) - 1) r(i)
          WHERE trim(substr(name, CAST(i AS INT), 3)) <> '')
SELECT doc_id, concept, string_agg(term, ',' ORDER BY term) AS terms FROM (SELECT doc_id, lower(text) AS body FROM documents) JOIN terms ON contains(body, term) GROUP BY doc_id, concept""")
def concept_scores_dictionary(spark, folder):
    """Some hundred terms, three letters from names of parts under the name's initial, in whole texts."""
    names = [r[0] for r in table(spark, folder, "part").select(F.lower("p_name")).distinct().collect()]        # the dictionary
    terms = {(name[0], name[i:i + 3]) for name in names for i in range(len(name) - 2)}
    found = dictionary.tag_dictionary(table(spark, folder, "documents"), F.col("text"), terms, ["doc_id"])
    return found.select("doc_id", "concept", F.array_join("terms", ",").alias("terms"))
