"""Concept detection by keyword, with anchor similarity as supporting evidence."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.functions.vectors import l2_normalize, mean_vector, similarities
from tidemark.operators.ranking import exact_quantiles, top_n
from tidemark.session import small_table

SEPARATION_GUARD = 1e-9
TIE_DIGITS = 9                 # similarities are ranked at this precision, so that equal vectors tie exactly


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode word boundaries."""
    return F.coalesce(text, F.lit("")).rlike("(?iU)" + pattern)


def anchor_sentences(spark: SparkSession, anchors: dict[str, list[str]] | None = None) -> DataFrame:
    """The dictionary's anchor sentences as rows to encode: (concept, text_for_embed)."""
    rows = [(c, s) for c, sentences in (anchors or S.CONCEPT_ANCHORS).items() for s in sentences]
    return small_table(spark, rows, "concept string, text_for_embed string")


def anchor_vectors(sentences: DataFrame, concept: str = "concept", vec: str = "vec") -> DataFrame:
    """One unit vector per concept: the renormalised mean of its normalised sentence vectors."""
    unit = sentences.select(concept, l2_normalize(F.col(vec)).alias("_u"))
    return unit.groupBy(concept).agg(l2_normalize(mean_vector(F.col("_u"))).alias("anchor"))


def collect_anchors(anchors: DataFrame, concepts: Iterable[str]) -> dict[str, list[float]]:
    """Anchors of the dictionary's concepts as plain lists; the dictionary bounds what is fetched."""
    names = list(concepts)
    return {r[0]: list(r[1]) for r in anchors.where(F.col("concept").isin(names)).select("concept", "anchor").collect()}


def tag_concepts(rows: DataFrame, text: Column, patterns: dict[str, str], anchors: dict[str, list[float]] | None = None,
                 vec: str = "vec") -> DataFrame:
    """Adds ``cells``: one (concept, hit, sim) struct per concept.  Works on batch and streaming frames."""
    scored = rows
    if anchors:
        names = [c for c in patterns if c in anchors]
        scored = rows.withColumn("_sims", similarities(F.col(vec), np.array([anchors[c] for c in names])))
        position = {c: i for i, c in enumerate(names)}
    cells = []
    for concept, pattern in patterns.items():
        has_anchor = bool(anchors) and concept in anchors
        sim = F.col("_sims")[position[concept]] if has_anchor else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(concept).alias("concept"), matches(text, pattern).alias("hit"), sim.alias("sim")))
    tagged = scored.withColumn("cells", F.array(*cells))
    return tagged.drop("_sims") if anchors else tagged


def concept_hits(tagged: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (row, concept) hit."""
    hits = F.filter("cells", lambda c: c.getField("hit"))
    return tagged.select(*columns, F.inline(hits)).drop("hit").withColumnRenamed("sim", "anchor_similarity")


def concept_summary(tagged: DataFrame, flagged: Iterable[str], pay: str = "salary_month_min",
                    length: str = "description_len") -> DataFrame:
    """Per concept: size, pay against everyone, description length and how well anchors separate the hits."""
    long = tagged.select(F.col(pay).cast("double").alias("_pay"), F.col(length).cast("double").alias("_len"),
                         F.inline("cells"))
    hit_pay = F.when(F.col("hit"), F.col("_pay"))
    base = long.groupBy("concept").agg(
        F.count(F.when(F.col("hit"), 1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("share"),
        F.count(hit_pay).alias("_paid"), F.avg("sim").alias("_mean"), F.stddev_pop("sim").alias("_std"))
    measures = long.select("concept", F.inline(F.filter(F.array(
        F.struct(F.lit("pay").alias("measure"), hit_pay.alias("x")),
        F.struct(F.lit("len").alias("measure"), F.when(F.col("hit"), F.col("_len")).alias("x")),
        F.struct(F.lit("sim").alias("measure"), F.when(F.col("hit"), F.col("sim")).alias("x")),
        F.struct(F.lit("all").alias("measure"), F.col("sim").alias("x"))), lambda m: m.getField("x").isNotNull())))
    levels = exact_quantiles(measures, ["concept", "measure"], "x", {"p50": 0.5, "p99": 0.99})
    wide = levels.groupBy("concept").agg(
        F.max(F.when(F.col("measure") == "pay", F.col("p50"))).alias("median_salary"),
        F.max(F.when(F.col("measure") == "len", F.col("p50"))).alias("median_desc_len"),
        F.max(F.when(F.col("measure") == "sim", F.col("p50"))).alias("anchor_sim_median"),
        F.max(F.when(F.col("measure") == "all", F.col("p99"))).alias("anchor_sim_p99_all"))
    everyone = exact_quantiles(tagged.select(F.col(pay).alias("_p")), [], "_p", {"_base": 0.5})
    flagged_list = list(flagged)
    joined = base.join(wide, "concept", "left").withColumn("_base", everyone.scalar())
    return joined.select(
        "concept", (F.col("concept").isin(flagged_list) if flagged_list else F.lit(False)).alias("is_ai"), "n", "share",
        "median_salary", F.try_divide("median_salary", "_base").alias("salary_premium"),
        (F.col("_paid") / F.greatest(F.col("n"), F.lit(1))).alias("salary_coverage"), "median_desc_len",
        "anchor_sim_median", "anchor_sim_p99_all",
        ((F.col("anchor_sim_median") - F.col("_mean")) / (F.col("_std") + SEPARATION_GUARD)).alias("separation_sigma"))


def concept_examples(tagged: DataFrame, columns: list[str], key: str, n: int = S.EXAMPLES_PER_CONCEPT,
                     hit: bool = True) -> DataFrame:
    """Per concept, the ``n`` hits (or non-hits) with the highest anchor similarity."""
    wanted = F.filter("cells", lambda c: c.getField("hit") == F.lit(hit))
    rows = tagged.select(key, *columns, F.inline(wanted)).drop("hit").withColumn(
        "anchor_similarity", F.round("sim", TIE_DIGITS)).drop("sim")
    return top_n(rows, ["concept"], [F.col("anchor_similarity").desc_nulls_last(), F.col(key).asc()], n)


def concept_candidates(tagged: DataFrame, columns: list[str], key: str, n: int = S.CANDIDATES_PER_CONCEPT) -> DataFrame:
    """Rows the keywords miss but anchors rank highest; for review only, never counted."""
    return concept_examples(tagged, columns, key, n, hit=False)


def concept_counts(scores: DataFrame, flagged: Iterable[str], key: str = "job_id") -> DataFrame:
    """Distinct ids with any concept and with a flagged concept (one row)."""
    per_id = scores.groupBy(key).agg(F.max(F.col("concept").isin(list(flagged))).alias("_ai"))
    return per_id.agg(F.count(F.lit(1)).alias("n_digital_jobs"), F.count(F.when(F.col("_ai"), 1)).alias("n_ai_jobs"))


def concept_cross(scores: DataFrame, postings: DataFrame, category: str, min_n: int = 1,
                  key: str = "job_id") -> DataFrame:
    """Concept by category; shares within a concept are taken over the cells that pass ``min_n``."""
    labelled = postings.select(key, F.col(category).cast("string").alias("category"))
    hits = scores.select(key, "concept").join(labelled, key).groupBy("concept", "category").agg(
        F.count(F.lit(1)).alias("n"))
    totals = labelled.groupBy("category").agg(F.count(F.lit(1)).alias("n_category"))
    kept = hits.where(F.col("n") >= min_n).join(totals, "category")
    return kept.select(
        "concept", "category", "n", "n_category",
        (F.col("n") / F.sum("n").over(Window.partitionBy("concept"))).alias("share_in_concept"),
        (F.col("n") / F.col("n_category")).alias("share_in_category"))


def concept_pay(scores: DataFrame, postings: DataFrame, pay: str = "salary_month_min", key: str = "job_id") -> DataFrame:
    """Pay quartiles per concept over rows with pay."""
    paid = scores.select(key, "concept").join(
        postings.where(F.col(pay).isNotNull()).select(key, F.col(pay).alias("_pay")), key)
    counts = paid.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    levels = exact_quantiles(paid, ["concept"], "_pay", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return counts.join(levels, "concept").select("concept", "n", "p50", "p25", "p75")


def concept_members(scores: DataFrame, postings: DataFrame, concept: str, columns: list[str], limit: int = 100,
                    key: str = "job_id") -> DataFrame:
    if limit > 1000:
        raise ValueError("limit is at most 1000")
    known = scores.where(F.col("concept") == concept).join(postings.select(key), key, "left_semi")
    even = known.withColumn("anchor_similarity", F.round("anchor_similarity", TIE_DIGITS))
    best = even.orderBy(F.col("anchor_similarity").desc(), key).limit(limit).select(key, "anchor_similarity")
    return best.join(postings.select(key, *columns), key)


def concept_pivot(cross: DataFrame, concepts: list[str], value: str = "n") -> DataFrame:
    """Category rows by concept columns, missing cells 0."""
    return cross.groupBy("category").pivot("concept", concepts).agg(F.first(value)).na.fill(0)


def keyword_vs_vector(tagged: DataFrame, key: str, top: int = 500) -> DataFrame:
    """Per concept: share of keyword hits among the ``top`` rows by anchor similarity, and whether the
    99th percentile of everyone exceeds the median of the hits."""
    long = tagged.select(key, F.inline("cells")).withColumn("sim", F.round("sim", TIE_DIGITS))
    totals = long.groupBy("concept").agg(F.count(F.when(F.col("hit"), 1)).alias("n_hits"))
    ranked = top_n(long, ["concept"], [F.col("sim").desc_nulls_last(), F.col(key).asc()], top)
    found = ranked.groupBy("concept").agg(F.count(F.when(F.col("hit"), 1)).alias("n_found"))
    measures = long.select("concept", F.inline(F.filter(F.array(
        F.struct(F.lit("hit").alias("measure"), F.when(F.col("hit"), F.col("sim")).alias("x")),
        F.struct(F.lit("all").alias("measure"), F.col("sim").alias("x"))), lambda m: m.getField("x").isNotNull())))
    levels = exact_quantiles(measures, ["concept", "measure"], "x", {"p50": 0.5, "p99": 0.99}).groupBy("concept").agg(
        F.max(F.when(F.col("measure") == "hit", F.col("p50"))).alias("median_hits"),
        F.max(F.when(F.col("measure") == "all", F.col("p99"))).alias("p99_all"))
    return totals.join(found, "concept").join(levels, "concept").select(
        "concept", "n_hits", "n_found", F.try_divide("n_found", "n_hits").alias("recall_at_top"), "median_hits",
        "p99_all", (F.col("p99_all") > F.col("median_hits")).alias("p99_beats_hits"))


def headline_metrics(series: DataFrame, summary: DataFrame, snapshot_label: str) -> DataFrame:
    """One row: largest cluster share, share of the ten largest, mean premium of flagged concepts (nulls skipped)."""
    shares = series.where((F.col("snapshot_date") == snapshot_label) & (F.col("cluster_id") != S.NOISE))
    ten = shares.orderBy(F.col("share").desc(), "cluster_id").limit(10)
    premium = summary.where("is_ai").agg(F.avg("salary_premium"))
    return ten.agg(F.max("share").alias("max_share"), F.sum("share").alias("top10_share")).withColumn(
        "mean_ai_premium", premium.scalar())
