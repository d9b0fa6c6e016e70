"""Character n-gram TF-IDF over titles and the terms that set a cluster apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.operators.ranking import top_n

# --- fixed values: n-gram range, vocabulary size, terms per cluster ---------------------------
NGRAM_MIN, NGRAM_MAX = 2, 4
CANDIDATE_TERMS, SHOWN_TERMS = 12, 6


def char_ngrams(text: Column, low: int = NGRAM_MIN, high: int = NGRAM_MAX) -> Column:
    """All in-word character n-grams of the lower-cased text, each word padded with one space."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1)))
        cut_out = F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.length(w) >= n, cut_out).otherwise(F.array().cast("array<string>"))

    def of_word(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, of_word))


def title_tfidf(titles: DataFrame, group: str, title: str, min_df: int | None = None,
                max_terms: int | None = None) -> DataFrame:
    """Normalised TF-IDF per distinct (group, title): (group, title, n, term, weight).

    Equal titles are counted once with their multiplicity ``n`` before any n-gram is built.  The
    vocabulary is what ``min_df`` leaves, or the ``max_terms`` most frequent of it if given.
    """
    distinct = titles.groupBy(group, F.coalesce(title, F.lit("")).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    # grouping by (group, title) already placed each title, so counting and the length need no shuffle
    tokens = distinct.select(group, "title", "n", F.explode(char_ngrams(F.col("title"))).alias("term")).groupBy(
        group, "title", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = titles.count()
    least = max(2, n_docs // 5000) if min_df is None else min_df
    terms = tokens.groupBy("term").agg(F.sum("n").alias("df"), F.sum(F.col("n") * F.col("tf")).alias("_cf")).where(F.col("df") >= least)
    if max_terms is not None:
        terms = terms.orderBy(F.col("_cf").desc(), "term").limit(max_terms)
    vocabulary = terms.select("term", (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tokens.join(vocabulary, "term").withColumn("_w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(group, "title")))
    return weighted.select(group, "title", "n", "term", (F.col("_w") / length).alias("weight"))


def distinctive_terms(titles: DataFrame, cluster: str = "cluster_id", title: str = "job_title",
                      min_df: int | None = None) -> DataFrame:
    """(cluster, top_terms): terms by cluster mean minus global mean, among terms that occur in the cluster."""
    n_docs = titles.count()
    sums = title_tfidf(titles, cluster, title, min_df).groupBy(cluster, "term").agg(
        F.sum(F.col("n") * F.col("weight")).alias("_s"))
    sizes = titles.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    overall = F.sum("_s").over(Window.partitionBy("term")) / F.lit(float(n_docs))
    lift = (sums.withColumn("_global", overall).where(F.col(cluster) != S.NOISE).join(sizes, cluster)
            .select(cluster, "term", F.round(F.col("_s") / F.col("_size") - F.col("_global"), 9).alias("lift")))
    best = top_n(lift, [cluster], [F.col("lift").desc(), F.col("term").asc()], CANDIDATE_TERMS, rank="rank")
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.trim("term").alias("term"))))
    shown = F.slice(F.filter(F.transform(ordered, lambda t: t.getField("term")), lambda t: F.length(t) >= 2), 1, SHOWN_TERMS)
    return best.groupBy(cluster).agg(F.array_join(shown, " ").alias("top_terms"))
