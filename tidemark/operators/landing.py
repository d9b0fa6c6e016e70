"""Landing: nested hits to flat rows, first-seen dedupe, per-bucket cap, resume state, snapshot ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import latest_per_key, top_n


def flatten_hits(pages: DataFrame, snapshot: str, url_prefix: str = "", url_suffix: str = "/") -> DataFrame:
    """One landing row per hit of a result page (``schema.HIT_PAGE``); array fields become JSON text."""
    hits = pages.select("bucket", "page", F.posexplode("result.hits").alias("pos", "hit"))
    empty = F.lit("[]")
    return hits.select(
        F.lit(snapshot).alias("snapshot_date"),
        F.col("hit.jobId").alias("job_id"),
        F.col("hit.title").alias("job_title"),
        F.col("hit.companyId").alias("company_id"),
        F.col("hit.companyName").alias("company_name"),
        F.col("hit.updateAt").alias("updated_at"),
        F.col("hit.industry.id").alias("industry_id"),
        F.col("hit.industry.name").alias("industry_name"),
        F.col("bucket").alias("industry_bucket"),
        F.col("hit.require.experience").alias("exp_code"),
        F.coalesce(F.to_json("hit.require.grades"), empty).alias("edu_codes"),
        F.coalesce(F.to_json("hit.require.majors"), empty).alias("major_codes"),
        F.col("hit.workCity.name").alias("city_name"),
        F.col("hit.salary").alias("salary_desc"),
        F.coalesce("hit.description", F.lit("")).alias("description"),
        F.concat(F.lit(url_prefix), F.col("hit.jobId"), F.lit(url_suffix)).alias("job_url"),
        F.coalesce("hit.isHappiness", F.lit("false")).alias("is_happiness"),
        F.col("hit.recruitCountString").alias("recruit_range"),
        "page", "pos",
    )


def first_seen(rows: DataFrame, key: str | list[str], arrival: list[Column], landed: DataFrame | None = None) -> DataFrame:
    """First arrival of each key across all buckets; blank keys and keys already landed are dropped."""
    keys = [key] if isinstance(key, str) else key
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    fresh = latest_per_key(rows.where(present), keys, arrival)
    return fresh.join(landed.select(*keys).distinct(), keys, "left_anti") if landed is not None else fresh


def cap_per_bucket(rows: DataFrame, bucket: str, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows per bucket, in arrival order."""
    return top_n(rows, [bucket], order, cap)


def bucket_counts(landing: DataFrame, bucket: str = "industry_bucket") -> DataFrame:
    return landing.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def pending_pages(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of the work list that are not finished yet."""
    return work.join(finished.select(*keys).distinct(), keys, "left_anti")


def read_progress(markers: DataFrame) -> DataFrame:
    """Progress markers ``{"pages": ["bucket|page"], "complete": bool}`` as (bucket, page, complete)."""
    page = F.explode_outer("pages").alias("_page")
    split = F.split("_page", r"\|")
    return markers.select("complete", page).select(
        F.try_element_at(split, F.lit(1)).alias("bucket"),
        F.try_element_at(split, F.lit(2)).try_cast("int").alias("page"), "complete")


def snapshot_ledger(landing: DataFrame, ingested: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """Per snapshot: rows landed, rows ingested, and whether landing is marked complete."""
    counts = [
        df.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias(name))
        for df, name in ((landing, "n_landed"), (ingested, "n_ingested"))]
    ledger = counts[0].join(counts[1], "snapshot_date", "full_outer")
    if completed is None:
        ledger = ledger.withColumn("complete", F.lit(False))
    else:
        flags = completed.groupBy("snapshot_date").agg(F.max("complete").alias("complete"))
        ledger = ledger.join(flags, "snapshot_date", "full_outer")
    return ledger.select(
        "snapshot_date", F.coalesce("n_landed", F.lit(0)).alias("n_landed"),
        F.coalesce("complete", F.lit(False)).alias("complete"),
        F.coalesce("n_ingested", F.lit(0)).alias("n_ingested"))
