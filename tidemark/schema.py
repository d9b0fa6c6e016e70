"""Struct types of the landing rows, the posting table and the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.settings import CANONICAL_COLUMNS

# --- fixed values: the columns of a landed posting -------------------------------------------
SOURCE_COLUMNS = [
    "job_id", "job_title", "company_id", "company_name", "updated_at",
    "industry_id", "industry_name", "industry_bucket", "exp_code",
    "edu_codes", "major_codes", "city_name", "salary_desc", "description",
    "job_url", "is_happiness", "recruit_range",
]

_TYPED = {
    "updated_at": T.TimestampType(), "is_happiness": T.BooleanType(),
    "salary_min": T.DoubleType(), "salary_max": T.DoubleType(),
    "salary_month_min": T.DoubleType(), "description_len": T.LongType(),
}


#: every landing field as text, so list and integer fields keep their source spelling
LANDING = T.StructType([T.StructField(c, T.StringType()) for c in ["snapshot_date", *SOURCE_COLUMNS]])

POSTINGS = T.StructType([T.StructField(c, _TYPED.get(c, T.StringType())) for c in CANONICAL_COLUMNS])

#: fixed values: one fetched result page, nested hits plus the bucket and page that asked for them
HIT_PAGE = (
    "bucket string, page int, result struct<"
    "pagination: struct<page: int, `limit`: int, totalCount: bigint, totalPage: int>,"
    "hits: array<struct<jobId: string, title: string, companyId: string, companyName: string,"
    " updateAt: string, industry: struct<id: string, name: string>, workCity: struct<name: string>,"
    " `require`: struct<experience: string, grades: array<string>, majors: array<string>>,"
    " salary: string, description: string, isHappiness: string, recruitCountString: string>>>"
)

VECTORS = "snapshot_date string, job_id string, vec array<float>"

# --- fixed values: the columns of the derived tables ------------------------------------------
DERIVED = {
    "reference_labels": ("job_id string, cluster_id bigint"),
    "clusters": (
        "cluster_id bigint, kind string, label string, top_titles string, top_terms string, first_seen string"),
    "cluster_timeseries": ("snapshot_date string, cluster_id bigint, n bigint, share double"),
    "flow_category_cluster": (
        "category string, cluster_id bigint, n bigint, snapshot_date string, dimension string,"
        " share_in_category double"),
    "job_cluster": ("snapshot_date string, job_id string, cluster_id bigint, sim double"),
    "survival": (
        "from_snapshot string, to_snapshot string, dimension string, category string, n_from bigint,"
        " n_to bigint, n_survived bigint, n_gone bigint, n_added bigint, churn_rate double, renewal_rate double"),
    "cluster_flow": (
        "from_snapshot string, to_snapshot string, from_cluster bigint, to_cluster bigint, n bigint, kind string"),
    "company_shift": (
        "from_snapshot string, to_snapshot string, company_id string, company_name string, bucket_label string,"
        " industry_class string, n_from bigint, n_to bigint, cos_similarity double, shift_score double,"
        " from_cluster bigint, to_cluster bigint"),
    "assignment_stability": (
        "from_snapshot string, to_snapshot string, n_survivors bigint, n_comparable bigint,"
        " agreement double, noise_floor double"),
    "concept_scores": ("snapshot_date string, job_id string, concept string, anchor_similarity double"),
    "concept_summary": (
        "concept string, is_ai boolean, n bigint, share double, median_salary double, salary_premium double,"
        " salary_coverage double, median_desc_len double, anchor_sim_median double, anchor_sim_p99_all double,"
        " separation_sigma double"),
    "concept_examples": (
        "job_id string, job_title string, company_name string, bucket_label string, industry_class string,"
        " city_name string, salary_month_min double, job_url string, concept string, anchor_similarity double"),
    "concept_candidates": (
        "job_id string, job_title string, company_name string, bucket_label string, job_url string, concept string,"
        " anchor_similarity double"),
    "analysis_meta": ("key string, value string"),
    "concept_meta": ("key string, value string"),
}


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
