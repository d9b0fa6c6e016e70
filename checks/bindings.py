"""The operators' inputs derived from the given tables, in Spark and in the same words as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import latest_per_key
from tidemark.session import checkpoint_dir, spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df      # CPU-bound text work


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the session's checkpoints, for queries that write and read back."""
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def r6(column: str) -> Column:
    return F.round(F.col(column), 6).alias(column)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places.  Values that were rounded before keep all their places (9 or 12 here):
    rounding a rounded value again would put it on a half, where engines differ."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- B1: the latest order of each customer in each year ---------------------------------------
def yearly(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("snapshot_date", F.date_format("o_orderdate", "yyyy"))
    latest = latest_per_key(orders, ["o_custkey", "snapshot_date"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    joined = latest.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    digit = F.substring("o_orderpriority", 1, 1).cast("long")
    late = (F.col("o_orderkey") % 50 == 0) & (F.col("snapshot_date") >= "1997")
    return joined.select(
        "snapshot_date", F.col("o_custkey").cast("string").alias("job_id"), F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("company_id"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("pay"),
        F.when(late, F.lit(9).cast("long")).when(F.col("o_orderpriority") == "5-LOW", F.lit(-1).cast("long"))
        .otherwise(digit).alias("cluster_id"),
        (F.col("c_acctbal") / 10000).alias("sim"))


YEARLY = """b1 AS (
  SELECT strftime(o_orderdate, '%Y') AS snapshot_date, CAST(o_custkey AS VARCHAR) AS job_id,
         o_orderpriority AS priority, c_mktsegment AS segment, c_nationkey AS company_id,
         CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS pay,
         CASE WHEN o_orderkey % 50 = 0 AND year(o_orderdate) >= 1997 THEN CAST(9 AS BIGINT)
              WHEN o_orderpriority = '5-LOW' THEN CAST(-1 AS BIGINT)
              ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS cluster_id,
         c_acctbal / 10000 AS sim
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate)
                                     ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
  JOIN customer ON c_custkey = o_custkey WHERE rn = 1)"""

PRIORITY_SEGMENT = {"priority": "priority", "segment": "segment"}

LONG = """long AS (
  SELECT snapshot_date, job_id, cluster_id, 'priority' AS dimension, priority AS category FROM b1
  UNION ALL SELECT snapshot_date, job_id, cluster_id, 'segment', segment FROM b1)"""

PAIRS = """axis AS (SELECT DISTINCT snapshot_date FROM b1),
pairs AS (SELECT * FROM (SELECT snapshot_date AS from_snapshot,
            lead(snapshot_date) OVER (ORDER BY snapshot_date) AS to_snapshot FROM axis)
          WHERE to_snapshot IS NOT NULL)"""

SERIES = """series AS (
  SELECT snapshot_date, cluster_id, count(*) AS n,
         count(*) / sum(count(*)) OVER (PARTITION BY snapshot_date) AS share FROM b1 GROUP BY 1, 2)"""

CATALOG = """catalog AS (
  SELECT cluster_id, 'C' || CAST(cluster_id AS VARCHAR) AS label, min(snapshot_date) AS first_seen
  FROM b1 WHERE cluster_id <> -1 GROUP BY 1)"""


def yearly_catalog(b1: DataFrame) -> DataFrame:
    return b1.where(F.col("cluster_id") != -1).groupBy("cluster_id").agg(
        F.min("snapshot_date").alias("first_seen")).select(
        "cluster_id", F.concat(F.lit("C"), F.col("cluster_id").cast("string")).alias("label"), "first_seen")


# --- B2: embeddings as two overlapping snapshots, split by label ------------------------------
def vector_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Early snapshot: labels 0-6; late snapshot: labels 3-9.  Label 5 plays noise."""
    base = table(spark, folder, "embeddings")
    labels = F.when(F.col("label") <= 6, F.array(F.lit("s1"))).otherwise(F.array().cast("array<string>"))
    later = F.when(F.col("label") >= 3, F.array(F.lit("s2"))).otherwise(F.array().cast("array<string>"))
    return base.select(
        F.explode(F.concat(labels, later)).alias("snapshot_date"), F.col("vec_id").alias("job_id"),
        F.col("embedding").alias("vec"), F.when(F.col("label") == 5, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"),
        (F.col("vec_id") % 21).alias("company_id"), (F.col("vec_id") % 4).cast("string").alias("bucket"))


VECTOR_SNAPSHOTS = """v AS (
  SELECT s.snapshot_date, vec_id AS job_id, CAST(embedding AS DOUBLE[]) AS vec,
         CAST(CASE WHEN label = 5 THEN -1 ELSE label END AS BIGINT) AS cluster_id,
         vec_id % 21 AS company_id, CAST(vec_id % 4 AS VARCHAR) AS bucket
  FROM embeddings JOIN (VALUES ('s1'), ('s2')) s(snapshot_date)
    ON (s.snapshot_date = 's1' AND label <= 6) OR (s.snapshot_date = 's2' AND label >= 3))"""


# --- B3: events as arriving hits --------------------------------------------------------------
def event_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a fetched page with one hit; the same (user, type) arrives many times."""
    none = F.lit(None).cast("string")
    hit = F.struct(
        F.concat_ws("-", "user_id", "event_type").alias("jobId"), F.col("event_type").alias("title"),
        F.col("user_id").cast("string").alias("companyId"), none.alias("companyName"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("updateAt"),
        F.struct(F.get_json_object("props", "$.k").alias("id"), none.alias("name")).alias("industry"),
        F.struct(none.alias("name")).alias("workCity"),
        F.struct(none.alias("experience"), F.array(F.col("event_type")).alias("grades"),
                 F.lit(None).cast("array<string>").alias("majors")).alias("require"),
        F.format_number("value", 2).alias("salary"), none.alias("description"), none.alias("isHappiness"),
        none.alias("recruitCountString"))
    one = F.lit(1)
    paging = F.struct(F.col("event_id").cast("int").alias("page"), one.alias("limit"),
                      one.cast("long").alias("totalCount"), one.alias("totalPage"))
    return table(spark, folder, "events").select(
        F.col("event_type").alias("bucket"), F.col("event_id").cast("int").alias("page"),
        F.struct(paging.alias("pagination"), F.array(hit).alias("hits")).alias("result"))


# --- B4: parts as titled, priced items with vectors -------------------------------------------
PART_CONCEPTS = {
    "widget": r"\bwidget\b", "gears": r"\b(gear|gizmo)\b", "ring": r"\bring\b", "anvil": r"\banvil\b",
    "bolt": r"\bbolt\b", "temperature": r"\b(hot|cold)\b", "color": r"\b(red|blue)\b", "small": r"\bsmall\b"}
PART_FLAGGED = ("widget", "gears", "ring")


def parts(spark: SparkSession, folder: str, vectors: bool = False) -> DataFrame:
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("job_id"), F.col("p_name").alias("job_title"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 6 != 0, F.col("p_retailprice")).alias("salary_month_min"),
        F.length("p_name").cast("long").alias("description_len"))
    if not vectors:
        return rows
    stored = table(spark, folder, "embeddings")
    size = stored.agg(F.count(F.lit(1)).alias("size")).scalar()
    return rows.withColumn("_size", size).withColumn("_vec", F.col("job_id") % F.col("_size")).join(
        stored.select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("vec"),
                      F.col("label").cast("long").alias("cluster_id")), "_vec").drop("_vec", "_size")


PARTS = """p AS (
  SELECT p_partkey AS job_id, p_name AS job_title, p_type AS category, p_brand AS brand,
         CASE WHEN p_size % 6 <> 0 THEN p_retailprice END AS salary_month_min,
         CAST(length(p_name) AS BIGINT) AS description_len,
         CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS cluster_id
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""

_VALUES = ", ".join(f"('{c}', '(?i){pattern}', {i})" for i, (c, pattern) in enumerate(PART_CONCEPTS.items()))
CONCEPTS = f"""k AS (SELECT * FROM (VALUES {_VALUES}) t(concept, pattern, label)),
hits AS (SELECT concept, p.* FROM p JOIN k ON regexp_matches(job_title, pattern))"""

#: the anchor of concept i is the renormalised mean of the vectors with label i
ANCHORS = """u AS (
  SELECT label, vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
un AS (SELECT label, vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM u),
m AS (SELECT label, i, avg(x) AS x FROM un GROUP BY 1, 2),
a AS (SELECT label, list(x ORDER BY i) AS raw, sqrt(sum(x * x)) AS len FROM m GROUP BY 1),
anchors AS (SELECT concept, pattern, list_transform(raw, lambda y: y / len) AS anchor FROM a JOIN k USING (label)),
cells AS (SELECT p.*, concept, regexp_matches(job_title, pattern) AS hit, list_dot_product(vec, anchor) AS sim
          FROM p, anchors)"""


# --- B5: documents as postings ----------------------------------------------------------------
def documents(spark: SparkSession, folder: str) -> DataFrame:
    first_line = F.substring_index("text", "\n", 1)
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("job_id"), first_line.alias("job_title"),
        F.col("source").alias("company_name"), F.col("source").alias("company_id"),
        F.col("lang").alias("industry_bucket"), F.col("lang").alias("industry_name"), F.col("text").alias("description"))


DOCUMENTS = """d AS (
  SELECT CAST(doc_id AS VARCHAR) AS job_id, split_part(text, chr(10), 1) AS job_title,
         source AS company_name, source AS company_id, lang AS industry_bucket, lang AS industry_name,
         text AS description FROM documents)"""


# --- B6: texts made from orders, for parsing --------------------------------------------------
def order_texts(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("月薪", "年薪", "時薪", "日薪", "論件計酬", "面議", "")])
    amount = F.format_number(F.floor("o_totalprice"), 0)
    second = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("~"), F.format_number(F.floor("o_totalprice") * 2, 0)))
    return spread(table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")).select(
        "o_orderkey",
        F.concat(F.element_at(kinds, (F.col("o_orderkey") % 7 + 1).cast("int")), F.lit(" "), amount,
                 F.coalesce(second, F.lit("")), F.lit("元")).alias("pay_text"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("bad").alias("stamp_text"),
        F.element_at(F.array(F.lit("True"), F.lit("1"), F.lit("false"), F.lit("")),
                     (F.col("o_orderkey") % 4 + 1).cast("int")).alias("flag_text"))


ORDER_TEXTS = """t AS (
  SELECT o_orderkey,
         ['月薪', '年薪', '時薪', '日薪', '論件計酬', '面議', ''][o_orderkey % 7 + 1] || ' '
           || format('{:,}', CAST(floor(o_totalprice) AS BIGINT))
           || CASE WHEN o_orderkey % 2 = 0 THEN '~' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT) * 2) ELSE '' END
           || '元' AS pay_text,
         CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')
              WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'bad' END AS stamp_text,
         ['True', '1', 'false', ''][o_orderkey % 4 + 1] AS flag_text
  FROM orders)"""
