"""Cleaning over documents (B5), order texts (B6), pages (B8) and yearly snapshots (B1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import (
    DOCUMENTS, ORDER_TEXTS, YEARLY, documents, order_texts, rounded, table, yearly)
from checks.registry import check
from tidemark.functions import coerce, pay, text
from tidemark.operators import clean

# The tables hold no other entity and no character that NFKC changes; the unit tests cover those.


def _clean_sql(column: str) -> str:
    s = column
    for pattern, out in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&"),
                         ("<[^>]{1,200}>", " "), ("[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2190}-\\x{21FF}]", " "),
                         ("[※★☆◆◇■□●○▲△▼▽*=＝_－—–\\-~～·・]{3,}", " "),
                         ("(?m)^[\\s\\d]{0,4}[.、)）:：]\\s*", ""), ("\\s+", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{out}', 'g')"
    return f"trim({s})"


@check("normalize_text", f"""SELECT doc_id, {_clean_sql("text")} AS cleaned,
  CAST(length({_clean_sql("text")}) AS BIGINT) AS description_len FROM documents""")
def normalize_text(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("cleaned"))
    return rows.withColumn("description_len", F.length("cleaned").cast("long"))


@check("normalize_html", f"SELECT page_id, {_clean_sql('html')} AS cleaned FROM pages")
def normalize_html(spark, folder):
    return table(spark, folder, "pages").select("page_id", text.normalize_text(F.col("html")).alias("cleaned"))


_KEPT = f"""c AS (SELECT job_id, {_clean_sql("job_title")} AS job_title, company_name, industry_name,
  {_clean_sql("description")} AS description FROM d),
m AS (SELECT *, regexp_full_match(job_title, '(?i)\\s*(測試|test|測試職缺)?\\s*') OR length(description) < 10 AS bad FROM c)"""


def _marked(spark, folder):
    return documents(spark, folder).withColumns({
        "job_title": text.normalize_text(F.col("job_title")), "description": text.normalize_text(F.col("description"))
    }).withColumn("_defect", clean.has_defect(F.col("job_title"), F.length("description")))


@check("hard_defect_filter", f"WITH {DOCUMENTS}, {_KEPT} SELECT job_id, job_title FROM m WHERE NOT bad")
def hard_defect_filter(spark, folder):
    return _marked(spark, folder).where("NOT _defect").select("job_id", "job_title")


@check("ingest_audit", f"""WITH {DOCUMENTS}, u AS (SELECT any_value(job_title) AS t, description FROM d GROUP BY description),
x AS (SELECT {_clean_sql("description")} AS description FROM u)
SELECT (SELECT count(*) FROM d) AS n_read, (SELECT count(*) FROM d) - count(*) AS n_stale,
       count(*) FILTER (length(description) < 10) AS n_dropped, count(*) FILTER (length(description) >= 10) AS n_kept,
       round(count(*) FILTER (length(description) >= 10) / (SELECT count(*) FROM d), 6) AS keep_rate FROM x""")
def ingest_audit(spark, folder):
    """Exact copies count as stale versions; the title plays no part here."""
    raw = documents(spark, folder)
    unique = clean.drop_stale_versions(raw.withColumn("updated_at", F.lit(None).cast("timestamp")), "description")
    cleaned = unique.withColumn("description", text.normalize_text(F.col("description")))
    marked = cleaned.withColumn("_defect", clean.has_defect(F.lit("title"), F.length("description")))
    return rounded(clean.ingest_audit(raw, marked))


@check("embed_text", f"""WITH {DOCUMENTS}
SELECT job_id, trim(job_title || '。' || job_title || '。' || industry_name || '。' || description,
                    ' ' || chr(10)) AS text_for_embed FROM d""")
def embed_text(spark, folder):
    built = text.embedding_text(F.col("job_title"), F.col("industry_name"), F.col("description"))
    return documents(spark, folder).select("job_id", built.alias("text_for_embed"))


@check("clean_label", f"""WITH {DOCUMENTS},
a AS (SELECT job_id, regexp_replace(regexp_replace(job_title, '[（(【\\[［].{{0,40}}?[）)】\\]］]', '', 'g'),
                                    '^[^\\p{{L}}\\p{{N}}]+', '') AS t FROM d),
b AS (SELECT job_id, t, list_filter(list_transform(regexp_split_to_array(
        regexp_replace(t, '[-–—](\\S)', '/\\1', 'g'), '[/|｜・‧,，、~～]'), lambda p: trim(p)), lambda p: length(p) >= 2) AS parts FROM a)
SELECT job_id, substr(regexp_replace(trim(coalesce(parts[1], t)), '[^\\p{{L}}\\p{{N}}]+$', ''), 1, 16) AS label FROM b""")
def clean_label(spark, folder):
    return documents(spark, folder).select("job_id", text.clean_title(F.col("job_title")).alias("label"))


@check("timestamp_coerce", f"""WITH {ORDER_TEXTS}
SELECT o_orderkey, strftime(CASE WHEN stamp_text LIKE '%/%' THEN try_strptime(stamp_text, '%Y/%m/%d %H:%M:%S')
  ELSE try_strptime(stamp_text, '%Y-%m-%d') END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM t""")
def timestamp_coerce(spark, folder):
    parsed = coerce.to_timestamp(F.col("stamp_text"))
    return order_texts(spark, folder).select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@check("bool_coerce", f"WITH {ORDER_TEXTS} SELECT o_orderkey, lower(flag_text) IN ('true', '1') AS is_happiness FROM t")
def bool_coerce(spark, folder):
    return order_texts(spark, folder).select("o_orderkey", coerce.to_boolean(F.col("flag_text")).alias("is_happiness"))


_PAID = """x AS (SELECT o_orderkey, regexp_extract(pay_text, '月薪|年薪|時薪|日薪|論件計酬|面議', 0) AS found,
  list_filter(list_transform(regexp_extract_all(pay_text, '[0-9,]{3,}'),
              lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE)), lambda v: v >= 100) AS nums FROM t),
y AS (SELECT o_orderkey, found, CASE WHEN found <> '面議' AND len(nums) > 0 THEN nums END AS nums FROM x),
paid AS (SELECT o_orderkey, NULLIF(found, '') AS kind, list_min(nums) AS lo,
  CASE WHEN len(nums) > 1 THEN list_max(nums) END AS hi,
  round_even(list_min(nums) * CASE found WHEN '月薪' THEN 1.0::DOUBLE WHEN '年薪' THEN 1::DOUBLE / 12
                                         WHEN '時薪' THEN 176.0::DOUBLE WHEN '日薪' THEN 22.0::DOUBLE END, 0) AS month_min FROM y)"""


@check("pay_extract", f"WITH {ORDER_TEXTS}, {_PAID} SELECT * FROM paid")
def pay_extract(spark, folder):
    return order_texts(spark, folder).select("o_orderkey", pay.parse_pay(F.col("pay_text")).alias("p")).select("o_orderkey", "p.*")


@check("canonical_projection", f"""WITH {ORDER_TEXTS}, {_PAID}
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, coalesce(kind, '') AS salary_type, lo AS salary_min, hi AS salary_max,
       month_min AS salary_month_min, lower(flag_text) IN ('true', '1') AS is_happiness, trim(pay_text) AS salary_desc,
       '未分類' AS industry_class, CAST(length(pay_text) AS BIGINT) AS description_len
FROM t JOIN paid USING (o_orderkey)""")
def canonical_projection(spark, folder):
    """The whole cleaning chain over order texts as postings, cut to the columns that vary."""
    landing = order_texts(spark, folder).select(
        F.col("o_orderkey").alias("job_id"), F.lit("item").alias("job_title"), F.col("pay_text").alias("salary_desc"),
        F.concat(F.lit("0123456789"), F.col("pay_text")).alias("description"), F.col("flag_text").alias("is_happiness"))
    rows = clean.canonical_projection(clean.clean_postings(landing, "s1"))
    return rows.select(
        "job_id", "salary_type", "salary_min", "salary_max", "salary_month_min", "is_happiness", "salary_desc",
        "industry_class", (F.col("description_len") - 10).alias("description_len"))


@check("column_align_union", f"""WITH {YEARLY}
SELECT job_id, snapshot_date, priority, NULL::VARCHAR AS segment FROM b1 WHERE snapshot_date < '1998'
UNION ALL SELECT job_id, snapshot_date, NULL, segment FROM b1 WHERE snapshot_date >= '1998'""")
def column_align_union(spark, folder):
    b1 = yearly(spark, folder)
    old = b1.where("snapshot_date < '1998'").select("job_id", "snapshot_date", "priority")
    new = b1.where("snapshot_date >= '1998'").select("job_id", "snapshot_date", "segment")
    return clean.align_columns(clean.align_and_union([old, new]), ["segment", "priority"]).select(
        "job_id", "snapshot_date", "priority", "segment")


@check("lookup_class", f"""WITH {YEARLY}, n AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name FROM nation WHERE n_nationkey <= 20)
SELECT snapshot_date, job_id, coalesce(n_name, '未分類') AS industry_class
FROM b1 LEFT JOIN n ON k = CAST(company_id AS VARCHAR)""")
def lookup_class(spark, folder):
    names = table(spark, folder, "nation").where("n_nationkey <= 20")
    out = clean.join_lookup(yearly(spark, folder), "company_id", names, "n_nationkey", "n_name", "industry_class", "未分類")
    return out.select("snapshot_date", "job_id", "industry_class")


@check("lookup_bucket_passthrough", f"""WITH {YEARLY}, n AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name FROM nation WHERE n_nationkey <= 20)
SELECT snapshot_date, job_id, coalesce(n_name, CAST(company_id AS VARCHAR), '未分類') AS bucket_label
FROM b1 LEFT JOIN n ON k = CAST(company_id AS VARCHAR)""")
def lookup_bucket_passthrough(spark, folder):
    names = table(spark, folder, "nation").where("n_nationkey <= 20")
    out = clean.join_lookup(yearly(spark, folder), "company_id", names, "n_nationkey", "n_name", "bucket_label", "未分類", True)
    return out.select("snapshot_date", "job_id", "bucket_label")


@check("finite_or_null", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / NULLIF(l_discount, 0), 6) AS ratio FROM lineitem""")
def finite_or_null(spark, folder):
    lines = table(spark, folder, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_extendedprice", "l_discount"))
    return rounded(lines.select("l_orderkey", "l_linenumber", coerce.finite_or_null(ratio).alias("ratio")))
