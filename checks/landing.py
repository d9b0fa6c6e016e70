"""Landing, streaming and gap audits over events (B3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.bindings import YEARLY, event_pages, rounded, scratch, table, yearly
from checks.registry import check
from tidemark.operators import gaps, landing
from tidemark.session import cut, small_table
from tidemark.sources import readers, tables
from tidemark.streaming import stateful
from tidemark.streaming.landing import land_stream, page_stream

_FLAT = """flat AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS job_id, event_type AS industry_bucket,
         CAST(user_id AS VARCHAR) AS company_id, json_extract_string(props, '$.k') AS industry_id,
         '["' || event_type || '"]' AS edu_codes, '[]' AS major_codes,
         'https://jobs.example/' || CAST(user_id AS VARCHAR) || '-' || event_type || '/' AS job_url,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at, 'false' AS is_happiness, '' AS description, event_id AS page
  FROM events)"""
_COLUMNS = ["job_id", "industry_bucket", "company_id", "industry_id", "edu_codes", "major_codes", "job_url", "updated_at",
            "is_happiness", "description", "page"]
_FIRST = "SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY industry_bucket, page) = 1"
_ARRIVAL = ("industry_bucket", "page", "pos")


def _columns():
    return [F.col(c).cast("long").alias(c) if c == "page" else F.col(c) for c in _COLUMNS]


def _flat(spark, folder):
    return landing.flatten_hits(event_pages(spark, folder), "2024-01", "https://jobs.example/")


@check("landing_flatten", f"WITH {_FLAT} SELECT * FROM flat")
def landing_flatten(spark, folder):
    return _flat(spark, folder).select(*_columns())


@check("landing_first_seen", f"WITH {_FLAT} {_FIRST}")
def landing_first_seen(spark, folder):
    return landing.first_seen(_flat(spark, folder), "job_id", [F.col(c) for c in _ARRIVAL]).select(*_columns())


@check("stream_landing", f"WITH {_FLAT} {_FIRST}")
def stream_landing(spark, folder):
    """The same rows through JSON files and a stream that stops when the files are used up."""
    base = scratch(spark)
    event_pages(spark, folder).write.json(f"{base}/pages")
    rows = landing.flatten_hits(page_stream(spark, f"{base}/pages"), "2024-01", "https://jobs.example/")
    land_stream(rows, f"{base}/landed", f"{base}/state", arrival=_ARRIVAL).awaitTermination()
    return spark.read.parquet(f"{base}/landed").select(*_columns())


@check("stream_landing_stateful", f"WITH {_FLAT} {_FIRST}")
def stream_landing_stateful(spark, folder):
    """Three batches in the order of arrival; keys are remembered by the state store."""
    base = scratch(spark)
    files = _in_turn(spark, event_pages(spark, folder), ["bucket", "page"], f"{base}/pages", 3, "json")
    rows = landing.flatten_hits(page_stream(spark, f"{base}/pages", files), "2024-01", "https://jobs.example/")
    stateful.land_stream_stateful(rows, f"{base}/landed", f"{base}/state", arrival=_ARRIVAL).awaitTermination()
    return spark.read.parquet(f"{base}/landed").select(*_columns())


#: rows of one file of a slice
_FILE_ROWS = 1 << 18


def _in_turn(spark, rows: DataFrame, order: list[str], path: str, n: int, kind: str) -> int:
    """``rows`` in ``n`` slices as ``ntile`` over ``order`` cuts them, written under ``path``; the number of files of each slice.

    A file has at most ``_FILE_ROWS`` rows, a slice the same number of files as the others, dated one after the other as a stream reads them.
    Rows get their places within ranges of the order, so no task sorts or writes a whole slice.
    """
    ranged = cut(rows.repartitionByRange(max(1, -(-rows.count() // _FILE_ROWS)), *order).withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in sorted(sizes):
        before.append((i, total))
        total += sizes[i]
    files = max(1, -(-(-(-total // n)) // _FILE_ROWS))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    short, longer = divmod(total, n)                        # the first slices have one row more
    edge = F.lit(longer * (short + 1))
    at = F.when(F.col("_place") < edge, F.col("_place")).otherwise(F.col("_place") - edge)
    size = F.when(F.col("_place") < edge, F.lit(short + 1)).otherwise(F.lit(max(short, 1)))
    slice_ = F.floor(at / size) + F.when(F.col("_place") < edge, 0).otherwise(longer)
    file = F.floor(at % size * files / size)
    dealt = ranged.join(F.broadcast(small_table(spark, before, "_range int, _before bigint")), "_range").withColumn("_place", place).withColumn(
        "_file", (slice_ * files + file).cast("int")).select("_file", *rows.columns)
    dealt.repartition(n * files, "_file").write.partitionBy("_file").format(kind).save(f"{path}-dealt")
    fs, to = tables._fs(spark, path)
    fs.mkdirs(to)
    empty = spark.createDataFrame([], rows.schema)
    for i in range(n * files):
        folder = tables._fs(spark, f"{path}-dealt/_file={i}")[1]
        if not fs.exists(folder):                           # fewer rows than slices
            empty.coalesce(1).write.format(kind).save(f"{path}-none-{i}")
            folder = tables._fs(spark, f"{path}-none-{i}")[1]
        for name in [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]:
            target = tables._fs(spark, f"{path}/{i:06d}.{kind}")[1]
            fs.rename(name, target)
            fs.setTimes(target, 1_700_000_000_000 + i * 1000, -1)
    return files


@check("category_cap", """
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 100""")
def category_cap(spark, folder):
    rows = table(spark, folder, "events")
    return landing.cap_per_bucket(rows, "event_type", [F.col("ts"), F.col("event_id")], 100).select("event_type", "event_id")


@check("category_cap_large", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag
  ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) <= 4500""")
def category_cap_large(spark, folder):
    """A cap over few, large buckets: the salted first pass."""
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return landing.cap_per_bucket(table(spark, folder, "lineitem"), "l_returnflag", order, 4500).select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@check("bucket_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def bucket_counts(spark, folder):
    return landing.bucket_counts(table(spark, folder, "events"), "event_type")


@check("resume_antijoin", """
WITH work AS (SELECT DISTINCT event_type AS bucket, CAST(user_id AS INTEGER) AS page FROM events),
done AS (SELECT DISTINCT event_type AS bucket, CAST(user_id AS INTEGER) AS page FROM events WHERE ts < TIMESTAMP '2024-01-04')
SELECT bucket, page FROM work ANTI JOIN done USING (bucket, page)""")
def resume_antijoin(spark, folder):
    """Work list of (type, user) against the markers of the first three days."""
    events = table(spark, folder, "events")
    work = events.select(F.col("event_type").alias("bucket"), F.col("user_id").cast("int").alias("page")).distinct()
    marks = events.where("ts < timestamp_ntz'2024-01-04'").select(
        F.array(F.concat_ws("|", "event_type", "user_id")).alias("pages"), F.lit(False).alias("complete"))
    return landing.pending_pages(work, landing.read_progress(marks), ["bucket", "page"])


@check("snapshot_ledger", f"""WITH {YEARLY}
SELECT y AS snapshot_date, landed AS n_landed, y < '2001' AS complete, coalesce(n, 0) AS n_ingested FROM
 (SELECT strftime(o_orderdate, '%Y') AS y, count(*) AS landed FROM orders GROUP BY 1)
 LEFT JOIN (SELECT snapshot_date, count(*) AS n FROM b1 WHERE snapshot_date <> '1999' GROUP BY 1) ON y = snapshot_date""")
def snapshot_ledger(spark, folder):
    landed = table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy").alias("snapshot_date"))
    done = landed.select("snapshot_date", (F.col("snapshot_date") < "2001").alias("complete"))
    return landing.snapshot_ledger(landed, yearly(spark, folder).where("snapshot_date <> '1999'"), done)


@check("json_landing", "SELECT CAST(event_id AS VARCHAR) AS job_id, event_type AS job_title, '2024-01' AS snapshot_date FROM events")
def json_landing(spark, folder):
    path = f"{scratch(spark)}/rows"
    table(spark, folder, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("job_title")).write.json(path)
    return readers.read_json_landing(spark, path, "2024-01").select("job_id", "job_title", "snapshot_date")


@check("csv_landing", """
SELECT CAST(doc_id AS VARCHAR) AS job_id, text AS description, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS industry_bucket,
       '2024-01' AS snapshot_date FROM documents""")
def csv_landing(spark, folder):
    """Whole multi-line texts through quoted CSV; empty fields stay empty text."""
    path = f"{scratch(spark)}/rows"
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("description"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("industry_bucket"))
    rows.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_csv_landing(spark, path, "2024-01", rows.columns).select(
        "job_id", "description", "industry_bucket", "snapshot_date")


# --- gaps -------------------------------------------------------------------------------------
_GAPS = """g AS (SELECT ts, event_id, event_type, lag(event_type) OVER w AS before,
  (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM events WINDOW w AS (ORDER BY ts, event_id)),
gaps AS (SELECT *, CASE WHEN event_type = before THEN 'within' ELSE 'change' END AS kind FROM g WHERE gap IS NOT NULL)"""


def _gaps(spark, folder):
    return gaps.event_gaps(table(spark, folder, "events"), "ts", "event_type", "event_id")


@check("gap_audit", f"""WITH {_GAPS}
SELECT kind, count(*) AS n, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, count(*) FILTER (gap < 60) AS n_below_floor,
  count(*) FILTER (gap < 1) AS n_burst, round(sum(gap), 3) AS total_gap, round(median(gap), 9) AS median_gap FROM gaps GROUP BY 1""")
def gap_audit(spark, folder):
    audit = gaps.gap_audit(_gaps(spark, folder), {"within": 60, "change": 60})
    return rounded(audit.withColumn("total_gap", F.round("total_gap", 3)), 9)


@check("gap_stream", f"""WITH {_GAPS}
SELECT kind, count(*) AS n, round(min(gap), 6) AS min_gap, round(max(gap), 6) AS max_gap, count(*) FILTER (gap < 60) AS n_below_floor,
  count(*) FILTER (gap < 1) AS n_burst, round(sum(gap), 3) AS total_gap, round(median(gap), 9) AS median_gap FROM gaps GROUP BY 1""")
def gap_stream(spark, folder):
    """The audit over events that came in four slices of time."""
    base = scratch(spark)
    events = table(spark, folder, "events").select("ts", "event_type", "event_id")
    files = _in_turn(spark, events, ["ts", "event_id"], f"{base}/slices", 4, "parquet")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/slices")
    stateful.gap_stream(stream, f"{base}/out", f"{base}/state", "ts", "event_type", "event_id").awaitTermination()
    audit = gaps.gap_audit(stateful.read_gaps(spark, f"{base}/out"), {"within": 60, "change": 60})
    return rounded(audit.withColumn("total_gap", F.round("total_gap", 3)), 9)


@check("smallest_gaps", f"""WITH {_GAPS}
SELECT event_id AS tie, event_type AS key, before AS previous_key, round(gap, 6) AS gap, kind FROM gaps
ORDER BY gaps.gap, ts, event_id LIMIT 5""")
def smallest_gaps(spark, folder):
    return rounded(gaps.smallest_gaps(_gaps(spark, folder)).drop("ts"))


@check("event_rate", """
SELECT count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span,
       round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS rate FROM events""")
def event_rate(spark, folder):
    return rounded(gaps.event_rate(table(spark, folder, "events"), "ts"))
