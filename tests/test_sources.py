import json

import pytest
from pyspark.sql import functions as F
from tidemark.operators import concepts, landing
from tidemark.schema import DERIVED
from tidemark.sources import export, meta, readers, tables
from tidemark.streaming.landing import land_stream, page_stream, tagged_postings


def test_csv_with_mark_and_quoted_newlines(spark, folder):
    with open(f"{folder}/a.csv", "w", encoding="utf-8-sig") as f:
        f.write('job_id,job_title,description\n1,"say ""hi""","line one\nline two, more"\n2,,\n007,NA,null\n')
    got = [tuple(r) for r in readers.read_csv_landing(spark, f"{folder}/a.csv", "s").orderBy("job_id").collect()]
    assert got == [("s", "007", "NA", "null"), ("s", "1", 'say "hi"', "line one\nline two, more"), ("s", "2", "", "")]


def test_json_lines(spark, folder):
    with open(f"{folder}/a.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"job_id": "1", "edu_codes": ["4", "5"], "is_happiness": True, "industry_id": 12}) + "\n\n")
        f.write(json.dumps({"job_id": "2", "edu_codes": [], "industry_id": None}) + "\n")
    got = [(r.job_id, r.edu_codes, r.is_happiness, r.industry_id) for r in
           readers.read_json_landing(spark, f"{folder}/a.jsonl", "s").orderBy("job_id").collect()]
    assert got == [("1", '["4", "5"]', "true", "12"), ("2", "[]", None, None)]
    open(f"{folder}/empty.jsonl", "w").close()
    with pytest.raises(ValueError):
        readers.read_json_landing(spark, f"{folder}/empty.jsonl", "s")


def test_upsert_guard_and_idempotence(spark, folder):
    path = f"{folder}/t"
    df = spark.createDataFrame([("2026-05-19", "1", 1), ("2026-05-19", "2", 2)], "snapshot_date string, job_id string, v int")
    tables.upsert_snapshot(df, path, "2026-05-19")
    tables.upsert_snapshot(df.limit(1), path, "2026-08-02-dev")
    for _ in range(2):
        tables.upsert_snapshot(df.where("job_id = '1'"), path, "2026-05-19")
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [
        ("1", 1, "2026-05-19"), ("1", 1, "2026-08-02-dev")]
    with pytest.raises(ValueError, match=r"added \['w'\], removed \['v'\]"):
        tables.upsert_snapshot(df.withColumnRenamed("v", "w"), path, "2026-05-19")
    with pytest.raises(ValueError):
        tables.upsert_snapshot(df.select("snapshot_date", "v", "job_id"), path, "2026-05-19")
    assert dict(tables.read_table(spark, path).dtypes)["snapshot_date"] == "string"


def test_missing_and_empty_tables(spark, folder):
    assert tables.read_table(spark, f"{folder}/none", DERIVED["survival"]).columns[:2] == ["from_snapshot", "to_snapshot"]
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{folder}/none")
    empty = tables.read_table(spark, f"{folder}/none", DERIVED["survival"])
    tables.replace_table(empty, f"{folder}/survival")
    assert tables.read_table(spark, f"{folder}/survival", DERIVED["survival"]).count() == 0


def test_meta_and_export(spark, folder):
    m = meta.meta_frame(spark, {"snapshots": ["a", "b"], "n": "3"})
    assert meta.meta_dict(m, json_keys=("snapshots",)) == {"snapshots": ["a", "b"], "n": "3"}
    assert meta.meta_dict(m.where("false")) == {}
    doc = export.nest(spark.createDataFrame([(2, "y"), (1, "x")], "a int, b string"), "core")
    export.write_documents(doc, f"{folder}/out")
    row = spark.read.json(f"{folder}/out").head()
    assert json.loads(row.document) == [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}] and row.name == "core"
    assert json.loads(export.nest(m.where("false"), "x").head().document) == []


def pages(folder, name, items):
    with open(f"{folder}/pages/{name}.json", "w", encoding="utf-8") as f:
        for bucket, page, ids in items:
            hits = [{"jobId": i, "title": f"工程師 {bucket}", "description": "負責 Python 與 AWS 開發", "salary": "月薪 40,000元"} for i in ids]
            f.write(json.dumps({"bucket": bucket, "page": page, "result": {"hits": hits}}) + "\n")


def landed(spark, folder, **options):
    rows = landing.flatten_hits(page_stream(spark, f"{folder}/pages", 1), "s1", "https://jobs.example/")
    land_stream(rows, f"{folder}/landed", f"{folder}/state", **options).awaitTermination()
    return spark.read.parquet(f"{folder}/landed")


def test_stream_lands_first_arrivals_over_batches(spark, folder):
    import os
    import time
    os.mkdir(f"{folder}/pages")
    for i, items in enumerate([[("a", 1, ["1", "2"]), ("b", 1, ["2", "3"])], [("a", 2, ["3", "4", None])], [("b", 2, ["4", "5"])]]):
        pages(folder, f"p{i}", items)
        os.utime(f"{folder}/pages/p{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    got = {r.job_id: r.industry_bucket for r in landed(spark, folder).collect()}
    assert got == {"1": "a", "2": "a", "3": "b", "4": "a", "5": "b"}
    pages(folder, "p9", [("c", 1, ["5", "6"])])
    again = landed(spark, folder)
    assert {r.job_id: r.industry_bucket for r in again.collect()} == {**got, "6": "c"}
    assert again.count() == 6


def test_stream_cap_counts_all_batches(spark, folder):
    import os
    import time
    os.mkdir(f"{folder}/pages")
    for i in range(3):
        pages(folder, f"p{i}", [("a", i, [f"{i}{j}" for j in range(4)])])
        os.utime(f"{folder}/pages/p{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    got = sorted(r.job_id for r in landed(spark, folder, cap=6).collect())
    assert got == ["00", "01", "02", "03", "10", "11"]


def test_enrichment_runs_on_a_stream(spark, folder):
    import os
    os.mkdir(f"{folder}/pages")
    pages(folder, "p0", [("14_design", 1, ["1"])])
    rows = landing.flatten_hits(page_stream(spark, f"{folder}/pages"), "s1")
    stream = concepts.concept_hits(tagged_postings(rows, "s1"), ["job_id", "salary_month_min", "bucket_label"])
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = {(r.concept, r.salary_month_min, r.bucket_label) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {("軟體開發", 40000.0, "設計"), ("雲端／DevOps", 40000.0, "設計")}


def test_empty_table_and_empty_snapshot(spark, folder):
    from tidemark.sources import tables

    path = f"{folder}/t"
    none = spark.createDataFrame([], "job_id string, n int, snapshot_date string")
    tables.replace_table(none, path, "snapshot_date")
    assert tables.read_table(spark, path).columns == none.columns and tables.read_table(spark, path).count() == 0
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], none.schema)
    for day in ("2026-01-01", "2026-02-01"):
        tables.upsert_snapshot(rows, path, day)
    tables.upsert_snapshot(none, path, "2026-01-01")
    assert [tuple(r) for r in tables.read_table(spark, path).groupBy("snapshot_date").count().collect()] == [("2026-02-01", 2)]


def test_a_killed_write_leaves_the_former_rows(spark, folder):
    path = f"{folder}/t"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "snapshot_date string, v int")
    tables.replace_table(df, path, "snapshot_date")
    before = tables.pointer(spark, path)
    broken = df.where("snapshot_date = 'a'").withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception):
        tables.upsert_snapshot(broken, path, "a")
    tables._write_version(df.withColumn("v", F.col("v") + 10), path, True)              # written, never pointed to
    assert tables.pointer(spark, path) == before
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(1, "a"), (2, "b")]
    assert tables.vacuum(spark, path) >= 1
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(1, "a"), (2, "b")]


def test_an_upsert_is_evaluated_once_and_conflicts_are_seen(spark, folder):
    path, runs = f"{folder}/t", spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("a", 1), ("a", 2), ("c/d=e", 3)], "snapshot_date string, v int")

    @F.udf("int")
    def counted(v):
        runs.add(1)
        return v

    tables.upsert_snapshot(df.where("snapshot_date = 'a'").withColumn("v", counted("v")), path, "a")
    assert runs.value == 2
    tables.upsert_snapshot(df.where("v = 3"), path, "c/d=e")
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(1, "a"), (2, "a"), (3, "c/d=e")]
    kept = tables.read_table(spark, path).where("snapshot_date = 'a'")
    assert "PartitionFilters: [isnotnull(snapshot_date" in kept._jdf.queryExecution().toString()
    now = tables.pointer(spark, path)
    with pytest.raises(RuntimeError):
        tables._point(spark, path, now["number"], df.schema, True, {})
    with pytest.raises(ValueError):
        tables.replace_table(df, path, "v")


def test_reports_of_a_fresh_base_are_empty(spark, folder):
    from tidemark.plans.reports import Reports

    r = Reports(spark, f"{folder}/none")
    for made in (r.concepts(), r.concept_examples("x"), r.concept_candidates(), r.timeline(), r.category_series(), r.cluster_series()):
        assert made.columns and made.count() == 0
