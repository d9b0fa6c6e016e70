import pytest
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.operators import clean, landing
from tidemark.schema import POSTINGS, SOURCE_COLUMNS

COLUMNS = "job_id string, job_title string, industry_name string, industry_bucket string, updated_at string, description string, salary_desc string"


def rows(spark, data):
    return spark.createDataFrame(data, COLUMNS)


def test_clean_chain(spark):
    long = "需要三年以上經驗的後端工程師"
    source = rows(spark, [
        ("1", "舊版", "軟體", "14_design", "2026-01-01", long, "月薪 40,000元"),
        ("1", "新版", "電腦軟體相關 ", "14_design", "2026-02-01", long, "月薪 50,000元"),
        ("2", "TEST", "x", "14_design", "2026-02-01", long, ""),
        ("3", "短", "x", "zz_other", "bad", "九個字元的描述文字", ""),
        ("4", "剛好", "x", "zz_other", None, "十個字元的描述文字呀", None),
        ("5", "去壞", "x", "", "2026-03-01", "&nbsp;<br>", ""),
        ("5", "去壞", "x", "", "2026-01-01", long, "")])
    marked = clean.clean_postings(source, "2026-05-19", {"電腦軟體相關": "J"}, audit=True).cache()
    kept = {r.job_id: r for r in marked.where("NOT _defect").collect()}
    assert sorted(kept) == ["1", "4"]            # the newest version of 5 is broken, so 5 is gone
    assert kept["1"].job_title == "新版" and kept["1"].industry_class == "J" and kept["1"].salary_month_min == 50000.0
    assert kept["1"].bucket_label == "設計" and kept["4"].bucket_label == "zz_other"
    assert kept["4"].industry_class == S.UNCLASSIFIED and kept["4"].description_len == 10 and kept["4"].salary_type == ""
    audit = clean.ingest_audit(source, marked).head()
    assert (audit.n_read, audit.n_stale, audit.n_dropped, audit.n_kept) == (7, 2, 3, 2)
    plain = clean.clean_postings(source, "2026-05-19")
    assert plain.columns == S.CANONICAL_COLUMNS
    assert [f.dataType for f in plain.schema] == [f.dataType for f in POSTINGS.fields]


def test_dedupe_puts_undated_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "2026-01-01", 2), ("b", None, 3)], "job_id string, updated_at string, v int")
    got = {r.job_id: r.v for r in clean.drop_stale_versions(df).collect()}
    assert got == {"a": 2, "b": 3}


def test_lookup_keeps_full_width_separators(spark):
    df = spark.createDataFrame([("機械設備租賃／維修",), (" 農事╱畜牧相關 ",), ("農事/畜牧相關",), ("",), (None,)], "n string")
    table = {"機械設備租賃／維修": "N", "農事╱畜牧相關": "A"}
    assert [r[0] for r in df.select(clean.lookup_class(F.col("n"), table)).collect()] == ["N", "A", "未分類", "未分類", "未分類"]


def test_align_and_canonical(spark):
    df = clean.align_columns(spark.createDataFrame([("1",)], "job_id string"), SOURCE_COLUMNS)
    assert set(SOURCE_COLUMNS) == set(df.columns)
    assert clean.canonical_projection(df).columns == S.CANONICAL_COLUMNS


def test_dimension_names():
    assert clean.resolve_dimension(None) == "industry_class"
    assert clean.resolve_dimension("職務類別") == "bucket_label"
    with pytest.raises(ValueError):
        clean.resolve_dimension("nope")


def test_flatten_hits_defaults(spark):
    from tidemark.schema import HIT_PAGE
    page = {"bucket": "14_design", "page": 2, "result": {"pagination": None, "hits": [
        {"jobId": "7", "title": "t", "industry": None, "workCity": {"name": "台北"},
         "require": {"experience": "1", "grades": ["4", "5"], "majors": None}, "isHappiness": None}]}}
    row = landing.flatten_hits(spark.createDataFrame([page], HIT_PAGE), "s", "https://jobs.example/").head()
    assert (row.edu_codes, row.major_codes, row.description, row.is_happiness) == ('["4","5"]', "[]", "", "false")
    assert row.job_url == "https://jobs.example/7/" and row.city_name == "台北" and row.industry_id is None


def test_first_seen_drops_blank_and_landed(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 0), ("", 1), ("b", 3), ("c", 4)], "job_id string, at int")
    landed = spark.createDataFrame([("c",)], "job_id string")
    got = {r.job_id: r["at"] for r in landing.first_seen(df, "job_id", [F.col("at")], landed).collect()}
    assert got == {"a": 0, "b": 3}


def test_progress_markers(spark):
    marks = spark.createDataFrame([(["x|1", "x|2"], False), ([], True)], "pages array<string>, complete boolean")
    got = sorted((r.bucket, r.page, r.complete) for r in landing.read_progress(marks).collect() if r.bucket)
    assert got == [("x", 1, False), ("x", 2, False)]


def test_newest_of_mixed_stamps_wins(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.coerce import to_timestamp

    shapes = ["2026-05-19T08:30:00.123Z", "2026-05-19T08:30:00+0800", "2026-05-19 08:30:00.5", "2026-05-19T08:30",
              "2026-05-19T08:30:00.123456+08:00", "2026/05/19 08:30:00.123", "bad", "2026-13-40T08:30"]
    got = [str(r[0]) for r in spark.createDataFrame([(s,) for s in shapes], "s string").select(to_timestamp(F.col("s"))).collect()]
    assert got == ["2026-05-19 08:30:00.123000", "2026-05-19 00:30:00", "2026-05-19 08:30:00.500000", "2026-05-19 08:30:00",
                   "2026-05-19 00:30:00.123456", "2026-05-19 08:30:00.123000", "None", "None"]
