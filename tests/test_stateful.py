import json
import os
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import landing as checks_landing
from tests.test_sources import pages
from tidemark.operators import dictionary, gaps, landing, sampling
from tidemark.streaming import stateful
from tidemark.streaming.landing import page_stream


def landed(spark, folder, **options):
    rows = landing.flatten_hits(page_stream(spark, f"{folder}/pages", 1), "s1", "https://jobs.example/")
    query = stateful.land_stream_stateful(rows, f"{folder}/landed", f"{folder}/state", **options)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/landed"), query.recentProgress


def put(folder, i, items):
    os.makedirs(f"{folder}/pages", exist_ok=True)
    pages(folder, f"p{i}", items)
    os.utime(f"{folder}/pages/p{i}.json", (time.time() - 100 + i, time.time() - 100 + i))


def test_first_arrivals_over_batches_cost_their_own_keys(spark, folder):
    for i, items in enumerate([[("a", 1, ["1", "2"]), ("b", 1, ["2", "3"])], [("a", 2, ["3", "4", None, ""])], [("b", 2, ["4", "5"])]]):
        put(folder, i, items)
    rows, progress = landed(spark, folder)
    got = {r.job_id: r.industry_bucket for r in rows.collect()}
    assert got == {"1": "a", "2": "a", "3": "b", "4": "a", "5": "b"}
    # a batch writes the state of its new keys only, and nothing that has landed is read
    assert [p["stateOperators"][0]["numRowsUpdated"] for p in progress if p["numInputRows"]] == [3, 1, 1]
    assert all("landed" not in s["description"] for p in progress for s in p["sources"])
    put(folder, 9, [("c", 1, ["5", "6"])])
    again, _ = landed(spark, folder)
    assert {r.job_id: r.industry_bucket for r in again.collect()} == {**got, "6": "c"} and again.count() == 6


def test_keys_of_a_stream_are_settled_without_python(spark, folder):
    def hit(bucket, page, ids):
        put(folder, page, [(bucket, page, ids)])

    hit("b", 1, ["1", "2", "1"])
    hit("a", 2, ["2", "3", "", None])
    hit(None, 3, ["3", "4"])
    rows = landing.flatten_hits(page_stream(spark, f"{folder}/pages", 2), "s1", "https://jobs.example/")
    query = stateful.land_stream_stateful(rows, f"{folder}/landed", f"{folder}/state")
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/landed")
    assert got.drop("batch_id").columns == rows.columns
    # of two buckets in a batch the lesser one counts, then the place in the page; a key of an earlier batch does not come again
    assert sorted((r.batch_id, r.job_id, r.industry_bucket, r.page, r.pos) for r in got.collect()) == [
        (0, "1", "b", 1, 0), (0, "2", "a", 2, 0), (0, "3", "a", 2, 1), (1, "4", None, 3, 1)]
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"dedupe"}


def test_cap_counts_all_batches(spark, folder):
    for i in range(3):
        put(folder, i, [("a", i, [f"{i}{j}" for j in range(4)])])
    rows, _ = landed(spark, folder, cap=6)
    assert sorted(r.job_id for r in rows.collect()) == ["00", "01", "02", "03", "10", "11"]


def test_gap_stream_and_late_events(spark, folder):
    os.mkdir(f"{folder}/in")
    slices = [[(10, "a", 1), (12, "a", 2), (12, "b", 3)], [(12, "b", 4), (11, "a", 5), (20, "a", 6), (None, "a", 8)], [(20, "a", 6), (21, "b", 7)]]
    for i, events in enumerate(slices):
        with open(f"{folder}/in/{i}.json", "w") as f:
            f.writelines(json.dumps({"ts": None if t is None else f"2024-01-01 00:00:{t:02d}", "key": k, "tie": n}) + "\n" for t, k, n in events)
        os.utime(f"{folder}/in/{i}.json", (time.time() - 100 + i, time.time() - 100 + i))
    stream = spark.readStream.schema("ts timestamp, key string, tie int").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    stateful.gap_stream(stream, f"{folder}/out", f"{folder}/state", "ts", "key", "tie").awaitTermination()
    got = sorted((r.tie, r.previous_key, r.gap, r.kind) for r in stateful.read_gaps(spark, f"{folder}/out").collect())
    assert got == [(2, "a", 2.0, "within"), (3, "a", 0.0, "change"), (4, "b", 0.0, "within"), (6, "b", 8.0, "change"), (7, "a", 1.0, "change")]
    late = sorted(r.tie for r in spark.read.parquet(f"{folder}/out/late").collect())
    assert late == [5, 6, 8]
    on_time = spark.read.schema("ts timestamp, key string, tie int").json(f"{folder}/in").where("tie NOT IN (5, 8)").distinct()
    assert sorted(r.gap for r in gaps.event_gaps(on_time, "ts", "key", "tie").collect()) == sorted(g[2] for g in got)


@pytest.mark.parametrize("n_rows,files", [(100, 4), (2, 1)])
def test_slices_are_those_of_ntile_in_files_of_bounded_size(spark, folder, monkeypatch, n_rows, files):
    monkeypatch.setattr(checks_landing, "_FILE_ROWS", 10)
    rows = spark.range(n_rows).select((F.col("id") * 7 % n_rows).alias("ts"), F.col("id").alias("tie"))
    assert checks_landing._in_turn(spark, rows, ["ts", "tie"], f"{folder}/in", 3, "parquet") == files
    written = [sorted(r.ts for r in spark.read.parquet(f"{folder}/in/{i:06d}.parquet").collect()) for i in range(3 * files)]
    assert max(map(len, written)) <= 10
    want = rows.select("ts", F.ntile(3).over(Window.orderBy("ts", "tie")).alias("part")).collect()
    for part in (1, 2, 3):
        assert sum(written[(part - 1) * files:part * files], []) == sorted(r.ts for r in want if r.part == part)


def test_dictionary_counts_overlaps_and_words(spark):
    rows = spark.createDataFrame([(1, "Anana BANANA ana_1"), (2, None), (3, ""), (4, "ΑΣ ας")], "id int, text string")
    terms = [("fruit", "ana"), ("fruit", "Banana"), ("other", "ana"), ("none", " "), ("greek", "ας")]
    got = {(r.id, r.concept): (r.terms, r.n) for r in dictionary.tag_dictionary(rows, F.col("text"), terms, ["id"]).collect()}
    assert got[(1, "fruit")] == (["ana", "banana"], 6) and got[(1, "other")] == (["ana"], 5) and (2, "fruit") not in got
    words = {(r.id, r.concept): r.n for r in dictionary.tag_dictionary(rows, F.col("text"), terms, ["id"], whole_words=True).collect()}
    assert words[(1, "fruit")] == 1 and (1, "other") not in words
    assert dictionary.tag_dictionary(rows, F.col("text"), [], ["id"]).count() == 0
    with pytest.raises(ValueError):
        dictionary.dictionary_hits(F.col("text"), [("c", "x" * (65 << 20))])


def test_thresholds_give_the_sorted_prefix(spark):
    draws = [(i, (i * 7919 % 1000) / 10 if i % 50 else None) for i in range(1000)] + [(2000 + i, 5.0) for i in range(30)]
    df = spark.createDataFrame(draws, "job_id long, d double")
    order = sorted(draws, key=lambda r: (r[1] is None, r[1] if r[1] is not None else 0, r[0]))
    for n in (0, 1, 5, 64, 500, 985, 1010, 1030, 5000):
        assert sorted(r.job_id for r in sampling.smallest(df, F.col("d"), n, "job_id").collect()) == sorted(i for i, _ in order[:n]), n
    ids = sorted(str(i) for i, _ in draws)
    for n in (0, 1, 7, 400, 1030, 2000):
        assert sorted(str(r.job_id) for r in sampling.first_by_id(df, n).collect()) == ids[:n]
    repeated = spark.createDataFrame([("b",)] * 5 + [("a",), (None,)], "job_id string")
    assert sorted(repr(r.job_id) for r in sampling.first_by_id(repeated, 4).collect()) == ["'a'", "'b'", "'b'", "None"]
