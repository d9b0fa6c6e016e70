import os

from pyspark.sql import functions as F

from tidemark.operators import bitmaps, sketches, snapshots

DIMS = {"p": "priority"}


def postings(spark, rows):
    return spark.createDataFrame(rows, "snapshot_date string, job_id string, priority string")


def words_on_disk(folder):
    return {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{folder}/words/data") for f in names if f.endswith(".parquet")}


def test_bitmaps_keep_numbers_and_other_snapshots(spark, folder):
    rows = [("a", str(i), "x" if i % 3 else "y") for i in range(300)] + [("a", "7", "x"), ("a", None, "x"), ("a", "900", None)]
    later = [("b", str(i), "x" if i % 2 else "y") for i in range(150, 450)]
    third = [("c", str(i), "z") for i in range(20)]
    df = postings(spark, rows + later + third)
    store = bitmaps.Bitmaps(spark, folder)
    for label in ("a", "b"):
        store.upsert(df.where(F.col("snapshot_date") == label), label, DIMS)
    numbers, before = {r.key: r.number for r in store.ids().collect()}, words_on_disk(folder)
    assert len(numbers) == len(set(numbers.values())) == 451
    store.upsert(df.where("snapshot_date = 'c'"), "c", DIMS)
    store.upsert(df.where("snapshot_date = 'c'"), "c", DIMS)                      # again: nothing changes
    assert {r.key: r.number for r in store.ids().collect()} == numbers
    assert before.items() <= words_on_disk(folder).items()                    # files of a and b are as they were
    axis = ["a", "b", "c"]
    key = lambda r: (r.from_snapshot, r.dimension, r.category)
    want = sorted((tuple(r) for r in snapshots.survival(df.where("job_id IS NOT NULL"), axis, DIMS).collect()), key=repr)
    assert sorted((tuple(r) for r in bitmaps.survival(store.words(), axis).collect()), key=repr) == want
    assert {key(r): (r.n_both, r.n_either) for r in bitmaps.set_counts(store.words(), axis).collect()}[("a", "p", "x")] == (50, 300)


def test_bitmap_flow_has_both_ends(spark, folder):
    df = postings(spark, [("a", "1", "x"), ("a", "2", "x"), ("a", "3", "y"), ("b", "1", "x"), ("b", "2", "y"), ("b", "4", "y")])
    store = bitmaps.Bitmaps(spark, folder)
    for label in ("a", "b"):
        store.upsert(df.where(F.col("snapshot_date") == label), label, DIMS)
    got = {(r.from_category, r.to_category): r.n for r in bitmaps.flow(store.words(), ["a", "b"], "p").collect()}
    assert got == {("x", "x"): 1, ("x", "y"): 1, ("y", None): 1, (None, "y"): 1}
    assert bitmaps.survival(store.words(), ["a"]).count() == 0


def test_sketches_merge_and_leave_missing_values_out(spark):
    rows = [("a", "x", float(i), str(i % 40)) for i in range(5000)] + [("b", "x", float(i), str(i % 60)) for i in range(5000, 9000)] + [
        ("a", "y", None, None), ("b", "y", float("nan"), "1"), ("b", "y", float("inf"), "1")]
    df = spark.createDataFrame(rows, "s string, g string, v double, c string")
    made = sketches.group_sketches(df, ["s", "g"], "v", "c")
    total = {r.g: r for r in sketches.sketch_quantiles(sketches.merged(made, ["g"]), ["g"], {"p50": 0.5, "p90": 0.9}).collect()}
    assert total["x"].n_measured == 9000 and abs(total["x"].p50 - 4500) < 180 and abs(total["x"].p90 - 8100) < 180
    assert total["y"].n_measured == 0 and total["y"].p50 is None
    counts = {r.g: (r.n, r.n_distinct) for r in sketches.sketch_counts(sketches.merged(made, ["g"]), ["g"]).collect()}
    assert counts["y"] == (3, 1) and counts["x"][0] == 9000 and abs(counts["x"][1] - 60) <= 2
    assert sketches.merged(made.where("false"), ["g"]).count() == 0
