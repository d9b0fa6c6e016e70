import pytest
from pyspark.sql import functions as F

from tidemark import settings as S
from tidemark.operators import concepts, encode, gaps, sampling

GEN, ML = "生成式 AI／LLM", "機器學習／深度學習"


def hits(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "job_id string, t string")
    tagged = concepts.tag_concepts(df, F.col("t"), S.CONCEPT_PATTERNS)
    return {(r.job_id, r.concept) for r in concepts.concept_hits(tagged, ["job_id"]).collect()}


def test_keyword_boundaries(spark):
    texts = ["provide prompt service", "Prompt Engineering", "使用LLM模型", "uses LLM now", "chatgpt 與 pytorch", None, "thai air", "C# .NET"]
    got = hits(spark, texts)
    assert got == {("1", GEN), ("3", GEN), ("4", GEN), ("4", ML), ("7", "軟體開發")}


def test_fixed_dictionary_shape():
    assert set(S.CONCEPT_ANCHORS) == set(S.CONCEPT_PATTERNS) and set(S.AI_CONCEPTS) <= set(S.CONCEPT_PATTERNS)
    assert len(S.CONCEPT_PATTERNS) == 8 and len(S.BUCKET_LABELS) == 20


def test_summary_of_a_concept_without_hits(spark):
    df = spark.createDataFrame([("1", "aws", 100.0, 5), ("2", "x", None, 6), ("3", "aws", None, 7)],
                               "job_id string, t string, salary_month_min double, description_len long")
    tagged = concepts.tag_concepts(df, F.col("t"), {"cloud": r"\baws\b", "none": "zzz"})
    got = {r.concept: r for r in concepts.concept_summary(tagged, ["none"]).collect()}
    assert got["none"].n == 0 and got["none"].median_salary is None and got["none"].salary_coverage == 0.0 and got["none"].is_ai
    assert got["cloud"].n == 2 and got["cloud"].median_salary == 100.0 and got["cloud"].salary_premium == 1.0
    assert got["cloud"].salary_coverage == 0.5 and got["cloud"].median_desc_len == 6.0


def test_cross_shares_follow_the_minimum(spark):
    scores = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "c")], "job_id string, concept string")
    rows = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", "x")], "job_id string, cat string")
    got = [tuple(r) for r in concepts.concept_cross(scores, rows, "cat", 2).collect()]
    assert got == [("c", "x", 2, 3, 1.0, 2 / 3)]


def test_anchor_is_a_renormalised_mean(spark):
    df = spark.createDataFrame([("c", [2.0, 0.0]), ("c", [0.0, 5.0])], "concept string, vec array<float>")
    anchor = concepts.collect_anchors(concepts.anchor_vectors(df), ["c"])["c"]
    assert anchor == pytest.approx([0.5 ** 0.5, 0.5 ** 0.5])


def test_anchors_from_the_dictionary(spark):
    sentences = concepts.anchor_sentences(spark)
    assert sentences.count() == sum(map(len, S.CONCEPT_ANCHORS.values()))
    anchors = concepts.collect_anchors(concepts.anchor_vectors(encode.hashed_ngram_vectors(sentences)), S.CONCEPT_PATTERNS)
    assert set(anchors) == set(S.CONCEPT_PATTERNS) and all(sum(x * x for x in v) == pytest.approx(1.0) for v in anchors.values())


def test_encoder_is_pluggable_and_keeps_columns(spark):
    import numpy as np

    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text_for_embed string")
    got = {r.id: r.vec for r in encode.encode(df, factory).collect()}
    assert got[1] == pytest.approx([3 / 10 ** 0.5, 1 / 10 ** 0.5], abs=1e-6) and got[2] == [0.0, 1.0]


def test_offline_encoder_sees_the_whole_text(spark):
    base = "word " * 3000
    df = spark.createDataFrame([(1, base + "alpha"), (2, base + "omega"), (3, base + "alpha"), (4, None)], "id int, t string")
    got = {r.id: r.vec for r in encode.hashed_ngram_vectors(df, "t", dim=64).collect()}
    assert got[1] == got[3] and got[1] != got[2] and set(got[4]) == {0.0}


def test_offline_encoder_ranks_similar_texts_first(spark):
    texts = ["senior software engineer backend", "software engineer backend services", "hospital night nurse", "nurse for hospital wards"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    v = {r.id: r.vec for r in encode.hashed_ngram_vectors(df, "t").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert dot(0, 1) > max(dot(0, 2), dot(0, 3)) and dot(2, 3) > max(dot(2, 0), dot(2, 1))


def test_window_slots_equal_plain_ngrams(spark):
    """The batch hashing sees exactly the n-grams of the column expression."""
    import pyarrow as pa
    from tidemark.operators.textfeatures import char_ngrams

    df = spark.createDataFrame([("Ab c  déf",), ("",), ("x",), ("中文 字",)], "t string")
    rows = df.select(encode._single_spaced(F.col("t")).alias("s"), char_ngrams(F.col("t")).alias("g")).collect()
    sizes = {}
    for start, n, owner, slot in encode._window_slots(pa.array([r.s for r in rows]), 1 << 18):
        for i in range(n):
            sizes[start + i] = (int((owner == i).sum()), len(set(slot[owner == i].tolist())))
    assert [sizes[i] for i in range(4)] == [(len(r.g), len(set(r.g))) for r in rows]


def test_join_vectors_guards(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "job_id string")
    good = spark.createDataFrame([("1", [1.0])], "job_id string, vec array<float>")
    assert encode.join_vectors(rows, good, ["job_id"]).count() == 1
    for bad in (good.union(good), spark.createDataFrame([("9", [1.0])], "job_id string, vec array<float>")):
        with pytest.raises(ValueError):
            encode.join_vectors(rows, bad, ["job_id"])


def test_gaps_across_partitions(spark):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i * i / 10), "ab"[i % 3 == 0]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, k string").repartition(7)
    got = {r.tie: (round(r.gap, 6), r.kind) for r in gaps.event_gaps(df, "ts", "k", "id").collect()}
    want = {i: (round((i * i - (i - 1) ** 2) / 10, 6), "within" if rows[i][2] == rows[i - 1][2] else "change") for i in range(1, 500)}
    assert got == want


def test_samples(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("job_id"), (F.col("id") % 4).cast("string").alias("industry_bucket"))
    n = sampling.sample_fraction(df, 0.55).count()
    assert 2000 < n < 2400 and n == sampling.sample_fraction(df.repartition(3), 0.55).count()
    heavy = sampling.sample_weighted(df, 800, F.when(F.col("industry_bucket") == "0", 20.0))
    by = {r.industry_bucket: r["count"] for r in heavy.groupBy("industry_bucket").count().collect()}
    assert sum(by.values()) == 800 and by["0"] > 3 * by["1"]
    made = sampling.synthetic_snapshot(df.withColumn("snapshot_date", F.lit("a")), "b", 1000, 1500)
    assert made.count() == 1500 and made.select("job_id").distinct().count() == 1500
    base = sampling.first_by_id(df, 1000)
    assert made.join(base, "job_id", "left_semi").count() == sampling.sample_fraction(base, 0.55, seed=7).count()
