import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking


def brute(values, p):
    return float(np.percentile(values, p * 100))


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 10 + [4.0], [-1.0, 0.0, 1.0, -2.5, 1e-9, 1e12], list(np.linspace(-3, 7, 101)),
    [0.0] * 5, [-4.0, -4.0, -1e-7], [100000.0 + i * 1e-6 for i in range(50)]])
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("g", float("nan"))], "k string, v double")
    row = ranking.exact_quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.75, "d": 0.99, "e": 1.0}).head()
    for name, p in {"a": 0.01, "b": 0.5, "c": 0.75, "d": 0.99, "e": 1.0}.items():
        assert row[name] == pytest.approx(brute(values, p), rel=1e-12, abs=1e-12)


def test_exact_quantiles_by_group_with_null_key(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 3000, p=[0.8, 0.1, 0.1]), "v": rng.lognormal(3, 2, 3000).round(2)})
    got = {r.k: r.m for r in ranking.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"m": 0.5}).collect()}
    for key, group in pdf.fillna({"k": "null"}).groupby("k"):
        assert got[None if key == "null" else key] == pytest.approx(group.v.median())


def test_exact_quantiles_of_values_in_one_bin(spark):
    """Epoch seconds share one bin; it is cut again, and a part with many equal values stays exact."""
    rng = np.random.default_rng(8)
    seconds = 1698693053.0 + np.concatenate([rng.integers(0, 300_000, 9000), np.full(4000, 77_777)])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(seconds)) % 3 // 2, "v": seconds}))
    assert df.select(ranking._value_bin(F.col("v"))).distinct().count() == 1
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    for row in ranking.exact_quantiles(df, ["k"], "v", probs).collect():
        mine = seconds[np.arange(len(seconds)) % 3 // 2 == row.k]
        assert [row[n] for n in probs] == pytest.approx([np.quantile(mine, p) for p in probs.values()], rel=1e-15)


def test_top_n_large_n_equals_plain_window(spark, monkeypatch):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), F.hash("id").alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    plain = sorted(map(tuple, ranking.top_n(df, ["k"], order, 900, rank="r").collect()))
    monkeypatch.setattr(ranking, "_MAP_SIDE_LIMIT", 10)
    assert sorted(map(tuple, ranking.top_n(df, ["k"], order, 900, rank="r").collect())) == plain


def test_small_n_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = ranking.top_n(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", None), ("b", 9)], "k string, v int")
    assert {r.k: r.m for r in ranking.modal_value(df, ["k"], "v", "m").collect()} == {"a": 1, "b": 9}
