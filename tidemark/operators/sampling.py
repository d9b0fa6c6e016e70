"""Deterministic samples: every draw is a hash of the id, so a rerun or a lost task draws the same rows.

Draws come from MD5, which other engines can follow.  A sample of ``n`` rows is a threshold and then a filter: the threshold is
narrowed down by histograms of bounded size, so no task and not the driver ever holds the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

_HEX = 13                        # hexadecimal digits of a draw: 52 bits, exact in a double
_BINS, _LEVELS = 4096, 4
_SORTED_ROWS = 100_000           # rows around the threshold that are sorted at last


def uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) that depends only on the id and the seed."""
    digits = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, _HEX)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** _HEX)


def smallest(rows: DataFrame, draw: Column, n: int, tie: str) -> DataFrame:
    """The ``n`` rows of least ``draw`` (not negative; null counts as largest), then of least ``tie``."""
    if n <= 0:
        return rows.limit(0)
    value = F.coalesce(draw.cast("double"), F.lit(float("inf")))
    # monotone from [0, inf] to [0, 1]
    drawn = rows.withColumn("_draw", value).withColumn("_unit", F.when(F.col("_draw") == float("inf"), 1.0).otherwise(F.col("_draw") / (1 + F.col("_draw"))))
    low, width, below = 0.0, 1.0, 0
    for _ in range(_LEVELS):
        step = width / _BINS
        inside = drawn.where((F.col("_unit") >= low) & (F.col("_unit") < low + width) if low + width < 1 else F.col("_unit") >= low)
        place = F.least(F.floor((F.col("_unit") - low) / step), F.lit(_BINS - 1)).cast("int")
        counts = {r["_bin"]: r["count"] for r in inside.groupBy(place.alias("_bin")).count().collect()}       # _BINS rows
        if below + sum(counts.values()) <= n:
            return rows if below + sum(counts.values()) < n or low + width >= 1 else drawn.where(F.col("_unit") < low + width).drop("_draw", "_unit")
        at = 0
        while below + counts.get(at, 0) < n:
            below += counts.get(at, 0)
            at += 1
        low, width = low + at * step, step
        if counts[at] <= _SORTED_ROWS:
            break
    last = low + width >= 1
    edge = drawn.where((F.col("_unit") >= low) & (F.lit(last) | (F.col("_unit") < low + width)))
    # rows of one bin only; equal draws beyond every level are still told apart by the tie
    rest = edge.orderBy("_draw", tie).limit(n - below)
    return drawn.where(F.col("_unit") < low).unionByName(rest).drop("_draw", "_unit")


def first_by_id(rows: DataFrame, n: int, key: str = "job_id") -> DataFrame:
    """The base period: the first ``n`` rows in id order (ids compared as text, null first).

    Only ids are range-partitioned to find the ``n``-th; rows are then filtered.  Of rows with the ``n``-th id, as many as fit stay.
    """
    if n <= 0:
        return rows.limit(0)
    ids = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(ids.repartitionByRange("_id").withColumn("_part", F.spark_partition_id()))
    below = 0
    for part in ranged.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect():               # one row a partition
        if below + part["n"] >= n:
            break
        below += part["n"]
    else:
        return rows
    inside = Window.orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = ranged.where(F.col("_part") == part["_part"]).withColumn("_sum", F.sum("_n").over(inside)).where(F.col("_sum") >= n - below)
    edge = reached.orderBy("_id").select("_id", "_n", "_sum").head()                                          # ids of one range
    own = F.coalesce(F.col(key).cast("string"), F.lit(""))
    left = n - below - (edge["_sum"] - edge["_n"])
    return rows.where(own < edge["_id"]).unionByName(rows.where(own == edge["_id"]).limit(left))


def sample_fraction(rows: DataFrame, fraction: float, key: str = "job_id", seed: int = 2) -> DataFrame:
    return rows.where(uniform(key, seed) < fraction)


def category_weight(category: str, seed: int, low: float = 0.3, high: float = 2.0) -> Column:
    return F.lit(low) + uniform(category, seed) * (high - low)


def sample_weighted(rows: DataFrame, n: int, weight: Column, key: str = "job_id", seed: int = 3) -> DataFrame:
    """``n`` rows without replacement, weights as given (missing counts as 1).

    Exponential keys ``-ln(u) / w`` (Efraimidis and Spirakis 2006): the n smallest are the sample.
    """
    return smallest(rows, -F.log(uniform(key, seed)) / F.coalesce(weight, F.lit(1.0)), n, key)


def synthetic_snapshot(rows: DataFrame, label: str, base_n: int, n: int, survive: float = 0.55, key: str = "job_id",
                       category: str = "industry_bucket", snapshot: str = "snapshot_date", seed: int = 7) -> DataFrame:
    """A made-up later snapshot: a share of the base period plus weighted newcomers, under a new label."""
    base = first_by_id(rows, base_n, key)
    survivors = sample_fraction(base, survive, key, seed)
    pool = rows.join(base.select(key), key, "left_anti")
    fresh = sample_weighted(pool, max(n - survivors.count(), 0), category_weight(category, seed), key, seed + 1)
    return survivors.unionByName(fresh.select(*survivors.columns)).withColumn(snapshot, F.lit(label))
