"""Quantile and distinct-count sketches per group, written once a snapshot and merged over any range of snapshots.

A group's row holds its row count, a KLL sketch of a measure and an HLL sketch of a column.  Reports over many snapshots
then read one small row per (snapshot, group) instead of the postings.  The rank error of a quantile is about 1.65 / k of
the rows at 99 % confidence (below 1 % for k = 400), that of a distinct count about 1.04 / sqrt(2 ** bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KLL_K = 400
HLL_BITS = 14


def group_sketches(rows: DataFrame, keys: list[str], measure: str, distinct: str, k: int = KLL_K, bits: int = HLL_BITS) -> DataFrame:
    """``keys``, n, n_measured, measure_sketch, distinct_sketch.  Null, NaN and infinite measures are left out; a group
    without any has a null sketch.  Null values of ``distinct`` are not counted."""
    value = F.col(measure).cast("double")
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    kll = F.call_function("kll_sketch_agg_double", finite, F.lit(k))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(finite).alias("n_measured"), kll.alias("_kll"),
        F.hll_sketch_agg(F.col(distinct).cast("string"), bits).alias("distinct_sketch")).select(
        *keys, "n", "n_measured", F.when(F.col("n_measured") > 0, F.col("_kll")).alias("measure_sketch"), "distinct_sketch")


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The same columns for coarser ``keys`` (none: one row): sketches of all snapshots or groups as one."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_measured").alias("n_measured"),
        F.call_function("kll_merge_agg_double", F.col("measure_sketch")).alias("_kll"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch")).select(
        *keys, "n", "n_measured", F.when(F.col("n_measured") > 0, F.col("_kll")).alias("measure_sketch"), "distinct_sketch")


def sketch_quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float]) -> DataFrame:
    """``keys``, n_measured and a column for each of ``points`` (name to fraction); null where nothing was measured."""
    at = lambda q: F.call_function("kll_sketch_get_quantile_double", F.col("measure_sketch"), F.lit(float(q)))
    return sketches.select(*keys, "n_measured", *(F.when(F.col("n_measured") > 0, at(q)).alias(name) for name, q in points.items()))


def sketch_counts(sketches: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias(name))
