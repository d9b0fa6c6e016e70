"""Gaps between neighbouring events on one global time order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles
from tidemark.session import cut


def event_gaps(events: DataFrame, ts: str, key: str, tie: str) -> DataFrame:
    """One row per adjacent pair: the later event with its gap in seconds and ``kind`` (``within``/``change``).

    Events are range-partitioned by (time, tie) and the partition number is written down with the
    checkpoint.  ``lag`` runs inside each range; only the first row of a range needs the last row of the
    range before it, and those edge rows number one per partition.
    """
    ranged = cut(
        events.select(F.col(ts).alias("ts"), F.col(key).alias("key"), F.col(tie).alias("tie"))
        .repartitionByRange("ts", "tie").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy("ts", "tie")
    local = ranged.select(
        "*", F.lag("ts").over(inside).alias("_ts"), F.lag("key").over(inside).alias("_key"),
        F.row_number().over(inside).alias("_at"))
    last = ranged.groupBy("_part").agg(F.max_by(F.struct("ts", "key"), F.struct("ts", "tie")).alias("_last"))
    edges = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_edge"))
    joined = local.join(edges, "_part", "left")
    first = F.col("_at") == 1
    before = F.when(first, F.col("_edge.ts")).otherwise(F.col("_ts"))
    before_key = F.when(first, F.col("_edge.key")).otherwise(F.col("_key"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(1e6)
    return joined.select(
        "ts", "key", "tie", before_key.alias("previous_key"), seconds.alias("gap"),
        F.when(F.col("key").eqNullSafe(before_key), "within").otherwise("change").alias("kind")
    ).where(F.col("gap").isNotNull())


def gap_audit(gaps: DataFrame, floors: dict[str, float], burst: float = 1.0) -> DataFrame:
    """Per kind: count, min, median, max, gaps under the kind's floor and under ``burst`` seconds, total span."""
    gaps = cut(gaps.select("kind", "gap"))          # read three times below
    floor = F.lit(None).cast("double")
    for kind, value in floors.items():
        floor = F.when(F.col("kind") == kind, F.lit(float(value))).otherwise(floor)
    stats = gaps.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        F.count(F.when(F.col("gap") < floor, 1)).alias("n_below_floor"),
        F.count(F.when(F.col("gap") < burst, 1)).alias("n_burst"), F.sum("gap").alias("total_gap"))
    median = exact_quantiles(gaps, ["kind"], "gap", {"median_gap": 0.5})
    return stats.join(median, "kind")


def event_rate(events: DataFrame, ts: str) -> DataFrame:
    """Events per second over the observed span (one row)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.agg(F.count(F.lit(1)).alias("n"), ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("span")).select(
        "n", "span", F.try_divide(F.col("n").cast("double"), F.col("span")).alias("rate"))


def smallest_gaps(gaps: DataFrame, n: int = 5) -> DataFrame:
    return gaps.orderBy("gap", "ts", "tie").limit(n)
