"""Streams that remember: first arrivals from a state store, and gaps that go on from one batch to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import gaps, landing
from tidemark.sources.tables import table_exists

BATCH = "batch_id"


def first_arrivals(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a stream, each as ``_row`` beside its ``_key``, and for every key that no batch had before one row more without
    ``_row``; null and blank keys are dropped.  :func:`first_rows` makes the first arrivals of a batch of them.

    The state of a key is an entry without content in Spark's state store, which no Python worker sees, so a batch costs what its own
    rows cost, however much has landed.  Keys are never forgotten: give the session the RocksDB state store where they outgrow memory.
    """
    present = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    arrived = present.select(F.col(key).alias("_key"), F.struct(*rows.columns).alias("_row"))
    new = present.select(F.col(key).alias("_key")).dropDuplicates(["_key"])
    return arrived.unionByName(new, allowMissingColumns=True)


def first_rows(batch: DataFrame, arrival: tuple[str, ...]) -> DataFrame:
    """The least row by ``arrival``, nulls first and equal ones as they come, of each key that is new in a batch of :func:`first_arrivals`."""
    order = [F.col(f"_row.{c}") for c in arrival if c in batch.schema["_row"].dataType.names]
    place = F.when(F.col("_row").isNotNull(), F.struct(F.lit(0), *order))
    found = batch.groupBy("_key").agg(F.min_by("_row", place).alias("_row"), F.max(F.col("_row").isNull()).alias("_new"))
    return found.where("_new").select("_row.*")


def land_stream_stateful(rows: DataFrame, path: str, checkpoint: str, key: str = "job_id",
                         arrival: tuple[str, ...] = ("industry_bucket", "page", "pos"), bucket: str = "industry_bucket",
                         cap: int | None = None) -> StreamingQuery:
    """:func:`landing.land_stream` without reading what has landed: keys are in the state store and, with ``cap``, the rows
    held by each bucket in one small table, a row for each bucket and batch.

    A batch that runs again replaces its own ``batch_id`` partitions.
    """
    held_path = f"{path}_held"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_rows(batch, arrival)
        if cap is not None:
            order = [F.col(c) for c in arrival]
            ranked = landing.top_n(fresh, [bucket], order, cap, rank="_place")
            if table_exists(spark, held_path):
                held = spark.read.parquet(held_path).where(F.col(BATCH) < batch_id).groupBy(bucket).agg(F.sum("n").alias("_held"))
                ranked = ranked.join(held, bucket, "left").where(F.col("_place") + F.coalesce("_held", F.lit(0)) <= cap).drop("_held")
            fresh = ranked.drop("_place")
        _put(fresh, path, batch_id)
        if cap is not None:
            landed = spark.read.parquet(path).where(F.col(BATCH) == batch_id)
            _put(landing.bucket_counts(landed, bucket), held_path, batch_id)

    return (first_arrivals(rows, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _put(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH).parquet(path))


def _after(edge) -> Column:
    same = F.col("ts") == F.lit(edge["ts"])
    return (F.col("ts") > F.lit(edge["ts"])) | (same & (F.col("tie") > F.lit(edge["tie"])))


def gap_stream(events: DataFrame, path: str, checkpoint: str, ts: str, key: str, tie: str) -> StreamingQuery:
    """Gaps between neighbouring events over all batches, in ``<path>/gaps``: the rows of :func:`gaps.event_gaps`.

    What a batch leaves to the next is its last event, in ``<path>/edges``.  An event not later than the last one of the batches
    before is late: it would change gaps that were handed out, so it goes to ``<path>/late`` and into no gap; events without
    a time are late, too.  A batch that runs again replaces its own rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(F.col(ts).alias("ts"), F.col(key).alias("key"), F.col(tie).alias("tie"))
        edge = None
        if table_exists(spark, f"{path}/edges"):
            edge = spark.read.parquet(f"{path}/edges").where(F.col(BATCH) < batch_id).orderBy(F.col("ts").desc(), F.col("tie").desc()).head()
        on_time = F.coalesce(_after(edge) if edge else F.col("ts").isNotNull(), F.lit(False))
        _put(rows.where(~on_time), f"{path}/late", batch_id)
        fresh = rows.where(on_time)
        if edge:
            before = spark.read.parquet(f"{path}/edges").where((F.col("ts") == F.lit(edge["ts"])) & (F.col("tie") == F.lit(edge["tie"])))
            fresh = fresh.unionByName(before.select("ts", "key", "tie").limit(1))
        _put(gaps.event_gaps(fresh, "ts", "key", "tie"), f"{path}/gaps", batch_id)
        last = rows.where(on_time).agg(F.max(F.struct("ts", "tie", "key")).alias("last")).where("last IS NOT NULL").select("last.*")
        _put(last.select("ts", "key", "tie"), f"{path}/edges", batch_id)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/gaps").drop(BATCH)
