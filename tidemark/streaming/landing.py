"""Landing as Structured Streaming: result pages in, first-seen rows out, restartable at any batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import settings as S
from tidemark.operators import clean, concepts, landing
from tidemark.schema import HIT_PAGE
from tidemark.sources.tables import table_exists

BATCH = "batch_id"


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(HIT_PAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def land_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "job_id",
                arrival: tuple[str, ...] = ("industry_bucket", "page", "pos"), bucket: str = "industry_bucket",
                cap: int | None = None) -> StreamingQuery:
    """Append the first arrival of every id to ``path`` and stop when the input is used up.

    A batch is written to its own ``batch_id`` partition and compared only with earlier batches, so a
    batch that is run again replaces its own rows and nothing else.  Each batch reads just the key
    column of what has landed; prefer few large batches.  With ``cap`` a bucket stops growing at that
    many rows over all batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        landed = None
        if table_exists(spark, path):
            landed = spark.read.parquet(path).where(F.col(BATCH) < batch_id)
        order = [F.col(c) for c in arrival]
        fresh = landing.first_seen(batch, key, order, landed)
        if cap is not None:
            fresh = landing.cap_per_bucket(fresh, bucket, order, cap)
            if landed is not None:
                held = landing.bucket_counts(landed, bucket).withColumnRenamed("n", "_held")
                ranked = landing.top_n(fresh, [bucket], order, cap, rank="_place")
                fresh = ranked.join(held, bucket, "left").where(
                    F.col("_place") + F.coalesce("_held", F.lit(0)) <= cap).drop("_place", "_held")
        (fresh.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path))

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def tagged_postings(rows: DataFrame, snapshot: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Stateless enrichment of a landing stream: cleaning, pay, lookups and concept hits."""
    typed = clean.coerce_types(clean.align_columns(rows, clean.SOURCE_COLUMNS))
    cleaned = clean.finish_postings(typed.select(*clean.SOURCE_COLUMNS), snapshot)
    text = F.concat_ws(" ", "job_title", "description")
    return concepts.tag_concepts(cleaned, text, patterns or S.CONCEPT_PATTERNS)
