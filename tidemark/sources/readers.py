"""Landing readers: CSV dumps, JSON lines, result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import HIT_PAGE, LANDING


def read_csv_landing(spark: SparkSession, path: str, snapshot: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with header, optional UTF-8 mark and quoted newlines; every field is text and empty stays empty.

    Give ``columns`` (the header in file order) to skip the header scan.
    """
    reader = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    raw = reader.csv(path)
    kept = [c for c in raw.columns if c != "snapshot_date"]
    return raw.select(F.lit(snapshot).alias("snapshot_date"), *[F.coalesce(c, F.lit("")).alias(c) for c in kept])


def read_json_landing(spark: SparkSession, path: str, snapshot: str, schema: T.StructType = LANDING) -> DataFrame:
    """JSON lines under a text schema, so lists and numbers keep their spelling; empty input is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path} has no rows")
    return rows.withColumn("snapshot_date", F.lit(snapshot))


def read_hit_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HIT_PAGE).json(path)
