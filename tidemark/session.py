"""Session helpers: a local session for tests and benches, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: int | str = "*", app: str = "tidemark", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's own setting, or a scratch one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    Unlike an RDD checkpoint the table is columnar and its size is known, so later steps read only the
    columns they need and small results are broadcast.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one task per core; a large input is left as it is.

    For a plain scan only: asking a plan with shuffles for its partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A driver-side list as a local relation: its size is known, so Spark broadcasts it under its threshold."""
    typed = spark.createDataFrame([], schema).schema
    columns = list(zip(*rows)) if rows else [[] for _ in typed.names]
    arrow = to_arrow_schema(typed)
    return spark.createDataFrame(
        pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], names=typed.names), typed)
