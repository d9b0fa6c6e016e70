"""Nested JSON documents of the served aggregates, built and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import top_n

TOP_PER_CLUSTER, TOP_PER_CONCEPT = 30, 100


def nest(df: DataFrame, name: str) -> DataFrame:
    """(name, document): an already bounded report as one JSON array."""
    return df.agg(F.coalesce(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))), F.lit("[]")).alias("document")
                  ).select(F.lit(name).alias("name"), "document")


def nest_top(df: DataFrame, group: str, order: list, n: int, name: str) -> DataFrame:
    """(name, group_key, document): the first ``n`` rows of each group as one JSON array per group."""
    best = top_n(df, [group], order, n, rank="rank")
    body = F.struct("rank", *[c for c in df.columns if c != group])
    return best.groupBy(F.col(group).cast("string").alias("group_key")).agg(
        F.to_json(F.sort_array(F.collect_list(body))).alias("document")).select(F.lit(name).alias("name"), "group_key", "document")


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON object per line, one line per document."""
    documents.write.mode("overwrite").json(path)
