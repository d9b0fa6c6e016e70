"""Key-value tables whose values may hold JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import small_table


def meta_frame(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    """(key, value) rows; lists and dicts become JSON text."""
    rows = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in values.items()]
    return small_table(spark, rows, "key string, value string")


def meta_map(meta: DataFrame) -> DataFrame:
    """One row with all entries as a map."""
    return meta.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries"))


def meta_dict(meta: DataFrame, json_keys: tuple[str, ...] = ()) -> dict[str, object]:
    row = meta_map(meta).head()
    entries = dict(row[0] or {})
    return {k: json.loads(v) if k in json_keys else v for k, v in entries.items()}
