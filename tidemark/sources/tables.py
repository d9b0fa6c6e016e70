"""Parquet tables: snapshot upsert, full replace, optional read, rebuild.

A table's folder holds ``data/version=<id>`` folders, which are written once and never changed, and ``pointers/<number>``: small
JSON files that name the version of each snapshot and the column types.  Readers follow the highest pointer.  A write
adds a version and then a pointer, so a reader sees the former rows or the new ones, a killed write leaves the former
ones, and a table may be computed from itself.  Of two writers that start from one pointer the second one fails.
``vacuum`` removes versions that no kept pointer names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import empty
from tidemark.session import small_table

PARTITION = "snapshot_date"
_ALL = ""                        # the part of a table without snapshots


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


# --- pointers ---------------------------------------------------------------------------------
def _pointer_numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = _fs(spark, f"{path}/pointers")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _read_pointer(spark: SparkSession, path: str, number: int) -> dict:
    rows = spark.read.text(f"{path}/pointers/{number:09d}.json", wholetext=True).collect()
    return json.loads("".join(r[0] for r in rows))


def pointer(spark: SparkSession, path: str) -> dict | None:
    """The highest pointer: {number, schema, partitioned, parts: {snapshot: version}}."""
    numbers = _pointer_numbers(spark, path)
    return _read_pointer(spark, path, numbers[-1]) | {"number": numbers[-1]} if numbers else None


def _point(spark: SparkSession, path: str, number: int, schema: T.StructType, partitioned: bool, parts: dict[str, str]) -> None:
    """Written aside and then renamed, which fails if another writer took the number."""
    note = json.dumps({"schema": json.loads(schema.json()), "partitioned": partitioned, "parts": parts})
    fs, aside = _fs(spark, f"{path}/pointers/.{number:09d}-{uuid.uuid4().hex}")
    _, target = _fs(spark, f"{path}/pointers/{number:09d}.json")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(note.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"{path} was changed by another writer; read it again")


def _write_version(df: DataFrame, path: str, partitioned: bool) -> tuple[str, set[str]]:
    """The version's name and, from one evaluation of ``df``, the snapshots that it has rows of."""
    version, seen = uuid.uuid4().hex, Observation()
    value = F.collect_set(F.col(PARTITION).cast("string")) if partitioned else F.count(F.lit(1))
    writer = df.observe(seen, value.alias("seen")).write
    (writer.partitionBy(PARTITION) if partitioned else writer).parquet(f"{path}/data/version={version}")
    found = seen.get["seen"]
    return version, {str(s) for s in found} if partitioned else {_ALL}


# --- reading ----------------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The table, or an empty frame of ``schema`` when it does not exist.

    Snapshot labels are text even when they look like dates, so partition values are not inferred.  A folder of plain
    Parquet files without pointers is read as it is.
    """
    now = pointer(spark, path)
    if now is None and not table_exists(spark, path):
        if schema is None:
            raise FileNotFoundError(path)
        return empty(spark, schema)
    if now is None:
        found = spark.read.parquet(path).schema
        typed = T.StructType([T.StructField(f.name, T.StringType() if f.name == PARTITION else f.dataType) for f in found])
        rows = spark.read.schema(typed).parquet(path)
    else:
        rows = _read_parts(spark, path, now)
    if schema is None:
        return rows
    wanted = empty(spark, schema).schema
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def _read_parts(spark: SparkSession, path: str, now: dict) -> DataFrame:
    stored = T.StructType.fromJson(now["schema"])
    if not now["parts"]:
        return empty(spark, stored)
    if not now["partitioned"]:
        return spark.read.schema(stored).parquet(f"{path}/data/version={now['parts'][_ALL]}")
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{path}/data/version={version}/{PARTITION}={escape(label)}" for label, version in now["parts"].items()]
    typed = T.StructType([*stored, T.StructField("version", T.StringType())])
    return spark.read.schema(typed).option("basePath", f"{path}/data").parquet(*folders).select(*stored.names)


def stored_schema(spark: SparkSession, path: str) -> T.StructType:
    """The types of the table, which a table without rows keeps too."""
    now = pointer(spark, path)
    return T.StructType.fromJson(now["schema"]) if now else spark.read.parquet(path).schema


# --- writing ----------------------------------------------------------------------------------
def _ordered(df: DataFrame, partitioned: bool) -> T.StructType:
    """The partition column comes last, as text."""
    fields = [T.StructField(f.name, f.dataType) for f in df.schema if not partitioned or f.name != PARTITION]
    return T.StructType(fields + [T.StructField(PARTITION, T.StringType())] * partitioned)


def replace_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Full overwrite; an empty frame leaves an empty table with its types."""
    if partition_by not in (None, PARTITION):
        raise ValueError(f"tables are partitioned by {PARTITION} or not at all")
    spark, partitioned = df.sparkSession, partition_by is not None
    now = pointer(spark, path)
    rows = df.where(F.col(PARTITION).isNotNull()) if partitioned else df
    version, seen = _write_version(rows, path, partitioned)
    _point(spark, path, (now or {"number": 0})["number"] + 1, _ordered(df, partitioned), partitioned, {s: version for s in sorted(seen)})


def upsert_snapshot(df: DataFrame, path: str, snapshot: str) -> None:
    """Replace one snapshot's rows and leave the others; the column list must match the stored one.

    ``df`` is evaluated once and may read the table itself.  Without rows the snapshot goes.
    """
    spark, now = df.sparkSession, pointer(df.sparkSession, path)
    if now is not None:
        if not now["partitioned"]:
            raise ValueError(f"{path} has no snapshots; replace it")
        stored = [c for c in T.StructType.fromJson(now["schema"]).names if c != PARTITION]
        given = [c for c in df.columns if c != PARTITION]
        if stored != given:
            added, removed = [c for c in given if c not in stored], [c for c in stored if c not in given]
            raise ValueError(f"columns of {path} changed (or their order); added {added}, removed {removed}; rebuild the table")
    rows = df.drop(PARTITION).withColumn(PARTITION, F.lit(snapshot))
    version, seen = _write_version(rows, path, True)
    parts = {s: v for s, v in (now or {"parts": {}})["parts"].items() if s != snapshot} | {s: version for s in seen}
    _point(spark, path, (now or {"number": 0})["number"] + 1, _ordered(rows, True), True, dict(sorted(parts.items())))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete pointers but the last ``keep`` and versions that these do not name; the number of versions deleted.

    Readers of an older pointer and writes under way lose their files, so run it when there are none.
    """
    if keep < 1:
        raise ValueError("keep at least one pointer")
    numbers = _pointer_numbers(spark, path)
    named = {v for n in numbers[-keep:] for v in _read_pointer(spark, path, n)["parts"].values()}
    fs, data = _fs(spark, f"{path}/data")
    gone = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName().removeprefix("version=") not in named] if fs.exists(data) else []
    for n in numbers[:-keep]:
        fs.delete(_fs(spark, f"{path}/pointers/{n:09d}.json")[1], False)
    for old in gone:
        fs.delete(old, True)
    return len(gone)


def rebuild(frames: Iterable[DataFrame], path: str) -> None:
    """Drop the table and write it again from cleaned snapshots."""
    combined = None
    for df in frames:
        combined = df if combined is None else combined.unionByName(df)
    if combined is None:
        raise ValueError("nothing to rebuild from")
    replace_table(combined, path, PARTITION)


def list_tables(spark: SparkSession, base: str, names: Iterable[str]) -> DataFrame:
    """Which of the known tables exist under a base folder."""
    return small_table(
        spark, [(n, table_exists(spark, f"{base}/{n}")) for n in sorted(names)], "table_name string, present boolean")


__all__ = ["PARTITION", "list_tables", "pointer", "read_table", "rebuild", "replace_table", "stored_schema", "table_exists",
           "upsert_snapshot", "vacuum"]
