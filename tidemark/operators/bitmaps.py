"""Ids as bits: survival, set counts and flow from bitmaps per (snapshot, dimension, category), without shuffling ids.

Ids get dense numbers that never change.  A snapshot adds one row for each (dimension, category, word): a bitmap of 32,768
numbers.  Comparisons then shuffle words, a few bytes for many ids, and a new snapshot leaves the words of the others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.snapshots import _long_by_dimension
from tidemark.session import small_table
from tidemark.sources import tables

ID_PARTS = 1024                  # numbers are handed out in so many independent ranges
_RANGE_BITS = 40
IDS = "key string, part int, number bigint, snapshot_date string"
WORDS = "dimension string, category string, word bigint, bits binary, snapshot_date string"


def extend_ids(known: DataFrame, keys: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, part, number) for the ids of ``keys`` that ``known`` lacks; numbers go on where each part's range ended."""
    part = F.pmod(F.xxhash64("key"), F.lit(ID_PARTS)).cast("int")
    fresh = keys.select(F.col(key).cast("string").alias("key")).where("key IS NOT NULL").distinct().join(
        known.select("key"), "key", "left_anti").withColumn("part", part)
    ends = known.groupBy("part").agg(F.max("number").alias("_end"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("key"))         # one range's new ids
    start = F.col("part").cast("long") * F.lit(1 << _RANGE_BITS) - 1
    return fresh.join(F.broadcast(ends), "part", "left").select(
        "key", "part", (F.coalesce("_end", start) + place).alias("number"))       # ends: ID_PARTS rows


def snapshot_words(postings: DataFrame, ids: DataFrame, dimensions: dict[str, str], key: str = "job_id") -> DataFrame:
    """(dimension, category, word, bits) of one snapshot; null ids and categories are left out, repeated rows count once."""
    rows = postings.where(F.col(key).isNotNull()).withColumn("key", F.col(key).cast("string")).join(ids.select("key", "number"), "key")
    long = _long_by_dimension(rows, dimensions, ["number"]).where(F.col("category").isNotNull())
    return long.groupBy("dimension", "category", F.bitmap_bucket_number("number").alias("word")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


class Bitmaps:
    """The tables ``ids`` and ``words`` under a base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def ids(self) -> DataFrame:
        return tables.read_table(self.spark, f"{self.base}/ids", IDS)

    def words(self) -> DataFrame:
        return tables.read_table(self.spark, f"{self.base}/words", WORDS)

    def upsert(self, postings: DataFrame, snapshot: str, dimensions: dict[str, str], key: str = "job_id") -> None:
        """Put one snapshot.  Ids first seen here are numbered under its label and keep their number if it is put again."""
        mine = self.ids().where(F.col("snapshot_date") == snapshot)
        fresh = extend_ids(self.ids(), postings, key)
        tables.upsert_snapshot(mine.select("key", "part", "number").unionByName(fresh), f"{self.base}/ids", snapshot)
        tables.upsert_snapshot(snapshot_words(postings, self.ids(), dimensions, key), f"{self.base}/words", snapshot)


def _paired(words: DataFrame, axis: list[str], snapshot: str) -> DataFrame:
    """Each word once for every adjacent pair that it is a side of."""
    sides = [(axis[i + d], i, d) for i in range(len(axis) - 1) for d in (0, 1)]
    pairs = small_table(words.sparkSession, sides, f"{snapshot} string, _pair int, _side int")
    return words.join(F.broadcast(pairs), snapshot)                                 # two rows a snapshot


def _labels(axis: list[str]) -> list:
    names = F.array(*[F.lit(s) for s in axis])
    return [F.get(names, F.col("_pair")).alias("from_snapshot"), F.get(names, F.col("_pair") + 1).alias("to_snapshot")]


def set_counts(words: DataFrame, axis: list[str], snapshot: str = "snapshot_date") -> DataFrame:
    """n_from, n_to, n_both and n_either per adjacent pair, dimension and category."""
    here = F.bitmap_count("bits")
    side = lambda d: F.coalesce(F.sum(F.when(F.col("_side") == d, here)), F.lit(0).cast("long"))
    both = F.when(F.count(F.lit(1)) == 2, F.bitmap_count(F.bitmap_and_agg("bits"))).otherwise(F.lit(0).cast("long"))
    per_word = _paired(words, axis, snapshot).groupBy("_pair", "dimension", "category", "word").agg(
        side(0).alias("n_from"), side(1).alias("n_to"), both.alias("n_both"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("n_either"))
    return per_word.groupBy("_pair", "dimension", "category").agg(*(F.sum(c).alias(c) for c in ("n_from", "n_to", "n_both", "n_either"))).select(
        *_labels(axis), "dimension", "category", "n_from", "n_to", "n_both", "n_either")


def survival(words: DataFrame, axis: list[str], snapshot: str = "snapshot_date") -> DataFrame:
    """The columns of :func:`snapshots.survival`, from words."""
    counts = set_counts(words, axis, snapshot)
    gone, added = F.col("n_from") - F.col("n_both"), F.col("n_to") - F.col("n_both")
    return counts.select(
        "from_snapshot", "to_snapshot", "dimension", "category", "n_from", "n_to", F.col("n_both").alias("n_survived"),
        gone.alias("n_gone"), added.alias("n_added"), F.try_divide(gone, F.col("n_from")).alias("churn_rate"),
        F.try_divide(added, F.col("n_to")).alias("renewal_rate"))


def flow(words: DataFrame, axis: list[str], dimension: str, snapshot: str = "snapshot_date") -> DataFrame:
    """(from_snapshot, to_snapshot, from_category, to_category, n) of one dimension in which an id has one category a
    snapshot; a null end stands for ids that came or went.

    Words of the two sides meet by their number, so a pair of categories is compared only where both have ids.
    """
    rows = _paired(words.where(F.col("dimension") == dimension), axis, snapshot).select("_pair", "_side", "category", "word", "bits")
    old = rows.where("_side = 0").select("_pair", "word", F.col("category").alias("_from"), F.col("bits").alias("_a"))
    new = rows.where("_side = 1").select("_pair", "word", F.col("category").alias("_to"), F.col("bits").alias("_b"))
    met = old.join(new, ["_pair", "word"]).select("_pair", "word", "_from", "_to", F.explode(F.array("_a", "_b")).alias("bits"))
    moved = met.groupBy("_pair", "_from", "_to", "word").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n")).groupBy(
        "_pair", "_from", "_to").agg(F.sum("n").alias("n")).where("n > 0")
    sizes = rows.groupBy("_pair", "_side", "category").agg(F.sum(F.bitmap_count("bits")).alias("_all"))

    def rest(side: int, end: str, other: str) -> DataFrame:
        stayed = moved.groupBy("_pair", F.col(end).alias("category")).agg(F.sum("n").alias("_met"))
        left = sizes.where(F.col("_side") == side).join(stayed, ["_pair", "category"], "left")
        return left.select("_pair", F.col("category").alias(end), F.lit(None).cast("string").alias(other),
                           (F.col("_all") - F.coalesce("_met", F.lit(0))).alias("n")).where("n > 0")

    whole = moved.unionByName(rest(0, "_from", "_to")).unionByName(rest(1, "_to", "_from"))
    return whole.select(*_labels(axis), F.col("_from").alias("from_category"), F.col("_to").alias("to_category"), "n")
