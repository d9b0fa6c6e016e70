"""Byte-level text helpers in numpy, shared by the operators of this package, and connected components.

Texts reach Python as Arrow batches.  Work goes over slices of a megabyte of UTF-8, so memory follows
the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SLICE_BYTES = 1 << 20
SALTS = 64

#: fixed values: the bytes that separate words, U+0020 and U+0009 to U+000D
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = 0x9E3779B97F4A7C15                       # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {}


def unused(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each lengthened until no column has it in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of rows of at most ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the runs where ``inside`` holds; a text's edge ends a run."""
    before = np.empty(len(inside) + 1, dtype=bool)
    before[0], before[1:] = False, inside
    fresh = ~before[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(inside)]] = True
    starts = np.flatnonzero(inside & fresh)
    stop = np.empty(len(inside), dtype=bool)
    if len(stop):
        stop[:-1] = fresh[1:]
        stop[-1] = True
        stop[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial modulo 2**64 from one running sum, then mixed with the length."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_table(BASE, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * power_table(INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start index) of each window of ``k`` consecutive values of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i:i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(out[at]), at


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` items after linking ``i`` with ``j``: the smallest index it reaches."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        lower = label.copy()
        np.minimum.at(lower, i, least)
        np.minimum.at(lower, j, least)
        np.minimum.at(lower, label[i], least)
        np.minimum.at(lower, label[j], least)
        lower = lower[lower]
        if np.array_equal(lower, label):
            break
        label = lower
        open_ = label[i] != label[j]
        i, j = (i[open_], j[open_]) if open_.any() else (i[:0], j[:0])
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def with_least(rows: DataFrame, key: str, value: str, out: str, keep: str = "true", best: Callable[[str], Column] = F.min) -> DataFrame:
    """The rows that ``keep``, plus ``out``: the least ``value`` (or the ``best``) among all rows of their key.

    A key is split over ``SALTS`` parts: minima of the parts are settled first, and rows are joined by key and
    part, so a key that holds most rows is spread over tasks.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(key, "_salt").agg(best(value).alias("_part"))
    least = parts.select(key, "_salt", best("_part").over(Window.partitionBy(key)).alias(out))   # SALTS rows a key at most
    return salted.where(keep).join(least, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Alternates two star steps: each node hands its larger neighbours to its least neighbour, then its smaller
    ones.  Degrees shrink every round; a hub is split by :func:`with_least`.  Each round is written to the
    checkpoint folder.  No edges give no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0]
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, "a", "b", "m", "b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = with_least(large, "a", "b", "m")
        now = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
