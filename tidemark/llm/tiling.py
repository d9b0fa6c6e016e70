"""Benchmark decontamination by greedy string tiling.

Texts become sequences of lower-cased words.  Documents that share a seed, a window of five words, with a benchmark
item are found by a join on the seeds' Karp-Rabin hashes; a Bloom filter of fixed size over the item's seeds keeps
other windows out of the join.  Each candidate pair is then tiled: the longest matches between unmarked words are
found by Karp-Rabin hashes of falling length, marked in both texts, and the search goes on until no match of
seed length is left.  The share of marked words of the item decides, so reordered passages count in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, INVERSE, mix, power_table, runs, span_hashes, text_slices, unused, window_hashes
from tidemark.session import cut

SEED_WORDS = 5
THRESHOLD = 0.6
PAIRS = 1 << 18                 # pairs of equal windows looked at together
BLOOM_BITS = 24                 # 2**24 bits, 2 MB, whatever the size of the benchmark

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row of each word) by slices.  Words are runs of ASCII letters and digits and all other
    code points from U+0080; A-Z is lower-cased."""
    for first, _, data, offsets in text_slices(column):
        data = _LOWER[data]
        starts, ends, doc = runs(_WORD[data], offsets)
        yield first, span_hashes(data, starts, ends), doc


def _places(seeds: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    return [seeds & mask, (seeds >> np.uint64(32)) & mask]


def item_seeds(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(item, seed, n_words, places): the distinct seeds of each item, by its row hash, and at how many places of the item
    each is; items under ``k`` words have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, doc in word_hashes(batch.column(1)):
                h, at = window_hashes(words, doc, k)
                n = np.bincount(doc, minlength=len(batch))
                rows = first + doc[at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(h.view(np.int64)), pa.array(n[doc[at]].astype(np.int64))],
                    names=["item", "seed", "n_words"])

    return items.select(row_hash(key, text).alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "item bigint, seed bigint, n_words bigint").groupBy("item", "seed", "n_words").agg(F.count(F.lit(1)).alias("places"))


def bloom(seeds: DataFrame) -> np.ndarray:
    """The filter as bytes.  Bits are gathered by Spark, so what the driver gets is bounded by the filter's size."""
    low, high = F.col("seed").bitwiseAND(F.lit((1 << BLOOM_BITS) - 1)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))
    bits = seeds.select(F.explode(F.array(low, high)).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint8)


def in_bloom(seeds: np.ndarray, filled: np.ndarray) -> np.ndarray:
    found = np.ones(len(seeds), dtype=bool)
    for p in _places(seeds):
        found &= (filled[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def tiles(item: np.ndarray, doc: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, length) of two arrays of word hashes, longest first.

    Ties go to the earliest place in the item, then in the document.  No word is in two tiles.
    """
    free_item, free_doc = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), len(doc)))
    while length >= least:
        found = _matches(item, doc, free_item, free_doc, length)
        marked = False
        for size, i, j in found:
            if free_item[i:i + size].all() and free_doc[j:j + size].all() and np.array_equal(item[i:i + size], doc[j:j + size]):
                free_item[i:i + size] = False
                free_doc[j:j + size] = False
                out.append((i, j, size))
                marked = True
        if not marked:
            if length == least:
                break
            length = max(least, length // 2)
    return sorted(out, key=lambda t: (-t[2], t[0], t[1]))


class _Hashed:
    """Words with running sums, so that any stretch has its Karp-Rabin hash and its count of marked words at once."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * power_table(BASE, len(words)), out=self.total[1:])
        self.marked = np.concatenate([[0], np.cumsum(~free)])
        self.inverse = power_table(INVERSE, len(words) + 1)

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.inverse[at]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the windows of ``k`` words without a marked one."""
        if len(self.words) < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.marked[k:] == self.marked[:-k])
        return mix(self.hashes(at, k)), at


def _matches(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``k`` unmarked words as (length, item start, document start), longest first.

    Pairs of equal windows are looked at a part at a time, and of each match only the first is kept, so memory follows the
    matches and not the pairs.  Lengths are found by bisection on hashes; the caller compares the words.
    """
    a, b = _Hashed(item, free_item), _Hashed(doc, free_doc)
    hi, at_item = a.windows(k)
    hd, at_doc = b.windows(k)
    order = np.argsort(hi, kind="stable")
    hi, at_item = hi[order], at_item[order]
    lo, up = np.searchsorted(hi, hd), np.searchsorted(hi, hd, "right")
    hit = np.flatnonzero(up > lo)
    at_doc, lo, many = at_doc[hit], lo[hit], (up - lo)[hit]
    ends = np.cumsum(many)
    found = []
    first = 0
    while first < len(many):
        before = ends[first] - many[first]
        last = max(first + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = many[first:last]
        j = np.repeat(at_doc[first:last], n)
        i = at_item[np.repeat(lo[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        inner = (i > 0) & (j > 0)
        inner[inner] = (item[i[inner] - 1] == doc[j[inner] - 1]) & free_item[i[inner] - 1] & free_doc[j[inner] - 1]
        found.append((i[~inner], j[~inner]))
        first = last
    if not found:
        return []
    i, j = (np.concatenate(x) for x in zip(*found))
    size, most = np.full(len(i), k), np.minimum(len(item) - i, len(doc) - j)
    while (size < most).any():                               # size fits, most + 1 does not
        half = (size + most + 1) // 2
        fits = ((a.marked[i + half] == a.marked[i]) & (b.marked[j + half] == b.marked[j]) & (a.hashes(i, half) == b.hashes(j, half)))
        size, most = np.where(fits, half, size), np.where(fits, most, half - 1)
    order = np.lexsort((j, i, -size))
    return list(zip(size[order].tolist(), i[order].tolist(), j[order].tolist()))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", threshold: float = THRESHOLD, k: int = SEED_WORDS) -> DataFrame:
    """One row per leaking (document, item): ``key``, ``item_key``, coverage, n_tiles, longest, row_hash.

    ``coverage`` is the share of the item's words in tiles, at least ``threshold``.  ``row_hash`` identifies the
    document's row by key and text.  Equal rows are reported once.  Null and short texts and items under ``k`` words
    leak nothing.  Null keys are kept as they are.  Empty tables give no rows.
    """
    seeds = cut(item_seeds(items, item_key, item_text, k))
    filled = bloom(seeds)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, doc in word_hashes(batch.column(2)):
                h, at = window_hashes(words, doc, k)
                hit = np.flatnonzero(in_bloom(h, filled))
                h, rows = h[hit].view(np.int64), doc[at[hit]]
                edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
                lists = [np.unique(x) for x in np.split(h, edges[1:])] if len(rows) else []
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(first + rows[edges])) for c in batch.columns] + [pa.array(lists, pa.list_(pa.int64()))],
                    names=["row_hash", "doc", "text", "seeds"])

    kind = dict(docs.dtypes)[key]
    picked = docs.select(row_hash(key, text).alias("row_hash"), F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    hits = cut(picked.mapInArrow(seek, f"row_hash bigint, doc {kind}, text string, seeds array<bigint>"))
    shared = hits.select("row_hash", F.explode("seeds").alias("seed")).distinct().join(seeds, "seed")
    pairs = shared.groupBy("row_hash", "item").agg(F.sum("places").alias("n"), F.max("n_words").alias("n_words")).where(
        F.col("n") * k >= F.col("n_words") * threshold).select("row_hash", "item")
    texts = hits.groupBy("row_hash").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))
    named = items.select(row_hash(item_key, item_text).alias("item"), F.col(item_key).alias("name"), F.col(item_text).cast("string").alias("item_text")).distinct()
    ready = pairs.join(texts, "row_hash").join(named, "item").select("row_hash", "doc", "name", "text", "item_text")
    item_kind = dict(items.dtypes)[item_key]

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("item_text", "text"))):
                item, doc = (np.concatenate([w for _, w, _ in word_hashes(pa.array([x]))] or [np.zeros(0, np.uint64)]) for x in (a, b))
                found = tiles(item, doc, k)
                made.append((sum(t[2] for t in found) / max(1, len(item)), len(found), max([0, *(t[2] for t in found)])))
            columns = list(zip(*made)) if made else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_hash"), batch.column("doc"), batch.column("name"), pa.array(columns[0], pa.float64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                names=["row_hash", "doc", "name", "coverage", "n_tiles", "longest"])

    tiled = ready.mapInArrow(tile, f"row_hash bigint, doc {kind}, name {item_kind}, coverage double, n_tiles bigint, longest bigint")
    return tiled.where(F.col("coverage") >= threshold).select(
        F.col("doc").alias(key), F.col("name").alias(item_key), "coverage", "n_tiles", "longest", "row_hash")


def row_hash(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text).cast("string"))


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item leaks; columns stay as they are, whatever their names.

    Null and empty texts are kept, repeated rows are judged alike, empty tables of either kind drop nothing.
    """
    mark, = unused(docs.columns, "_row_hash")
    leaking = cut(find_leaks(docs, items, key, text).select(F.col("row_hash").alias(mark)).distinct())
    return docs.withColumn(mark, row_hash(key, text)).join(leaking, mark, "left_anti").select(*docs.columns)
