"""Text to unit vectors with any encoder, a hashed n-gram encoder for offline use, and freshness checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import NORM_GUARD, as_lists
from tidemark.operators.textfeatures import NGRAM_MAX, NGRAM_MIN

_HASH_SLOTS = 1 << 18
_CHARS_AT_ONCE = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: a factory runs once per Python worker and returns texts -> (n, dim) matrix
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def encode(rows: DataFrame, factory: EncoderFactory, text: str = "text_for_embed", out: str = "vec",
           batch: int = 64) -> DataFrame:
    """Adds the unit vector of ``text``; other columns pass through untouched, Arrow batch by Arrow batch."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = ["" if t is None else t for t in b.column(text).to_pylist()]
            parts = [np.asarray(model(texts[i:i + batch]), dtype=np.float32) for i in range(0, len(texts), batch)]
            if not parts:
                continue
            m = np.vstack(parts)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_GUARD)
            yield pa.RecordBatch.from_arrays([*b.columns, as_lists(m, pa.float32())], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def _single_spaced(text: Column) -> Column:
    """Lower case, single spaces, one space on both ends."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def _window_slots(texts: pa.Array, slots: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hash slots of all in-word character n-grams: (first row, rows, owner of each slot, slot).

    Rows are joined with line breaks and hashed as one array of code points, a bounded number of
    characters at a time; windows that run over a word or a row are masked out.
    """
    rows = texts.to_pylist()
    start = 0
    while start < len(rows):
        stop, budget = start, _CHARS_AT_ONCE
        while stop < len(rows) and (stop == start or budget >= len(rows[stop])):
            budget -= len(rows[stop])
            stop += 1
        block = rows[start:stop]
        codes = np.frombuffer("\n".join([*block, ""]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(block)), [len(t) + 1 for t in block])
        end, space = codes == 10, codes == 32
        owners, found = [], []
        for n in range(NGRAM_MIN, NGRAM_MAX + 1):
            size = len(codes) - n + 1
            if size <= 0:
                break
            mixed, valid = np.full(size, n, dtype=np.uint64), np.ones(size, dtype=bool)
            for i in range(n):
                mixed = (mixed ^ codes[i:i + size]) * _MIX
                mixed ^= mixed >> np.uint64(29)
                valid &= ~end[i:i + size]
                if 0 < i < n - 1:
                    valid &= ~space[i:i + size]
            if n == 2:
                valid &= ~(space[:size] & space[1:1 + size])      # a blank text has no n-gram
            owners.append(owner[:size][valid])
            found.append((mixed[valid] % np.uint64(slots)).astype(np.int64))
        yield start, len(block), np.concatenate(owners), np.concatenate(found)
        start = stop


def slot_idf(rows: DataFrame, text: str, slots: int = _HASH_SLOTS) -> np.ndarray:
    """Smooth inverse document frequency per hash slot; at most ``slots`` numbers reach the driver."""

    @F.arrow_udf("array<int>")
    def distinct_slots(values: pa.Array) -> pa.Array:
        parts = []
        for _, n, owner, slot in _window_slots(values, slots):
            seen = np.unique(owner * slots + slot)
            ends = np.searchsorted(seen, np.arange(n + 1) * slots).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((seen % slots).astype(np.int32))))
        return pa.concat_arrays(parts)

    seen = rows.select(F.explode(distinct_slots(_single_spaced(F.col(text)))).alias("slot")).groupBy("slot").agg(
        F.count(F.lit(1)).alias("df"))
    n = rows.count()
    idf = np.full(slots, np.log(1.0 + n) + 1.0)
    found = seen.toArrow()
    idf[found["slot"].to_numpy()] = np.log((1.0 + n) / (1.0 + found["df"].to_numpy())) + 1.0
    return idf


def hashed_ngram_vectors(rows: DataFrame, text: str = "text_for_embed", out: str = "vec", dim: int = 256,
                         idf: np.ndarray | None = None) -> DataFrame:
    """Offline encoder: IDF-weighted n-gram slots, signed projection to ``dim``, unit length.

    The whole text counts.  Give the reference snapshot's ``idf`` to encode later snapshots in the
    same space.
    """
    weights = slot_idf(rows, text) if idf is None else idf
    slots = len(weights)
    mixed = np.arange(1, slots + 1, dtype=np.uint64) * _MIX
    column = ((mixed >> np.uint64(20)) % np.uint64(dim)).astype(np.int64)
    signed = rows.sparkSession.sparkContext.broadcast(
        (column, weights * np.where((mixed >> np.uint64(60)) & np.uint64(1), 1.0, -1.0)))

    @F.arrow_udf("array<float>")
    def project(values: pa.Array) -> pa.Array:
        place, amount = signed.value
        parts = []
        for _, n, owner, slot in _window_slots(values, slots):
            m = np.bincount(owner * dim + place[slot], weights=amount[slot], minlength=n * dim).reshape(n, dim)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_GUARD)
            parts.append(as_lists(m.astype(np.float32), pa.float32()))
        return pa.concat_arrays(parts)

    return rows.withColumn(out, project(_single_spaced(F.col(text))))


def with_text_hash(rows: DataFrame, text: str = "text_for_embed") -> DataFrame:
    return rows.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256))


def needs_encoding(rows: DataFrame, stored: DataFrame, keys: list[str], text: str = "text_for_embed") -> DataFrame:
    """Rows whose (keys, text hash) has no stored vector, so a changed text is encoded again."""
    return with_text_hash(rows, text).join(stored.select(*keys, "text_hash"), [*keys, "text_hash"], "left_anti")


def vector_coverage(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, vectors, matched, rows without vector, vectors without row, repeated vector keys."""
    sides = rows.select(*keys, F.lit(1).alias("_r"), F.lit(0).alias("_v")).unionByName(
        vectors.select(*keys, F.lit(0).alias("_r"), F.lit(1).alias("_v")))
    per_key = sides.groupBy(*keys).agg(F.sum("_r").alias("r"), F.sum("_v").alias("v"))
    has_r, has_v = F.col("r") > 0, F.col("v") > 0
    return per_key.agg(
        F.sum("r").alias("n_rows"), F.sum("v").alias("n_vectors"), F.count(F.when(has_r & has_v, 1)).alias("n_matched"),
        F.count(F.when(has_r & ~has_v, 1)).alias("n_without_vector"),
        F.count(F.when(~has_r & has_v, 1)).alias("n_without_row"),
        F.count(F.when(F.col("v") > 1, 1)).alias("n_repeated_keys"))


def join_vectors(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have a vector, joined by key; raises when a vector has no row or a key repeats."""
    report = vector_coverage(rows, vectors, keys).head()
    if report["n_without_row"] or report["n_repeated_keys"]:
        raise ValueError(f"vectors do not line up with rows: {report.asDict()}")
    return rows.join(vectors, keys)
