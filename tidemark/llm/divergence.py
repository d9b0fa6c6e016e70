"""How far the term use of a language's sources lies apart: a sparse merge for each pair of sources.

Terms are runs of ASCII letters and of code points from U+0080, A-Z lower-cased.  Counts are gathered per
(language, source, term) with a combine in each task.  Terms in enough documents of a language are kept, dealt into
chunks of bounded size by hash and numbered inside their chunk, so a group is, chunk by chunk, a sorted array of
(term id, count).  One task takes a chunk of an unordered pair of sources: it intersects the two arrays by
galloping and prices terms of both, of one side only and of neither.  The price is symmetric, so a sum serves both
directions.  All arithmetic is on integers; counts may reach 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import top_n
from tidemark.session import cut

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1000                     # its cube, 10**9, is the unit of a share
SMOOTH = 2                       # added to every count
CHUNK_TERMS = 1 << 15            # terms of a chunk, on average
HELD_ENTRIES = 400_000           # entries of a task's counters before they are handed on
PIECE_BYTES = 1 << 20            # of a text split at once
RUN = 256                        # elements looked up together between two gallops

_FOLD = bytearray(b" " * 128 + bytes(range(128, 256)))
for _b in range(65, 91):
    _FOLD[_b] = _FOLD[_b + 32] = _b + 32
_FOLD = bytes(_FOLD)


def _pieces(folded: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; pieces end between terms."""
    at, size = 0, len(folded)
    while at < size:
        end = size if size - at <= PIECE_BYTES else folded.rfind(b" ", at, at + PIECE_BYTES)
        if end < at:                                             # one term longer than a piece
            end = folded.find(b" ", at + PIECE_BYTES)
            end = size if end < 0 else end
        yield folded[at:end].split()
        at = end + 1


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; a row with an empty term counts
    the documents of a group, so groups without terms stay."""
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], Counter] = {}
        seen: dict[tuple[str, str], Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for group, counts in uses.items():
                terms = list(counts)
                for first in range(0, len(terms), 100_000):
                    part = terms[first:first + 100_000]
                    column = pa.array(part, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group[0]] * len(part), pa.string()), pa.array([group[1]] * len(part), pa.string()), column,
                         pa.array([counts[t] for t in part], pa.int64()), pa.array([seen[group][t] for t in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"])
            uses.clear()
            seen.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group, body in zip(zip(langs, sources), batch.column(2)):
                if group not in uses:
                    uses[group], seen[group] = Counter(), Counter()
                folded = body.as_buffer().to_pybytes().translate(_FOLD)
                if len(folded) <= PIECE_BYTES:
                    terms = folded.split()
                    uses[group].update(terms)
                    own = set(terms)
                else:
                    own = set()
                    for terms in _pieces(folded):
                        uses[group].update(terms)
                        own.update(terms)
                own.add(b"")
                seen[group].update(own)
                uses[group].setdefault(b"", 0)
            if sum(map(len, uses.values())) > HELD_ENTRIES:
                yield from hand_on()
        yield from hand_on()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
                          ((lang, "lang"), (source, "source"), (text, "text"))))
    return plain.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), a division by thousands in turn, so nothing overflows."""
    whole = total + SMOOTH * terms
    part, out = n + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        up = part * SCALE
        out, part = out * SCALE + F.call_function("div", up, whole), up % whole
    return out + 1


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """:func:`share` of an array."""
    whole = total + SMOOTH * terms
    part, out = n + SMOOTH, np.zeros(len(n), dtype=np.int64)
    for _ in range(3):
        part = part * SCALE
        out, part = out * SCALE + part // whole, part % whole
    return out + 1


def price(p, q):
    return (p - q) * (p - q) // (p + q)


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Where each value of the sorted ``few`` would stand in the sorted ``many``: a run of values at a time, its bracket
    found by steps of doubling width from where the last run ended."""
    out = np.empty(len(few), dtype=np.int64)
    at = 0
    for first in range(0, len(few), RUN):
        run = few[first:first + RUN]
        step = RUN
        while at + step < len(many) and many[at + step] < run[-1]:
            step *= 2
        out[first:first + RUN] = at + np.searchsorted(many[at:at + step + 1], run)
        at = int(out[first + len(run) - 1])
    return out


def merge(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, totals: tuple[int, int], terms: int, chunk_terms: int) -> int:
    """The summed price of a chunk of ``chunk_terms`` terms: ids ``a`` with counts ``n_a`` in one group, ``b`` with ``n_b`` in the other."""
    if len(a) > len(b):
        a, n_a, b, n_b, totals = b, n_b, a, n_a, totals[::-1]
    zero_a, zero_b = (int(shares(np.zeros(1, np.int64), t, terms)[0]) for t in totals)
    p, q = shares(n_a, totals[0], terms), shares(n_b, totals[1], terms)
    at = gallop(a, b)
    both = np.zeros(len(a), dtype=bool)
    inside = at < len(b)
    both[inside] = b[at[inside]] == a[inside]
    met = np.zeros(len(b), dtype=bool)
    met[at[both]] = True
    total = int(price(p[both], q[at[both]]).sum())               # in both groups
    total += int(price(p[~both], zero_b).sum())                  # in the first only
    total += int(price(q[~met], zero_a).sum())                   # in the second only
    return total + (chunk_terms - len(a) - len(b) + int(both.sum())) * price(zero_a, zero_b)


def _packed(table: pa.Table) -> pa.Table:
    """The entries of a group in a chunk as one row: sorted ids and counts as the bytes of little-endian arrays."""
    ids, n = table["id"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(ids)
    first = table.slice(0, 1).select(["lang", "source", "chunk"])
    wide = n.astype("<u2") if n.max() < 1 << 16 else n.astype("<i8")
    return first.append_column("ids", pa.array([ids[order].astype("<i4").tobytes()], pa.binary())).append_column(
        "counts", pa.array([wide[order].tobytes()], pa.binary()))


def _arrays(ids: bytes | None, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids or b"", "<i4").astype(np.int64)
    kind = "<u2" if len(counts or b"") == 2 * len(found) else "<i8"
    return found, np.frombuffer(counts or b"", kind).astype(np.int64)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS,
          top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the language's others, and its own terms.

    Part ``pair``: every other source of the language and the summed price over all kept terms, ranked from the
    farthest.  Part ``term``: the ``top`` terms that the source uses more than its language, by price.  Ties go to the
    item first in UTF-8 order.  Null text, language or source reads as empty; a repeated row is a document more.  A
    language without a kept term gives prices of 0 and no terms.  A language with one source has no pair.  An empty
    table gives no rows; other columns are ignored.
    """
    counts = cut(count_terms(docs, text, lang, source))
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(
        F.col("docs") >= min_documents).select("lang", "term", "total")
    kept = cut(kept)
    chunks = max(1, -(-kept.count() // CHUNK_TERMS))
    in_chunk = Window.partitionBy("lang", "chunk").orderBy("term")             # a chunk's terms only
    numbered = cut(kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn(
        "id", (F.row_number().over(in_chunk) - 1).cast("int")))
    langs = numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    used = cut(counts.where("n > 0").join(numbered, ["lang", "term"]).select("lang", "source", "term", "chunk", "id", "n", "total"))
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    groups = cut(counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("all", "terms", "lang_total"))))

    # part term
    priced = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("all"), F.col("terms"))).withColumn(
        "q", share(F.col("total"), F.col("lang_total"), F.col("terms"))).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = top_n(priced, ["lang", "source"], [F.col("value").desc(), F.col("item")], top, "rank")

    # part pair: each group's array of each chunk, empty ones too, goes to every pair it is in
    sizes = numbered.groupBy("lang", "chunk").agg(F.count(F.lit(1)).cast("int").alias("chunk_terms"))
    arrays = cut(used.select("lang", "source", "chunk", "id", "n").groupBy("lang", "source", "chunk").applyInArrow(
        _packed, "lang string, source string, chunk int, ids binary, counts binary"))
    filled = groups.join(sizes, "lang").join(arrays, ["lang", "source", "chunk"], "left").select(
        "lang", "source", "chunk", "chunk_terms", "all", "terms", "ids", "counts")
    named = groups.select("lang", "source")
    pairs = named.withColumnRenamed("source", "one").join(named.withColumnRenamed("source", "other"), "lang").where("one < other")
    columns = ["lang", "one", "other", "chunk", "chunk_terms", "all", "terms", "ids", "counts"]
    sides = [filled.withColumnRenamed("source", side).join(pairs, ["lang", side]).select(*(F.col(c).alias(c) for c in columns))
             for side in ("one", "other")]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.to_pylist()[0], right.to_pylist()[0]
        value = merge(*_arrays(a["ids"], a["counts"]), *_arrays(b["ids"], b["counts"]), (a["all"], b["all"]), a["terms"], a["chunk_terms"])
        return pa.table({"lang": pa.array([a["lang"]], pa.string()), "one": pa.array([a["one"]], pa.string()),
                         "other": pa.array([a["other"]], pa.string()), "value": pa.array([value], pa.int64())})

    keys = ["lang", "one", "other", "chunk"]
    merged = sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInArrow(task, "lang string, one string, other string, value bigint")
    summed = pairs.join(merged.groupBy("lang", "one", "other").agg(F.sum("value").alias("value")), ["lang", "one", "other"], "left").select(
        "lang", "one", "other", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    both = summed.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")),
                                                   F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("s"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")      # one row for each other source
    ranked = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(terms.select(*ranked.columns))
