"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, in tiles, with numpy exclusive-or and bit counts.  A tile holds rows of one
band and one class of population counts; since the distance of two fingerprints is at least the difference of
their population counts, only tiles of the same or the next class (a class is ``radius + 1`` counts wide) are
paired, and inside a pair of tiles each block of rows meets only the rows within the radius of its counts.

Bands keep the pairs of tiles from growing with the square of the corpus:

* one 64-bit word and a small radius: ``radius + 1`` blocks of bits, of which one must be equal, so no link is lost;
* the wide fingerprint of the corpus stage: 28 blocks of nine bits.  The fingerprint only proposes pairs there; each
  is confirmed by the exact similarity of its shingle sets before components are built.

A band with more than ``cap`` rows is cut into tiles of about ``cap`` rows, spread over tasks; smaller bands
are packed into groups of about ``cap`` rows.  Nothing is dropped at any size.  From each pair of tiles only a
spanning forest of its links leaves the task, so a group of copies never becomes all its pairs.  In the corpus stage
the nodes with a link in a pair of tiles meet again with their texts, and the forest is that of confirmed links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, forest, mix, unused, with_least
from tidemark.session import cut

SEED = 42
TILE_ROWS = 8192
_ROWS_AT_ONCE, _COMPARED_AT_ONCE, PAIRS_AT_ONCE = 64, 1024, 1 << 20
#: words of the wide fingerprint of the corpus stage, and the most bits that may differ: sets of five-word shingles
#: of similarity 0.8 differ in 38.8 of 256 bits on average with a standard deviation of 5.7, so 57 is 3.2 of these off
STAGE_WORDS64, STAGE_RADIUS, STAGE_SHINGLE, BLOCK_BITS = 4, 57, 5, 9
STAGE_SIMILARITY = 0.8          # least share of common distinct shingles of near copies
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_digests(text: str, k: int) -> bytes:
    """XXH64 (seed 42, big-endian) of every window of ``k`` words, joined by one space; fewer words: of all of them."""
    words = _WORD.findall(text.encode().lower())            # bytes.lower changes A-Z only
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[:-k + 1 or None] - [len(w) + 1 for w in words[:len(words) - k + 1]]).tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())])


def shingle_set(text: str, k: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.frombuffer(shingle_digests(text, k), dtype=">u8"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values of two sets of shingle hashes; two empty sets are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def fingerprint(text: str, k: int, words64: int = 1) -> tuple[list[int], int]:
    """(signed 64-bit words, number of shingles).  A bit is 1 if it is set in over half the shingle hashes."""
    return fingerprint_of(np.frombuffer(shingle_digests(text, k), dtype=">u8"), words64)


def fingerprint_of(h: np.ndarray, words64: int) -> tuple[list[int], int]:
    n = len(h)
    if not n:
        return [0] * words64, 0
    if words64 > 1:
        h = h.astype(np.uint64)
        h = np.stack([h] + [mix(h + np.uint64(0x9E3779B97F4A7C15 * i % (1 << 64))) for i in range(1, words64)], axis=1).astype(">u8")
    rows = h.reshape(n, words64).view(np.uint8)
    counts = np.zeros(64 * words64, dtype=np.int64)
    for i in range(0, n, 255):                              # sums of at most 255 bits fit a byte
        counts += np.add.reduce(np.unpackbits(rows[i:i + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).view(">i8").tolist(), n


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", k: int = 3, words64: int = 1) -> DataFrame:
    """``keys`` plus fingerprint words ``w0``.. and ``size`` (shingles).  Null and wordless texts get zero."""
    names = [f"w{i}" for i in range(words64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t or "", k, words64) for t in (x.as_py() for x in batch.column(len(keys)))]
            cols = [pa.array([m[0][i] for m in made], pa.int64()) for i in range(words64)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], *cols, pa.array([m[1] for m in made], pa.int64())], names=[*keys, *names, "size"])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + [f"{w} bigint" for w in names] + ["size bigint"])
    return docs.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def set_fingerprints(docs: DataFrame, keys: list[str], text: str, k: int, words64: int) -> DataFrame:
    """``keys``, ``node`` (a hash of the set of distinct shingles) and fingerprint words of that set."""
    names = [f"w{i}" for i in range(words64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(len(keys)):
                h = shingle_set(t.as_py() or "", k)
                node = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64)
                made.append([int(node), *fingerprint_of(h, words64)[0]])
            cols = [pa.array([m[i] for m in made], pa.int64()) for i in range(words64 + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], *cols], names=[*keys, "node", *names])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["node bigint"] + [f"{w} bigint" for w in names])
    return docs.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` (words x rows, sorted by population count) within ``radius``, for a few rows
    of ``a`` at a time: all pairs of a tile of copies would be its square."""
    ones_a, ones_b = (np.bitwise_count(x).sum(axis=0, dtype=np.int64) for x in (a, b))
    half = max(1, a.shape[0] // 2)
    for i in range(0, a.shape[1], _ROWS_AT_ONCE):
        block = a[:, i:i + _ROWS_AT_ONCE]
        lo = np.searchsorted(ones_b, ones_a[i] - radius)
        hi = np.searchsorted(ones_b, ones_a[min(i + _ROWS_AT_ONCE, a.shape[1]) - 1] + radius, "right")
        if lo >= hi:
            continue
        far = np.bitwise_count(block[0][:, None] ^ b[0, lo:hi][None, :])
        for w in range(1, half):
            far = far + np.bitwise_count(block[w][:, None] ^ b[w, lo:hi][None, :])
        x, y = np.nonzero(far <= radius)                    # a part of the words bounds the distance from below
        if a.shape[0] > half:
            whole = np.bitwise_count(block[:, x] ^ b[:, lo:hi][:, y]).sum(axis=0, dtype=np.int64)
            x, y = x[whole <= radius], y[whole <= radius]
        if len(x):
            yield x + i, y + lo


def _equal_bands(band: np.ndarray, words: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` among rows of the same band, for one distance of their places at a time; rows are
    sorted by band."""
    half = max(1, words.shape[0] // 2)
    for d in range(1, len(band)):
        same = band[:-d] == band[d:]
        if not same.any():
            break
        far = np.bitwise_count(words[0, :-d] ^ words[0, d:])
        for w in range(1, half):
            far = far + np.bitwise_count(words[w, :-d] ^ words[w, d:])
        at = np.flatnonzero(same & (far <= radius))         # a part of the words bounds the distance from below
        at = at[np.bitwise_count(words[:, at] ^ words[:, at + d]).sum(axis=0, dtype=np.int64) <= radius]
        if len(at):
            yield at, at + d


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """:func:`common.forest` over pairs that come a few at a time."""
    label, waiting = np.arange(n), []

    def settled() -> np.ndarray:
        child = np.flatnonzero(label != np.arange(n))
        i, j = (np.concatenate(x) for x in zip((child, label[child]), *waiting))
        return forest(i, j, n)

    for i, j in pairs:
        apart = label[i] != label[j]
        waiting.append((i[apart], j[apart]))
        if sum(len(x) for x, _ in waiting) > PAIRS_AT_ONCE:
            label, waiting = settled(), []
    return settled()


def _shares_before(differs: np.ndarray, spans: list[tuple[int, int, int]], band: np.ndarray) -> np.ndarray:
    """Mask of the pairs, given their differing bits (words x pairs), that are equal in a span before the one ``band`` is of."""
    own, out = band >> 33, np.zeros(differs.shape[1], dtype=bool)
    for at, (w, lo, hi) in enumerate(spans):
        out |= (at < own) & ((differs[w] >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) == 0)
    return out


def links(prints: DataFrame, radius: int, words64: int = 1, cap: int = TILE_ROWS, nodes_only: bool = False) -> DataFrame:
    """Edges (a, b) between nodes of ``prints`` (node, w0..) at ``radius`` or fewer differing bits that share a band.

    Only a spanning forest of each tile pair is returned, which keeps components and loses no link.  With ``nodes_only``
    the result is (node, g, pair): the nodes that have a link in a tile pair, and which one it is.  A link counts only in
    the first band that its ends share, so that a node goes on about once for each neighbour, not once for each band.
    """
    names = [f"w{i}" for i in range(words64)]
    ones = sum((F.bit_count(w) for w in names[1:]), F.bit_count(names[0]))
    if words64 == 1:
        edges = [i * 64 // (radius + 1) for i in range(radius + 2)]
    else:
        edges = list(range(0, 64, BLOCK_BITS))
    spans = [(w, lo, hi) for w in names for lo, hi in zip(edges, edges[1:])]
    bands = F.array(*[F.shiftrightunsigned(w, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) + F.lit(i << 33) for i, (w, lo, hi) in enumerate(spans)])
    places = [(names.index(w), lo, hi) for w, lo, hi in spans]
    per_row = len(spans)
    rows = prints.select("node", *names, F.explode(bands).alias("band"), F.floor(ones / (radius + 1)).cast("int").alias("level"))
    groups = max(1, -(-prints.count() * per_row // cap))
    by_level = rows.groupBy("band", "level").agg(F.count(F.lit(1)).alias("n"))
    hot = by_level.groupBy("band").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("level", F.ceil(F.col("n") / cap).cast("int")))).alias("tiles")
    ).where(F.col("n") > cap).drop("n")
    own = F.struct(F.col("level").alias("l"), F.pmod(F.xxhash64("node"), F.col("tiles")[F.col("level")]).cast("int").alias("t"))
    others = F.flatten(F.transform(
        F.filter(F.map_keys("tiles"), lambda c: F.abs(c - F.col("level")) <= 1),
        lambda c: F.transform(F.sequence(F.lit(0), F.col("tiles")[c] - 1), lambda t: F.struct(c.alias("l"), t.alias("t")))))
    placed = rows.join(hot, "band", "left").withColumn("own", F.when(F.col("tiles").isNotNull(), own))
    cold = placed.where("tiles IS NULL").select(
        "node", *names, "band", F.pmod(F.xxhash64("band"), F.lit(groups)).alias("g"),
        F.lit(None).cast("struct<l:int,t:int>").alias("lo"), F.lit(None).cast("struct<l:int,t:int>").alias("hi"), F.lit(0).alias("side"))
    warm = placed.where("tiles IS NOT NULL").withColumn("other", F.explode(others)).select(
        "node", *names, "band", F.col("band").alias("g"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    keyed = cold.unionByName(warm).select(
        "node", *names, "band", "side", "g", F.concat_ws(":", "lo.l", "lo.t", "hi.l", "hi.t").alias("pair"))

    def compare(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        words = np.stack([table[w].to_numpy().view(np.uint64) for w in names])
        band, side, pair = table["band"].to_numpy(), table["side"].to_numpy(), table["pair"][0].as_py()
        count = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
        if not pair:
            order = np.argsort(band, kind="stable")
            found = ((order[i], order[j]) for i, j in _equal_bands(band[order], words[:, order], radius))
        else:
            order = np.argsort(count, kind="stable")
            a, b = order[side[order] == 0], order[side[order] == 1]
            one, other = pair.split(":")[:2], pair.split(":")[2:]
            if one == other:
                b = a
            found = ((a[i], b[j]) for i, j in _near(words[:, a], words[:, b], radius))
        if nodes_only:
            has = np.zeros(len(node), dtype=bool)
            for i, j in found:
                first = (node[i] != node[j]) & ~_shares_before(words[:, i] ^ words[:, j], places, band[i])
                has[i[first]] = has[j[first]] = True
            linked = np.unique(node[has])
            return pa.table({"node": pa.array(linked, pa.int64()), "g": pa.array(np.full(len(linked), table["g"][0].as_py()), pa.int64()),
                             "pair": pa.array([pair] * len(linked), pa.string())})
        label = _forest(found, len(node))
        child = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[child], pa.int64()), "b": pa.array(node[label[child]], pa.int64())})

    return keyed.groupBy("g", "pair").applyInArrow(compare, "node bigint, g bigint, pair string" if nodes_only else "a bigint, b bigint")


def groups(marks: DataFrame, first: str, radius: int, words64: int = 1) -> DataFrame:
    """``marks`` (a written table with ``first``, w0.., size) plus ``component``: the least ``first`` that a row reaches."""
    names = [f"w{i}" for i in range(words64)]
    node = F.col("w0") if words64 == 1 else F.xxhash64(*names)
    prints = cut(marks.groupBy(*names).agg(F.min(first).alias("_first")).withColumn("node", node))
    roots = components(links(prints, radius, words64))
    rooted = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return marks.join(with_least(rooted, "root", "_first", "component").select(*names, "component"), names)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Words are runs of anything but U+0020 and U+0009 to U+000D, A-Z lower-cased; a text with fewer than ``k``
    words is one shingle.  Null and wordless texts have fingerprint zero and are linked like any other.  Rows
    with equal keys stay separate rows.  A null key is ignored by the least key of a component unless all
    are null.  An empty table gives no rows; other columns are ignored.
    """
    marks = cut(fingerprints(docs, [key], text, k))
    found = groups(marks, key, radius)
    return found.select(key, F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def confirmed(rows: DataFrame, k: int, least: float, radius: int, words64: int) -> DataFrame:
    """Edges (a, b) of a spanning forest, for each tile pair of ``rows`` (node, w0.., g, pair, _text), of the links within
    ``radius`` whose shingle sets have at least ``least`` similarity.  Near links come first; ends that are already
    in one tree aren't compared."""
    names = [f"w{i}" for i in range(words64)]

    def confirm(table: pa.Table) -> pa.Table:
        node, texts = table["node"].to_numpy(), table["_text"]
        words = np.stack([table[w].to_numpy().view(np.uint64) for w in names])
        order = np.argsort(np.bitwise_count(words).sum(axis=0, dtype=np.int64), kind="stable")
        root, sets, out = np.arange(len(node)), {}, []
        for i, j in _near(words[:, order], words[:, order], radius):
            i, j = order[i[i < j]], order[j[i < j]]
            near = np.argsort(np.bitwise_count(words[:, i] ^ words[:, j]).sum(axis=0, dtype=np.int64), kind="stable")
            i, j = i[near], j[near]
            while len(i):
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]
                for x, y in zip(i[:_COMPARED_AT_ONCE].tolist(), j[:_COMPARED_AT_ONCE].tolist()):
                    if root[x] == root[y]:
                        continue
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = shingle_set(texts[z].as_py() or "", k)
                    if similarity(sets[x], sets[y]) >= least:
                        root[root == max(root[x], root[y])] = min(root[x], root[y])
                        out.append((x, y))
                i, j = i[_COMPARED_AT_ONCE:], j[_COMPARED_AT_ONCE:]
        ends = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[ends[:, 0]], pa.int64()), "b": pa.array(node[ends[:, 1]], pa.int64())})

    return rows.select("node", *names, "g", "pair", "_text").groupBy("g", "pair").applyInArrow(confirm, "a bigint, b bigint")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the least key (null last), then the first read.

    Texts link if the sets of their five-word shingles have similarity 0.8 or more (common of all distinct ones).
    Fingerprints of 256 bits over these sets propose the pairs: at most 57 differing bits and one of 28 blocks of
    nine bits equal.  Equal sets are one node.  Columns are those of ``docs``; null texts are one group.
    """
    row, = unused(docs.columns, "_row")
    kept = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    ordered = kept.select(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("r")).alias("_first"),
                          F.col(text).cast("string").alias("_text"))
    marks = cut(set_fingerprints(ordered, ["_first"], "_text", STAGE_SHINGLE, STAGE_WORDS64))
    names = [f"w{i}" for i in range(STAGE_WORDS64)]
    prints = cut(marks.groupBy("node", *names).agg(F.min("_first").alias("_first")))
    linked = cut(links(prints, STAGE_RADIUS, STAGE_WORDS64, nodes_only=True))
    texts = cut(prints.join(linked.select("node").distinct(), "node", "left_semi").select("node", *names, F.col("_first.r").alias("_row")).join(
        kept.select(F.col(row).alias("_row"), F.col(text).cast("string").alias("_text")), "_row").drop("_row"))
    roots = components(confirmed(linked.join(texts, "node"), STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_RADIUS, STAGE_WORDS64))
    rooted = prints.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = with_least(rooted, "root", "_first", "_least").where(F.col("_first") == F.col("_least")).select(F.col("_first.r").alias(row))
    return kept.join(stays, row, "left_semi").select(*docs.columns)
