"""Hard negatives by exact integer scores from float32 products in a residue number system.

Components become integers.  Each is reduced modulo a few primes of ten bits to a residue around zero; a product of
residue matrices over 64 components then stays below 2**24 and is exact in float32, which is the fast path of every
matrix library.  Mixed-radix digits, again in float32, and one integer Horner step (Chinese remaindering) give the
signed score.  As many primes are taken as the block's own bound on a score asks for.

Anchors are dealt into blocks and rows into stripes; the task of a (block, stripe) holds the block and streams the
stripe, keeping the best of each anchor, so it hands on a few rows for each anchor however long the stripe is.  Positives
are sought among buckets of labels; their scores give the windows in which negatives are sought among all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import top_n

PRIMES = (1021, 1019, 1013, 1009, 997, 991)      # the largest under 2**10: 64 products of half of one stay under 2**24
SLICE = 64
LABEL_BUCKETS = 64
ANCHOR_BLOCK = 16_384
STRIPE_ROWS = 1 << 22
CELL = 1 << 20                                   # scores held at once
NONE = np.iinfo(np.int64).min


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p``, around zero; exact for float32 below 2**24."""
    return x - np.rint(x * np.float32(1 / p)) * np.float32(p)


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product exceeds twice ``bound``, so that signed values are told apart."""
    product = 1
    for i, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound + 2:
            return PRIMES[:i]
    raise ArithmeticError(f"a score may reach {bound}: the components are too large for exact 64-bit scores")


def product(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Inner products, as exact signed integers, of the rows behind the residue matrices ``a`` and ``b``."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        r = np.zeros((a[i].shape[0], b[i].shape[0]), dtype=np.float32)
        for at in range(0, a[i].shape[1], SLICE):
            r = balanced(a[i][:, at:at + SLICE] @ b[i][:, at:at + SLICE].T + r, p)
        for j in range(i):
            inverse = pow(primes[j], -1, p)
            r = balanced((r - digits[j]) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(r)
    out = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        out *= p
        out += digit.astype(np.int64)
    whole = int(np.prod([int(p) for p in primes], dtype=object))
    out[out > whole // 2] -= whole                           # a digit rounded to the far side of half
    out[out < -(whole // 2)] += whole
    return out


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a list column as a matrix; shorter rows are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale)
    if len(values) and np.abs(values).max() >= 2.0 ** 62:
        raise ArithmeticError("a component is too large for exact 64-bit scores")
    lengths = np.diff(np.asarray(column.offsets))
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.astype(np.int64).reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


class Best:
    """The best ``n`` of each slot by score, then id, then mark; equal rows are one."""

    def __init__(self, slots: int, n: int):
        self.n, self.floor = n, np.full(slots, NONE)
        self.rows = [np.zeros(0, dtype=np.int64) for _ in range(4)]          # slot, score, id, mark

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids, mark = (np.concatenate(x) for x in zip(self.rows, (slot, score, ids, mark)))
        order = np.lexsort((mark, ids, -score, slot))
        slot, score, ids, mark = slot[order], score[order], ids[order], mark[order]
        fresh = np.ones(len(slot), dtype=bool)
        fresh[1:] = (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1]) | (score[1:] != score[:-1])
        slot, score, ids, mark = slot[fresh], score[fresh], ids[fresh], mark[fresh]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.n
        last = rank == self.n - 1
        self.floor[slot[last]] = score[last]
        self.rows = [x[keep] for x in (slot, score, ids, mark)]


def _stream(scale: int, n: int, negatives: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells come sorted: the anchors of a cell, then its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, held = None, None, []

        def ready() -> dict:
            t = pa.Table.from_batches(held)
            vec = integers(t["vec"], scale)
            a = {c: t[c].to_numpy() for c in ("id", "mark", "label")} | {"vec": vec, "reach": int(np.abs(vec).sum(axis=1).max(initial=0)), "step": 64}
            spans = t["spans"].to_pylist()
            a["width"] = max([len(s or ()) for s in spans], default=0) if negatives else 1
            a["low"], a["high"] = np.full((len(spans), a["width"]), 1), np.full((len(spans), a["width"]), 0)
            a["positive"], a["score"] = np.zeros((len(spans), a["width"]), np.int64), np.zeros((len(spans), a["width"]), np.int64)
            if negatives:
                for i, s in enumerate(spans):
                    for j, x in enumerate(s or ()):
                        a["low"][i, j], a["high"][i, j], a["positive"][i, j], a["score"][i, j] = x["low"], x["high"], x["id"], x["score"]
            a["best"], a["by"] = Best(len(spans) * a["width"], n), {}
            return a

        def score_rows(a: dict, ids, mark, label, vec) -> None:
            width = max(vec.shape[1], a["vec"].shape[1])
            bound = a["reach"] * int(np.abs(vec).max(initial=0))
            primes = primes_for(bound)
            if (len(primes), width) not in a["by"]:
                a["by"] = {(len(primes), width): residues(np.pad(a["vec"], ((0, 0), (0, width - a["vec"].shape[1]))), primes)}
            left = a["by"][(len(primes), width)]
            right = residues(np.pad(vec, ((0, 0), (0, width - vec.shape[1]))), primes)
            at = 0
            while at < len(ids):
                # few rows first: they set a floor under which later rows are passed over
                part = slice(at, at + min(a["step"], max(1, CELL // len(a["id"]))))
                s = product(left, [r[part] for r in right], primes)
                same = a["label"][:, None] == label[None, part]
                other = a["id"][:, None] != ids[None, part]
                fits = other & ~same if negatives else other & same
                for j in range(a["width"]):
                    slots = np.arange(len(a["id"])) * a["width"] + j
                    hit = fits & (s >= np.maximum(a["best"].floor[slots], a["low"][:, j] if negatives else NONE)[:, None])
                    if negatives:
                        hit &= s <= a["high"][:, j][:, None]
                    i, k = np.nonzero(hit)
                    a["best"].add(slots[i], s[i, k], ids[part][k], mark[part][k])
                at, a["step"] = part.stop, a["step"] * 2

        def result(a: dict) -> pa.RecordBatch:
            slot, score, ids, mark = a["best"].rows
            i, j = slot // a["width"], slot % a["width"]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (a["id"][i], a["mark"][i], j, a["positive"][i, j], a["score"][i, j], ids, mark, score)],
                names=["anchor_id", "anchor_mark", "slot", "positive_id", "positive_score", "id", "mark", "score"])

        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])])) if len(cells) else []
            for first, last in zip(edges, [*edges[1:], len(cells)]):
                part = batch.slice(first, last - first)
                if cells[first] != cell:
                    if anchors is not None:
                        yield result(anchors)
                    cell, anchors, held = cells[first], None, []
                if sides[first] == 0:
                    held.append(part)
                    continue
                if anchors is None:
                    if not held:
                        continue                                            # rows of a cell without anchors
                    anchors, held = ready(), []
                if anchors["width"]:
                    score_rows(anchors, *(part.column(part.schema.get_field_index(c)).to_numpy() for c in ("id", "mark", "label")),
                               integers(part.column(part.schema.get_field_index("vec")), scale))
        if anchors is not None:
            yield result(anchors)

    return run


_FOUND = ("anchor_id bigint, anchor_mark bigint, slot bigint, positive_id bigint, positive_score bigint, id bigint, mark bigint, score bigint")
_SPANS = "array<struct<low:bigint,high:bigint,id:bigint,score:bigint>>"


def _search(rows: DataFrame, anchors: DataFrame, sizes: dict[int, tuple[int, int]], scale: int, n: int, negatives: bool) -> DataFrame:
    """The best of each stripe for each anchor.  ``sizes``: for each bucket its anchor blocks and row stripes."""
    lookup = lambda i: F.create_map(*[F.lit(x) for b, s in sizes.items() for x in (b, s[i])])[F.col("bucket")]
    cell = (F.col("bucket").cast("long") * F.lit(1 << 44) + F.col("block").cast("long") * F.lit(1 << 22) + F.col("stripe")).alias("cell")
    hashed = lambda *c: F.xxhash64("id", "mark", *c)
    kept = F.col("bucket").isin(list(sizes))
    left = anchors.where(kept).withColumn("block", F.pmod(hashed(), lookup(0))).withColumn("stripe", F.explode(F.sequence(F.lit(0), lookup(1) - 1)))
    # the partition's number spreads repeated rows
    right = rows.where(kept).withColumn("stripe", F.pmod(hashed(F.spark_partition_id()), lookup(1))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), lookup(0) - 1)))
    columns = ["id", "mark", "label", "vec"]
    dealt = left.select(cell, F.lit(0).alias("side"), *columns, "spans").unionByName(
        right.select(cell, F.lit(1).alias("side"), *columns, F.lit(None).cast(_SPANS).alias("spans")))
    cells = sum(b * s for b, s in sizes.values())
    return dealt.repartition(max(1, min(cells, 1 << 16)), "cell").sortWithinPartitions("cell", "side").mapInArrow(_stream(scale, n, negatives), _FOUND)


def mine(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", every: int = 100, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key is divisible by ``every``.  A score is the inner product of ``floor(scale * x)``.  An
    anchor's positives are its ``positives`` best rows of the same label and another key; for each, the ``negatives`` best
    rows of another label and key whose score lies from ``low`` to ``high`` per cent of the positive's.  Ties go to the
    smaller key.  Rows with a null key, label or vector, or a null or non-finite component, take no part.  Equal rows are
    one row; different rows with one key are told apart.  A shorter vector is filled with zeros.  Components so large that
    a score may pass 2**58 raise an ArithmeticError.  An empty table gives no rows; other columns are ignored.
    """
    integral = dict(vectors.dtypes)[label] in ("tinyint", "smallint", "int", "bigint")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vec).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), (F.col(label).cast("long") if integral else F.xxhash64(label)).alias("label"),
        F.col(vec).alias("vec")).withColumn("mark", F.xxhash64("label", "vec")).withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int"))
    anchors = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "mark"])
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("a")).collect()   # LABEL_BUCKETS rows
    total, cores = sum(r["n"] for r in counts), vectors.sparkSession.sparkContext.defaultParallelism

    def size(n: int, a: int) -> tuple[int, int]:
        stripes = max(-(-n // STRIPE_ROWS), min(-(-cores * n // max(1, total)), -(-n // 1024)), 1)
        return -(-a // ANCHOR_BLOCK), min(stripes, 1 << 22)

    by_label = {r["bucket"]: size(r["n"], r["a"]) for r in counts if r["a"]} or {0: (1, 1)}
    spanless = anchors.withColumn("spans", F.lit(None).cast(_SPANS))
    found = _search(rows, spanless, by_label, scale, positives, False).select("anchor_id", "anchor_mark", "id", "mark", "score").distinct()
    best = top_n(found, ["anchor_id", "anchor_mark"], [F.col("score").desc(), F.col("id"), F.col("mark")], positives)
    exact = lambda c: c.cast("decimal(38,0)")
    wide = [exact(F.col("score")) * p for p in (low, high)]
    spans = best.withColumn("low", F.ceil(wide[0] / 100).cast("long")).withColumn("high", F.floor(wide[1] / 100).cast("long")).groupBy(
        F.col("anchor_id").alias("id"), F.col("anchor_mark").alias("mark")).agg(
        F.sort_array(F.collect_list(F.struct("low", "high", "id", "score"))).cast(_SPANS).alias("spans"))       # ``positives`` entries
    whole = {0: size(total, sum(r["a"] for r in counts))} if any(r["a"] for r in counts) else {0: (1, 1)}
    one = lambda df: df.withColumn("bucket", F.lit(0))
    near = _search(one(rows), one(anchors.join(spans, ["id", "mark"])), whole, scale, negatives, True).distinct()
    ranked = top_n(near, ["anchor_id", "anchor_mark", "slot"], [F.col("score").desc(), F.col("id"), F.col("mark")], negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
