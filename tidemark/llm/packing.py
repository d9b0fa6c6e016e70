"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each task packs the documents of its own partition in blocks, so there is no shuffle and no task grows with
the corpus.  A document's full windows are cut off first; the remainders of a block, in pieces of at most 512
tokens, are divided over k windows by differencing: every piece starts as a partial partition of its own, and the two partial partitions of
the largest spread are merged so that large sums meet small ones, until one is left.  k starts at the least
possible count and rises while a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
BLOCK_ITEMS = 384          # remainders differenced together
PIECE = 512                # remainders are cut to this length, so that few sums are forced to be uneven
CACHE_WORDS = 300_000      # entries of each of the two generations of a worker's word-to-ids cache
_tokenizers: dict[str, Callable[[str], bytes]] = {}


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``k`` groups of near-equal sums (largest differencing; ties by first index)."""
    # a partial partition: [(sum, tree of indexes)] by falling sum, absent groups being zero
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        lone = k - len(b)                                    # groups of a that meet none of b
        merged = a[:lone] + b[:max(0, k - len(a))]
        over = len(a) - lone
        for x in range(max(0, over)):                        # largest of a with smallest of b
            s, t = a[lone + x], b[len(b) - 1 - x]
            merged.append((s[0] + t[0], (s[1], t[1])))
        merged.sort(key=lambda g: -g[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        found, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += (x[1], x[0])
            else:
                found.append(x)
        out.append(found)
    return out


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indexes of ``sizes`` (each at most ``capacity``) in windows of at most ``capacity``."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        k += max(1, k // 128)


def word_ids(path: str) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian 32-bit bytes, equal to the tokenizer's own.

    White space always ends a piece of this kind of vocabulary, so a text is split at spaces and line feeds and
    each part is encoded once per worker.  Plain words, with or without ASCII marks behind them, are their letters'
    ids and then the marks'; letters go to the tokenizer's model directly, every other part through the whole
    tokenizer.  The cache has two generations: a full one becomes the old one, and a part found there moves back, so
    frequent words stay while rare ones go.
    """
    if path in _tokenizers:
        return _tokenizers[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    encode = lambda s: array("I", tokenizer.encode(s, add_special_tokens=False).ids).tobytes()
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]      # the byte alphabet of byte-level vocabularies
    rest = [b for b in range(256) if b not in printable]
    alphabet = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    simple = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z")
    marks = {"": b""}
    old: dict[str, bytes] = {}

    class Cache(dict):
        def __missing__(self, part: str) -> bytes:
            nonlocal old
            ids = old.get(part)
            if ids is None:
                m = simple.match(part)
                if m is None:
                    ids = encode(part)
                else:
                    letters, tail = m.groups()
                    core = letters.lower()
                    if core != part:
                        ids = self[core]
                        if tail not in marks:
                            if len(marks) > 10_000:
                                marks.clear()
                                marks[""] = b""
                            marks[tail] = encode(tail)
                        ids += marks[tail]
                    else:
                        letters = core if core.isascii() else core.encode().decode("latin-1").translate(alphabet)
                        ids = array("I", [t.id for t in tokenize(letters)]).tobytes()
            if len(self) >= CACHE_WORDS:
                old = dict(self)
                self.clear()
            self[part] = ids
            return ids

    cache = Cache({"": b""})
    _tokenizers[path] = lambda text: b"".join(map(cache.__getitem__, text.replace("\n", " ").split(" ")))
    return _tokenizers[path]


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A document is its ids and then ``end_id``, so a null or empty text is one id.  Every id lies in one piece.  A
    sequence is padded to ``capacity`` unless its length is a power of two.  Rows with equal or null keys are
    documents of their own.  An empty table gives no rows.  ``keep_ids`` adds the ids of each piece.  Sequence
    ids are unique, not dense: the task's number and a count.
    """
    types = dict(docs.dtypes)
    schema = (f"`{key}` {types[key]}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint, padded_length bigint" + (", ids array<int>" if keep_ids else ""))
    last = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        next_sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        done: list[tuple] = []
        waiting: list[tuple] = []
        kept: list[bytes] = []

        def piece(doc, start: int, ids: bytes, total: int, at: int, length: int) -> None:
            padded = length if length & (length - 1) == 0 else capacity
            done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, next_sequence, at, padded))
            if keep_ids:
                kept.append(ids)

        def flush() -> None:
            nonlocal next_sequence
            for window in pack([len(w[2]) // 4 for w in waiting], capacity):
                length, at = sum(len(waiting[i][2]) for i in window) // 4, 0
                for i in window:
                    doc, start, ids, total = waiting[i]
                    piece(doc, start, ids, total, at, length)
                    at += len(ids) // 4
                next_sequence += 1
            waiting.clear()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * 8
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4").tolist() for x in kept], pa.list_(pa.int32())))
                names.append("ids")
            done.clear()
            kept.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        key_type, items = None, 0
        for batch in batches:
            key_type = batch.schema.field(0).type
            for doc, words in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1))):
                ids = ids_of(words or "") + last
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    piece(doc, start, ids[4 * start:4 * (start + capacity)], total, 0, capacity)
                    next_sequence += 1
                    start += capacity
                if start < total:
                    items += 1
                for at in range(start, total, PIECE):
                    waiting.append((doc, at, ids[4 * at:4 * (at + PIECE)], total))
                if items >= BLOCK_ITEMS:
                    flush()
                    items = 0
                if len(done) >= 20_000:
                    yield emit()
        if key_type is not None:
            flush()
            yield emit()

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
