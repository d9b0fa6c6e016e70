"""Repeated passages found by suffix arrays, and removed from all documents but the first.

A passage is a string of ``least`` bytes that also starts in a document of a smaller key.  Equal windows of that
length must meet in one task.  The key of a window is its least k-gram hash (its minimiser), which is the same wherever
the window stands; consecutive windows with one key form a segment, so a text is dealt out as short overlapping
segments.  A Bloom filter over the keys that occur in two documents or more keeps the rest of the corpus at home; it only
saves work.  A task joins its segments to one string, sorts their suffixes in two stages and compares neighbours:
windows with a common prefix of ``least`` bytes are one passage, and the smallest document of a run keeps it.

Whole copies of a text go at once: the document of the least key stands for all of them, and a second Bloom filter, over
the rows that stand for a text, lets the passes over windows leave the others out.  It, too, only saves work.

Two-stage sorting: only suffixes smaller than their successor are sorted directly.  The others follow from
scanning the buckets of first bytes in order: a suffix greater than its successor stands in its bucket as its successor
stands in the array.  Order is settled to the length of a passage, which is all that a comparison of neighbours needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, INVERSE, mix, power_table
from tidemark.session import cut

LEAST = 50
GRAM = 16                        # bytes of the k-gram behind a window's key
WINDOWS = 1 << 16                # windows of a suffix array's segments hashed at once
RUN_WINDOWS = 192                # windows of a segment at most, so that rows stay short in texts of one repeated byte
SLICE = 1 << 17                  # bytes of text hashed at once: a few megabytes of numbers, which a cache holds
FIRST_BITS = (16, 27)            # the filter of the rows that stand for a text has 16 bits for each of them within these powers of two
HELD_BYTES = 12 << 20            # segments of a task gathered before equal ones are settled and the rest handed on
HELD_KEYS = 1 << 20
KEY_BYTES = 5                    # of a key inside its part, whose number grows with the text: few keys meet by chance
GROUP_BYTES = 4 << 20            # segments of one suffix array, on average
HOT = 20_000                     # from so many documents on, the windows of a key are dealt out by their own content
FILTER_BITS = (20, 27)           # the filter has one bit for each byte of text within these powers of two, that of hot keys
HOT_SHARE_BITS = 6               # ... two to this power times fewer
PARTS = (64, 1 << 20)            # parts of the key space, one for each PART_BYTES of text within these bounds
PART_BYTES = 8 << 20


# --- windows and their keys -------------------------------------------------------------------
def _window_keys(data: np.ndarray, least: int, gram: int) -> np.ndarray:
    """The least hash of the k-grams inside the window that starts at each byte."""
    n = len(data)
    if n < least:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_table(BASE, n), out=total[1:])
    low = mix((total[gram:] - total[:-gram]) * power_table(INVERSE, n - gram + 1))
    width, have = least - gram + 1, 1
    while have < width:                                       # the minimum over a doubling span
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _pieces(column: pa.Array, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, start, bytes) of each text in pieces of at most SLICE bytes that overlap, so that each window is in one piece."""
    for row, value in enumerate(column):
        data = np.frombuffer(value.as_buffer(), dtype=np.uint8)
        for at in range(0, max(1, len(data) - least + 1), SLICE - least + 1):
            yield row, at, data[at:at + SLICE]


def _batched(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, keys of windows, row, start of each piece's windows) over several short texts at once.

    Returns flat arrays: the joined bytes, and for each window its place in them, its row and its start in the text.
    """
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def join():
        data = np.concatenate([d for _, _, d in held])
        lengths = np.array([len(d) for _, _, d in held])
        base = np.cumsum(lengths) - lengths
        counts = np.maximum(lengths - least + 1, 0)
        piece = np.repeat(np.arange(len(held)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = base[piece] + inside
        row = np.array([r for r, _, _ in held])[piece]
        start = np.array([s for _, s, _ in held])[piece] + inside
        return data, place, row, start

    for piece in _pieces(column, least):
        if len(piece[2]) < least:
            continue
        if size + len(piece[2]) > SLICE and held:
            yield join()
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        yield join()


def _runs(keys: np.ndarray, row: np.ndarray, start: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows and window counts of the runs of one key in one piece of one text."""
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(keys)))
    parts = -(-counts // longest)
    if (parts > 1).any():
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        counts = np.minimum(np.repeat(counts, parts) - inside * longest, longest)
        first = np.repeat(first, parts) + inside * longest
    return first, counts


# --- the filter -------------------------------------------------------------------------------
def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpack(found: pa.ChunkedArray) -> np.ndarray:
    raw = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in found] or [np.zeros(0, np.uint8)]).reshape(-1, KEY_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = raw
    return out.view("<u8").ravel()


def first_rows(ids: DataFrame, bits: int, parts: int) -> np.ndarray:
    """A Bloom filter as bytes over ``mark``, a hash of a row that stands for its text."""
    stretch = max(8, (1 << bits) // parts)

    def fill(table: pa.Table) -> pa.Table:
        filled = np.zeros(stretch, dtype=bool)
        for p in _places(_rest(table["mark"].to_numpy().view(np.uint64), parts), stretch):
            filled[p] = True
        return pa.table({"part": table["part"][:1], "filled": pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary())})

    found = ids.select("mark", F.pmod("mark", F.lit(parts)).alias("part")).groupBy("part").applyInArrow(fill, "part bigint, filled binary").toArrow()
    whole = np.zeros((parts, stretch // 8), dtype=np.uint8)
    for part, stored in zip(found["part"].to_pylist(), found["filled"]):
        whole[part] = np.frombuffer(stored.as_buffer(), np.uint8)
    return whole.reshape(-1)


def _standing(batches: Iterator[pa.RecordBatch], firsts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows that may stand for their text."""
    for batch in batches:
        mark = batch.column(batch.schema.get_field_index("mark")).to_numpy(zero_copy_only=False).view(np.uint64)
        yield batch.filter(pa.array(_passes(mark, firsts, parts)))


def shared_keys(rows: DataFrame, least: int, gram: int, bits: int, parts: int, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two Bloom filters as bytes: the keys found in two documents or more, and those found in HOT documents or more.

    Keys travel packed: a task hands on one row for each part of the key space, with KEY_BYTES of each key found in one document
    so far, and of each found in several with their number.  A key handed on twice counts as shared, which at worst (a long
    document, handed on in two goes) keeps a segment for nothing.  Each part answers with its own stretch of the
    filters, so the driver gets the filters and nothing else.
    """
    stretch = (1 << bits) // parts
    hot_stretch = max(8, stretch >> HOT_SHARE_BITS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, docs = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            fresh = np.ones(len(keys), dtype=bool)
            fresh[1:] = keys[1:] != keys[:-1]
            first = np.flatnonzero(fresh)
            new = np.ones(len(keys), dtype=np.int64)
            new[1:] = fresh[1:] | (docs[1:] != docs[:-1])
            count = np.add.reduceat(new, first)
            keys = keys[first]
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            names, at = np.unique(part[order], return_index=True)
            one, many, numbers = [], [], []
            for k, n in zip(np.split(keys[order] // np.uint64(parts), at[1:]), np.split(count[order], at[1:])):
                one.append(_pack(k[n == 1]))
                many.append(_pack(k[n > 1]))
                numbers.append(n[n > 1].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array(x, pa.binary()) for x in (one, many, numbers))],
                                             names=["part", "one", "many", "numbers"])

        size = 0
        for batch in _standing(batches, firsts, parts):
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for data, place, row, start in _batched(batch.column(1), least):
                keys = _window_keys(data, least, gram)[place]
                first, _ = _runs(keys, row, start, 1 << 60)
                held.append((keys[first], docs[row[first]]))
                size += len(first)
                if size > HELD_KEYS:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    def settle(table: pa.Table) -> pa.Table:
        one, many = _unpack(table["one"]), _unpack(table["many"])
        numbers = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table["numbers"]]).astype(np.int64)
        keys, count = np.concatenate([one, many]), np.concatenate([np.ones(len(one), dtype=np.int64), numbers])
        order = np.argsort(keys, kind="stable")
        keys, count = keys[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(count, first) if len(first) else first
        out = []
        for wanted, width in ((total > 1, stretch), (total >= HOT, hot_stretch)):
            filled = np.zeros(width, dtype=bool)
            for p in _places(keys[first][wanted], width):
                filled[p] = True
            out.append(np.packbits(filled, bitorder="little").tobytes())
        return pa.table({"part": table["part"][:1], "shared": pa.array(out[:1], pa.binary()), "hot": pa.array(out[1:], pa.binary())})

    packed = rows.mapInArrow(gather, "part bigint, one binary, many binary, numbers binary")
    found = packed.groupBy("part").applyInArrow(settle, "part bigint, shared binary, hot binary").toArrow()
    filters = []
    for name, width in (("shared", stretch), ("hot", hot_stretch)):
        whole = np.zeros((parts, width // 8), dtype=np.uint8)
        for part, stored in zip(found["part"].to_pylist(), found[name]):
            whole[part] = np.frombuffer(stored.as_buffer(), np.uint8)
        filters.append(whole.reshape(-1))
    return filters[0], filters[1]


def _rest(keys: np.ndarray, parts: int) -> np.ndarray:
    """What is packed of a key inside its part."""
    return (keys // np.uint64(parts)) & np.uint64((1 << 8 * KEY_BYTES) - 1)


def _places(rest: np.ndarray, stretch: int) -> list[np.ndarray]:
    """Two bits of a packed key inside its part's stretch."""
    return [(rest % np.uint64(stretch)).astype(np.int64), (mix(rest) % np.uint64(stretch)).astype(np.int64)]


def _passes(keys: np.ndarray, filled: np.ndarray, parts: int) -> np.ndarray:
    stretch = len(filled) * 8 // parts
    base = (keys % np.uint64(parts)).astype(np.int64) * stretch
    out = np.ones(len(keys), dtype=bool)
    for p in _places(_rest(keys, parts), stretch):
        p = p + base
        out &= (filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


# --- segments ---------------------------------------------------------------------------------
def _gathered(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of the stretches, one after the other."""
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return data[np.repeat(at, length) + inside]


def _stretch_hashes(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each stretch, a slice of the stretches at a time; ``at`` rises."""
    out = np.zeros(len(at), dtype=np.uint64)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE)))
        low, high = int(at[first]), int((at[first:last] + length[first:last]).max())
        part = data[low:high]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power_table(BASE, len(part)), out=total[1:])
        start = at[first:last] - low
        out[first:last] = (total[start + length[first:last]] - total[start]) * power_table(INVERSE, len(part) + 1)[start]
        first = last
    return mix(out + length.astype(np.uint64))


def _equal_stretches(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each stretch, the index of the first one of equal content.  Hashes propose, bytes decide."""
    _, first, group = np.unique(_stretch_hashes(data, at, length), return_index=True, return_inverse=True)
    same = first[group]
    check = np.flatnonzero(same != np.arange(len(at)))
    wrong = length[check] != length[same[check]]
    for some in np.array_split(np.flatnonzero(~wrong), max(1, len(check) // 20_000)):
        if len(some):
            i = check[some]
            differs = _gathered(data, at[i], length[i]) != _gathered(data, at[same[i]], length[i])
            wrong[some] = np.add.reduceat(differs, np.cumsum(length[i]) - length[i]) > 0
    same[check[wrong]] = check[wrong]
    return same


def _merged(doc: np.ndarray, text_id: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one text that overlap or touch as one."""
    order = np.lexsort((start, text_id, doc))
    doc, text_id, start, end = doc[order], text_id[order], start[order], end[order]
    if not len(doc):
        return doc, text_id, start, end
    text = np.ones(len(doc), dtype=bool)
    text[1:] = (doc[1:] != doc[:-1]) | (text_id[1:] != text_id[:-1])
    number = np.cumsum(text) - 1
    shift = number * (int(end.max()) + 1)                       # texts one after the other, so that one running maximum serves all
    reach = np.maximum.accumulate(end + shift)
    fresh = text
    fresh[1:] |= start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], text_id[first], start[first], reach[last] - shift[last]


def _owners(same: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each stretch, the least document among the stretches equal to it."""
    low = doc.copy()
    np.minimum.at(low, same, doc)
    return low[same]


def cut_segments(rows: DataFrame, least: int, gram: int, filters: tuple[np.ndarray, np.ndarray], parts: int, groups: int,
                 firsts: np.ndarray) -> DataFrame:
    """Rows of two kinds.  With ``body``: a segment, its document, its place and its group.  Without: a stretch to remove,
    whose equal was seen in the same task in a smaller document."""
    shared, hot = filters
    names = ["g", "doc", "text_id", "start", "length", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            body = np.concatenate([x[0] for x in held])
            group, doc, text_id, start, length = (np.concatenate([x[i] for x in held]) for i in range(1, 6))
            held.clear()
            at = np.cumsum(length) - length
            gone = doc > _owners(_equal_stretches(body, at, length), doc)
            removed = _merged(doc[gone], text_id[gone], start[gone], (start + length)[gone])
            stay = np.flatnonzero(~gone)
            for first in range(0, len(removed[0]), 50_000):
                d, t, lo, hi = (x[first:first + 50_000] for x in removed)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d % groups, d, t, lo, hi - lo)] + [pa.nulls(len(d), pa.binary())], names=names)
            for first in range(0, len(stay), 50_000):
                i = stay[first:first + 50_000]
                data, offsets = _gathered(body, at[i], length[i]), np.append(0, np.cumsum(length[i])).astype(np.int32)
                bodies = pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(x[i], pa.int64()) for x in (group, doc, text_id, start, length)] + [bodies], names=names)

        for batch in _standing(batches, firsts, parts):
            docs, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for data, place, row, start in _batched(batch.column(1), least):
                keys = _window_keys(data, least, gram)[place]
                first, counts = _runs(keys, row, start, RUN_WINDOWS)
                wanted = _passes(keys[first], shared, parts)
                first, counts = first[wanted], counts[wanted]
                if not len(first):
                    continue
                fine = _passes(keys[first], hot, parts)
                group = (mix(keys[first]) % np.uint64(groups)).astype(np.int64)
                length = counts + least - 1
                if fine.any():                                     # a hot key: each window on its own, dealt out by content
                    windows = np.repeat(first[fine], counts[fine]) + np.arange(counts[fine].sum()) - np.repeat(
                        np.cumsum(counts[fine]) - counts[fine], counts[fine])
                    content = _window_hash(data, place[windows], least)
                    first = np.concatenate([first[~fine], windows])
                    group = np.concatenate([group[~fine], (content % np.uint64(groups)).astype(np.int64)])
                    length = np.concatenate([length[~fine], np.full(len(windows), least)])
                body = _gathered(data, place[first], length)
                held.append((body, group, docs[row[first]], ids[row[first]], start[first], length))
                size += len(body) + 48 * len(first)
                if size > HELD_BYTES:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    return rows.mapInArrow(run, "g bigint, doc bigint, text_id bigint, start bigint, length bigint, body binary")


def _window_hash(data: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_table(BASE, len(data)), out=total[1:])
    return mix((total[at + least] - total[at]) * power_table(INVERSE, len(data) + 1)[at] + np.uint64(least))


# --- suffix arrays ----------------------------------------------------------------------------
def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros stand beyond the end."""
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    n = len(text) + depth + 8
    out = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + n]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one, whose successor is empty, is not."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    up = text[differs] < text[differs + 1]
    at = np.searchsorted(differs, np.arange(n))
    return np.append(up, False)[at]


def _direct(suffixes: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``suffixes`` by their first ``depth`` bytes: eight at a time, and only among those equal so far."""
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    key = words[order]
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] = key[1:] == key[:-1]
    group = np.cumsum(~tied)
    for at in range(8, depth, 8):
        again = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(again):
            break
        some, label = order[again], group[again]
        key = words[some + at]
        turn = np.lexsort((key, label))
        some, key = some[turn], key[turn]
        order[again] = some
        equal = np.zeros(len(again), dtype=bool)
        equal[1:] = (key[1:] == key[:-1]) & (label[1:] == label[:-1])
        tied[again] = equal
        group = np.cumsum(~tied)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` (bytes) ordered at least by their first ``depth`` bytes, in two stages."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_next(text)
    words = _words(text, depth)
    direct = _direct(np.flatnonzero(small), words, depth)
    sizes = np.bincount(text, minlength=256)
    heads = np.cumsum(sizes) - sizes
    split = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))                      # its successor, the empty suffix, comes first of all
    out = np.empty(n, dtype=np.int64)
    for c in np.flatnonzero(sizes):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        induced = []
        while len(level):                                            # successors in this same bucket: runs of the byte
            induced.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~small[before]]
        bucket = np.concatenate([*induced, direct[split[c]:split[c + 1]]])
        out[heads[c]:heads[c] + sizes[c]] = bucket
        waiting[c] = []
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~small[before]]
        first = text[before]
        turn = np.argsort(first, kind="stable")
        for part in np.split(before[turn], np.flatnonzero(np.diff(first[turn])) + 1) if len(before) else []:
            waiting[text[part[0]]].append(part)
    return out


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, ``depth`` at most, that each suffix of ``order`` shares with the one before it."""
    out = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    for at in range(0, depth, 8):
        x = words[order[open_] + at] ^ words[order[open_ - 1] + at]
        ends = x != 0
        lead = np.zeros(int(ends.sum()), dtype=np.int64)
        rest = x[ends]
        for shift in (56, 48, 40, 32, 24, 16, 8):
            lead += (rest >> np.uint64(shift)) == 0
        out[open_[ends]] = at + lead
        open_ = open_[~ends]
        if not len(open_):
            break
    out[open_] = depth
    return np.minimum(out, depth)


def repeated_windows(bodies: list[bytes] | np.ndarray, lengths: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of the windows that a segment of a smaller document holds too.  ``bodies``: the joined bytes."""
    # one byte up, so that zero ends every segment; UTF-8 has no byte 255
    size = int(lengths.sum()) + len(lengths)
    ends = np.cumsum(lengths + 1) - 1
    text = np.zeros(size, dtype=np.uint8)
    inside = np.ones(size, dtype=bool)
    inside[ends] = False
    text[inside] = bodies + np.uint8(1)
    order = suffix_array(text, least)
    segment = np.repeat(np.arange(len(lengths)), lengths + 1)
    order = order[order + least <= ends[segment[order]]]              # suffixes that hold a whole window
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prefix = common_prefixes(_words(text, least), order, least)
    first = np.flatnonzero(prefix < least)
    holder = doc[segment[order]]
    low = np.minimum.reduceat(holder, first)
    gone = order[holder > np.repeat(low, np.diff(np.append(first, len(order))))]
    return segment[gone], gone - (ends - lengths)[segment[gone]]


def _met(data: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """Whether each stretch holds a window whose hash occurs again: only those can share one.  ``data``: the joined bytes."""
    if not len(length):
        return np.zeros(0, dtype=bool)
    counts = length - least + 1
    of = np.repeat(np.arange(len(length)), counts)
    place = np.arange(len(of)) + of * (least - 1)
    hashes = np.concatenate([_window_hash(data[at[0]:at[-1] + least], at - at[0], least) for at in (
        place[i:i + WINDOWS] for i in range(0, len(place), WINDOWS))])
    order = np.argsort(hashes)
    again = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(length), dtype=bool)
    out[of[order[1:][again]]] = True
    out[of[order[:-1][again]]] = True
    return out


def _settle(least: int):
    def run(table: pa.Table) -> pa.Table:
        doc, text_id, start, length = (table[c].to_numpy() for c in ("doc", "text_id", "start", "length"))
        open_ = np.asarray(pc.is_valid(table["body"]))
        out = [(doc[~open_], text_id[~open_], start[~open_], start[~open_] + length[~open_])]
        if open_.any():
            body = table["body"].filter(pa.array(open_)).cast(pa.large_binary()).combine_chunks()
            body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
            offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            doc, text_id, start, length = doc[open_], text_id[open_], start[open_], length[open_]
            at = offsets[:-1] - offsets[0]
            same = _equal_stretches(data, at, length)
            low = _owners(same, doc)
            gone = doc > low
            out.append((doc[gone], text_id[gone], start[gone], start[gone] + length[gone]))
            # one segment of each content, that of the least document, is sorted; its other places follow it
            mine = np.flatnonzero(~gone)
            _, lead = np.unique(same[mine], return_index=True)
            lead = mine[lead]
            lead = lead[_met(_gathered(data, at[lead], length[lead]), length[lead], least)]
            slot = np.full(len(doc), -1)
            slot[same[lead]] = np.arange(len(lead))
            segment, place = repeated_windows(_gathered(data, at[lead], length[lead]), length[lead], doc[lead], least)
            turn = np.lexsort((place, segment))
            segment, place = segment[turn], place[turn]
            new = np.ones(len(segment), dtype=bool)
            new[1:] = (segment[1:] != segment[:-1]) | (place[1:] > place[:-1] + least)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(segment))[:len(head)] - 1
            seg, lo, hi = segment[head], place[head], place[tail] + least
            a, b = np.searchsorted(seg, slot[same[mine]]), np.searchsorted(seg, slot[same[mine]], "right")
            many = b - a
            pick = np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            of = np.repeat(mine, many)
            out.append((doc[of], text_id[of], start[of] + lo[pick], start[of] + hi[pick]))
        found = _merged(*(np.concatenate(x) for x in zip(*out)))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("doc", "text_id", "start", "end"), found)})

    return run


# --- the operator -----------------------------------------------------------------------------
def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """``key``, ``body`` (the text's bytes), ``spans`` (array of start, end: bytes removed, sorted, apart) and ``kept`` (the rest).

    A byte goes if a string of ``least`` bytes over it also starts in a document with a smaller key.  Strings are judged on the
    input and lie inside one document.  A null text is empty.  A null key is neither smaller nor larger than another:
    such a row keeps its text and takes nothing from others.  Rows with equal keys take nothing from each other; repeated rows
    stay.  An empty table gives no rows; other columns are ignored.  ``key`` is an integer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("body"))
    own = rows.where(F.col("doc").isNotNull() & (F.octet_length("body") >= least)).select("doc", "body", F.xxhash64("body").alias("text_id")).withColumn(
        "mark", F.xxhash64("doc", "text_id"))
    ids = cut(own.select("doc", "text_id", "mark", F.octet_length("body").cast("long").alias("n"), F.unhex(F.sha2("body", 256)).alias("whole")))
    size, n_rows = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    bits = min(max(int(size).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    parts = 1 << min(max((int(size) // PART_BYTES).bit_length(), PARTS[0].bit_length() - 1), PARTS[1].bit_length() - 1)
    held = ids.groupBy("whole").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").drop("last")
    marked = ids.join(held, "whole", "left")
    firsts = first_rows(marked.where("owner IS NULL OR doc = owner"), min(max((16 * n_rows).bit_length(), FIRST_BITS[0]), FIRST_BITS[1]), parts)
    filters = shared_keys(own.select("doc", "body", "mark"), least, gram, bits, parts, firsts)
    groups = max(1, int(size) * 4 // GROUP_BYTES)
    segments = cut_segments(own, least, gram, filters, parts, groups, firsts)
    spans = segments.groupBy("g").applyInArrow(_settle(least), "doc bigint, text_id bigint, start bigint, end bigint")
    copies = marked.where("doc > owner").select("doc", "text_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")).distinct()
    lists = cut(spans.unionByName(copies).groupBy("doc", "text_id").agg(
        F.collect_list(F.struct("start", "end")).alias("found")))                                                 # those of one document
    joined = rows.withColumn("text_id", F.xxhash64("body")).join(lists, ["doc", "text_id"], "left").select("doc", "body", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_out, kept_out = [], []
            for body, found in zip(batch.column(1), batch.column(2)):
                buffer = body.as_buffer()
                n = len(buffer)
                if not found.is_valid:
                    spans_out.append([])
                    kept_out.append(buffer.to_pybytes())
                else:
                    start, end = (found.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    fresh = np.ones(len(start), dtype=bool)
                    fresh[1:] = start[1:] > reach[:-1]
                    lo = start[fresh]
                    hi = reach[np.append(np.flatnonzero(fresh)[1:], len(start)) - 1]
                    spans_out.append(list(zip(lo.tolist(), hi.tolist())))
                    data = buffer.to_pybytes()
                    kept_out.append(b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), n])))
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([[{"start": a, "end": b} for a, b in s] for s in spans_out], span_type), pa.array(kept_out, pa.binary())],
                names=[key, "body", "spans", "kept"])

    return joined.mapInArrow(run, f"`{key}` bigint, body binary, spans array<struct<start:bigint,end:bigint>>, kept binary")
