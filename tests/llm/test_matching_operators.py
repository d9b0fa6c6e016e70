"""Source divergence, hard negatives and repeated passages against brute force."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.edge import documents, none
from tidemark.llm import divergence, hard_negatives, queries, suffixes

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- source divergence ------------------------------------------------------------------------
def audited(rows, least, top):
    """The contract word by word, in Python integers."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        words = term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        counts = {s: groups[lang, s] for s in sources}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        price = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            others = sorted(((sum(price(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(others)]
            own = sorted(((price(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(own[:top])]
    return sorted(out, key=repr)


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 7)
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "été", "ΑΣ", "日本", "x", "y2z", "İ"]
    rows = [(" ".join(rng.choice(words, size=int(rng.integers(0, 12)), p=[.3, .2, .1, .1, .1, .1, .05, .05])),
             [None, "", "en", "fr"][int(rng.integers(0, 4))], [None, "a", "b", "c", "é"][int(rng.integers(0, 5))]) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "lonely", "s"), ("alpha " * 500, "en", "a"), ("12 34 !?", "none", "x"), ("word", "none", "y")] + [("alpha beta", "en", "a")] * 3
    df = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], "text string, lang string, source string, term int, chunk string, rank string")
    assert rows_of(divergence.audit(df, min_documents=4, top=3)) == audited(rows, 4, 3)
    assert rows_of(divergence.audit(none(spark))) == []
    edge = documents(spark)
    assert rows_of(divergence.audit(edge, min_documents=1)) == audited([(r.text, r.lang, r.source) for r in edge.collect()], 1, 10)


def test_long_texts_are_counted_in_pieces():
    text = ("ab " * 700_000 + "c" * 1_500_000 + " d " + "e" * 10).encode()
    whole = collections.Counter(text.split())
    assert collections.Counter(itertools.chain.from_iterable(divergence._pieces(text))) == whole


def test_galloping_merge_and_wide_shares():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (3, 4000), (900, 1000), (1, 1)):
        a, b = (np.sort(rng.choice(5000, size, replace=False)) for size in (n, m))
        assert np.array_equal(divergence.gallop(a, b), np.searchsorted(b, a))
    for n, total, terms in ((0, 0, 1), (10 ** 12, 3 * 10 ** 15, 10 ** 9), (7, 9, 2)):
        assert int(divergence.shares(np.array([n]), total, terms)[0]) == 1 + 10 ** 9 * (n + 2) // (total + 2 * terms)


# --- hard negatives ---------------------------------------------------------------------------
def mined(rows, every=100, positives=5, negatives=10):
    ints = lambda v: [math.floor(256 * float(x)) for x in v]
    good = {(i, lab, tuple(ints(v))) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in good:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in good if j != i)
        for neg, j, _ in [s for s in scored if s[2] == lab][:positives]:
            fits = [s for s in scored if s[2] != lab and 30 * -neg <= 100 * -s[0] <= 90 * -neg][:negatives]
            out += [(i, j, r + 1, k, -neg, -s) for r, (s, k, _) in enumerate(fits)]
    return sorted(out, key=repr)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for width, reach in ((1, 3), (64, 256), (130, 300), (7, 10 ** 7), (64, 40_000)):
        a, b = rng.integers(-reach, reach + 1, (9, width)), rng.integers(-reach, reach + 1, (14, width))
        a[0], b[0] = reach, reach
        b[1] = -reach
        primes = hard_negatives.primes_for(int(np.abs(a).sum(axis=1).max()) * int(np.abs(b).max()))
        got = hard_negatives.product(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert np.array_equal(got, a @ b.T), (width, reach)
    assert all(((p + 1) // 2) ** 2 * hard_negatives.SLICE < 1 << 24 for p in hard_negatives.PRIMES)
    with pytest.raises(ArithmeticError):
        hard_negatives.primes_for(1 << 60)


@pytest.mark.parametrize("width,ties", [(5, False), (3, True), (70, False)])
def test_mining_equals_brute_force(spark, monkeypatch, width, ties):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)) + 0.4
    x = np.round(x * 2) / 2 if ties else x
    rows = [(int(i) * 5, [float(np.float32(c)) for c in v], int(rng.integers(0, 3))) for i, v in enumerate(x)]
    rows += rows[:40]                                                         # repeated rows are one
    rows += [(100_000, None, 1), (100_100, [1.0] * width, None), (100_200, [float("nan")] * width, 1), (100_300, [float("inf")] * width, 0),
             (100_400, [None] * width, 0), (None, [1.0] * width, 1), (100_500, [0.0] * width, 2), (100_600, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cell string, id int").repartition(5)
    padded = [(i, v if v is None or len(v) == width else v + [0.0] * (width - len(v)), lab) for i, v, lab in rows]
    assert rows_of(hard_negatives.mine(df)) == mined(padded)


def test_mining_edges(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert rows_of(hard_negatives.mine(spark.createDataFrame([], schema))) == []
    lone = spark.createDataFrame([(100, [1.0], "a"), (7, [1.0], "b")], schema)
    assert rows_of(hard_negatives.mine(lone)) == []                           # no positive
    some = spark.createDataFrame([(0, [2.0], "a"), (1, [1.0], "a"), (2, [0.5], "b"), (3, [0.95], "b")], schema)
    assert rows_of(hard_negatives.mine(some)) == [(0, 1, 1, 2, 512 * 256, 512 * 128)]


# --- repeated passages ------------------------------------------------------------------------
def stripped(rows, least=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1 if d is not None else 0):
            first[b[i:i + least]] = min(d, first.get(b[i:i + least], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - least + 1 if d is not None else 0):
            if first[b[i:i + least]] < d:
                gone[i + 1:i + 1 + least] = True
        kept = np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return df.select(df.columns[0], F.octet_length("body").cast("long"), (F.octet_length("body") - F.octet_length("kept")).cast("long"),
                     F.size("spans").cast("long"), F.sha2("kept", 256))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n, letters in itertools.product((0, 1, 2, 7, 60, 500), (1, 2, 5, 250)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        order, raw = suffixes.suffix_array(text, 50), text.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        assert [suffixes.smaller_than_next(text)[i] for i in range(n)] == [raw[i:] < raw[i + 1:] for i in range(n)]
        cut = [raw[i:i + 50] for i in order]
        assert cut == sorted(cut)
        lengths = suffixes.common_prefixes(suffixes._words(text, 50), order, 50) if n else []
        zeros = [x + b"\0" * (50 - len(x)) for x in cut]
        for k in range(1, n):
            same = next((i for i in range(50) if zeros[k][i] != zeros[k - 1][i]), 50)
            assert lengths[k] == same


def passages(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé日"), size=int(rng.integers(1, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = [text(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(0, 4))][int(rng.integers(0, 60)):], text(int(rng.integers(0, 20)))]
        rows.append((int(rng.integers(0, 70)), " ".join(parts)))              # keys repeat
    rows += [(i, rows[3][1]) for i in (500, 501, 3)] + [rows[7], rows[7]]           # whole copies and repeated rows
    rows += [(600, "a" * 700), (601, "b" + "a" * 300), (602, "the same line. " * 60), (603, "the same line. " * 9), (604, None), (605, ""),
             (None, rows[3][1]), (606, "x" * 49), (607, "x" * 49), (608, "y" * 50), (609, "y" * 50), (610, "nul \0 " * 20), (611, "nul \0 " * 20)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_repeats_equal_brute_force(spark, monkeypatch, small):
    if small:                                          # hot keys, short runs, many hand-overs, slices inside a text
        for name, value in (("HOT", 3), ("RUN_WINDOWS", 5), ("HELD_BYTES", 4000), ("HELD_KEYS", 300), ("GROUP_BYTES", 3000), ("SLICE", 400)):
            monkeypatch.setattr(suffixes, name, value)
    rows = passages(4)
    df = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "doc_id long, text string, body string, g int, kept string").repartition(4)
    assert rows_of(digest(suffixes.remove_repeats(df))) == stripped(rows)


def test_repeats_edges_and_spans(spark):
    edge = documents(spark)
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert rows_of(digest(suffixes.remove_repeats(edge))) == stripped(rows)
    assert rows_of(digest(suffixes.remove_repeats(none(spark)))) == []
    two = spark.createDataFrame([(1, "a" * 5 + "0123456789" * 6), (2, "b" * 7 + "0123456789" * 6 + "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(two).collect()}
    assert got[1].spans == [] and [tuple(s) for s in got[2].spans] == [(7, 67)] and bytes(got[2].kept) == b"b" * 7 + b"c"


def test_whole_copies_are_not_dealt_out(spark, monkeypatch):
    seen = []
    cut_segments = suffixes.cut_segments
    monkeypatch.setattr(suffixes, "cut_segments", lambda *a, **k: seen.append(cut_segments(*a, **k)) or seen[-1])
    rng = np.random.default_rng(8)
    line = "a line that stands in every one of these documents, whatever else they say. "
    once = [(i, line + " ".join(map(str, rng.integers(0, 10 ** 9, 40)))) for i in range(30)]
    rows = [(i + 100 * k, t) for k in (2, 0, 1, 5, 4, 3) for i, t in once] + [(7, once[7][1]), (107, once[7][1]), (None, once[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(digest(suffixes.remove_repeats(df))) == stripped(rows)
    suffixes.remove_repeats(spark.createDataFrame(once, "doc_id long, text string")).collect()
    copied, plain = (s.where("body IS NOT NULL").select("doc", "start", "length").distinct() for s in seen)
    assert {r.doc for r in copied.collect()} <= {i for i, _ in once} and plain.count() > 0


def test_only_segments_with_an_equal_window_are_sorted(monkeypatch):
    sizes = []
    suffix_array = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text, depth: sizes.append(len(text)) or suffix_array(text, depth))
    monkeypatch.setattr(suffixes, "WINDOWS", 7, raising=False)
    rng = np.random.default_rng(9)
    bodies = [bytes(rng.integers(97, 123, 70).astype(np.uint8)) for _ in range(50)] + [b"x" * 3 + b"0123456789" * 6, b"0123456789" * 6 + b"yy"]
    n = len(bodies)
    table = pa.table({"g": [0] * n, "doc": list(range(n)), "text_id": [0] * n, "start": [5] * n, "length": [len(b) for b in bodies],
                      "body": pa.array(bodies, pa.binary())})
    assert suffixes._settle(50)(table).to_pylist() == [{"doc": 51, "text_id": 0, "start": 5, "end": 65}]
    assert sizes == [63 + 62 + 2]
    assert suffixes._settle(50)(table.slice(0, 50)).num_rows == 0 and suffixes._settle(50)(table.slice(3, 1)).num_rows == 0


def test_queries_of_the_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op13_suffixes(spark, SF)) == stripped(docs)
