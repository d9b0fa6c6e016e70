import collections
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.edge import documents, none, plain
from tidemark.llm import blocks, chat, queries, sharding, simhash, tiling, warc
from tidemark.llm.common import components, forest, with_least

SF = "/root/testdata/sf0.001"


# --- near duplicates --------------------------------------------------------------------------
def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    component = brute_components(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for r in queries.op7_simhash(spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", component[r.doc_id])


@pytest.mark.parametrize("cap", [16, 100_000])
def test_tiles_lose_no_link(spark, cap):
    """Small tiles split hot bands over tasks; the components stay those of all pairs."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v, v) for v in signed], "node bigint, w0 bigint")
    edges = simhash.links(prints, 3, cap=cap).collect()
    expected = brute_components(sorted(signed), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    assert all(((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= 64 for e in edges)
    index = {n: i for i, n in enumerate(sorted(signed))}
    label = forest(np.array([index[e.a] for e in edges]), np.array([index[e.b] for e in edges]), len(index))
    assert {n: sorted(signed)[label[i]] for n, i in index.items()} == expected


def test_components_of_hubs_chains_and_nothing(spark):
    hub = [(5, 100 + i) for i in range(500)] + [(600 + i, 601 + i) for i in range(30)] + [(7, 7), (3, 105), (3, 105)]
    found = {r.node: r.root for r in components(spark.createDataFrame(hub, "a bigint, b bigint")).collect()}
    assert found == {3: 3, 5: 3, **{100 + i: 3 for i in range(500)}, **{600 + i: 600 for i in range(31)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_least_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("v"))
    got = {(r.k, r.v): r.m for r in with_least(rows, "k", "v", "m", "v > 5").collect()}
    assert got == {(v if v % 3 == 0 else -1, v): v if v % 3 == 0 else 1 for v in range(6, 3000)}


def test_near_duplicate_edges(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and {r.component_id for r in rows if r.doc_id in (3, 4, 5, 9)} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1} and simhash.near_duplicates(none(spark)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and simhash.drop_near_duplicates(none(spark)).count() == 0
    counts = collections.Counter(r.doc_id for r in kept.collect())
    assert counts[1] == 1 and counts[2] == 0 and counts[3] == 1 and counts[4] == 0


def test_stage_drops_near_copies_and_keeps_others(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    body = [rng.choice(words) for _ in range(300)]
    near = list(body)
    near[150] = "changed"
    other = [[rng.choice(words) for _ in range(300)] for _ in range(20)]
    rows = [(0, " ".join(body)), (1, " ".join(near)), (2, " ".join(body))] + [(10 + i, " ".join(o)) for i, o in enumerate(other)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {0, *range(10, 30)}


def test_stage_finds_pairs_of_similarity_just_over_the_level(spark):
    """Pairs of similarity 0.80 to 0.82 and one of equal sets but repeated lines are found, pairs under 0.79 stay."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    rows, similar = [], {}
    for g in range(400):
        body = [word() for _ in range(304)]
        near = list(body)
        for at in range(4, 300, 300 // rng.choice([5, 6, 7]))[:7]:
            near[at] = word()
        a, b = simhash.shingle_set(" ".join(body), 5), simhash.shingle_set(" ".join(near), 5)
        similar[g] = simhash.similarity(a, b)
        rows += [(2 * g, " ".join(body)), (2 * g + 1, " ".join(near))]
    line = " ".join(word() for _ in range(30))
    rest = " ".join(word() for _ in range(150))
    rows += [(1000, f"{line} {rest}"), (1001, f"{' '.join([line] * 20)} {rest}")]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    lost = [g for g, s in similar.items() if s >= 0.8 and 2 * g + 1 in kept]
    assert sum(0.8 <= s < 0.83 for s in similar.values()) > 80 and len(lost) <= 2
    assert all(2 * g + 1 in kept for g, s in similar.items() if s < 0.8) and 1000 in kept and 1001 not in kept


def test_a_link_is_proposed_in_one_band_and_pairs_come_a_few_at_a_time(spark):
    """Copies that share nearly all bands go on once, not once for each band, and no tile holds the square of its rows."""
    rng = np.random.default_rng(3)
    centre = rng.integers(-2 ** 62, 2 ** 62, (40, 4))
    rows = [(4 * g + c, *(int(w) ^ ((1 << int(rng.integers(0, 60))) if c else 0) for w in x)) for g, x in enumerate(centre) for c in range(2)]
    prints = spark.createDataFrame(rows, "node bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    for cap in (16, 8192):
        found = simhash.links(prints, simhash.STAGE_RADIUS, 4, cap=cap, nodes_only=True)
        assert {r.node for r in found.collect()} == {r[0] for r in rows}
        assert found.count() == len(rows)
    copies = np.zeros((4, 3000), dtype=np.uint64)
    sizes = [len(x) for x, _ in simhash._near(copies, copies, 57)]
    assert sum(sizes) == 3000 ** 2 and max(sizes) <= 64 * 3000
    assert (simhash._forest(simhash._near(copies, copies, 57), 3000) == 0).all()


# --- leaks ------------------------------------------------------------------------------------
def coverage(item, doc, k=5):
    windows = collections.Counter(tuple(doc[i:i + k]) for i in range(len(doc) - k + 1))
    return len({j for i in range(len(item) - k + 1) if tuple(item[i:i + k]) in windows for j in range(i, i + k)}) / max(1, len(item))


def test_leaks_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    tokens = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    expected = {(d, i): c for d, w in docs.items() for i, x in items.items() if (c := coverage(x, w)) >= 0.6}
    got = {(r.doc_id, r.item_id): r.coverage for r in queries.op4_tiling(spark, folder).collect()}
    assert got == pytest.approx(expected) and got


def test_tiles_are_greedy_and_find_reordered_passages():
    h = lambda s: np.array([zlib.crc32(w.encode()) for w in s.split()], dtype=np.uint64)
    item = h("a b c d e f g h i j k l m n")
    assert tiling.tiles(item, h("x h i j k l m n y a b c d e f g z")) == [(0, 9, 7), (7, 1, 7)]
    assert tiling.tiles(item, h("a b c d")) == [] and tiling.tiles(h(""), item) == []
    same = h("a " * 12)
    assert sum(t[2] for t in tiling.tiles(same, h("a " * 30))) == 12
    rng = random.Random(8)
    for _ in range(100):
        one, two = (np.array([rng.randrange(3) for _ in range(rng.randint(0, 40))], dtype=np.uint64) for _ in range(2))
        seen_i, seen_j = set(), set()
        for i, j, n in tiling.tiles(one, two):
            assert n >= 5 and (one[i:i + n] == two[j:j + n]).all()
            assert seen_i.isdisjoint(range(i, i + n)) and seen_j.isdisjoint(range(j, j + n))
            seen_i |= set(range(i, i + n))
            seen_j |= set(range(j, j + n))


def test_items_that_repeat_a_line_leak(spark):
    verse = " ".join(["one line of a song again"] * 20)
    items = spark.createDataFrame([(1, verse), (2, verse)], "item_id bigint, text string")
    docs = spark.createDataFrame([(5, f"before it {verse} and after"), (6, "one line of a song again")], "doc_id bigint, text string")
    assert plain(tiling.find_leaks(docs, items), "doc_id", "item_id", "coverage") == [(5, 1, 1.0), (5, 2, 1.0)]


def test_leak_edges(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "alpha BETA, gamma delta epsilon zeta"), (2, None), (3, "the"), (None, "null id with some words")], "item_id bigint, text string")
    found = plain(tiling.find_leaks(docs, items), "doc_id", "item_id")
    assert found == sorted([(1, 1), (2, 1), (None, None)], key=repr)
    kept = tiling.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert tiling.find_leaks(none(spark), items).count() == 0 and tiling.find_leaks(docs, items.limit(0)).count() == 0


# --- pages ------------------------------------------------------------------------------------
def test_blocks_on_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op3_blocks(spark, SF).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_blocks_without_an_article():
    prose = "It was the first day of the year and the people of the town were in the streets to see what had come to them from the sea."
    page = (f"<body><div class='menu'><a href=/>Home</a></div><div id=cookie-notice>We use cookies and the like on this page for you.</div>"
            f"<form><p>{prose}</p></form><div><h2>A title</h2><p>{prose}</p><p>Short.</p><p>{prose}<br><br>Tail &amp; more &eacute;</p></div>"
            f"<ul><li><a href=1>one link</a><li><a href=2>and another link with a long text that says little</a></ul>"
            f"<div class=comments><p>{prose}</p></div><script>var x='<p>{prose}</p>'</script><footer>{prose}</footer>")
    assert blocks.main_text(page).split("\n\n") == ["A title", prose, "Short.", prose, "Tail & more é"]
    assert blocks.main_text(None) == blocks.main_text("") == "" and blocks.main_text("<p") == ""
    assert blocks.main_text("<article><p>Only short text.<p>More <a title='x>y'>of it</a></article>") == "Only short text.\n\nMore of it"


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (1, "u", "<article>a</article>", "x"), (2, "u", "<div" * 5000, "x")],
                                  "page_id bigint, url string, html string, text string")
    assert plain(blocks.extract(pages), "page_id", "n_chars") == sorted([(1, 0), (None, 0), (1, 1), (2, 0)], key=repr)
    assert blocks.extract(pages.limit(0)).count() == 0


# --- archives ---------------------------------------------------------------------------------
def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert plain(queries.QUERIES[name](spark, SF), *columns) == sorted(map(tuple, result.fetchall()), key=repr)


def test_archives_against_sql(spark):
    same_as_sql(spark, "op8_warc")


def test_archive_round_trip_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/é\r\nx", "same"), (5, None, "same"), (5, None, "same"), (None, "u", "same"), (7, "u", None), (8, "u", ""), (None, "u", "lone"),
         (9, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 3), (10, "u", "é" * 100_000)], "page_id bigint, url string, html string")
    rows = warc.captures_round_trip(pages).collect()
    assert len(rows) == 9
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows), key=repr)
    assert got == sorted([(1, "revisit", 5, 4), (5, "response", None, 4), (5, "response", None, 4), (None, "revisit", 5, 4), (7, "revisit", 8, 0),
                          (8, "response", None, 0), (None, "response", None, 4), (9, "response", None, 99), (10, "response", None, 200_000)], key=repr)
    assert {bytes(r.payload) for r in rows if r.page_id == 10} == {("é" * 100_000).encode()}
    assert warc.captures_round_trip(pages.limit(0)).count() == 0


def test_assembly_joins_by_identifier(spark):
    base = dict(url="u", date="d", refers_to=None, payload_digest="x", fields={"key": "1"}, payload=b"", payload_bytes=0)
    records = spark.createDataFrame(
        [dict(base, record_id="r1", type="response", concurrent_to=None), dict(base, record_id="q1", type="request", concurrent_to="r1"),
         dict(base, record_id="m1", type="metadata", concurrent_to="r1"), dict(base, record_id="r2", type="response", concurrent_to=None),
         dict(base, record_id="q9", type="request", concurrent_to="gone")], warc.RECORD)
    rows = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(rows) == {"r1", "r2"} and rows["r1"].request.record_id == "q1" and rows["r1"].metadata.fields == {"key": "1"}
    assert rows["r2"].request is None and rows["r2"].metadata is None


# --- conversations ----------------------------------------------------------------------------
def test_conversations_against_sql(spark):
    same_as_sql(spark, "op6_chat")


def test_template_language():
    render = lambda t, **s: "".join(x for x, _ in chat.compile_template(t)(s))
    assert render("{{ 'a' + 'b' | upper }}{% if not x %}no{% elif y == 'z' %}z{% else %}e{% endif %}", x=1, y="z") == "aBz"
    assert render("{% set n = 1 + 2 %}{{ n }}{% for a in l %}{{ a.b }},{% endfor %}", l=[{"b": 1}, {"b": None}]) == "31,,"
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ 'y' | upper }}{% else %}{{ q }}{% endif %}z")) == ("block", [("text", "xYz")])
    chunks = list(chat.compile_template("a{% generation %}{{ t }}{% endgeneration %}b")({"t": "T"}))
    assert chunks == [("a", False), ("T", True), ("b", False)]
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ f() }}", "{{ x[0] }}", "{% include 'a' %}", "{% if x %}", "{{ x | exec }}", "{% endfor %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        render("{{ missing }}")


def test_escape_is_reversible():
    rng = random.Random(9)
    for _ in range(500):
        s = "".join(rng.choice("\\<>#lgh a") for _ in range(12))
        assert chat.unescape(chat.escape(s)) == s and not set("<>#") & set(chat.escape(s))


def test_conversation_edges(spark):
    turns = spark.createDataFrame(
        [(1, 0, None, None, "x"), (1, None, "assistant", "</turn>\n<turn user>\n", "x"), (None, 0, "assistant", "n", "x"), (1, 0, None, None, "x"),
         (2, 0, "a>\nb", "\\h", "x")], "conv_id bigint, turn bigint, role string, text string, n_turns string")
    rows = {r.conv_id: r for r in chat.format_conversations(turns, keep_text=True).collect()}
    assert {k: r.n_turns for k, r in rows.items()} == {1: 3, None: 1, 2: 1}
    r = rows[1]
    assert chat.unescape("".join(r.formatted[a:b] for a, b in r.loss_spans)) == "</turn>\n<turn user>\n" and r.formatted_chars == len(r.formatted)
    assert [t[:2] for t in chat.read_turns(iter([(rows[2].formatted, False)]))] == [("a>\nb", "\\h")]
    assert chat.format_conversations(turns.limit(0)).count() == 0


# --- shards -----------------------------------------------------------------------------------
def check_shards(rows, n):
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - (min(sizes.values()) if len(sizes) == n else 0) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_sharding(spark, SF).collect()
    check_shards(rows, 24)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}


def test_shard_bins_and_edges(spark):
    docs = documents(spark)
    wide = docs.crossJoin(spark.range(40).select("id")).repartition(5)
    rows = sharding.shuffle_shards(wide, 7, 1, bin_rows=10).collect()
    check_shards(rows, 7)
    assert len(rows) == docs.count() * 40 and sharding.shuffle_shards(none(spark)).count() == 0
    check_shards(sharding.shuffle_shards(docs, 24).collect(), 24)


def test_matrix_is_exact_and_uniform():
    rows = [50, 0, 31, 19]
    total = np.zeros((4, 3))
    for seed in range(2000):
        m = sharding.communication_matrix(rows, 3, seed)
        assert m.sum(axis=1).tolist() == rows and sorted(m.sum(axis=0).tolist()) == [33, 33, 34]
        total += m
    assert np.allclose(total / 2000, np.array(rows)[:, None] / 3 * np.ones(3), atol=0.25)
    big = sharding.communication_matrix([1_000_000, 3_000_000_000], 2, 1)
    assert big.sum() == 3_001_000_000 and abs(int(big[0, 0]) - 500_000) < 5_000


# --- the pipeline -----------------------------------------------------------------------------
def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, sizes = docs, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        assert i == 4 or docs.columns == first.columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(pieces) == sizes[4] and all(p.n == p.t for p in pieces)


def test_draws_are_hypergeometric_at_any_size():
    rng = np.random.Generator(np.random.PCG64(5))
    for good, bad, n in ((3, 5, 4), (50, 20, 30), (1000, 3000, 200)):
        got = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(4000)])
        mean, var = n * good / (good + bad), n * good * bad * (good + bad - n) / ((good + bad) ** 2 * (good + bad - 1))
        assert abs(got.mean() - mean) < 5 * (var / 4000) ** 0.5 and abs(got.var() / var - 1) < 0.15
        assert got.min() >= max(0, n - bad) and got.max() <= min(good, n)
    from math import comb
    exact = [comb(3, x) * comb(5, 4 - x) / comb(8, 4) for x in range(4)]
    got = np.bincount([sharding._hypergeometric(rng, 3, 5, 4) for _ in range(8000)], minlength=4) / 8000
    assert np.abs(got - exact).max() < 0.03
    big = np.array([sharding._hypergeometric(rng, 3 * 10 ** 9, 10 ** 9, 10 ** 6) for _ in range(1500)])
    assert abs(big.mean() - 750_000) < 5 * 433 / 1500 ** 0.5 and abs(big.std() / 433 - 1) < 0.1
    assert sharding._hypergeometric(rng, 0, 5, 3) == 0 and sharding._hypergeometric(rng, 5, 0, 3) == 3


def test_long_repeats_tile_in_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(1)
    line = rng.integers(1, 1 << 60, 9).astype(np.uint64)
    item = np.concatenate([np.tile(line, 100), rng.integers(1, 1 << 60, 3).astype(np.uint64), np.tile(line, 122)])[:2000]
    tracemalloc.start()
    found = tiling.tiles(item, np.tile(line, 4445)[:40000])
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert sum(size for _, _, size in found) == 1997


SENTENCES = "The quick brown fox jumps over the lazy dog and it was not amused by this at all, for the day was long and the sun was hot. "


@pytest.mark.parametrize("page", [
    '<main class="main has-sidebar">%s</main>', '<article class="post has-comments">%s</article>', '<div class="content with-sidebar">%s</div>',
    '<div id="no-sidebar">%s</div>', '<div class="site fixed-header">%s</div>', "<button>Go<div>%s</div>", "<title>T<body><div>%s</div>",
    '<div class="sidebar"><article>%s</article></div>', "<body><select><option>a<p>x</p>%s</body>", '<div class="navigable">%s</div>'])
def test_articles_survive_names_and_open_tags(page):
    text = f"<p>{SENTENCES}</p>"
    assert blocks.main_text(page % text * 1).endswith(SENTENCES.strip())


@pytest.mark.parametrize("place", ['<div class="sidebar">%s</div>', '<div class="sidebar-left">%s</div>', '<div id="site-footer">%s</div>', "<nav>%s</nav>",
                                   '<div class="post-comments">%s</div>', '<div class="side-bar">%s</div>', '<ul class="menu main-menu">%s</ul>'])
def test_places_beside_the_article_go(place):
    assert blocks.main_text(f"<article><p>{SENTENCES}</p></article>" + place % f"<p>{SENTENCES}</p>") == SENTENCES.strip()


def test_other_languages_lists_and_captions():
    russian = "<p>Быстрая коричневая лиса прыгает через ленивую собаку, и это было очень смешно для всех собравшихся там людей.</p>"
    assert len(blocks.main_text(f"<div>{russian * 3}</div>")) > 300
    items = "<ul>" + "<li>An item of the list that has some text now.</li>" * 5 + "</ul>"
    assert blocks.main_text(items).count("An item") == 5
    assert blocks.main_text(f"<article><figure><figcaption>What it shows</figcaption></figure><p>{SENTENCES}</p></article>").startswith("What it shows")
