import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.edge import documents, none, plain
from tidemark.llm import langid, packing, perplexity, pii, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(spark, folder=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


# --- packing ----------------------------------------------------------------------------------
def check_pieces(rows, wanted):
    """Every id in exactly one piece, checksums right, sequences gapless and within the capacity."""
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        ids = wanted[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(wanted[r.doc_id])
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_length))
    assert covered == {k: len(v) for k, v in wanted.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and pieces[0][2] == (at if at & (at - 1) == 0 else 2048)
    return sequences


def test_packing_round_trip(spark):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = {k: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for k, t in texts(spark).items()}
    rows = queries.op1_packing(spark, SF).collect()
    sequences = check_pieces(rows, wanted)
    used = sum(map(len, wanted.values()))
    assert len(sequences) * 2048 < 1.1 * used + 8 * 2048


def test_ids_equal_the_tokenizers(spark):
    tokenizer, ids = Tokenizer.from_file(PATH), packing.word_ids(PATH)
    rng = random.Random(1)
    parts = ["don't", "it's", "Über", "naïve", "é", "ΑΣ", "x\u001cy", "a b", "12,5", "...", ",.", "Wort.", "ENDE,", "日本", "\t", "\r\n", "  ",
             "<|endoftext|>", "ßß", "ÿ.", "a.b", "'s", "😀"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", "", "  "]) for _ in range(8))
        assert np.frombuffer(ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_differencing_is_near_equal():
    assert sorted(map(sorted, packing.differencing([8, 7, 6, 5, 4], 2))) == [[0, 2], [1, 3, 4]]
    rng = random.Random(2)
    for k in (1, 2, 5, 30):
        sizes = [rng.randint(1, 512) for _ in range(200)]
        groups = packing.differencing(sizes, k)
        assert sorted(i for g in groups for i in g) == list(range(200))
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert max(sums) - min(sums) <= 512
    assert packing.pack([]) == [] and all(sum([2048, 2048, 1][i] for i in w) <= 2048 for w in packing.pack([2048, 2048, 1]))


def test_packing_edges(spark):
    rows = packing.pack_documents(documents(spark), PATH, keep_ids=True).collect()
    assert all(r.ids[-1] == 1 for r in rows if r.start + r.length == r.doc_tokens)
    assert sum(r.length for r in rows if r.doc_id == 3) == 1
    assert packing.pack_documents(none(spark), PATH).count() == 0


# --- quality ----------------------------------------------------------------------------------
def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(threes)
    marked = {j for i, t in enumerate(threes) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))


def test_base_rules_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op2_perplexity(spark, SF).collect()}
    for k, t in texts(spark).items():
        n, chars, symbols, dup, repeated = base(t)
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and not (r.base_failed and r.kept)


def brute_kneser_ney(strings):
    """Interpolated modified Kneser-Ney over class sequences, each counted once a string, by definition; returns p(w | those before)."""
    order, bits = perplexity.ORDER, perplexity.CLASS_BITS
    import pyarrow as pa
    from tidemark.llm.common import text_slices
    counts = collections.Counter()
    for _, _, data, offsets in text_slices(pa.array(strings)):
        sym, doc = perplexity.symbols(data, offsets)
        for d in range(len(strings)):
            s = [0] * (order - 1) + sym[doc == d].tolist()
            counts.update({tuple(s[i:i + order]) for i in range(len(s) - order + 1)})
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    discounts = {}
    for k, level in levels.items():
        n = [0] + [sum(c == i for c in level.values()) for i in (1, 2, 3, 4)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        discounts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / max(1, n[i]), 0.1), i - 0.05) for i in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (1 << bits)
        own = {g: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        cut = lambda c: discounts[k][min(c, 3)]
        c, total = own.get(gram, 0), sum(own.values())
        return ((c - cut(c) if c else 0) + sum(map(cut, own.values())) * p(gram[1:])) / total

    return p


def test_kneser_ney_against_its_definition(spark):
    strings = ["the cat sat on the mat. the cat ran", "a dog, a log; a Bog 12", "the dog sat é on the log", ""]
    docs = spark.createDataFrame([(i, s, "en") for i, s in enumerate(strings)], "doc_id bigint, text string, lang string")
    model = perplexity.kneser_ney(perplexity.count_ngrams(docs)).toArrow()
    scorer, p = perplexity.sorted_arrays(model)["en"], brute_kneser_ney(strings)
    rng = random.Random(3)
    pool = [*map(ord, "theocadgs"), 0, 0xE9, 1000]
    coded = lambda g: tuple(0 if c == " " else ord(c) for c in g)
    grams = [tuple(rng.choice(pool) for _ in range(perplexity.ORDER)) for _ in range(60)]
    grams += [coded(g[:perplexity.ORDER]) for g in ("the ca", " on th", "sat on", "   the", " a dog", "t é on")]
    assert np.allclose(scorer.log_probabilities(code_of(grams)), [np.log(p(g)) for g in grams], atol=1e-4)
    for context in ["the c", "zzzzz", "t on "]:
        every = code_of([(*coded(context[:perplexity.ORDER - 1]), w) for w in range(perplexity.CLASSES)])
        assert abs(np.exp(scorer.log_probabilities(every)).sum() - 1) < 1e-3


def test_the_model_grows_with_its_texts(spark):
    """More texts give more entries: nothing bounds the alphabet or the number of n-grams."""
    def size(n):
        docs = spark.createDataFrame([(i, "".join(chr(0x4E00 + (i * 97 + j * j) % 20000) for j in range(200)), "zh") for i in range(n)], "doc_id bigint, text string, lang string")
        return perplexity.count_ngrams(docs).count()

    sizes = [size(n) for n in (10, 40, 160)]
    assert sizes[1] > 3 * sizes[0] and sizes[2] > 3 * sizes[1]


def test_a_split_model_scores_alike(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) + " é 東京 " * (i % 3), "en" if i % 4 else None) for i in range(30)] + [(7, "the cat", "de")] * 3 + [(8, None, "de"), (None, "the cat", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("_same", F.xxhash64("text"))
    model = perplexity.cut(perplexity.kneser_ney(perplexity.count_ngrams(docs)))
    results = []
    for entries in (perplexity.MODEL_ENTRIES, 400):
        folder, turns = perplexity.stored(model, entries)
        assert (len(turns) == 1) == (entries > 400)
        found = perplexity.scored(docs, ["doc_id", "_same"], "text", "lang", folder, turns).collect()
        results.append(sorted((tuple(str(v) for v in r[:-1]), round(r.loss or -1, 9)) for r in found))
    assert len(results[0]) == len(rows) and results[0] == results[1]


def code_of(grams):
    out = np.zeros(len(grams), dtype=np.int64)
    for column in np.array(grams, dtype=np.int64).T:
        out = out << perplexity.CLASS_BITS | column
    return out


def test_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(4)
    words = ["the", "cat", "house", "of", "and", "river", "to", "green", "walks", "in", "old", "stone"]
    prose = [(i, " ".join(rng.choice(words) for _ in range(120)), "en") for i in range(60)]
    noise = [(100 + i, " ".join("".join(rng.choice("qxzjvkw#%&0123") for _ in range(7)) for _ in range(120)), "en") for i in range(3)]
    rows = {r.doc_id: r.kept for r in perplexity.quality(spark.createDataFrame(prose + noise, "doc_id bigint, text string, lang string")).collect()}
    assert all(rows[i] for i in range(60)) and not any(rows[100 + i] for i in range(3))


def test_bands_against_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op2_perplexity(spark, folder).collect()}
    judged = [(r.quality, rows[r.doc_id].kept) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in rows and not rows[r.doc_id].base_failed]
    bad, good = ([kept for quality, kept in judged if quality == q] for q in (0, 1))
    assert bad.count(False) >= 0.75 * len(bad) > 0 and good.count(False) <= 0.02 * len(good)


def prose(rng, n):
    words = ["the", "cat", "house", "of", "and", "river", "to", "green", "walks", "in", "old", "stone"]
    return " ".join(rng.choice(words) for _ in range(n))


def test_bands_of_single_texts_and_hot_copies(spark):
    """One text per language, only copies, and copies that hold both quartiles: a clean text stays, noise goes."""
    rng = random.Random(8)
    copy = prose(rng, 120)
    rows = [(0, prose(rng, 120), "one"), (1, prose(rng, 120), None), *((10 + i, copy, "same") for i in range(5))]
    rows += [(100 + i, copy, "hot") for i in range(90)] + [(200 + i, prose(rng, 120), "hot") for i in range(30)]
    noise = [(300 + i, " ".join("".join(rng.choice("qxzjvkw#%&0123") for _ in range(7)) for _ in range(120)), "hot") for i in range(2)]
    found = perplexity.quality(spark.createDataFrame(rows + noise, "doc_id bigint, text string, lang string")).collect()
    kept = {r.doc_id: r.kept for r in found}
    assert len(kept) == len(rows) + 2 and {k for k in kept if not kept[k]} == {300, 301}
    assert all(np.log(r.most_perplexity / r.least_perplexity) >= 2 * perplexity.LEAST_WIDTH - 1e-9 for r in found)


def test_quality_edges(spark):
    docs = documents(spark)
    rows = perplexity.quality(docs).collect()
    assert len(rows) == docs.count() and all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (3, 4, 5, 9))
    assert perplexity.quality(none(spark)).count() == 0


# --- personal data ----------------------------------------------------------------------------
def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[2])))


def own_spans(t):
    return [s for s in pii.find_spans(t, pii.automaton()) if s[2] in pii.KINDS[:4]]


def test_spans_against_the_base_rules():
    rng = random.Random(5)
    for alphabet in ("a@.-1", "12. ", "0123456789 -", "+1()-. 55", "ab@.é+% 127.0"):
        for _ in range(1500):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert own_spans(t) == base_spans(t), repr(t)


def test_personal_data_query(spark):
    rows = {r.doc_id: r for r in queries.op5_pii(spark, SF).collect()}
    for k, t in texts(spark).items():
        spans = base_spans(t)
        assert rows[k].base_sha256 == hashlib.sha256(pii.shown(spans).encode()).hexdigest()
        assert [rows[k][f"n_{c}"] for c in pii.KINDS[:4]] == [sum(s[2] == c for s in spans) for c in pii.KINDS[:4]]


def test_extra_kinds_and_redaction():
    t = "see http://bob:secret@host.example/x, IBAN GB82 WEST 1234 5698 7654 32 and account no: 12345678."
    kinds = {s[2]: t[s[0]:s[1]] for s in pii.find_spans(t, pii.automaton())}
    assert kinds["url_login"] == "bob:secret" and kinds["iban"] == "GB82 WEST 1234 5698 7654 32" and kinds["account"] == "12345678"
    assert pii.redact("mail a.b@c.de now", own_spans("mail a.b@c.de now")) == "mail <EMAIL> now"
    assert not pii.find_spans("iban is a word and an account of things, 2020 was long: 3 years", pii.automaton())


@pytest.mark.parametrize("cue", ["Account No: ", "Account Number: ", "aCCount nUmber ", "account no ", "ACCOUNT NO. ", "Ssn ", "PassPort "])
def test_cues_in_any_case(cue):
    text = f"\u0130\u00c4 {cue}12345678 end"
    spans = pii.find_spans(text, pii.automaton())
    assert [(text[a:b], k) for a, b, k in spans] == [("12345678", "account")] and pii.redact(text, spans).endswith(f"{cue}<ACCOUNT> end")


def test_redaction_keeps_rows_and_columns(spark):
    docs = documents(spark).withColumn("text", F.when(F.col("doc_id") == 2, "x@y.zz é").otherwise(F.col("text")))
    done = pii.redact_documents(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert plain(done.where("doc_id = 2"), "text", "n_chars") == [("<EMAIL> é", 9)]
    assert plain(done.where("doc_id = 3"), "text") == [(None,)] and pii.redact_documents(none(spark)).count() == 0
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(none(spark)).count() == 0


# --- language ---------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op9_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_edges(spark):
    docs = documents(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 8)} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 8, 9})
    assert langid.identify(none(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("name,family", [("en", "germanic"), ("pt-BR", "romance"), ("xx", "=xx")])
def test_families(name, family):
    assert langid.family_of(name) == family
