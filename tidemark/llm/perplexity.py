"""Quality rules by n-gram perplexity under a modified Kneser-Ney model counted by Spark.

The units are code points: all capitals, all digits and all white space of ASCII are one class each, Latin-1 is taken
as it is and the rest hashed to 32,512 classes, so an n-gram of order four is an exact 60-bit number and the model has
no fixed size: it gets larger with the corpus.  An n-gram's count is the number of different texts of its language
that hold it: tasks count their own n-grams in sorted arrays, Spark adds them up, and the discounts, continuation
counts and interpolated probabilities are DataFrame steps over the counts.  The model is a table of sorted arrays in
the checkpoint folder, in parts of bounded size that the scoring tasks read; the driver never holds it.
Bands are by language: quartiles of the log-perplexity of the different texts, widened by a multiple of their
distance and at least by a fixed width, so that copies or a language of one text can't close the band.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BASE, SPACES, mix, runs, span_hashes, text_slices, window_hashes
from tidemark.llm.tiling import bloom, in_bloom
from tidemark.session import checkpoint_dir, cut, small_table

ORDER, CLASS_BITS = 4, 15
CLASSES = 1 << CLASS_BITS
COUNT_CODES = 1 << 21           # n-grams sorted at once by a counting task, and sums that it holds before handing them on
MODEL_ENTRIES = 16_000_000      # entries a scoring task holds at once, 12 bytes each; larger models are scored with in turns
BAND = 3.0                      # quartile distances between a quartile and the edge of the band; figures in the README
LEAST_WIDTH = 0.05              # of log-perplexity: a band reaches at least as far beyond both quartiles, 50 steps of the grid
BIN = 0.001                     # grid of log-perplexity on which quartiles are taken
UNKNOWN = "und"
#: fixed values: the symbols counted as ``n_symbols``
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _classes() -> np.ndarray:
    """Class of each ASCII byte: white space and controls 0, all digits and all capitals one class each, others themselves."""
    out = np.arange(256)
    out[:33] = 0
    out[48:58], out[65:91] = ord("0"), ord("A")
    return out


_CLASS = _classes()


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, its text): ASCII by :func:`_classes`, Latin-1 as it is, others by a hash of their bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    out = _CLASS[data[at]]
    wide = lead >= 0x80
    spots = at[wide]
    value = np.zeros(len(spots), dtype=np.int64)
    for step in range(4):
        byte = data[np.minimum(spots + step, len(data) - 1)].astype(np.int64)
        value = np.where((step == 0) | ((byte & 0xC0) == 0x80), value * 67 + byte, value)
    latin = (lead[wide] & 0xFE) == 0xC2
    out[wide] = np.where(latin, (lead[wide] & 3) << 6 | (data[np.minimum(spots + 1, len(data) - 1)] & 0x3F), 256 + value % (CLASSES - 256))
    return out, np.searchsorted(offsets, at, "right") - 1


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram code, text) of each code point of a text: its class after those of the three before it, blanks at the start."""
    sym, doc = symbols(data, offsets)
    code = sym.copy()
    for back in range(1, min(ORDER, len(sym))):
        code[back:] |= np.where(doc[back:] == doc[:-back], sym[:-back], 0) << (CLASS_BITS * back)
    return code, doc


def _middle(code: np.ndarray | Column) -> np.ndarray | Column:
    """A number of the last two classes of ``code``, alike in numpy and in Spark, by which a large model is split."""
    if isinstance(code, Column):
        return F.shiftright(F.pmod(code.bitwiseAND(F.lit((1 << 2 * CLASS_BITS) - 1)) * F.lit(2654435761), F.lit(1 << 32)), 8)
    return ((code & ((1 << 2 * CLASS_BITS) - 1)) * 2654435761 % (1 << 32)) >> 8


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n): the texts that hold each n-gram, added up by Spark after sums in each task.

    A task hands its sums on when they reach ``COUNT_CODES`` entries, so its memory doesn't follow its input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def settle() -> int:
            for name, parts in waiting.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                if name in sums:
                    code, n = np.concatenate([sums[name][0], code]), np.concatenate([sums[name][1], n])
                    order = np.argsort(code, kind="stable")
                    code, n = code[order], n[order]
                    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                    code, n = code[first], np.add.reduceat(n, first)
                sums[name] = (code, n)
            waiting.clear()
            return sum(len(code) for code, _ in sums.values())

        def handed() -> Iterator[pa.RecordBatch]:
            for name, (code, n) in sums.items():
                for i in range(0, len(code), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(code[part]), pa.string()), pa.array(code[part], pa.int64()), pa.array(n[part].astype(np.int64))],
                        names=["lang", "code", "n"])
            sums.clear()

        size = 0
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for first, last, data, offsets in text_slices(batch.column(1)):
                code, doc = codes(data, offsets)
                _, fresh = np.unique(mix(code.view(np.uint64) * np.uint64(BASE) + doc.astype(np.uint64)), return_index=True)
                code, doc = code[fresh], doc[fresh]
                part = names[first:last]
                for name in set(part.tolist()):
                    waiting.setdefault(name, []).append(code[(part == name)[doc]])
                size += len(code)
                if size >= COUNT_CODES:
                    size = 0
                    if settle() >= COUNT_CODES:
                        yield from handed()
        settle()
        yield from handed()

    per_task = docs.select(_language(lang).alias("lang"), F.col(text).cast("string").alias("_text")).mapInArrow(
        run, "lang string, code bigint, n bigint")
    return per_task.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def different_texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, text): each different text of a language once, so that the model learns no copy by heart.

    Texts whose hash occurs once stay where they are.  A Bloom filter of fixed size over the others' hashes picks the
    rows that are grouped; what it picks wrongly is grouped for nothing.
    """
    rows = docs.select(_language(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    hashed = rows.withColumn("seed", F.xxhash64("lang", "text"))
    filled = bloom(hashed.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"))

    @F.arrow_udf("boolean")
    def repeated(seed: pa.Array) -> pa.Array:
        return pa.array(in_bloom(seed.to_numpy().view(np.uint64), filled))

    marked = hashed.withColumn("_again", repeated("seed")).drop("seed")
    return marked.where("NOT _again").drop("_again").unionByName(marked.where("_again").groupBy("lang", "text").agg(F.lit(1)).select("lang", "text"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, k, weight, code, value): interpolated modified Kneser-Ney of orders 1 to ``ORDER``.

    Where ``weight`` is false, ``value`` is the log-probability of the last class of an n-gram after the others;
    where it is true, the log of the weight that the n-gram, as a context, gives to the next lower order.  The
    highest order uses counts of texts, lower orders the number of different classes before the n-gram; order 1 falls back
    to the uniform distribution.
    """
    levels = {ORDER: counts.select("lang", "code", "n")}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << (CLASS_BITS * k)) - 1
        levels[k] = cut(levels[k + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(
            F.count(F.lit(1)).alias("n")))
    lower = counts.select("lang").distinct().select("lang", F.lit(0).cast("bigint").alias("suffix"), F.lit(1.0 / CLASSES).alias("p_low"))
    parts = []
    for k in range(1, ORDER + 1):
        level = levels[k]
        kinds = level.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = "(n1 / greatest(n1 + 2 * n2, 1))"
        discount = kinds.select("lang", *[
            F.expr(f"least(greatest({i} - {i + 1} * {y} * n{i + 1} / greatest(n{i}, 1), 0.1D), {i} - 0.05D)").alias(f"d{i}") for i in (1, 2, 3)])
        cut_by = "CASE WHEN n = 1 THEN d1 WHEN n = 2 THEN d2 ELSE d3 END"
        with_d = level.join(F.broadcast(discount), "lang").select(
            "lang", "code", "n", F.expr(cut_by).alias("d"), F.shiftright("code", CLASS_BITS).alias("context"),
            F.col("code").bitwiseAND(F.lit((1 << (CLASS_BITS * (k - 1))) - 1)).cast("bigint").alias("suffix"))
        context = cut(with_d.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken")))
        found = cut(with_d.join(context, ["lang", "context"]).join(lower, ["lang", "suffix"]).select(
            "lang", "code", ((F.col("n") - F.col("d") + F.col("taken") * F.col("p_low")) / F.col("total")).alias("p")))
        row = lambda order, weight, code, value: ("lang", F.lit(order).alias("k"), F.lit(weight).alias("weight"), F.col(code).alias("code"), F.log(value).cast("float").alias("value"))
        parts.append(context.select(*row(k - 1, True, "context", F.col("taken") / F.col("total"))))
        parts.append(found.select(*row(k, False, "code", F.col("p"))))
        lower = found.select("lang", F.col("code").alias("suffix"), F.col("p").alias("p_low"))
    return reduce(DataFrame.unionByName, parts)


Sorted = tuple[np.ndarray, np.ndarray]
_NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))


class Scorer:
    """Sorted arrays of one language: per order the codes with their log-probabilities, and contexts with their weights."""

    def __init__(self, tables: dict[tuple[int, bool], Sorted]) -> None:
        self.tables = tables

    def _look_up(self, k: int, weight: bool, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables.get((k, weight), _NONE)
        if not len(keys):
            return np.zeros(len(code), dtype=np.float32), np.zeros(len(code), dtype=bool)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        known = keys[at] == code
        return np.where(known, values[at], np.float32(0)), known

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        """Of each n-gram; one that is not in the model backs off, in the end to the uniform distribution."""
        out = np.zeros(len(code), dtype=np.float64)
        todo = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            part = code[todo] & ((1 << (CLASS_BITS * k)) - 1)
            value, known = self._look_up(k, False, part)
            out[todo] += value
            todo, part = todo[~known], part[~known]
            out[todo] += self._look_up(k - 1, True, part >> CLASS_BITS)[0]
        out[todo] -= math.log(CLASSES)
        return out


def sorted_arrays(model: pa.Table) -> dict[str, Scorer]:
    """Scorers of the languages in ``model``, a table of :func:`kneser_ney`'s columns."""
    out: dict[str, Scorer] = {}
    if not len(model):
        return out
    names = model["lang"].combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    group = (names.indices.to_numpy().astype(np.int64) * (ORDER + 1) + model["k"].to_numpy()) * 2 + model["weight"].to_numpy()
    code, value = model["code"].to_numpy(), model["value"].to_numpy()
    for g in np.unique(group).tolist():
        own = np.flatnonzero(group == g)
        keys = code[own]
        if (keys[1:] < keys[:-1]).any():
            own = own[np.argsort(keys, kind="stable")]
            keys = code[own]
        name = names.dictionary[g // 2 // (ORDER + 1)].as_py()
        out.setdefault(name, Scorer({})).tables[g // 2 % (ORDER + 1), bool(g % 2)] = (keys, value[own])
    return out


Turn = tuple[list[str], int, int]


def stored(model: DataFrame, entries: int = MODEL_ENTRIES) -> tuple[str, list[Turn]]:
    """Write ``model`` in parts of about ``entries`` rows; returns the folder and (languages, split, splits) of each part.

    Small languages share a part.  A larger one is split by the two classes before the last of an n-gram, which are the
    last two of its contexts, so that all a code point can ask for lies in one part; orders 1 and 2 go to all of its parts.
    """
    spark = model.sparkSession
    folder = f"{checkpoint_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    turns: list[Turn] = []
    first, room = [], 0
    for row in sorted(model.groupBy("lang").count().collect()):
        splits = -(-row["count"] // entries)
        if splits > 1:
            first.append((row["lang"], len(turns), splits))
            turns += [([row["lang"]], i, splits) for i in range(splits)]
            room = 0
            continue
        if row["count"] > room:
            turns.append(([], 0, 1))
            room = entries
        turns[-1][0].append(row["lang"])
        first.append((row["lang"], len(turns) - 1, 1))
        room -= row["count"]
    placed = model.join(small_table(spark, first, "lang string, first int, splits int"), "lang")
    everywhere = F.col("k") <= F.when(F.col("weight"), 1).otherwise(2)
    split = F.pmod(F.when(F.col("weight"), _middle(F.col("code"))).otherwise(_middle(F.shiftright("code", CLASS_BITS))), F.col("splits")).cast("int")
    spots = F.when(everywhere, F.sequence(F.lit(0), F.col("splits") - 1)).otherwise(F.array(split))
    placed = placed.withColumn("spot", F.explode(spots)).select((F.col("first") + F.col("spot")).alias("turn"), "lang", "k", "weight", "code", "value")
    placed.repartition("turn", "lang", "k", "weight").sortWithinPartitions("turn", "lang", "k", "weight", "code").write.partitionBy("turn").parquet(folder)
    return folder, turns


_held: dict[tuple[str, int], dict[str, Scorer]] = {}


def _scorers(folder: str, turn: int) -> dict[str, Scorer]:
    """A part of the stored model; a Python worker keeps the one that it used last."""
    if (folder, turn) not in _held:
        _held.clear()
        store, root = fs.FileSystem.from_uri(folder)
        _held[folder, turn] = sorted_arrays(ds.dataset(f"{root}/turn={turn}", filesystem=store, format="parquet").to_table())
    return _held[folder, turn]


def base_rules(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    inside = ~SPACES[data]
    starts, ends, doc = runs(inside, offsets)
    count = lambda d, w=None: np.bincount(d, weights=w, minlength=n).astype(np.int64)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    chars = sums(inside & ((data & 0xC0) != 0x80))
    words = span_hashes(data, starts, ends)
    window, at = window_hashes(words, doc, 3)
    repeated = np.zeros(len(words), dtype=bool)
    if len(window):
        _, back, many = np.unique(mix(window + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        twice = at[many[back] > 1]
        for i in range(3):
            repeated[twice + i] = True
    line_starts, line_ends, line_doc = runs(data != 10, offsets)
    before = np.concatenate([[0], np.cumsum(inside)])
    worded = before[line_ends] > before[line_starts]
    lines = mix(span_hashes(data, line_starts, line_ends)[worded] + line_doc[worded].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), dtype=bool)
    again[first] = False
    return [count(doc), chars.astype(np.int64), sums(_SYMBOL[data]).astype(np.int64), count(line_doc[worded][again]), count(doc[repeated])]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, keys: list[str], text: str, lang: str, folder: str, turn: int, split: int, splits: int) -> DataFrame:
    """``keys``, ``lang``, the base measures, the code points, and the negative log-probabilities of those of the part, added up."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _scorers(folder, turn)
            names = np.array(batch.column(width).to_pylist(), dtype=object)
            for first, last, data, offsets in text_slices(batch.column(width + 1)):
                base = base_rules(data, offsets)
                code, doc = codes(data, offsets)
                part, logp = names[first:last], np.zeros(len(code))
                for name in set(part.tolist()) & known.keys():
                    own = (part == name)[doc]
                    if splits > 1:
                        own &= _middle(code >> CLASS_BITS) % splits == split
                    own = np.flatnonzero(own)
                    logp[own] = known[name].log_probabilities(code[own])
                chars = np.bincount(doc, minlength=last - first)
                lost = -np.bincount(doc, weights=logp, minlength=last - first)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, last - first) for c in batch.columns[:width + 1]), *(pa.array(b, pa.int64()) for b in base),
                     pa.array(chars, pa.int64()), pa.array(lost, pa.float64())], names=[*keys, "_lang", *MEASURES, "chars", "lost"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_lang string", *(f"{m} bigint" for m in MEASURES), "chars bigint, lost double"])
    return docs.select(*keys, _language(lang).alias("_lang"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def scored(docs: DataFrame, keys: list[str], text: str, lang: str, folder: str, turns: list[Turn]) -> DataFrame:
    """One row per row of the languages of ``turns``: ``keys``, ``lang``, the base measures and the mean loss of a code point.

    Losses of a split model are added up over its parts; equal rows are counted there and unfolded again.
    """
    outputs = [measure(docs.where(_language(lang).isin(names)), keys, text, lang, folder, i, split, splits).withColumn("splits", F.lit(splits))
               for i, (names, split, splits) in enumerate(turns)]
    same = [*keys, "_lang", *MEASURES, "chars", "splits"]
    whole = [o for o, t in zip(outputs, turns) if t[2] == 1]
    if any(t[2] > 1 for t in turns):
        summed = reduce(DataFrame.unionByName, [o for o, t in zip(outputs, turns) if t[2] > 1]).groupBy(*same).agg(
            F.sum("lost").alias("lost"), F.count(F.lit(1)).alias("n")).withColumn("n", F.expr("n div splits"))
        blocks = summed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div 65536"))))
        unfolded = blocks.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(65536), F.col("n") - F.col("block") * 65536))))
        whole.append(unfolded.select(*same, (F.col("lost") / F.col("n")).alias("lost")))
    rows = reduce(DataFrame.unionByName, whole)
    return rows.select(*keys, "_lang", *MEASURES, F.expr("CASE WHEN chars > 0 THEN lost / chars END").alias("loss"))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", band: float = BAND) -> DataFrame:
    """One row per row: ``key``, the base measures, base_failed, kept, perplexity and the band of the language.

    A null or empty text has no words and fails the base rules.  A null language is ``und``.  A text is kept if it
    passes the base rules and its perplexity lies in the band of its language; the quartiles are exact on a grid
    of 0.001 over the different texts that pass the base rules, so copies count once.  Keys may repeat or be null; an empty table gives no rows.
    """
    counts = cut(count_ngrams(different_texts(docs, text, lang)))
    model = cut(kneser_ney(counts))
    folder, turns = stored(model)
    spoken = _language(lang)
    marked = docs.select(key, text, lang, F.xxhash64(F.col(text).cast("string")).alias("_same"))
    parts = [scored(marked, [key, "_same"], text, lang, folder, turns)] if turns else []
    silent = docs.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(key, spoken.alias("_lang"))
    found = [name for names, _, _ in turns for name in names]
    rest = silent.where(~F.col("_lang").isin(found)) if found else silent
    parts.append(rest.select(key, F.lit(None).cast("bigint").alias("_same"), "_lang", *[F.lit(0).cast("bigint").alias(m) for m in MEASURES], F.lit(None).cast("double").alias("loss")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(reduce(DataFrame.unionByName, parts).withColumn("base_failed", failed))
    texts = measured.where(~F.col("base_failed") & F.col("loss").isNotNull()).groupBy("_lang", "_same").agg(F.min("loss").alias("loss"))
    grid = texts.groupBy("_lang", F.round(F.col("loss") / BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("_lang")
    placed = grid.withColumn("upto", F.sum("n").over(over.orderBy("bin"))).withColumn("all", F.sum("n").over(over))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) * BIN
    beyond = F.greatest(band * (F.col("q3") - F.col("q1")), F.lit(LEAST_WIDTH))
    bands = placed.groupBy("_lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).select(
        "_lang", (F.col("q1") - beyond).alias("lower"), (F.col("q3") + beyond).alias("upper"))
    inside = F.col("loss").between(F.col("lower"), F.col("upper"))
    return measured.join(bands, "_lang", "left").select(
        key, *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.exp("loss").alias("perplexity"), F.exp("lower").alias("least_perplexity"), F.exp("upper").alias("most_perplexity"))
