"""Language identification by hierarchical discrimination.

First the family, then the language inside it.  Every decision is a vote of linear support vector machines, one
for each pair of families and one for each pair of languages of a family, over hashed character n-grams of the
whole text.  The machines are fitted side by side, one task each, on a bounded sample of labelled rows (about
``per_language`` rows of each language); only their weights travel to the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_BYTES, mix, unused
from tidemark.session import cut

UNDETERMINED = "und"
PER_LANGUAGE = 1200            # bound of the training sample, rows of each language on average
BITS = 14                      # 2**14 hashed features
ORDERS = (1, 2, 3)
SCALE = 50.0                   # shares of n-grams times this are the features
MIN_SCORE = 0.5

#: fixed values: families of closely related languages by ISO 639-1 code; any other label is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb", "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs", "baltic": "lt lv", "celtic": "ga cy gd br",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indic": "hi bn mr ne pa gu ur", "iranian": "fa ku ps tg",
    "semitic": "ar he mt am", "austronesian": "id ms tl jv su",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0], f"={language}")


def gram_indexes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature indexes, text indexes) of each order: n-grams of lower-cased letters, other runs being one blank."""
    letters = _letters()
    joined = "".join(f" {t.lower()} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t.lower()) + 2 for t in texts])
    inside = letters[points]
    keep = inside.copy()
    keep[1:] |= inside[:-1]                                  # the first blank behind a letter
    keep[0] = True
    keep[1:] |= doc[1:] != doc[:-1]                          # and each text's first
    points, doc = np.where(inside, points, 32)[keep].astype(np.uint64), doc[keep]
    h = np.zeros(len(points), dtype=np.uint64)
    shift = np.uint64(64 - BITS)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(n)
        if n in ORDERS:
            same = doc[:size] == doc[n - 1:]
            yield (mix(h[same]) >> shift).astype(np.int64), doc[:size][same]


@dataclass
class Model:
    """Languages by family, and a column of weights and a bias for each pair (first, second): positive means first."""

    families: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), dtype=np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, texts: list[str]) -> np.ndarray:
        sums, grams = np.zeros((len(texts), len(self.pairs))), np.zeros(len(texts))
        for index, doc in gram_indexes(texts):
            grams += np.bincount(doc, minlength=len(texts))
            for c in range(len(self.pairs)):
                sums[:, c] += np.bincount(doc, weights=self.weights[index, c], minlength=len(texts))
        return SCALE * sums / np.maximum(grams, 1)[:, None] + self.biases

    def vote(self, among: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """Most pairs won, then the larger sum of margins, then the name; confidence is the least of its pairs'."""
        if len(among) == 1:
            return among[0], 1.0
        own = {a: [margin[a, b] if (a, b) in margin else -margin[b, a] for b in among if b != a] for a in among}
        best = min(among, key=lambda a: (-sum(m > 0 for m in own[a]), -sum(own[a]), a))
        return best, float(1 / (1 + np.exp(-2 * min(own[best]))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score); a text without a letter is undetermined with score 0."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.families:
            return out
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        start = 0
        while start < len(at):
            stop, size = start, 0
            while stop < len(at) and (stop == start or size + len(texts[at[stop]]) <= SLICE_BYTES // 4):
                size += len(texts[at[stop]])
                stop += 1
            rows = self.margins([texts[i] for i in at[start:stop]])
            for i, row in zip(at[start:stop], rows):
                margin = dict(zip(self.pairs, row.tolist()))
                family, sure = self.vote(sorted(self.families), margin)
                language, also = self.vote(self.families[family], margin)
                out[i] = (language, min(sure, also))
            start = stop
        return out


def held_out(key: str) -> Column:
    """Rows never learned from: CRC-32 of the key as text leaves 1 modulo 3.  False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def separate(indexes: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge loss, dual coordinate descent, fixed order of draws)."""
    weights, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(signs))
    norms = np.array([v @ v for v in values]) + 1.0 + 0.5 / cost
    rng = np.random.Generator(np.random.PCG64(9))
    for _ in range(rounds):
        for i in rng.permutation(len(signs)):
            index, value, y = indexes[i], values[i], signs[i]
            slope = y * (weights[index] @ value + bias) - 1.0 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - slope / norms[i])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                weights[index] += step * value
                bias += step
    return weights.astype(np.float32), bias


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of (language, text) rows."""
    for batch in batches:
        indexes, values = [], []
        for text in (x.as_py() for x in batch.column(1)):
            counts = np.zeros(1 << BITS)
            for index, _ in gram_indexes([text]):
                counts += np.bincount(index, minlength=1 << BITS)
            at = np.flatnonzero(counts)
            indexes.append(at.astype(np.int32))
            values.append((SCALE * counts[at] / counts.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(indexes, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            names=["_lang", "draw", "at", "share"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on labelled rows that are not held out.  Rows without label or letter are left out; no rows, no model."""
    labelled = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where(
        F.col("_lang").isNotNull() & F.col("_key").isNotNull() & ~held_out("_key"))
    sizes = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    if not sizes:
        return Model()
    rate = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        rate = F.when(F.col("_lang") == name, F.lit(min(1.0, per_language / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(9), "_key", "_text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = cut(labelled.where((draw < rate) & F.col("_text").rlike(r"\p{L}")).select(
        "_lang", "_text", F.xxhash64("_key", "_text").alias("draw")).dropDuplicates(["_lang", "draw"]).mapInArrow(
        _features, "_lang string, draw bigint, at array<int>, share array<float>"))
    names = sorted(r["_lang"] for r in sample.select("_lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(family_of(name), []).append(name)
    pairs = list(combinations(sorted(families), 2)) + [p for f in sorted(families) for p in combinations(families[f], 2)]
    if not pairs:
        return Model(families)
    # the machines that a language's rows train, and on which side
    sides: dict[str, list[tuple[int, float]]] = {n: [] for n in names}
    for i, (first, second) in enumerate(pairs):
        for sign, member in ((1.0, first), (-1.0, second)):
            for n in families.get(member, [member]):
                sides[n].append((i, sign))
    jobs = sample.sparkSession.createDataFrame(
        [(n, i, sign) for n in names for i, sign in sides[n]], "_lang string, machine int, sign double")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_lang", "ascending"), ("draw", "ascending")])      # the same order whatever the shuffle
        weights, bias = separate([np.array(x) for x in table["at"].to_pylist()], [np.array(x) for x in table["share"].to_pylist()],
                                 table["sign"].to_numpy())
        return pa.table({"machine": table["machine"][:1], "weights": pa.array([weights], pa.list_(pa.float32())), "bias": pa.array([bias])})

    fitted = sample.join(F.broadcast(jobs), "_lang").groupBy("machine").applyInArrow(
        fit, "machine int, weights array<float>, bias double").toArrow().sort_by("machine")     # orderBy would fit twice, for its ranges
    return Model(families, pairs, np.stack([np.array(w.as_py(), dtype=np.float32) for w in fitted["weights"]], axis=1), fitted["bias"].to_numpy())


def _with_prediction(docs: DataFrame, columns: list[str], text: str, model: Model, language: str, score: str) -> DataFrame:
    """``columns`` and the prediction as ``language`` and ``score``, names that no column has."""
    body, = unused(columns, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.predict(batch.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                names=[*columns, language, score])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"`{language}` string", f"`{score}` double"])
    return docs.select(*columns, F.col(text).cast("string").alias(body)).mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row: ``key``, held_out, lang_pred, score.  Predictions use the text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned.  Keys may be null or
    repeat; an empty table gives no rows.
    """
    model = train(docs, key, text, lang)
    language, score = unused([key], "lang_pred", "score")
    return _with_prediction(docs.select(key, text), [key], text, model, language, score).select(
        key, held_out(key).alias("held_out"), F.col(language).alias("lang_pred"), F.col(score).alias("score"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without rows whose language is undetermined or scores under ``min_score``; all columns stay as they are,
    whatever their names.  Null, empty and letterless texts go.  Repeated rows are judged alike; an empty table gives no rows."""
    model = train(docs, key, text, lang)
    language, score = unused(docs.columns, "lang_pred", "score")
    scored = _with_prediction(docs, docs.columns, text, model, language, score)
    return scored.where((F.col(language) != UNDETERMINED) & (F.col(score) >= min_score)).select(*docs.columns)
