"""Tagging with large dictionaries: one automaton pass over each text instead of one pattern per concept.

The dictionary is compiled once in every worker (Aho-Corasick), so a text is read once however many terms there are.  The
dictionary itself travels with the function; it is a driver-side list, and :data:`MOST_BYTES` bounds it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
_HIT = pa.list_(pa.struct([("concept", pa.string()), ("terms", pa.list_(pa.string())), ("n", pa.int64())]))
_TYPE = "array<struct<concept:string,terms:array<string>,n:bigint>>"
_compiled: dict[tuple, object] = {}


def _automaton(pairs: tuple[tuple[str, str], ...]):
    """Term to its concepts; kept by the worker between batches."""
    if pairs not in _compiled:
        import ahocorasick

        concepts: dict[str, list[str]] = {}
        for concept, term in pairs:
            concepts.setdefault(term, []).append(concept)
        found = ahocorasick.Automaton()
        for term, names in concepts.items():
            found.add_word(term, (term, tuple(sorted(set(names)))))
        found.make_automaton()
        _compiled.clear()
        _compiled[pairs] = found
    return _compiled[pairs]


def dictionary_hits(text: Column, dictionary: Iterable[tuple[str, str]], whole_words: bool = False) -> Column:
    """Column of (concept, terms, n) structs by concept: the different terms found, sorted, and their places, overlapping ones too.

    Case of letters is ignored.  With ``whole_words`` a term counts only where no letter, digit or underscore touches it.
    Blank terms are left out; a null text has no hits.
    """
    pairs = tuple(sorted({(str(c), str(t).lower()) for c, t in dictionary if t and str(t).strip()}))
    if sum(len(c) + len(t) for c, t in pairs) > MOST_BYTES:
        raise ValueError(f"a dictionary may weigh {MOST_BYTES} bytes; split it by concept")

    @F.arrow_udf(_TYPE)
    def hits(values: pa.Array) -> pa.Array:
        found = _automaton(pairs) if pairs else None
        out = []
        for value in values.to_pylist():
            by: dict[str, dict[str, int]] = {}
            for last, (term, names) in found.iter(value) if value and found else ():
                if whole_words:
                    first = last - len(term)
                    if (first >= 0 and _word(value[first])) or (last + 1 < len(value) and _word(value[last + 1])):
                        continue
                for name in names:
                    terms = by.setdefault(name, {})
                    terms[term] = terms.get(term, 0) + 1
            out.append([{"concept": c, "terms": sorted(by[c]), "n": sum(by[c].values())} for c in sorted(by)])
        return pa.array(out, _HIT)

    return hits(F.lower(text))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def tag_dictionary(rows: DataFrame, text: Column, dictionary: Iterable[tuple[str, str]], columns: list[str],
                   whole_words: bool = False) -> DataFrame:
    """One row per (row, concept) with a hit: ``columns``, concept, terms, n.  For batch and streaming frames."""
    return rows.select(*columns, dictionary_hits(text, dictionary, whole_words).alias("_hits")).select(*columns, F.inline("_hits"))
