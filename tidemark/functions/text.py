"""Text cleaning as Column expressions.

Only two steps have no Spark builtin (HTML entities and Unicode NFKC).  They run as Arrow UDFs that
see nothing but the rows that need them: every other row passes a null to Python and stays in the JVM.  Both
are marked non-deterministic, which keeps Spark from copying the whole chain into every filter and
projection that uses the cleaned text.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: character classes of the cleaning rules (Java regex spelling) --------------
# a leading (?!...) only rejects plain ASCII early; it never changes what matches
TAG = r"<[^>]{1,200}>"
CONTROL = r"(?![ -~])[\x00-\x08\x0B\x0C\x0E-\x1F​-‏﻿]"
EMOJI = r"[\x{1F000}-\x{1FAFF}☀-➿\x{1F1E6}-\x{1F1FF}←-⇿]"
DECORATION = r"(?![a-zA-Z0-9\s.,])[※★☆◆◇■□●○▲△▼▽*=＝_－—–\-~～·・]{3,}"
BULLET = r"(?mdU)^[\s\d]{0,4}[.、)）:：]\s*"
SPACE_RUN = r"(?U)\s+"
EDGE_SPACE = r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z"
TITLE_BRACKETS = r"(?d)[（(【\[［].{0,40}?[）)】\]］]"
TITLE_LEAD = r"(?U)\A[\s\W_]+"
TITLE_SPLIT = r"(?U)[/|｜・‧,，、~～]|[-–—](?=\S)"
TITLE_TAIL = r"(?U)[\s\W_]+\z"
TITLE_LENGTH = 16
BLANK_TITLE = r"(?iuU)\A\s*(測試|test|測試職缺)?\s*\z"

#: characters that NFKC leaves alone; a text made only of these never goes to Python
_OUTSIDE_STABLE = r"(?![ -~])[^\x00-\x7FÀ-ÿ、。一-鿿]"


@F.arrow_udf(StringType())
def _unescape(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _to_nfkc(values: pa.Array) -> pa.Array:
    return pa.array(
        [None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


_unescape = _unescape.asNondeterministic()
_to_nfkc = _to_nfkc.asNondeterministic()


def unescape_html(text: Column) -> Column:
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def nfkc(text: Column, source: Column | None = None) -> Column:
    """NFKC form.  ``source`` is the raw text ``text`` was made from: deciding on it saves a second evaluation."""
    needed = text.rlike(_OUTSIDE_STABLE) if source is None else source.rlike(_OUTSIDE_STABLE) | source.contains("&")
    return F.coalesce(_to_nfkc(F.when(needed, text)), text)


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def normalize_text(text: Column) -> Column:
    """Unescape, drop tags, NFKC, drop control characters, emoji, decoration and bullets, collapse space."""
    raw = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(unescape_html(raw), TAG, " ")
    t = F.regexp_replace(nfkc(t, raw), CONTROL, "")
    t = F.regexp_replace(t, EMOJI, " ")
    t = F.regexp_replace(t, DECORATION, " ")
    t = F.regexp_replace(t, BULLET, "")
    return F.trim(F.regexp_replace(t, SPACE_RUN, " "))


def clean_title(title: Column) -> Column:
    """The job name alone: no bracketed spans, leading or trailing symbols, or text after a separator."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_BRACKETS, "")
    t = F.regexp_replace(t, TITLE_LEAD, "")
    parts = F.transform(F.split(t, TITLE_SPLIT, -1), strip)
    named = F.filter(parts, lambda p: F.length(p) >= 2)
    t = strip(F.coalesce(F.try_element_at(named, F.lit(1)), t))
    return F.substring(F.regexp_replace(t, TITLE_TAIL, ""), 1, TITLE_LENGTH)


def embedding_text(title: Column, industry: Column, description: Column, prefix: int | None = None) -> Column:
    """``title。title。industry。description`` with the title doubled as weight; ``prefix`` cuts the description if given."""
    blank = F.lit("")
    t, i, d = (F.coalesce(c, blank) for c in (title, industry, description))
    return strip(F.concat(t, F.lit("。"), t, F.lit("。"), i, F.lit("。"), d if prefix is None else F.substring(d, 1, prefix)))


def is_blank_title(title: Column) -> Column:
    return title.isNull() | title.rlike(BLANK_TITLE)
