"""Type coercions that never raise: text, timestamps, booleans, numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# --- fixed values: accepted timestamp spellings, tried in this order --------------------------
TIMESTAMP_FORMATS = (
    "yyyy-M-d H:mm:ss", "yyyy/M/d H:mm:ss", "yyyy-M-d'T'H:mm:ss", "yyyy-M-d'T'H:mm:ssXXX", "yyyy-M-d'T'H:mm:ss.SSS",
    "yyyy-M-d'T'H:mm:ss.SSSSSS", "yyyy-M-d H:mm:ss.SSSSSS", "yyyy-M-d H:mm", "yyyy/M/d H:mm", "yyyy-M-d", "yyyy/M/d",
    "yyyyMMdd", "yyyyMMddHHmmss",
)
_ISO = (r"\A(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T ](\d{1,2}):(\d{2})(:\d{2})?(\.\d{1,9})?\s?(Z|[+-]\d{2}(?::?\d{2})?)?()\z")
_FIELD = re.compile(r"'([^']*)'|([a-zA-Z])\2*|(.)")


def _shape(pattern: str) -> str:
    """Regex of the texts a timestamp pattern can parse, to reject the rest without a parse error."""
    out = []
    for m in _FIELD.finditer(pattern):
        quoted, letter, other = m.groups()
        width = len(m.group(0))
        if letter == "X":
            out.append(r"(Z|[+-]\d{2}:\d{2})")
        elif letter:
            out.append(r"\d{1,2}" if width == 1 else rf"\d{{{width}}}")
        else:
            out.append(re.escape(quoted if quoted is not None else other))
    return r"\A" + "".join(out) + r"\z"


def text_or_blank(value: Column) -> Column:
    """Stringify; null and the literal words ``None`` and ``nan`` become empty; then trim."""
    s = value.cast("string")
    return strip(F.when(s.isNull() | s.isin("None", "nan"), F.lit("")).otherwise(s))


def to_timestamp(value: Column, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """The listed spellings, then any ISO-like one: ``-`` or ``/``, ``T`` or a blank, a fraction of 1 to 9 digits and a
    zone as ``Z``, ``+08:00``, ``+0800`` or ``+08``, each optional.  Anything else is null."""
    listed = [F.when(value.rlike(_shape(f)), F.try_to_timestamp(value, F.lit(f))) for f in formats]
    plain = F.regexp_replace(value, _ISO, "$1-$2-$3 $4:$5:00$6$7$8$9")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(:\d{2}):00(:\d{2})", "$1$2"), r"([+-]\d{2})(\d{2})\z", "$1:$2")
    plain = F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?[+-]\d{2})\z", "$1:00")
    return F.coalesce(*listed, F.when(value.rlike(_ISO), plain.try_cast("timestamp")))


def to_boolean(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def finite_or_null(value: Column) -> Column:
    """NaN and the infinities become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)
