"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over the text finds anchors: at-signs, plus signs, digits, schemes and
identifier cues.  Deterministic local parsers expand each anchor to the span around it and validate it.
Kinds: email, ip, card and phone by the base rules, and then url_login (user and password of a URL), iban,
account (a number behind a cue such as ``account no``) and secret (the value given to a token, key or password).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused

#: kinds in the order that settles equal starts
KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "account", "secret")
CUES = ("account no", "account number", "account:", "acct", "ssn", "passport", "iban")
SECRET_CUES = ("token", "api_key", "api-key", "api key", "apikey", "access_key", "access-key", "access key", "private_key", "private-key",
               "private key", "secret", "password", "passwd")
SECRET_CHARS, QUOTED_SECRET_CHARS = 12, 8
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_HOST = _ALNUM | frozenset("-")
_SECRET = _ALNUM | frozenset("_-+/=.~")
_PHONE = _DIGITS | frozenset(" ().-")
Span = tuple[int, int]


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


# --- parsers: (text, anchor, end of the last span of the kind) -> (span or None, where to go on) --
def email_at(text: str, at: int, floor: int) -> tuple[Span | None, int]:
    """``at`` is an at-sign: local part to the left, host with at least one dot to the right."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _HOST)
    if start == at or end == at + 1:
        return None, floor
    dots = end
    while dots < len(text) and text[dots] == ".":
        label = _run(text, dots + 1, _HOST)
        if label == dots + 1:
            break
        dots = label
    return ((start, dots), dots) if dots > end else (None, floor)


def ips_in(text: str, at: int) -> tuple[list[Span], int]:
    """``at`` starts a run of digits: groups of four dotted numbers from the left, of which those up to 255 count."""
    bounds = [(at, _run(text, at, _DIGITS))]
    while bounds[-1][1] + 1 < len(text) and text[bounds[-1][1]] == "." and text[bounds[-1][1] + 1] in _DIGITS:
        start = bounds[-1][1] + 1
        bounds.append((start, _run(text, start, _DIGITS)))
    found = []
    for i in range(0, len(bounds) - 3, 4):
        if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in bounds[i:i + 4]):
            found.append((bounds[i][0], bounds[i + 3][1]))
    return found, bounds[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def card_at(text: str, at: int) -> tuple[Span | None, int]:
    """``at`` starts digits joined by single spaces or hyphens: 14 to 19 of them that pass Luhn."""
    n, end = len(text), at + 1
    digits = [text[at]]
    while end < n:
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    good = 14 <= len(digits) <= 19 and luhn("".join(digits))
    return ((at, end) if good else None), end


def phone_at(text: str, at: int) -> tuple[Span | None, int]:
    """``at`` is a plus sign before a digit: 10 to 15 digits with blanks, brackets, dots and hyphens."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None, at + 1
    end = _run(text, at + 2, _PHONE)
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return None, at + 1
    return ((at, end) if 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15 else None), end


def login_at(text: str, at: int) -> Span | None:
    """``at`` is a ``://``: ``user:password`` up to an at-sign of the same authority."""
    end = at + 3
    while end < len(text) and text[end] not in "/?#@ \t\r\n\"'<>":
        end += 1
    return (at + 3, end) if end < len(text) and text[end] == "@" and ":" in text[at + 3:end] and end > at + 3 else None


def iban_at(text: str, at: int) -> Span | None:
    """Country, check digits and 11 to 30 letters or digits with single blanks; remainder 1 modulo 97."""
    chars, end, last = [], at, at
    while end < len(text) and len(chars) < 34:
        if text[end] in _ALNUM and not text[end].islower():
            chars.append(text[end])
            end = last = end + 1
        elif text[end] == " " and chars and end + 1 < len(text) and text[end + 1] in _ALNUM:
            end += 1
        else:
            break
    code = "".join(chars)
    if len(code) < 15 or not (code[:2].isalpha() and code[2:4].isdigit()):
        return None
    number = int("".join(str(int(c, 36)) for c in code[4:] + code[:4]))
    return (at, last) if number % 97 == 1 else None


def account_after(text: str, end: int) -> Span | None:
    """Behind a cue: up to four separators, then 6 to 20 digits or hyphens that start and end with a digit."""
    at = end
    while at < len(text) and at < end + 4 and text[at] in " :#.=":
        at += 1
    if at == end or at >= len(text) or text[at] not in _DIGITS:
        return None
    stop = _run(text, at, _DIGITS | frozenset("-"))
    while text[stop - 1] == "-":
        stop -= 1
    follows = stop < len(text) and text[stop] in _ALNUM
    return (at, stop) if 6 <= stop - at <= 20 and not follows else None


def secret_after(text: str, end: int) -> Span | None:
    """Behind a cue: the rest of a name, quotes and blanks around ``=`` or ``:``, then a value of enough characters.

    An unquoted value holds a digit, so that ``password: something`` in prose is none; a quoted one ends at its quote.
    """
    at = _run(text, end, _ALNUM | frozenset("_-"))
    if at > end + 24:
        return None
    at = _run(text, at, frozenset(" \"'"))
    if at >= len(text) or text[at] not in "=:":
        return None
    at = _run(text, at + 1, frozenset(" >"))
    quote = text[at] if at < len(text) and text[at] in "\"'" else ""
    at += len(quote)
    stop = _run(text, at, _SECRET)
    while stop > at and text[stop - 1] == ".":
        stop -= 1
    value = text[at:stop]
    if quote:
        return (at, stop) if len(value) >= QUOTED_SECRET_CHARS and text[stop:stop + 1] == quote else None
    return (at, stop) if len(value) >= SECRET_CHARS and any(c in _DIGITS for c in value) else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ["@", "+", "://", *sorted(_DIGITS), *CUES, *SECRET_CUES]:
        found.add_word(word, word)
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """A-Z made a-z and nothing else, so that offsets stay; ``bytes.lower`` changes A-Z only."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then kind.  Extra kinds never overlap each other."""
    spans: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = phone_end = extra_end = 0
    for last, word in anchors.iter(folded(text)):
        if word in _DIGITS:
            if last >= card_end:
                span, card_end = card_at(text, last)
                if span:
                    spans.append((*span, "card"))
            if last >= ip_end:
                found, ip_end = ips_in(text, last)
                spans += [(*s, "ip") for s in found]
        elif word == "@":
            if last >= email_end:
                span, email_end = email_at(text, last, email_end)
                if span:
                    spans.append((*span, "email"))
        elif word == "+":
            if last >= phone_end:
                span, phone_end = phone_at(text, last)
                if span:
                    spans.append((*span, "phone"))
        else:
            if word == "://":
                kind, span = "url_login", login_at(text, last - 2)
            elif word == "iban":
                at = last + 1
                while at < len(text) and at < last + 5 and text[at] in " :#":
                    at += 1
                kind, span = "iban", iban_at(text, at)
            elif word in SECRET_CUES:
                kind, span = "secret", secret_after(text, last + 1)
            else:
                kind, span = "account", account_after(text, last + 1)
            if span and span[0] >= extra_end:
                extra_end = span[1]
                spans.append((*span, kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch of overlapping spans becomes the name of its first kind in angle brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join(out) + text[at:] if out else text


def _over_texts(docs: DataFrame, keys: list[str], text: str, schema: str, names: list[str], kinds: list[pa.DataType],
                row: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            made = [row(t.as_py(), anchors) for t in batch.column(len(keys))]
            columns = zip(*made) if made else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keys)], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keys, *names])

    types = dict(docs.dtypes)
    return docs.select(*keys, F.col(text).cast("string").alias(unused(keys, "_text")[0])).mapInArrow(
        run, ", ".join([f"`{k}` {types[k]}" for k in keys] + [schema]))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``key``, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Offsets are code points, end exclusive.  A null or empty text has no spans.  Keys may be null or repeat; an
    empty table gives no rows.
    """
    base = KINDS[:4]

    def row(text: str | None, anchors: ahocorasick.Automaton) -> tuple:
        spans = find_spans(text or "", anchors)
        own = [s for s in spans if s[2] in base]
        counts = [sum(s[2] == k for s in own) for k in base]
        return (*counts, hashlib.sha256(shown(own).encode()).hexdigest(), shown(spans))

    names = [*(f"n_{k}" for k in base), "base_sha256", "spans"]
    return _over_texts(docs, [key], text, ", ".join(f"n_{k} bigint" for k in base) + ", base_sha256 string, spans string",
                       names, [pa.int64()] * 4 + [pa.string()] * 2, row)


def redact_documents(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``<KIND>`` and ``length`` counted again where a text changed.

    Every row stays, repeated rows too; a null or empty text and one without personal data are left as they are.  Other
    columns may have any name.  An empty table gives no rows.
    """
    def row(text: str | None, anchors: ahocorasick.Automaton) -> tuple:
        spans = find_spans(text, anchors) if text else []
        return (redact(text, spans) if spans else text, bool(spans))

    others = [c for c in docs.columns if c != text]
    new, changed = unused(docs.columns, "_new", "_changed")
    held = docs.select(*others, text)
    done = _over_texts(held, others, text, f"`{new}` string, `{changed}` boolean", [new, changed], [pa.string(), pa.bool_()], row)
    kind = dict(docs.dtypes).get(length)
    return done.select(*[
        F.col(new).alias(text) if c == text else
        F.when(F.col(changed), F.char_length(new).cast(kind)).otherwise(F.col(length)).alias(length) if c == length else F.col(c)
        for c in docs.columns])
