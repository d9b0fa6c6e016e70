"""Main text of web pages by two passes of block rules.

The page is cut into blocks of text.  The first pass decides each block from its place (navigation, forms,
adverts, comments and the like are out; an article is in), its link density, its length and its share of stop
words.  Blocks too short to tell stay open; in the second pass they take the label of the nearest decided block
of the same region, the good one when both are as near.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_CHARS, KNOWN_SHARE = 120, 0.05
SHORT_CHARS, LINK_SHARE, ARTICLE_LINK_SHARE, STOP_SHARE = 60, 0.4, 0.8, 0.2

#: fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their them they this to was "
    "we were which who will with you your "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht "
    "noch oder sein sich sie sind über um und von vor war wie wird zu zum zur "
    "à au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se "
    "ses son sont sur un une vous "
    "al como con del el ella en entre es esta este fue ha la las lo los más me muy no o para pero por que se si sin sobre su sus también un "
    "una y ya").split())

_BREAK = r"</?(?:p|div|h[1-6]|article|section|main|body|ul|ol|li|table|header|footer|nav|aside|form)\b"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    # an unclosed one of these ends at the next block
    rf"|<(?P<part>title|select|button)\b[^>]*>(?:(?!{_BREAK}).)*?(?:</(?P=part)\s*>|(?={_BREAK})|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul").split())
_TRACKED = _BLOCK - frozenset(("p", "hr", "li", "dt", "dd", "tr", "td", "th", "option", "html", "body"))
_OUT = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"))
_IN = frozenset(("article", "main"))
#: fixed values: words of classes and ids that name what is no article
_HINT = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|"
    r"disqus|respond|repl(?:y|ies)|sidebar|widget|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|"
    r"social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|pagination|pager|toolbar|copyright|disclaimer|hidden", re.I)
#: fixed values: first parts of names that tell how a page looks, as in ``with-sidebar``
_STATES = frozenset("has with no not without is hide show fixed sticky enable enabled disable disabled".split())
_PARTS = re.compile(r"[_-]+")
_HINTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


def hinted(value: str) -> bool:
    """Whether a class, id or role names a place that is no article: ``sidebar``, ``sidebar-left``, ``site-footer``, but not
    ``has-sidebar``."""
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p]
        if parts and (_HINT.fullmatch(parts[0]) or "".join(parts[:2]).lower() == "sidebar" or
                      (_HINT.fullmatch(parts[-1]) and parts[0].lower() not in _STATES)):
            return True
    return False


@dataclass
class Block:
    text: str
    link_chars: int
    region: int             # 0: outside any article, else the number of the article
    out: bool               # in navigation, a form, an advert, ...
    good: bool | None = None


def blocks(page: str, hints: bool = True) -> list[Block]:
    """The blocks of text of a page in order, white space made one blank, references decoded.  Without ``hints``, classes
    and ids tell nothing."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[tuple[str, bool]] = []
    at, links, breaks, regions = 0, 0, 0, 0

    def take(raw: str) -> None:
        nonlocal breaks
        if raw:
            if not raw.isspace():
                breaks = 0
            parts.append((raw, links > 0))

    def end() -> None:
        nonlocal breaks
        breaks = 0
        if parts:
            raw = "".join(p for p, _ in parts)
            linked = "".join(p for p, inside in parts if inside)
            parts.clear()
            text = _SPACE.sub(" ", entities.unescape(raw)).strip()
            if text:
                _, out, region = stack[-1] if stack else ("", False, 0)
                found.append(Block(text, len(_SPACE.sub(" ", linked).strip()), region, out))

    for m in _TOKEN.finditer(page):
        take(page[at:m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"] or m["close2"])
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name == "br":
            breaks += 1
            parts.append((" ", links > 0))
            if breaks > 1:
                end()
        elif name in _BLOCK or name == "span":
            attrs = m["attrs"] or m["attrs2"] or ""
            if name in _BLOCK:
                end()
                links = 0
            else:
                continue
            if name not in _TRACKED:
                continue
            if closing:
                if any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
            elif not attrs.rstrip().endswith("/"):
                _, out, region = stack[-1] if stack else ("", False, 0)
                if name in _IN and not region:
                    regions += 1
                    region = regions
                named = hints and bool(attrs) and any(hinted(a or b or c) for a, b, c in _HINTED.findall(attrs)) or "hidden" in attrs.lower().split()
                inner_heading = name == "header" and region > 0
                stack.append((name, out or named or (name in _OUT and not inner_heading), region))
    take(page[at:])
    end()
    return found


def _stop_share(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def decide(found: list[Block]) -> list[Block]:
    """Both passes; returns the good blocks.

    Where hardly a word of the page is a known stop word the language is unknown, and length and links decide alone.
    Short blocks of a region without a decided block are judged by what they hold together.
    """
    plain = [b for b in found if not b.out and not b.region]
    known = bool(plain) and _stop_share(" ".join(b.text for b in plain)) >= KNOWN_SHARE
    for b in found:
        linked = b.link_chars / len(b.text)
        if b.out or linked > (ARTICLE_LINK_SHARE if b.region else LINK_SHARE):
            b.good = False
        elif len(b.text) < SHORT_CHARS:
            b.good = None
        else:
            b.good = bool(b.region) or not known or _stop_share(b.text) >= STOP_SHARE
    article = any(b.region and not b.out for b in found)
    before: dict[int, tuple[int, bool]] = {}
    earlier: list[tuple[int, bool] | None] = []
    for i, b in enumerate(found):
        earlier.append(before.get(b.region))
        if b.good is not None and not b.out:
            before[b.region] = (i, b.good)
    lists = _joined_lists(found, before, known)
    after: dict[int, tuple[int, bool]] = {}
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.good is None:
            left, right = earlier[i], after.get(b.region)
            sides = [(abs(i - s[0]), not s[1]) for s in (left, right) if s]
            b.good = not min(sides)[1] if sides else b.region > 0 or i in lists
        elif not b.out:
            after[b.region] = (i, b.good)
    return [b for b in found if b.good and (b.region > 0 or not article)]


def _joined_lists(found: list[Block], decided: dict[int, tuple[int, bool]], known: bool) -> set[int]:
    """Places of the runs of open blocks, in regions without a decided one, that are long enough together."""
    out: set[int] = set()
    run: list[int] = []
    for i, b in enumerate([*found, None]):
        if b is not None and b.good is None and b.region not in decided:
            run.append(i)
            continue
        text = " ".join(found[j].text for j in run)
        if len(text) >= LIST_CHARS and (not known or _stop_share(text) >= STOP_SHARE / 2):
            out.update(run)
        run = []
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    good = decide(found)
    if not good and any(b.region for b in found):             # every article stands inside a place named like a sidebar
        good = decide(blocks(page, hints=False))
    return "\n\n".join(b.text for b in good)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, text and n_chars.

    If a page has an article, only its blocks count.  Null and empty pages have an empty text.  Broken markup is
    read as far as it goes.  Keys may repeat or be null, equal pages give equal rows; an open block as near to a good as to a bad
    neighbour is good; an empty table gives no rows; other columns are ignored.
    """
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"])

    return pages.select(key, url, F.col(html).cast("string").alias("_html")).mapInArrow(
        run, f"`{key}` {types[key]}, `{url}` {types[url]}, text string, n_chars bigint")
