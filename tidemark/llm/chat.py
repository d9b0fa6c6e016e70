"""Chat formatting by a compiled template.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures.  The
language is a sandbox: texts, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}``/``{% elif %}``/``{% else %}``,
``{% set x = expression %}`` and ``{% generation %}``.  Expressions have literals, names, fields of mappings,
``+``, ``==``, ``!=``, ``and``, ``or``, ``not``, parentheses and the filters below.  Nothing else can be reached: no
attributes of objects, no calls, no imports, no indexes.

Rendering is a generator of (text, generated) chunks over an iterator of messages, so a conversation of any
length is rendered one turn at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}<turn {{ m.role | escape }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}")

_CODES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "#": "\\h"}
_DECODE = {v: k for k, v in _CODES.items()}


def escape(text: str) -> str:
    """Reversible: no ``<``, ``>`` or ``#`` is left, so no control string can occur in a text."""
    return re.sub(r"[\\<>#]", lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lgh]", lambda m: _DECODE[m[0]], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template does not follow the grammar, or a name is not there."""


_LEX = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+.|()=]))")
_KEYWORDS = {"and", "or", "not", "in", "true", "false", "none"}
_CONSTANTS = {"true": True, "false": False, "none": None}


# --- parsing: nodes are tuples whose first item is the kind ------------------------------------
def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if m is None:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over the tokens of one tag."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!="), ("+",))

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def whole(self) -> tuple:
        node = self.level(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[n] == ("not",):
            if self.peek() == "not":
                self.at += 1
                return ("not", self.level(n))
            return self.level(n + 1)
        left = self.level(n + 1)
        while self.peek() in self.LEVELS[n]:
            op = self.tokens[self.at][1]
            self.at += 1
            left = (op, left, self.level(n + 1))
        return left

    def filtered(self) -> tuple:
        node = self.primary()
        while self.peek() in (".", "|"):
            op = self.tokens[self.at][1]
            self.at += 1
            if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                raise TemplateError(f"a name must follow {op!r}")
            name = self.tokens[self.at][1]
            self.at += 1
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if name.startswith("_"):
                raise TemplateError(f"{name!r} is not allowed")
            node = ("filter" if op == "|" else "field", node, name)
        return node

    def primary(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return ("const", int(value))
        if value == "(":
            node = self.level(0)
            if self.peek() != ")":
                raise TemplateError("a parenthesis is not closed")
            self.at += 1
            return node
        if kind == "name" and value in _CONSTANTS:
            return ("const", _CONSTANTS[value])
        if kind == "name" and value not in _KEYWORDS and not value.startswith("_"):
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The syntax tree: ("block", [nodes])."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    stack: list[tuple[str, Any, list]] = [("root", None, [])]

    def close(*kinds: str) -> tuple[str, Any, list]:
        if stack[-1][0] not in kinds:
            raise TemplateError(f"{kinds[0]} is closed but not open")
        return stack.pop()

    def close_if(tail: list | None) -> None:
        kind, test, body = close("if", "else")
        if kind == "else":
            tail, (_, test, body) = body, close("if")
        chain = test
        node = ("if", chain["test"], ("block", body), ("block", tail or []))
        stack[-1][2].append(node)
        if chain["nested"]:
            close_if_nested()

    def close_if_nested() -> None:
        _, test, body = close("else")
        _, outer, first = close("if")
        stack[-1][2].append(("if", outer["test"], ("block", first), ("block", body)))
        if outer["nested"]:
            close_if_nested()

    for part in parts:
        if part.startswith("{{") and part.endswith("}}"):
            stack[-1][2].append(("emit", _Expression(_lex(part[2:-2])).whole()))
        elif part.startswith("{%") and part.endswith("%}"):
            tokens = _lex(part[2:-2])
            if not tokens:
                raise TemplateError("an empty tag")
            word, rest = tokens[0][1], tokens[1:]
            if word == "for":
                if len(rest) < 3 or rest[0][0] != "name" or rest[1][1] != "in":
                    raise TemplateError("for needs: name in expression")
                stack.append(("for", (rest[0][1], _Expression(rest[2:]).whole()), []))
            elif word == "if":
                stack.append(("if", {"test": _Expression(rest).whole(), "nested": False}, []))
            elif word == "elif":
                if stack[-1][0] != "if":
                    raise TemplateError("elif without if")
                stack.append(("else", None, []))
                stack.append(("if", {"test": _Expression(rest).whole(), "nested": True}, []))
            elif word == "else":
                if stack[-1][0] != "if":
                    raise TemplateError("else without if")
                stack.append(("else", None, []))
            elif word == "endif":
                close_if(None)
            elif word == "endfor":
                _, (name, over), body = close("for")
                stack[-1][2].append(("for", name, over, ("block", body)))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                _, _, body = close("generation")
                stack[-1][2].append(("generation", ("block", body)))
            elif word == "set" and len(rest) > 2 and rest[0][0] == "name" and rest[1][1] == "=":
                stack[-1][2].append(("set", rest[0][1], _Expression(rest[2:]).whole()))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        elif part:
            stack[-1][2].append(("text", part))
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return ("block", stack[0][2])


# --- constant folding -------------------------------------------------------------------------
def _apply(op: str, args: list) -> Any:
    if op == "filter":
        return FILTERS[args[1]](_shown(args[0]))
    if op == "not":
        return not args[0]
    if op == "+":
        both_numbers = all(isinstance(a, int) and not isinstance(a, bool) for a in args)
        return args[0] + args[1] if both_numbers else _shown(args[0]) + _shown(args[1])
    return (args[0] == args[1]) == (op == "==")


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: tuple) -> tuple:
    """The same tree with constant parts worked out, dead branches cut and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind == "filter":
        inner = fold(node[1])
        return ("const", _apply("filter", [inner[1], node[2]])) if inner[0] == "const" else ("filter", inner, node[2])
    if kind in ("and", "or"):
        left, right = fold(node[1]), fold(node[2])
        if left[0] == "const":
            return right if bool(left[1]) == (kind == "and") else left
        return (kind, left, right)
    if kind in ("not", "+", "==", "!="):
        args = [fold(a) for a in node[1:]]
        return ("const", _apply(kind, [a[1] for a in args])) if all(a[0] == "const" for a in args) else (kind, *args)
    if kind == "emit":
        inner = fold(node[1])
        return ("text", _shown(inner[1])) if inner[0] == "const" else ("emit", inner)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    flat: list[tuple] = []
    for child in map(fold, node[1]):
        for x in child[1] if child[0] == "block" else [child]:
            if x[0] == "text" and flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + x[1])
            elif x != ("text", ""):
                flat.append(x)
    return ("block", flat)


# --- closures ---------------------------------------------------------------------------------
Scope = dict[str, Any]
Chunks = Iterator[tuple[str, bool]]


def _value(node: tuple) -> Callable[[Scope], Any]:
    kind = node[0]
    if kind == "const":
        return lambda scope: node[1]
    if kind == "name":
        def name(scope: Scope) -> Any:
            if node[1] not in scope:
                raise TemplateError(f"no value for {node[1]!r}")
            return scope[node[1]]
        return name
    if kind == "field":
        inner, key = _value(node[1]), node[2]

        def field(scope: Scope) -> Any:
            holder = inner(scope)
            if not isinstance(holder, dict):
                raise TemplateError(f"{key!r} is not a field of a mapping")
            return holder.get(key)
        return field
    if kind == "filter":
        inner, apply = _value(node[1]), FILTERS[node[2]]
        return lambda scope: apply(_shown(inner(scope)))
    if kind in ("and", "or"):
        left, right = _value(node[1]), _value(node[2])
        return (lambda s: left(s) and right(s)) if kind == "and" else (lambda s: left(s) or right(s))
    parts = [_value(a) for a in node[1:]]
    return lambda scope: _apply(kind, [p(scope) for p in parts])


def _renderer(node: tuple, generated: bool = False) -> Callable[[Scope], Chunks]:
    kind = node[0]
    if kind == "block":
        parts = [_renderer(x, generated) for x in node[1]]

        def block(scope: Scope) -> Chunks:
            for part in parts:
                yield from part(scope)
        return block
    if kind == "text":
        return lambda scope: iter([(node[1], generated)])
    if kind == "emit":
        value = _value(node[1])
        return lambda scope: iter([(_shown(value(scope)), generated)])
    if kind == "generation":
        return _renderer(node[1], True)
    if kind == "set":
        value, name = _value(node[2]), node[1]

        def assign(scope: Scope) -> Chunks:
            scope[name] = value(scope)
            return iter(())
        return assign
    if kind == "if":
        test, yes, no = _value(node[1]), _renderer(node[2], generated), _renderer(node[3], generated)
        return lambda scope: (yes if test(scope) else no)(scope)
    name, over, body = node[1], _value(node[2]), _renderer(node[3], generated)

    def loop(scope: Scope) -> Chunks:
        inner = dict(scope)
        for item in over(scope) or ():
            inner[name] = item
            yield from body(inner)
    return loop


def compile_template(template: str) -> Callable[[Scope], Chunks]:
    """Parse, fold and close over; the result renders a scope to (text, generated) chunks."""
    return _renderer(fold(parse(template)))


# --- reading back -----------------------------------------------------------------------------
def read_turns(chunks: Chunks) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn of output in the default template's format."""
    buffer, masked = "", ""
    for text, generated in chunks:
        buffer += text
        masked += text if generated else ""
        while (end := buffer.find("</turn>\n")) >= 0:
            head, _, body = buffer[:end].partition(">\n")
            if not head.startswith("<turn "):
                raise ValueError("not a turn")
            yield unescape(head[6:]), unescape(body), unescape(masked)
            buffer, masked = buffer[end + 8:], ""
    if buffer:
        raise ValueError("an unfinished turn")


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per conversation: ``conv``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The digests are of the roles and texts read back from the output.  Rows are sorted by turn (null first), then
    role and text, so ties are settled and repeated rows stay.  Null roles and texts are empty; null
    conversations are one.  Rows stream through the renderer: a conversation of any length needs the memory of one
    turn, unless ``keep_text`` adds ``formatted`` and ``loss_spans`` ([start, end) in code points).
    An empty table gives no rows; other columns are ignored.
    """
    kind = dict(turns.dtypes)[conv]
    schema = (f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
              + (", formatted string, loss_spans array<array<bigint>>" if keep_text else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        key_type, rows = None, []

        def read() -> Iterator[tuple]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def emit() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "loss_spans"]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[:len(columns)])

        for key, group in itertools.groupby(read(), key=lambda r: r[0]):
            size, parts, spans = 0, [], []

            def chunks() -> Chunks:
                nonlocal size
                for piece, generated in render({"messages": ({"role": r[1], "text": r[2]} for r in group)}):
                    if keep_text:
                        parts.append(piece)
                        if generated and spans and spans[-1][1] == size:
                            spans[-1][1] += len(piece)
                        elif generated and piece:
                            spans.append([size, size + len(piece)])
                    size += len(piece)
                    yield piece, generated

            n, loss, all_turns, all_loss = 0, 0, hashlib.sha256(), hashlib.sha256()
            for who, said, masked in read_turns(chunks()):
                n, loss = n + 1, loss + len(masked)
                all_turns.update(f"{who}\n{said}\n".encode("utf-8", "surrogatepass"))
                all_loss.update(masked.encode("utf-8", "surrogatepass"))
            rows.append((key, n, all_turns.hexdigest(), loss, all_loss.hexdigest(), size,
                         *(("".join(parts), spans) if keep_text else ())))
            if len(rows) >= (200 if keep_text else 5000):
                yield emit()
        if rows:
            yield emit()

    picked = turns.select(conv, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate((role, text))],
                          F.col(turn).alias("_turn"))
    ordered = picked.repartition(F.col(conv)).sortWithinPartitions(conv, "_turn", "_0", "_1")
    return ordered.select(conv, "_0", "_1").mapInArrow(run, schema)
