"""Chat formatting with a compiled template.

A template is text with ``{{ expression }}``, ``{% for x in e %}``, ``{% if e %}`` /
``{% elif e %}`` / ``{% else %}``, ``{% set x = e %}`` and ``{% generation %}``, closed by
``{% end... %}``. It is parsed into a tree, constants are folded, and the tree becomes Python
closures that yield (text, under the loss mask) piece by piece. Expressions know literals,
names, fields of mappings, comparison, ``and or not``, ``+`` and the listed filters: no
Python attribute or call can be reached.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for message in messages %}{{ '<|im_start|>' + (message.role | line) + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash goes between, one more where there are some already."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """As ``escape``, and on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "+": lambda a, b: a + b, "in": lambda a, b: a in b,
}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(\w+)(.*?)-?%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(\d+)|(\w+)|(==|!=|[<>+|().\[\]]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...), folded as built."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unknown character in expression: {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at = 0

    def parse(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]}")
        return node

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            _, _, word, sign = self.tokens[self.at]
            if (word or sign) in wanted:
                self.at += 1
                return word or sign
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        word = self.tokens[self.at][2] if self.at < len(self.tokens) else None
        if not word:
            raise TemplateError("name expected")
        self.at += 1
        return word

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = fold(("or", node, self.both()))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = fold(("and", node, self.negated()))
        return node

    def negated(self) -> tuple:
        return fold(("not", self.negated())) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while sign := self.take("==", "!=", "<", ">", "in"):
            node = fold(("binary", sign, node, self.added()))
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = fold(("binary", "+", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.primary()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name}")
                node = fold(("filter", name, node))
            elif self.take("."):
                node = ("field", node, self.name())
            elif self.take("["):
                node = fold(("item", node, self.either()))
                self.need("]")
            else:
                return node

    def primary(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        text, number, word, sign = self.tokens[self.at]
        self.at += 1
        if text:
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if number:
            return ("const", int(number))
        if word in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[word])
        if word:
            return ("name", word)
        raise TemplateError(f"unexpected {sign!r}")


def fold(node: tuple) -> tuple:
    """An operation on constants becomes its value."""
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    if parts and all(x[0] == "const" for x in parts):
        return ("const", value_of(node)({}))
    return node


def value_of(node: tuple) -> Callable[[dict], Any]:
    """The closure that evaluates an expression in a scope."""
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope[n]
    if kind == "filter":
        return lambda scope, f=FILTERS[node[1]], v=value_of(node[2]): f(v(scope))
    if kind == "binary":
        return lambda scope, f=_BINARY[node[1]], a=value_of(node[2]), b=value_of(node[3]): f(a(scope), b(scope))
    if kind == "not":
        return lambda scope, v=value_of(node[1]): not v(scope)
    a = value_of(node[1])
    if kind == "field":
        return lambda scope, n=node[2]: _entry(a(scope), n)
    b = value_of(node[2])
    if kind == "item":
        return lambda scope: _entry(a(scope), b(scope))
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


def _entry(holder: Any, name: Any) -> Any:
    if not isinstance(holder, (dict, list, tuple)):
        raise TemplateError(f"no entry {name!r} can be read here")
    return holder[name]


def parse(source: str) -> list[tuple]:
    """The tree of a template: (text, s), (out, e), (for, x, e, body), (if, [(e, body)]),
    (set, x, e), (generation, body)."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()], ""))
        pieces.append(("out", "", m[1]) if m[2] is None else ("tag", m[2], m[3].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:], ""))
    body, rest = _block(pieces, 0, ())
    if rest < len(pieces):
        raise TemplateError(f"unexpected {pieces[rest][1]}")
    return body


def _block(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    body: list[tuple] = []
    while at < len(pieces):
        kind, word, rest = pieces[at]
        if kind == "tag" and word in ends:
            return _joined(body), at
        at += 1
        if kind == "text":
            body.append(("text", word))
        elif kind == "out":
            node = _Expression(rest).parse()
            body.append(("text", str(node[1])) if node[0] == "const" else ("out", node))
        elif word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"for {rest}")
            inner, at = _block(pieces, at, ("endfor",))
            body.append(("for", m[1], _Expression(m[2]).parse(), inner))
            at += 1
        elif word == "generation":
            inner, at = _block(pieces, at, ("endgeneration",))
            body.append(("generation", inner))
            at += 1
        elif word == "set":
            name, _, value = rest.partition("=")
            body.append(("set", name.strip(), _Expression(value).parse()))
        elif word == "if":
            arms, test = [], _Expression(rest).parse()
            while True:
                inner, at = _block(pieces, at, ("elif", "else", "endif"))
                if test != ("const", False):
                    arms.append((test, inner))
                _, word, rest = pieces[at]
                at += 1
                if word == "endif":
                    break
                test = ("const", True) if word == "else" else _Expression(rest).parse()
            # What stands behind a constant truth is never reached.
            for i, (t, inner) in enumerate(arms):
                if t[0] == "const" and t[1]:
                    arms = arms[: i + 1]
                    break
            if arms and arms[0][0][0] == "const":
                body.extend(arms[0][1])
            elif arms:
                body.append(("if", arms))
        else:
            raise TemplateError(f"unknown tag {word}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return _joined(body), at


def _joined(body: list[tuple]) -> list[tuple]:
    """Neighbouring texts become one."""
    out: list[tuple] = []
    for is_text, group in groupby(body, lambda n: n[0] == "text"):
        out += [("text", "".join(n[1] for n in group))] if is_text else list(group)
    return out


Piece = tuple[str, bool]


def compile_block(body: list[tuple]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_step(node) for node in body]

    def run(scope: dict, masked: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, masked)

    return run


def _step(node: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda scope, masked, t=node[1]: iter(((t, masked),))
    if kind == "out":
        value = value_of(node[1])
        return lambda scope, masked: iter(((str(value(scope)), masked),))
    if kind == "generation":
        inner = compile_block(node[1])
        return lambda scope, masked: inner(scope, True)
    if kind == "set":
        name, value = node[1], value_of(node[2])

        def assign(scope: dict, masked: bool) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "for":
        name, value, inner = node[1], value_of(node[2]), compile_block(node[3])

        def loop(scope: dict, masked: bool) -> Iterator[Piece]:
            for x in value(scope):
                scope[name] = x
                yield from inner(scope, masked)

        return loop
    arms = [(value_of(t), compile_block(b)) for t, b in node[1]]

    def choose(scope: dict, masked: bool) -> Iterator[Piece]:
        for test, inner in arms:
            if test(scope):
                yield from inner(scope, masked)
                return

    return choose


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    run = compile_block(parse(source))
    return lambda scope: run(dict(scope), False)


class Reader:
    """Reads turns and the text under the loss mask back from formatted output, as it comes."""

    def __init__(self):
        self.buffer, self.spans, self.done = "", [], 0
        self.turns, self.loss, self.n_turns, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0

    def feed(self, text: str, masked: bool) -> None:
        if masked and text:
            self.spans.append((len(self.buffer), len(self.buffer) + len(text)))
        self.buffer += text
        self.done += len(text)
        if not masked and (end := self.buffer.find("<|im_end|>\n")) >= 0:
            self._turn(end)

    def _turn(self, end: int) -> None:
        head, body = self.buffer[:end].split("\n", 1)
        if not head.startswith("<|im_start|>"):
            raise ValueError("a turn does not begin with its mark")
        role, text = unescape_line(head[len("<|im_start|>") :]), unescape(body)
        self.turns.update(f"{role}\n{text}\n".encode())
        for a, b in self.spans:
            span = unescape(self.buffer[a:b])
            self.loss.update(span.encode())
            self.loss_chars += len(span)
        self.n_turns += 1
        self.buffer, self.spans = self.buffer[end + len("<|im_end|>\n") :], []


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FORMATTED = "formatted string, spans array<struct<start:bigint,end:bigint>>"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
KEY_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
#: Rows and characters after which a batch goes out.
BATCH_ROWS, BATCH_CHARS = 1000, 1 << 20


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by number and by the length of the column at ``chars``."""
    done, held = [], 0
    for row in rows:
        done.append(dict(zip(schema.names, row, strict=True)))
        held += 0 if chars is None else len(row[chars])
        if len(done) == BATCH_ROWS or held >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done, held = [], 0
    yield pa.RecordBatch.from_pylist(done, schema=schema)


def render_turns(messages: Iterator[dict], render: Callable[[dict], Iterator[Piece]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(formatted text, spans under the loss mask) per message, as the messages come. What a
    template puts before the first message or after the last one is part of that turn's text."""
    ready: list[tuple[str, list[tuple[int, int]]]] = []
    parts, spans, length = [], [], 0

    def cut() -> None:
        nonlocal parts, spans, length
        ready.append(("".join(parts), spans))
        parts, spans, length = [], [], 0

    def given() -> Iterator[dict]:
        for i, message in enumerate(messages):
            if i:
                cut()
            yield message

    for piece, masked in render({"messages": given()}):
        yield from ready
        ready.clear()
        if masked and piece:
            spans.append((length, length + len(piece)))
        parts.append(piece)
        length += len(piece)
    cut()
    yield from ready


def format_turns(rows: DataFrame, template: str = CHATML, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(key, turn_no, formatted, spans): the formatted conversations, one row per turn; in
    order of ``turn_no`` (from 0) the texts of a conversation make up its whole text. A span
    (start, end) under the loss mask counts characters of its row's text.

    Rows are dealt by key and sorted by turn (then role and text, so ties have one order;
    nulls first). A conversation is rendered turn by turn as its rows stream by: one of any
    length takes the memory of one turn and one batch. Null roles and texts are empty; rows
    without a key form one conversation; repeated rows are turns of their own; an empty
    table gives no rows; other columns are left out.
    """
    empty = F.lit("")
    turns = rows.select(
        F.col(key).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    kind = turns.schema["_conv"].dataType.simpleString()
    schema = pa.schema([("_conv", KEY_TYPES[kind]), ("turn_no", pa.int64()), ("formatted", pa.string()), ("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)

        def formatted() -> Iterator[tuple]:
            for conv, group in groupby(_rows(batches, "_conv", "role", "text"), lambda t: t[0]):
                for no, (text, spans) in enumerate(render_turns(({"role": r, "text": t} for _, r, t in group), render)):
                    yield conv, no, text, [{"start": a, "end": b} for a, b in spans]

        yield from _batches(formatted(), schema, chars=2)

    dealt = turns.repartition("_conv").sortWithinPartitions("_conv", "_turn", "role", "text").select("_conv", "role", "text")
    return dealt.mapInArrow(run, f"_conv {kind}, turn_no long, {FORMATTED}").withColumnRenamed("_conv", key)


def read_back(formatted: DataFrame, key: str = "conv_id", dealt: bool = False) -> DataFrame:
    """(key, digest of the turns and the loss read from its text and spans) per conversation
    of ``format_turns``. ``dealt`` says that rows still lie as that operator left them; rows
    of a stored table are dealt and sorted again."""
    rows = formatted.withColumnRenamed(key, "_conv").select("_conv", "turn_no", "formatted", "spans")
    kind = rows.schema["_conv"].dataType.simpleString()
    schema = pa.schema(
        [("_conv", KEY_TYPES[kind]), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv, group in groupby(_rows(batches, "_conv", "formatted", "spans"), lambda t: t[0]):
                reader = Reader()
                for _, text, spans in group:
                    at = 0
                    for span in spans:
                        reader.feed(text[at : span["start"]], False)
                        reader.feed(text[span["start"] : span["end"]], True)
                        at = span["end"]
                    reader.feed(text[at:], False)
                yield conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.done

        yield from _batches(digests(), schema)

    if not dealt:
        rows = rows.repartition("_conv").sortWithinPartitions("_conv", "turn_no")
    return rows.mapInArrow(run, f"_conv {kind}, {DIGESTS}").withColumnRenamed("_conv", key)


def format_conversations(rows: DataFrame, template: str = CHATML, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(key, digest of what is read back from the formatted conversation) per conversation;
    see ``format_turns`` for the formatted rows themselves and for what becomes of odd rows."""
    return read_back(format_turns(rows, template, key, turn), key, dealt=True)


def render_conversation(messages: list[dict], template: str = CHATML) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask) of one conversation."""
    text, spans = "", []
    for piece, masked in compile_template(template)({"messages": messages}):
        if masked and piece:
            spans.append((len(text), len(text) + len(piece)))
        text += piece
    return text, spans
