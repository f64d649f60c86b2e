"""Chat formatting: a compiler for a small sandboxed template language.

Language: text, ``{{ expression }}``, ``{% for x in messages %} .. {% endfor %}``, ``{% if .. %} .. {% elif .. %} .. {% else %} .. {%
endif %}``, ``{% set x = .. %}`` and ``{% generation %} .. {% endgeneration %}``. Expressions: strings, integers, true, false, none, names,
``a.b``, ``a['b']``, ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``, parentheses and the filters below. Nothing else can be reached:
no calls, no Python attributes; ``a.b`` looks up a key.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Turns of the default template.
START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}<|im_start|>{{ m.role | name }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not in the language."""


def escape(s: str) -> str:
    """No ``<|`` is left: one backslash more stands between ``<`` and ``|`` than in ``s``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def name(s: str) -> str:
    """A role in one line without control strings."""
    return s.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unname(s: str) -> str:
    return s.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": name, "trim": str.strip, "upper": str.upper, "lower": str.lower}

_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
#: A tag ends at its first end outside of strings.
_TAG = re.compile(rf"\{{\{{((?:{_STRING}|.)*?)\}}\}}|\{{%((?:{_STRING}|.)*?)%\}}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.\[\]()|+]))")
#: Nested expressions and blocks.
DEPTH = 250
_CONSTANTS = {"true": True, "false": False, "none": None}
_CODES = {"n": "\n", "t": "\t", "r": "\r"}


# --- syntax tree: tuples whose first item is the kind ---


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((("text", "number", "name", "mark")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def next_is(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too soon")
        k, v = self.tokens[self.at]
        if kind not in (None, k) or value not in (None, v):
            raise TemplateError(f"{v!r} where {value or kind} was expected")
        self.at += 1
        return v

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.next_is("or"):
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.next_is("and"):
            self.take()
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.next_is("not"):
            self.take()
            return ("not", self.negated())
        left = self.joined()
        if self.next_is("==", "!="):
            return (self.take(), left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while self.next_is("+"):
            self.take()
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while self.next_is("|"):
            self.take()
            f = self.take("name")
            if f not in FILTERS:
                raise TemplateError(f"no filter {f!r}")
            left = ("filter", f, left)
        return left

    def atom(self) -> tuple:
        if self.next_is("("):
            self.take()
            tree = self.either()
            self.take("mark", ")")
        else:
            if self.at >= len(self.tokens):
                raise TemplateError("the expression ends too soon")
            kind, v = self.tokens[self.at]
            self.at += 1
            if kind == "text":
                tree = ("constant", re.sub(r"\\(.)", lambda m: _CODES.get(m[1], m[1]), v[1:-1], flags=re.S))
            elif kind == "number":
                tree = ("constant", int(v))
            elif kind == "name":
                tree = ("constant", _CONSTANTS[v]) if v in _CONSTANTS else ("name", v)
            else:
                raise TemplateError(f"unexpected {v!r}")
        while self.next_is(".", "["):
            if self.take() == ".":
                tree = ("item", tree, ("constant", self.take("name")))
            else:
                tree = ("item", tree, self.either())
                self.take("mark", "]")
        return tree


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template; one that is nested more than DEPTH times is refused, as it couldn't be folded or run."""
    try:
        tree = _parse(source)
    except RecursionError:
        raise TemplateError("the template is nested too deeply") from None
    level, depth = list(tree), 0
    while level:
        level, depth = [y for x in level if isinstance(x, (tuple, list)) for y in x], depth + 1
    if depth > DEPTH:
        raise TemplateError("the template is nested too deeply")
    return tree


def _parse(source: str) -> list[tuple]:
    parts, at = [], 0
    for m in _TAG.finditer(source):
        parts += [("text", source[at : m.start()])] if m.start() > at else []
        parts.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", source[at:])] if at < len(source) else []
    tree, rest = _block(parts, 0, ())
    if rest < len(parts):
        raise TemplateError(f"unexpected {parts[rest][1]!r}")
    return tree


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list[tuple], int]:
    out: list[tuple] = []
    while at < len(parts):
        kind, body = parts[at]
        word, _, rest = body.partition(" ") if kind == "tag" else ("", "", "")
        if word in ends:
            return out, at
        at += 1
        if kind == "text":
            out.append(("text", body))
        elif kind == "print":
            out.append(("print", _Expression(body).whole()))
        elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
            inner, at = _block(parts, at, ("endfor",))
            at = _end(parts, at)
            out.append(("for", m[1], _Expression(m[2]).whole(), inner))
        elif word == "if":
            arms, test = [], _Expression(rest).whole()
            while True:
                inner, at = _block(parts, at, ("elif", "else", "endif"))
                arms.append((test, inner))
                end, _, more = parts[_end(parts, at) - 1][1].partition(" ")
                at += 1
                if end == "endif":
                    break
                test = _Expression(more).whole() if end == "elif" else ("constant", True)
            out.append(("if", arms))
        elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)):
            out.append(("set", m[1], _Expression(m[2]).whole()))
        elif word == "generation":
            inner, at = _block(parts, at, ("endgeneration",))
            at = _end(parts, at)
            out.append(("generation", inner))
        else:
            raise TemplateError(f"unexpected {body!r}")
    if ends:
        raise TemplateError(f"{' or '.join(ends)} is missing")
    return out, at


def _end(parts: list, at: int) -> int:
    if at >= len(parts):
        raise TemplateError("a block is not closed")
    return at + 1


# --- constant folding ---


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold(tree: tuple) -> tuple:
    """The expression with every part that has no name replaced by its value."""
    kind = tree[0]
    if kind in ("constant", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2])
        return ("constant", FILTERS[tree[1]](_text(inner[1]))) if inner[0] == "constant" else ("filter", tree[1], inner)
    args = [fold(x) for x in tree[1:]]
    if kind in ("and", "or") and args[0][0] == "constant":
        return args[1] if bool(args[0][1]) == (kind == "and") else args[0]
    if all(a[0] == "constant" for a in args):
        return ("constant", _value((kind, *args))({}))
    return (kind, *args)


def fold_block(block: list[tuple]) -> list[tuple]:
    """Constant prints become text, neighbouring texts merge, and arms that can't be reached go."""
    out: list[tuple] = []
    for node in block:
        kind = node[0]
        if kind == "print":
            tree = fold(node[1])
            new = [("text", _text(tree[1]))] if tree[0] == "constant" else [("print", tree)]
        elif kind == "for":
            new = [("for", node[1], fold(node[2]), fold_block(node[3]))]
        elif kind == "generation":
            new = [("generation", fold_block(node[1]))]
        elif kind == "set":
            new = [("set", node[1], fold(node[2]))]
        elif kind == "if":
            arms = []
            for test, inner in node[1]:
                test = fold(test)
                if test[0] != "constant" or test[1]:
                    arms.append((test, fold_block(inner)))
                if test[0] == "constant" and test[1]:
                    break
            new = arms[0][1] if arms and arms[0][0][0] == "constant" else [("if", arms)] if arms else []
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# --- closures ---


def _value(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "constant":
        return lambda _, v=tree[1]: v
    if kind == "name":
        return lambda scope, n=tree[1]: scope.get(n)
    if kind == "filter":
        return lambda scope, f=FILTERS[tree[1]], x=_value(tree[2]): f(_text(x(scope)))
    args = [_value(x) for x in tree[1:]]
    if kind == "not":
        return lambda scope, x=args[0]: not x(scope)
    a, b = args
    if kind == "item":
        return lambda scope: v.get(b(scope)) if isinstance(v := a(scope), dict) else None
    return {
        "+": lambda scope: x + y if isinstance(x := a(scope), int) and isinstance(y := b(scope), int) else _text(x) + _text(b(scope)),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
    }[kind]


Pieces = Iterator[tuple[str, bool]]


def _emit(block: list[tuple], marked: bool) -> Callable[[dict], Pieces]:
    steps = [_node(x, marked) for x in block]

    def run(scope: dict) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _node(node: tuple, marked: bool) -> Callable[[dict], Pieces]:
    kind = node[0]
    if kind == "text":
        return lambda _, piece=(node[1], marked): iter((piece,))
    if kind == "print":
        return lambda scope, x=_value(node[1]): iter(((_text(x(scope)), marked),))
    if kind == "generation":
        inner = _emit(node[1], True)

        def generation(scope: dict) -> Pieces:
            yield "", True  # a span begins, even if it stays empty
            yield from inner(scope)

        return generation
    if kind == "set":

        def assign(scope: dict, n=node[1], x=_value(node[2])) -> Pieces:
            scope[n] = x(scope)
            return iter(())

        return assign
    if kind == "if":
        arms = [(_value(test), _emit(inner, marked)) for test, inner in node[1]]

        def choose(scope: dict) -> Pieces:
            return next((inner(scope) for test, inner in arms if test(scope)), iter(()))

        return choose
    body, items = _emit(node[3], marked), _value(node[2])

    def loop(scope: dict, n=node[1]) -> Pieces:
        rows, none = iter(items(scope) or ()), object()
        row, i = next(rows, none), 0
        while row is not none:
            ahead = next(rows, none)  # loop.last needs one row ahead, never the whole conversation
            yield from body(scope | {n: row, "loop": {"first": i == 0, "last": ahead is none, "index": i + 1, "index0": i}})
            row, i = ahead, i + 1

    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Pieces]:
    """A function from messages (dicts with role and text, read one by one) to pieces of output and whether each is under the loss mask."""
    run = _emit(fold_block(parse(source)), False)
    return lambda messages: run({"messages": messages})


# --- reading back ---


class Reader:
    """Reads turns back from formatted output, in pieces of any size."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.digest = "", 0, 0, hashlib.sha256()

    def feed(self, s: str) -> None:
        self.chars += len(s)
        self.rest += s
        while (end := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1 :]
            if not turn.startswith(START):
                raise ValueError("output doesn't begin with a turn")
            role, _, body = turn[len(START) :].partition("\n")
            self.digest.update(f"{unname(role)}\n{unescape(body)}\n".encode())
            self.turns += 1

    def close(self) -> None:
        if self.rest:
            raise ValueError("output after the last turn")


# --- operators ---

PARTS = "conv_id long, part long, text string, loss array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, template: str = CHATML) -> DataFrame:
    """Formatted conversations in parts, one or more for each turn: conv_id, part, text, loss (spans under the mask, in code points of
    the part). The parts of a conversation, in order, are its formatted text; they stand together and in order in one partition.

    ``rows``: conv_id, turn, role, text. Null texts and roles are empty; a null turn comes first; turns that tie are ordered by role, then
    text; rows that repeat are turns of their own; null ids make one conversation. Other columns are not read. Rows stream through
    the template one by one, so a conversation of any length takes little memory.
    """
    prepare(rows.sparkSession)
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = whole.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        source = ((c, r, t) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        row, out, size = next(source, None), [], 0
        while row is not None:
            conv, taken = row[0], 0

            def messages() -> Iterator[dict]:
                nonlocal row, taken
                while row is not None and row[0] == conv:
                    message = {"role": row[1], "text": row[2]}
                    row, taken = next(source, None), taken + 1
                    yield message

            part, at, said, spans, before = 0, -1, [], [], False
            length = 0
            for piece, marked in render(messages()):
                if taken != at and said and not (marked and before):
                    out.append((conv, part, "".join(said), spans))
                    size += length
                    part, said, spans, length = part + 1, [], [], 0
                at = taken
                if marked and piece == "":
                    spans.append((length, length))
                elif marked:
                    spans[-1] = (spans[-1][0], length + len(piece))
                said.append(piece)
                length, before = length + len(piece), marked
                if size > 4 << 20:
                    yield _parts(out)
                    out, size = [], 0
            out.append((conv, part, "".join(said), spans))
            size += length
            while row is not None and row[0] == conv:  # a template that leaves messages unread
                row = next(source, None)
        if out:
            yield _parts(out)

    return ordered.mapInArrow(run, PARTS)


def _parts(out: list[tuple]) -> pa.RecordBatch:
    spans = pa.array([[{"start": a, "end": b} for a, b in x[3]] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), spans], names=["conv_id", "part", "text", "loss"])


def digests(parts: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations``: one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, reader, conv, loss, chars = [], None, None, hashlib.sha256(), 0

        def done() -> None:
            reader.close()
            out.append((conv, reader.turns, reader.digest.hexdigest(), chars, loss.hexdigest(), reader.chars))

        for b in batches:
            for c, part, text, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if reader is None or part == 0:
                    if reader is not None:
                        done()
                    reader, conv, loss, chars = Reader(), c, hashlib.sha256(), 0
                reader.feed(text)
                for s in spans:
                    plain = unescape(text[s["start"] : s["end"]])
                    chars += len(plain)
                    loss.update(plain.encode())
        if reader is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
