"""Regular expressions over string columns: spans with offsets, without Python.

Word characters, digits, blanks and word borders are spelled out, so that they mean letters, numbers and white space of all scripts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
BLANK = r"\s\x1C-\x1F\x85\p{Z}"
BORDER = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

_OPEN, _CLOSE = "\u0001", "\u0002"
#: The type of a span: offsets count code units from 0, ``end`` exclusive.
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it, and also where it does so inside a lambda function."""
    return F.transform(F.array(value), body)[0]


def plain(text: Column) -> Column:
    """``text`` without the two marks that ``spans`` uses; others of their kind, and as long, stand for them."""
    return F.translate(text, _OPEN + _CLOSE, "\u0003\u0003")


#: Parts of a text whose offsets are added up in one fold; even, so that each run of parts begins with one that is no match.
_RUN = 64


def _parts(text: Column, pattern: str, ahead: str = "", match: str = "$0") -> Column:
    """``text`` cut at both ends of each match of ``pattern``: every second part is a match.

    ``ahead`` and ``match``: the groups of the pattern that stay before the cut, and that are the match.
    """
    return F.split(F.regexp_replace(plain(text), pattern, ahead + _OPEN + match + _CLOSE), f"[{_OPEN}{_CLOSE}]", -1)


def spans(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` from left to right without overlap: array of (start, end, value). Null gives null.

    Marks are put around the matches and the text is split there, and the parts' lengths add up to offsets.
    """
    return F.when(text.isNotNull(), let(_parts(text, pattern), placed))


def placed(parts: Column) -> Column:
    """The spans of every second part: array of (start, end, value). A fold copies its array with every match, so parts are folded in
    short runs, from the offsets at which the runs begin, and the runs' results are joined once.
    """

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        found = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value"))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def fold(run: Column, at: Column) -> Column:
        return F.aggregate(run, F.struct(at.alias("at"), F.lit(False).alias("hit"), F.expr(f"cast(array() as {SPAN})").alias("out")), step, lambda acc: acc["out"])

    def runs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _RUN).cast("int")), lambda k: F.slice(parts, k * _RUN + 1, F.lit(_RUN)))

    def joined(found: Column) -> Column:
        sizes = F.transform(found, lambda run: F.aggregate(run, F.lit(0), lambda n, part: n + F.length(part)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(begins, lambda at: F.flatten(F.transform(found, lambda run, k: fold(run, F.get(at, k)))))

    return F.when(F.size(parts) <= _RUN, fold(parts, F.lit(0))).otherwise(let(runs(parts), joined))


def beside(parts: Column, i: Column) -> Column:
    """The characters beside the match of number ``i``, from the parts and not from the whole text: (two, before, after), empty outside."""
    last = F.right(F.concat(F.coalesce(F.right(F.get(parts, 2 * i - 1), F.lit(2)), F.lit("")), F.get(parts, 2 * i)), F.lit(2))
    after = F.left(F.get(parts, 2 * i + 2), F.lit(1))
    return let(last, lambda x: F.struct(F.when(F.length(x) > 1, F.left(x, F.lit(1))).otherwise("").alias("two"), F.right(x, F.lit(1)).alias("before"), after.alias("after")))


def neighbours(text: Column, pattern: str) -> Column:
    """All matches with the characters beside them: array of (before, value, after); a character that isn't there is empty."""

    def around(parts: Column) -> Column:
        one = lambda p, i: F.struct(F.right(F.get(parts, i - 1), F.lit(1)).alias("before"), p.alias("value"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"), (i % 2 == 1).alias("hit"))
        return F.filter(F.transform(parts, one), lambda x: x["hit"])

    return F.when(text.isNotNull(), let(_parts(text, pattern), around))


def token_pattern(least: int = 1) -> str:
    return rf"{BORDER}[{WORD}-]{{{max(least, 1)},}}{BORDER}"


def tokens(text: Column, least: int = 1) -> Column:
    """Words of at least ``least`` word characters or hyphens between word borders, as ``spans`` gives them."""
    return spans(text, token_pattern(least))


def token_parts(text: Column, least: int = 1, only: Collection[str] | None = None) -> Column:
    """``text`` cut at both ends of its tokens, or of those that are one of ``only``: every second part is one.

    A token is a run of word characters and hyphens without the hyphens at its ends, so those few are found without the others.
    """
    if only is None:
        return _parts(text, token_pattern(least))
    words = sorted(w for w in set(only) if len(w) >= max(least, 1) and re.fullmatch(r"\w([\w-]*\w)?", w))
    if not words:
        return F.array(plain(text))
    return _parts(text, rf"(?<![{WORD}-])(-*+)({'|'.join(words)})(?=-*+(?![{WORD}]))", "$1", "$2")


def char_at(text: Column, index: Column) -> Column:
    """The character at an offset, empty outside of the text."""
    return F.when((index >= 0) & (index < F.length(text)), text.substr(index + 1, F.lit(1))).otherwise(F.lit(""))


def splice(text: Column, start: Column, end: Column, value: Column) -> Column:
    """``text`` with ``value`` in place of [start, end)."""
    return F.concat(text.substr(F.lit(1), start), value, text.substr(end + 1, F.length(text)))


#: Characters of a piece in which ``replaced`` looks offsets up: two to this power.
_PIECE = 10


def replaced(text: Column, found: Column) -> Column:
    """``text`` with ``after`` in place of [from, to) for each of ``found`` (from, to, after), which are in order and don't overlap.

    An offset is searched from the beginning of a string, so the text is cut into short pieces once and each offset searched in its own.
    """

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        i, j, low = F.shiftright(start, _PIECE), F.shiftright(end, _PIECE), F.lit((1 << _PIECE) - 1)
        piece, at = lambda k: F.coalesce(F.get(pieces, k), F.lit("")), lambda x: x.bitwiseAND(low)
        several = F.concat(piece(i).substr(at(start) + 1, low + 1), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), piece(j).substr(F.lit(1), at(end)))
        return F.when(i == j, piece(i).substr(at(start) + 1, end - start)).otherwise(several)

    def joined(pieces: Column) -> Column:
        begin = lambda k: F.coalesce(F.get(found, k - 1)["to"], F.lit(0))
        head = F.transform(found, lambda e, k: F.concat(cut(pieces, begin(k), e["from"]), e["after"]))
        return F.concat(F.array_join(head, ""), cut(pieces, begin(F.size(found)), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << _PIECE}}}+"), F.lit(0))
    return F.when(F.size(found) == 0, text).when(text.isNotNull(), let(pieces, joined))
