"""Edits of blanks around punctuation marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import WORD, char_at, let, spans
from .spelling import NONE, edit

#: Marks that a blank may not precede and that a letter may not follow at once. Fixed values.
MARKS = ",.:;!?"
LETTER = "A-Za-zА-Яа-яЁё"
BLANKS = r"[ \t\f\x0B]+"


def punct_edits(text: Column, before: bool = True, after: bool = True, typo_keys: tuple[str, ...] = ()) -> Column:
    """Blanks before a mark go; a mark before a letter gets a blank. ``key:typo`` keeps its colon where ``typo`` is a known typo."""
    found = []
    if before:
        found.append(F.transform(spans(text, rf"{BLANKS}[{MARKS}]"), lambda s: edit(s["start"], s["end"], s["value"], F.right(s["value"], F.lit(1)))))
    if after:
        marks = spans(text, rf"[{MARKS}](?=[{LETTER}])")
        if typo_keys:

            def glue(whole: Column, s: Column) -> Column:
                right = F.regexp_extract(whole.substr(s["end"] + 1, F.length(whole)), rf"\A[{LETTER}_]+", 0)
                return (s["value"] == ":") & char_at(whole, s["start"] - 1).rlike(f"[{WORD}]") & right.isin(*typo_keys)

            marks = let(text, lambda whole: F.filter(spans(whole, rf"[{MARKS}](?=[{LETTER}])"), lambda s: ~glue(whole, s)))
        found.append(F.transform(marks, lambda s: edit(s["start"], s["end"], s["value"], F.concat(s["value"], F.lit(" ")))))
    return F.array_sort(F.concat(*found)) if found else F.expr(NONE)


def tidy(text: Column) -> Column:
    """Blanks collapsed, and spaces and tabs taken off the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " "), F.lit(" \t"))


def space_before(text: Column) -> Column:
    return F.regexp_replace(text, rf"{BLANKS}([{MARKS}])", "$1")


def space_after(text: Column) -> Column:
    return F.regexp_replace(text, rf"([{MARKS}])(?=[{LETTER}])", "$1 ")
