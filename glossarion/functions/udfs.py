"""The few functions that have no built-in; all take and give whole Arrow batches, and rows that need none are passed as null."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def normalized_lines(text: str, collapse: bool = True, trim: bool = True) -> str:
    """Blanks collapsed and edges trimmed line by line; of all line ends only \\n stays where lines are trimmed."""
    out = []
    for line in text.splitlines(keepends=True):
        body, end = (line[:-1], "\n") if line.endswith("\n") else (line, "")
        body = re.sub(r"[ \t\f\v]+", " ", body) if collapse else body
        out.append((body.strip() if trim else body) + end)
    return "".join(out)


def normalized(text: str, collapse: bool = True, trim: bool = True, blank_lines: bool = True) -> str:
    text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\u00a0", " ").replace("\r\n", "\n").replace("\r", "\n")
    text = normalized_lines(text, collapse, trim)
    return re.sub(r"\n{3,}", "\n\n", text) if blank_lines else text


def normalize_udf(collapse: bool, trim: bool, blank_lines: bool):
    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: normalized(t, collapse, trim, blank_lines), na_action="ignore")

    return run


def tidy_lines(text: Column) -> Column:
    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(normalized_lines, na_action="ignore")

    return run(text)


def _pairwise(kind: str, dtype: str, f: Callable) -> Callable[[Column, Column], Column]:
    """A function of two texts as an Arrow function; a null on either side gives null."""

    @pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=dtype)

    return run


def changed_ratio(a: Column, b: Column) -> Column:
    """1 less the share of matching blocks of the two texts; texts that are equal don't reach Python."""
    differ = a != b
    share = _pairwise("double", "float64", lambda x, y: 1.0 - SequenceMatcher(None, x, y).ratio())
    return F.when(differ, share(F.when(differ, a), F.when(differ, b))).otherwise(F.when(a.isNotNull(), F.lit(0.0)))


def osa(a: str, b: str) -> int:
    """Edits that turn a into b, a swap of neighbours being one, without edits of what was swapped."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return row[-1]


def osa_distance(a: Column, b: Column) -> Column:
    return _pairwise("int", "Int32", osa)(a, b)


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def indel(a: Column, b: Column) -> Column:
    return _pairwise("double", "float64", indel_ratio)(a, b)
