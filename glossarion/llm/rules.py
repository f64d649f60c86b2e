"""Counts of whole texts that the quality rules use."""

from __future__ import annotations

import numpy as np

from .common import CHUNK_BYTES, chunks, mix, span_hash, windows_hash, words

#: Window of repeated words.
WINDOW = 8
#: Characters that count as symbols; fixed values.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC3)
_LEAD = (np.arange(256) & 0xC0) != 0x80
_MARK = np.isin(np.arange(256), [ord(c) for c in "!?.,;:"])
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("upper", "letters", "marks", "digits", "n_lines", "distinct_words", "top_word")


def _by_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per position) over each document's positions."""
    s = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=s[1:])
    return s[offsets[1:]] - s[offsets[:-1]]


def _same(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (document, hash) pairs: the document of each different pair, its count, and each row's pair."""
    with np.errstate(over="ignore"):
        # documents get numbers far from those of short spans, or the two could change places in the sum
        key = mix(hashes + mix(doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x5851F42D4C957F2D)))
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return doc[first], n, inverse


def statistics(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK_BYTES) -> np.ndarray:
    """A row of BASE and MORE counts per document; an empty text has zeros."""
    out = np.zeros((len(offsets) - 1, len(BASE) + len(MORE)), np.int64)
    for a, b in chunks(offsets, chunk):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        out[a:b] = _statistics(d, o)
    return out


def _statistics(d: np.ndarray, o: np.ndarray) -> np.ndarray:
    n = len(o) - 1
    res = np.zeros((n, len(BASE) + len(MORE)), np.int64)
    if not len(d):
        return res
    start, end, first = words(d, o)
    res[:, 0] = np.diff(first)
    lead = np.zeros(len(d) + 1, np.int64)
    np.cumsum(_LEAD[d], out=lead[1:])
    res[:, 1] = _by_doc(lead[end] - lead[start], first)
    res[:, 2] = _by_doc(_SYMBOL[d], o)
    # lines: from a document's start or after \n, to before \n or a document's end
    cut = np.flatnonzero(d == 10)
    ls = np.unique(np.concatenate([o[:-1][np.diff(o) > 0], cut + 1]))
    ls = ls[ls < len(d)]
    le = np.concatenate([ls[1:], [len(d)]])
    le = le - ((le > ls) & (d[le - 1] == 10))
    has = np.searchsorted(start, ls) < np.searchsorted(start, le)
    ls, le = ls[has], le[has]
    doc = np.searchsorted(o, ls, "right") - 1
    lines = np.bincount(doc, minlength=n)
    different = np.bincount(_same(doc, span_hash(d, ls, le))[0], minlength=n)
    res[:, 3] = lines - different
    word_doc = np.repeat(np.arange(n), np.diff(first))
    wh = span_hash(d, start, end)
    if len(wh) >= WINDOW:
        g = windows_hash(wh, WINDOW)
        at = np.flatnonzero(word_doc[: len(g)] == word_doc[WINDOW - 1 :])
        if len(at):
            _, count, inverse = _same(word_doc[at], g[at])
            again = at[count[inverse] > 1]
            cover = np.zeros(len(wh) + 1, np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + WINDOW, -1)
            res[:, 4] = _by_doc(np.cumsum(cover)[:-1] > 0, first)
    k = len(BASE)
    for i, table in enumerate((_UPPER, _LETTER, _MARK, _DIGIT)):
        res[:, k + i] = _by_doc(table[d], o)
    res[:, k + 4] = lines
    wd, count, _ = _same(word_doc, wh)
    res[:, k + 5] = np.bincount(wd, minlength=n)
    np.maximum.at(res[:, k + 6], wd, count)
    return res
