"""Language ID: each document is a mixture of languages, inferred by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, bounded_sample, chunks, prepare, utf8, words

#: The n-gram tables are fitted on so many labelled documents at most, those with the least hash of their id.
SAMPLE = 20_000
#: Tasks that count the sample's n-grams.
FIT_TASKS = 16
#: n-grams are hashed to so many cells.
CELLS = 1 << 16
#: Overlapping n-grams repeat evidence; their log-likelihoods count this much.
TEMPER = 0.4
STEPS = 12
#: What one more language must add to the log-likelihood, times the log of the number of words.
PENALTY = 3.0
#: A language with a smaller share than this is not tried.
LEAST = 0.02
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(d: np.ndarray) -> np.ndarray:
    """The hashed cell of the three lower-cased bytes around each position; white space is one kind of byte."""
    x = np.where(SPACE[d], np.uint8(32), LOWER[d]).astype(np.uint32)
    p = np.full(len(x) + 2, np.uint32(32))
    p[1:-1] = x
    key = p[:-2] << np.uint32(16) | p[1:-1] << np.uint32(8) | p[2:]
    return ((key * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: log P(n-gram | language), a row per cell
    table: np.ndarray

    def word_scores(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word in each language, and the documents' first words."""
        start, end, first = words(d, o)
        if not len(start):
            return np.zeros((0, len(self.langs))), first
        cut = np.empty(2 * len(start), np.int64)
        cut[0::2], cut[1::2] = start, end
        g = grams(d)
        out = np.empty((len(start), len(self.langs)))
        for k in range(len(self.langs)):
            s = np.concatenate([self.table[:, k][g], [0.0]])
            out[:, k] = np.add.reduceat(s, cut)[0::2]
        return out * TEMPER, first

    def infer(self, d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's proportions over the languages that the penalised likelihood selects."""
        ll, first = self.word_scores(d, o)
        n, k = len(o) - 1, len(self.langs)
        has = np.flatnonzero(np.diff(first) > 0)
        pi = np.zeros((n, k))
        if not len(has):
            return pi, has
        at, size = first[has], np.diff(first)[has]
        top = ll.max(axis=1, keepdims=True)
        like, base = np.exp(ll - top), np.add.reduceat(top[:, 0], at)
        p, _ = _mixture(like, at, size, np.full((len(has), k), 1.0 / k))
        order = np.argsort(-p, axis=1, kind="stable")
        best = np.zeros_like(p)
        best[np.arange(len(has)), order[:, 0]] = 1
        total = np.take_along_axis(np.add.reduceat(ll, at, axis=0), order[:, :1], 1)[:, 0]
        word_doc = np.repeat(np.arange(len(has)), size)
        for m in range(2, k + 1):
            tried = np.flatnonzero(np.take_along_axis(p, order[:, m - 1 : m], 1)[:, 0] >= LEAST)
            if not len(tried):
                break
            mask = np.zeros((len(tried), k))
            np.put_along_axis(mask, order[tried, :m], 1.0, 1)
            keep = np.isin(word_doc, tried)
            sub_at = np.concatenate([[0], np.cumsum(size[tried])[:-1]])
            q, lq = _mixture(like[keep], sub_at, size[tried], mask * np.maximum(p[tried], 1e-6))
            gain = lq + base[tried] - total[tried]
            wins = gain > PENALTY * np.log(size[tried] + 1.0)
            best[tried[wins]], total[tried[wins]] = q[wins], (lq + base[tried])[wins]
        pi[has] = best
        return pi, has


def _mixture(like: np.ndarray, at: np.ndarray, size: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each document's proportions from its words' likelihoods; languages that start at 0 stay there."""
    pi = pi / pi.sum(axis=1, keepdims=True)
    for _ in range(STEPS):
        r = like * np.repeat(pi, size, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, at, axis=0) / size[:, None]
    mixed = np.maximum((like * np.repeat(pi, size, axis=0)).sum(axis=1), 1e-300)
    return pi, np.add.reduceat(np.log(mixed), at)


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """n-gram tables of the languages in at most ``sample`` rows where ``usable`` holds and neither text nor lang is null."""
    ids = bounded_sample(docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")), "_id", sample)
    rows = docs.where(usable & F.col(lang).isNotNull()).select("doc_id", F.col(text).alias("_text"), F.col(lang).alias("_lang")).join(F.broadcast(ids.distinct()), F.col("doc_id") == F.col("_id")).select("_text", "_lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            d, o = utf8(batch, "_text")
            for i, name in enumerate(batch.column(1).to_pylist()):
                g = grams(d[o[i] : o[i + 1]])
                c = found.setdefault(name, np.zeros(CELLS, np.int64))
                c += np.bincount(g, minlength=CELLS)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([c.tobytes() for c in found.values()], pa.binary())], names=["_lang", "_counts"])

    total: dict[str, np.ndarray] = {}
    for row in rows.repartition(FIT_TASKS).mapInArrow(count, "_lang string, _counts binary").collect():
        total[row["_lang"]] = total.get(row["_lang"], 0) + np.frombuffer(row["_counts"], np.int64)
    if not total:
        return None
    langs = tuple(sorted(total))
    table = np.column_stack([total[x] for x in langs]) + 0.5
    return Model(langs, np.log(table / table.sum(axis=0)))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns (with ``with_text`` the text may be one of them), lang_pred, score (its share) and proportions (a map of the selected languages) for every row.

    ``und`` with score 0 where the text is null or has no letter (numerals and marks are none), or where nothing could be learned. Words
    are what white space divides, and a mixture is one of words: a text without any is of one language. Rows that repeat and null ids
    are judged row by row; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    seen = text if with_text else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch, seen)
            names, scores, shares = [], [], []
            for a, b in chunks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[d])])
                letters = letters[o[1:]] > letters[o[:-1]]
                pi = model.infer(d, o)[0] if model else np.zeros((b - a, 0))
                for i in range(b - a):
                    ok = model is not None and (letters[i] or any(map(str.isalpha, d[o[i] : o[i + 1]].tobytes().decode())))
                    k = int(np.argmax(pi[i])) if ok else 0
                    names.append(model.langs[k] if ok else UNKNOWN)
                    scores.append(min(1.0, float(pi[i, k])) if ok else 0.0)
                    shares.append([(model.langs[j], float(pi[i, j])) for j in np.flatnonzero(pi[i])] if ok else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=[*keep, "lang_pred", "score", "proportions"])

    schema = ", ".join([f"`{c}` {t}" for c, t in zip(keep, kinds, strict=True)]) + ", lang_pred string, score double, proportions map<string,double>"
    return docs.select(*keep, *([] if with_text else [F.col(text).alias("_text")])).mapInArrow(run, schema)
