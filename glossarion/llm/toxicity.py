"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, prepare, span_hash, stored, utf8, words
from .quality import labelled
from .rules import statistics

if TYPE_CHECKING:
    import pandas as pd

#: Everything is fitted on so many labelled rows at most, those with the least hash of their id.
SAMPLE = 20_000
FIT_TASKS = 8
#: Words and word beginnings are hashed to so many cells.
CELLS = 1 << 20
#: Lengths of word beginnings in bytes; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 8)
#: Rows of class 1 that must have a cell before it is mined, and how far its rows must speak against chance (log-likelihood ratio).
SUPPORT = 5
EVIDENCE = 12.0
#: What a row of class 1 still counts after each cell that was chosen for it.
EXPLAINED = 0.5
MINED = 6

#: Insults by language, one voter each; fixed values.
LEXICONS = {
    "en": "idiot idiots stupid moron morons loser losers scum trash pathetic disgusting worthless clown dumb fool jerk hate",
    "de": "idiot dumm dummkopf trottel abschaum arschloch versager widerlich wertlos hass",
    "fr": "idiot stupide imbécile débile crétin ordure minable dégoûtant connard haine",
    "es": "idiota estúpido imbécil basura escoria patético asqueroso inútil payaso odio",
}


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (document, cell) pairs of the texts' words and word beginnings, sorted by document.

    Words are lower-cased in A-Z and stripped of ASCII punctuation at either end.
    """
    d = LOWER[data]
    start, end, first = words(d, offsets)
    solid = ((d >= 97) & (d <= 122)) | (d >= 128)
    run = np.concatenate([[0], np.cumsum(solid)])
    at = np.concatenate([np.flatnonzero(solid), [len(d)]])
    has = run[end] > run[start]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[has]
    start, end = at[run[start[has]]], at[run[end[has]] - 1] + 1
    docs, keys = [], []
    for k, length in enumerate(LENGTHS):
        long = np.ones(len(start), bool) if not length else end - start > length
        stop = end if not length else start + length
        h = span_hash(d, start[long], stop[long])
        keys.append(mix(h + np.uint64(k + 1)) & np.uint64(CELLS - 1))
        docs.append(doc[long])
    pair = np.unique(np.concatenate(docs).astype(np.uint64) * np.uint64(CELLS) + np.concatenate(keys))
    return (pair // np.uint64(CELLS)).astype(np.int64), (pair % np.uint64(CELLS)).astype(np.int64)


def word_cell(word: str) -> int:
    d = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(mix(span_hash(d, np.array([0]), np.array([len(d)])) + np.uint64(1))[0] & np.uint64(CELLS - 1))


@dataclass(frozen=True)
class Voters:
    """Lexicon voters by cell, and pattern voters by rates; a vote is 1 (toxic), -1 (not) or 0 (none)."""

    #: voter of each cell, or -1
    lexicon: np.ndarray
    names: tuple[str, ...]

    def votes(self, n: int, doc: np.ndarray, cell: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = len(self.names)
        out = np.zeros((n, m), np.int8)
        voter = self.lexicon[cell]
        hit = np.zeros((n, m), np.int64)
        np.add.at(hit, (doc[voter >= 0], voter[voter >= 0]), 1)
        lex = m - 3
        out[:, :lex] = hit[:, :lex] > 0
        none = (hit[:, :lex] == 0).all(axis=1)
        w = np.maximum(counts[:, 0], 1)
        out[:, lex] = np.where(counts[:, 5] > 0.7 * np.maximum(counts[:, 6], 1), -1, 0)  # shouting or junk without words
        out[:, lex + 1] = np.where(none, -1, 0)  # no lexicon has a word of it
        out[:, lex + 2] = np.where(hit[:, :lex].sum(axis=1) >= 3, 1, np.where(none & (w >= 5), -1, 0))  # several insults
        return out


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each voter with the weight that its correlations leave it, and the share of class 1."""

    #: log-likelihoods by voter, class and vote + 1
    table: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(np.int64) + 1
        log = [np.log(p) + sum(self.weight[j] * self.table[j, c, v[:, j]] for j in range(votes.shape[1])) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def label_model(votes: np.ndarray, prior: float, steps: int = 30) -> LabelModel:
    """Expectation-maximisation from the votes alone, started with majority votes, in turn with the voters' correlations.

    Given the class, voters should be independent. What correlation is left between two voters in a class is estimated from the
    posterior's residuals, and a voter's evidence is divided by one plus the sum of its positive correlations, so that copies of one
    voter count about once. ``prior`` is the share of class 1, which votes alone can't tell.
    """
    n, m = votes.shape
    v = votes.astype(np.int64) + 1
    one = np.stack([(v == k) for k in range(3)], axis=2).astype(float)
    score = votes.sum(axis=1)
    q = np.clip(np.where(score > 0, 0.95, np.where(score < 0, prior * 0.2, prior)), 0.01, 0.99)
    weight, table = np.ones(m), np.zeros((m, 2, 3))
    for _ in range(steps):
        residual = 0.0
        for c, r in ((0, 1 - q), (1, q)):
            p = (np.einsum("n,nmk->mk", r, one) + 0.5) / (r.sum() + 1.5)
            table[:, c] = np.log(p)
            d = (votes - (p[:, 2] - p[:, 0])) * np.sqrt(r)[:, None]
            cov = d.T @ d
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            residual = residual + (r.sum() / max(n, 1)) * np.abs(cov / np.outer(sd, sd))
        np.fill_diagonal(residual, 0.0)
        weight = 1 / (1 + np.where(residual > 0.1, residual, 0).sum(axis=1))
        q = LabelModel(table, weight, prior).posterior(votes)
    return LabelModel(table, weight, prior)


@dataclass(frozen=True)
class Classifier:
    """Weights by cell, by vote (for and against) and the bias."""

    cell: np.ndarray
    vote: np.ndarray
    bias: float
    voters: Voters

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for a, b in chunks(offsets):
            d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            doc, cell = cells(d, o)
            v = self.voters.votes(b - a, doc, cell, statistics(d, o))
            z = self.bias + np.bincount(doc, weights=self.cell[cell], minlength=b - a) + np.hstack([v > 0, v < 0]) @ self.vote
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _descend(n: int, rows: np.ndarray, cols: np.ndarray, width: int, target: np.ndarray, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 features by accelerated gradient descent on soft targets."""
    w, bias = np.zeros(width), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)))
    m, s, t = np.zeros(width + 1), np.zeros(width + 1), 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, weights=w[cols], minlength=n), -40, 40)))
        g = np.append(np.bincount(cols, weights=(p - target)[rows], minlength=width) / n + l2 * w, (p - target).mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def _against_chance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of the rows' own share of class 1 against ``share``."""
    rate = toxic / np.maximum(toxic + clean, 1e-9)
    return toxic * np.log(np.maximum(rate, 1e-12) / max(share, 1e-12)) + clean * np.log(np.maximum(1 - rate, 1e-12) / max(1 - share, 1e-12))


def _lists(rows: DataFrame, telling: np.ndarray, voters: Voters | None = None) -> pd.DataFrame:
    """doc_id, toxic, found (numbers of the cells in ``telling``) and votes of the sample's rows, in the order of their ids."""
    column = np.full(CELLS, -1, np.int64)
    column[telling] = np.arange(len(telling))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch, "_text")
            found, votes = [], []
            for a, b in chunks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                doc, cell = cells(d, o)
                votes += voters.votes(b - a, doc, cell, statistics(d, o)).tolist() if voters else [[]] * (b - a)
                use = column[cell] >= 0
                doc, cell = doc[use], column[cell[use]]
                found += [cell[x:y].tolist() for x, y in zip(np.searchsorted(doc, np.arange(b - a)), np.searchsorted(doc, np.arange(b - a), "right"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int8()))], names=["doc_id", "toxic", "found", "votes"])

    return rows.select("_text", "_y", "doc_id").mapInArrow(see, "doc_id long, toxic boolean, found array<int>, votes array<tinyint>").toPandas().sort_values("doc_id", kind="stable")


def _choose(seen: pd.DataFrame, clean: np.ndarray, share: float) -> np.ndarray:
    """Cells that explain the rows of class 1, the strongest first. A row counts less for each cell that was chosen for it, so that words
    which stand next to insults in a row with many copies are not taken for insults.
    """
    toxic = seen[seen["toxic"]]["found"]
    row = np.repeat(np.arange(len(toxic)), toxic.map(len).to_numpy(int))
    cell = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in toxic)])
    by_cell = np.argsort(cell, kind="stable")
    cut = np.searchsorted(cell[by_cell], np.arange(len(clean) + 1))
    weight, chosen = np.ones(len(toxic)), []
    count = np.bincount(cell, minlength=len(clean)).astype(float)
    by_row = np.concatenate([[0], np.cumsum(toxic.map(len).to_numpy(int))])
    while len(count):
        value = _against_chance(count, clean, share)
        value[count < SUPPORT] = 0
        value[chosen] = 0
        best = int(np.argmax(value))
        if value[best] < EVIDENCE:
            break
        chosen.append(best)
        for r in row[by_cell[cut[best] : cut[best + 1]]]:
            lost = weight[r] * (1 - EXPLAINED)
            weight[r] -= lost
            count[cell[by_row[r] : by_row[r + 1]]] -= lost
    return np.array(chosen, np.int64)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, label: str = "toxic") -> Classifier | None:
    """Voters, label model and classifier from at most ``sample`` labelled documents; None where none is labelled.

    Null texts are empty ones. Labels without a document, null labels and null ids are not used; a document that repeats, or has several
    labels, is learned from as often.
    """
    prepare(docs.sparkSession)
    rows = stored(labelled(docs, labels, text, sample, label).select(F.col(text).alias("_text"), (F.col("_label") == 1).alias("_y"), "doc_id").repartition(FIT_TASKS, "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, CELLS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            data, offsets = utf8(batch, "_text")
            y = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            for a, b in chunks(offsets):
                doc, cell = cells(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for c in (0, 1):
                    total[c] += np.bincount(cell[y[a:b][doc] == c], minlength=CELLS).astype(np.int32)
                    n[c] += int((y[a:b] == c).sum())
        yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([int(n[1])]), pa.array([pa.Codec("zstd", 1).compress(total.tobytes(), asbytes=True)], pa.binary())], names=["clean", "toxic", "counts"])

    have, n = np.zeros((2, CELLS), np.int64), np.zeros(2)
    for r in rows.select("_text", "_y").mapInArrow(count, "clean long, toxic long, counts binary").toLocalIterator():
        n += (r["clean"], r["toxic"])
        have += np.frombuffer(pa.Codec("zstd").decompress(bytes(r["counts"]), 8 * CELLS, asbytes=True), np.int32).reshape(2, CELLS)
    if not n.sum():
        return None
    odds = np.log((have[1] + 0.25) / (n[1] + 0.5)) - np.log((have[0] + 0.25) / (n[0] + 0.5))
    share = n[1] / n.sum()
    evidence = np.where((have[1] >= SUPPORT) & (odds > 1.5), _against_chance(have[1], have[0], share), 0)
    telling = np.argsort(-evidence, kind="stable")
    telling = telling[evidence[telling] >= EVIDENCE]
    telling = telling[_choose(_lists(rows, telling), have[0][telling], share)]
    lexicon = np.full(CELLS, -1, np.int8)
    for i, c in enumerate(telling[odds[telling] > 3]):
        lexicon[c] = len(LEXICONS) + i % MINED
    for i, listed in enumerate(LEXICONS.values()):
        for word in listed.split():
            c = word_cell(word)
            if odds[c] > 0 or not have[:, c].any():
                lexicon[c] = i
    voters = Voters(lexicon, (*LEXICONS, *(f"mined {i}" for i in range(MINED)), "pattern: capitals", "pattern: no insult", "pattern: several insults"))
    seen = _lists(rows, telling, voters)
    votes = np.array(seen["votes"].tolist(), np.int8)
    model = label_model(votes, float(np.clip(n[1] / n.sum(), 0.01, 0.99)))
    target = model.posterior(votes)
    size = seen["found"].map(len).to_numpy()
    r = np.concatenate([np.repeat(np.arange(len(seen)), size), *(np.nonzero(x)[0] for x in (votes > 0, votes < 0))])
    c = np.concatenate([*(np.asarray(x, np.int64) for x in seen["found"] if len(x)), len(telling) + np.nonzero(votes > 0)[1], len(telling) + votes.shape[1] + np.nonzero(votes < 0)[1]]).astype(np.int64)
    w, bias = _descend(len(seen), r, c, len(telling) + 2 * votes.shape[1], target)
    by_cell = np.zeros(CELLS)
    by_cell[telling] = w[: len(telling)]
    return Classifier(by_cell, w[len(telling) :], bias, voters)


def score(docs: DataFrame, model: Classifier | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1) for every row; null texts are empty texts and are scored; without a model all scores are 0.

    Rows that repeat and null ids are scored row by row; an empty table gives an empty result; other columns are not read.
    """
    prepare(docs.sparkSession)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(*utf8(batch, "_text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(s)], names=[*keep, "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in zip(keep, kinds, strict=True)]) + ", score double")
