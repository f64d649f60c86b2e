"""Quality rules: an isolation forest on rule statistics, with its threshold set by labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, prepare, utf8
from .rules import BASE, MORE, statistics

#: The forest is fitted on so many labelled rows at most, those with the least hash of their id.
SAMPLE = 20_000
TREES = 128
#: Rows from which one tree is grown.
TREE_ROWS = 256
#: What it costs to reject a good row, counted in bad rows kept.
GOOD_COST = 3.0


def features(counts: np.ndarray) -> list[np.ndarray]:
    """Rates by word or character, which behave alike at every length, in groups: symbols, shouting, repeated words, repeated passages."""
    c = counts.astype(np.float64)
    w, ch, letters, lines = (np.maximum(c[:, i], 1) for i in (0, 1, 6, 9))
    return [
        np.column_stack([c[:, 2] / w, c[:, 2] / ch]),
        np.column_stack([c[:, 5] / letters, c[:, 7] / w]),
        np.column_stack([c[:, 11] / w, c[:, 10] / w**0.9]),
        np.column_stack([c[:, 4] / w, c[:, 3] / lines]),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node i of a tree splits column[i] at value[i]; leaves have column -1 and their path length in value."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / that of an unsuccessful search): near 1 is an anomaly, below 0.5 is usual."""
        total = np.zeros(len(x))
        for column, value, child in zip(self.column, self.value, self.child, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(2 * int(np.ceil(np.log2(max(self.rows, 2)))) + 1):
                c = column[at]
                if (c < 0).all():
                    break
                go = child[at] + (x[np.arange(len(x)), np.maximum(c, 0)] >= value[at])
                at = np.where(c < 0, at, go)
            total += value[at]
        return 2.0 ** (-(total / len(self.column)) / max(_usual(self.rows), 1e-9))


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    most = int(np.ceil(np.log2(max(rows, 2))))
    size = 2 ** (most + 1)
    column, value, child = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64)
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), rows, replace=False)], 0)], 1
        while todo:
            i, part, depth = todo.pop()
            wide = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
            if depth >= most or not len(wide):
                value[t, i] = depth + _usual(len(part))
                continue
            c = int(rng.choice(wide))
            v = rng.uniform(part[:, c].min(), part[:, c].max())
            column[t, i], value[t, i], child[t, i] = c, v, used
            todo += [(used, part[part[:, c] < v], depth + 1), (used + 1, part[part[:, c] >= v], depth + 1)]
            used += 2
    return Forest(column, value, child, rows)


def threshold(score: np.ndarray, good: np.ndarray, cost: float = GOOD_COST) -> float:
    """The score from which rejecting costs least: ``cost`` for each good row rejected and 1 for each bad row kept. Infinity without bad rows."""
    order = np.argsort(score)
    s, g = score[order], good[order]
    rejected = np.concatenate([np.cumsum(g[::-1])[::-1], [0]]) * cost
    kept = np.concatenate([[0], np.cumsum(~g)])
    at = int(np.argmin(rejected + kept)) if len(s) else 0
    if at >= len(s):
        return float("inf")
    return float(s[at]) if at == 0 else float((s[at - 1] + s[at]) / 2)


def _stats(docs: DataFrame, text: str, ids: list[str]) -> DataFrame:
    fields = [f"{docs.schema[c].dataType.simpleString()}" for c in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            st = statistics(*utf8(batch, text))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), *(pa.array(st[:, j]) for j in range(st.shape[1]))], names=[*ids, *BASE, *MORE])

    schema = ", ".join([f"`{c}` {t}" for c, t in zip(ids, fields, strict=True)] + [f"{c} long" for c in (*BASE, *MORE)])
    return docs.select(*ids, text).mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, text: str, sample: int, label: str = "quality") -> DataFrame:
    """At most ``sample`` labelled documents by the hash of their id; the ids that are broadcast are bounded by ``sample``."""
    some = bounded_sample(labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")), "_id", sample)
    return docs.select("doc_id", text).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", text, F.col("_label").cast("int").alias("_label"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[tuple[Forest, float]]:
    """A forest for each group of features, grown from labelled rows, with its threshold; none where no row is labelled.

    A group's threshold is set on the rows that the base rules and the groups before it keep. Groups have forests of their own
    because a mean path over all features hides what is unusual in one of them.
    """
    st = _stats(labelled(docs, labels, text, sample), text, ["_label", "doc_id"]).toPandas().sort_values(["doc_id", "_label"])
    if not len(st):
        return []
    counts, good = st[[*BASE, *MORE]].to_numpy(), st["_label"].to_numpy() == 1
    left, out = ~failed(counts), []
    for x in features(counts):
        forest = grow(x[left] if left.any() else x)
        score = forest.score(x)
        out.append((forest, threshold(score[left], good[left])))
        left &= score < out[-1][1]
    return out


def failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, the BASE counts, base_failed, anomaly (the highest score of any group) and kept for every row of ``docs``.

    Null texts have no words and fail the base rules. Rows that repeat, and null ids, are judged row by row. Labels without a document
    or with nulls are not used. Other columns are not read. Without any labelled row only the base rules decide.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels, text, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            st = statistics(*utf8(batch, text))
            bad = failed(st)
            score, kept = np.zeros(len(st)), ~bad
            for (forest, limit), x in zip(model, features(st), strict=False):
                own = forest.score(x)
                score, kept = np.maximum(score, own), kept & (own < limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(st[:, j]) for j in range(len(BASE))), pa.array(bad), pa.array(score), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, schema)
