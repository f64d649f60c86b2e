"""Connected components of links between ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Passes that shorten the links before labels are spread.
PASSES = 2
#: Links or labels of a file, about, where each of Spark's shuffle partitions would have fewer.
FILE_ROWS = 4096


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links replaced by links from its nodes to the least node that they reach inside the batch."""
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = list(range(len(nodes)))
        for i, j in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            up[max(i, j)] = min(i, j)
        for i in range(len(up)):  # a node's parent is less than the node, and done
            up[i] = up[up[i]]
        root = nodes[np.array(up, np.int64)] if len(up) else nodes
        keep = root != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])


def _files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has up to ``rows`` rows, dealt to fewer partitions where a round's table would be a file for a few rows each. What
    makes the rows keeps its own partitions; tables with enough rows for all partitions are left as they are.
    """
    few = -(-max(rows, 1) // FILE_ROWS)
    return df.repartition(few) if few < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) for all nodes of ``edges`` (a, b: long).

    First the links are shortened where tasks see them: sorted by their greater end, each Arrow batch keeps a link to the least node it
    reaches for each of its nodes, which leaves little more than one link a node. Then labels are spread in rounds: every node joins the least
    label of its neighbours and of its own label, so that distances halve, until none changes. Least labels are combined before they
    are shuffled, joins on a hot node can be split, and only the news whether a label changed comes to the driver. Every file that Hadoop
    writes to a local file system without its native code starts a process, so small tables are kept in few files.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    for _ in range(PASSES):
        links = links.repartition("a").sortWithinPartitions("a").mapInArrow(_shorten, "a long, b long")
    links = stored(_files(links.distinct(), edges.count()))
    rows = 2 * links.count()  # at least as many as there are nodes
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = stored(_files(labels, rows))
    while True:
        # what a node learns from its neighbours, it tells to those that carry it as their label
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        heard = near.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        told = labels.select("node", F.col("label").alias("old")).join(heard.select(F.col("node").alias("old"), F.col("label").alias("far")), "old")
        new = told.join(heard, "node").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved"))
        new = stored(_files(new, rows))
        moved = bool(new.where("moved").limit(1).count())
        labels = new.select("node", "label")
        release(spark)
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
