"""Sharding by balanced label propagation; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

ROUNDS = 3


def propagate(groups: DataFrame, shards: int, total: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels for groups of linked rows: _key, _start (the shard in which rows began), _label (where they are now), _n (so many rows).

    ``groups`` has _key, _start and _n; there are at most ``shards`` rows of a group. The links of a group run through its key (a hub), so
    that a group of m rows has m links and not m * m. In each round the hub joins the counts of its neighbours' shards. A group of up to
    total / shards rows proposes its fullest shard (of equal ones the lowest), and a larger one as many of its fullest shards as it must
    fill; rows in other shards ask to move there. A shard takes requests up to its quota of total / shards linked rows: a group moves
    if its hash, which differs by round, is below the share of requests that its target can take. Rows that may not move stay, and ask
    again in the next round. Without rounds all rows stay. Groups that repeat, null keys and an empty table need no care of their own.
    """
    labels, quota = groups.withColumn("_label", F.col("_start")), max(-(-total // shards), 1)
    for turn in range(rounds):
        parts = labels.groupBy("_key", "_label").agg(F.sum("_n").alias("_n"))
        # at most ``shards`` entries a key
        hub = parts.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("label")))).alias("_order"), F.sum("_n").alias("_all"))
        hub = hub.withColumn("_wide", F.least(F.ceil(F.col("_all") / quota), F.size("_order")).cast("int"))
        rank = F.array_position(F.transform("_order", lambda x: x["label"]), F.col("_label")).cast("int") - 1
        asked = labels.join(hub, "_key").withColumn("_rank", rank).withColumn("_stays", F.col("_rank") < F.col("_wide"))
        asked = asked.withColumn("_to", F.expr("element_at(_order, cast(_rank % _wide as int) + 1).label"))
        # rows that stay and rows that ask, by shard: one row for each shard
        load = asked.groupBy(F.col("_to").alias("_shard")).agg(F.sum(F.when(F.col("_stays"), F.col("_n")).otherwise(0)).alias("_base"), F.sum(F.when(F.col("_stays"), 0).otherwise(F.col("_n"))).alias("_requests"))
        share = load.select("_shard", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (quota - F.col("_base")) / F.greatest(F.col("_requests"), F.lit(1)))).alias("_share"))
        lot = F.pmod(F.xxhash64("_key", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moved = asked.join(F.broadcast(share), F.col("_to") == F.col("_shard"))  # as many rows as shards
        labels = stored(moved.select("_key", "_start", F.when(~F.col("_stays") & (lot < F.col("_share")), F.col("_to")).otherwise(F.col("_label")).alias("_label"), "_n"))
    return labels


def number(rows: DataFrame, order: list[str], by: str) -> DataFrame:
    """``rows`` with _index, gapless from 0 in ``order`` within each value of ``by``, which leads the order.

    Two passes: rows are range-partitioned and sorted once; the counts of each value of ``by`` in each partition are prefix-summed and
    give every run its offset. What is broadcast has at most as many rows as there are partitions and values of ``by`` together.
    """
    sorted_rows = rows.repartitionByRange(*[F.col(c) for c in (by, *order)]).sortWithinPartitions(by, *order)
    placed = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    runs = placed.groupBy(F.shiftright("_at", 33).alias("_part"), by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))
    joined = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(runs), ["_part", by])
    return joined.withColumn("_index", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_rows", "_before")


def settle(placed: DataFrame, shards: int, total: int) -> DataFrame:
    """``placed`` (_label, _strength, _key, _id, _row) with _shard: counts differ by one at most, and every row stays in the shard of its
    label but those that are too many there.

    Of a label with too many rows those with the fewest linked rows beside them move (``_strength``); they are numbered, and fill the
    shards that have too few, one after the other.
    """
    counts = {r["_label"]: r["n"] for r in placed.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as shards
    surplus, before, room = [], [], [0]
    for s in range(shards):
        more = counts.get(s, 0) - (total // shards + (s < total % shards))
        before.append(sum(surplus))
        surplus.append(max(more, 0))
        room.append(room[-1] + max(-more, 0))
    numbered = number(placed, ["_strength", "_key", "_id", "_row"], by="_label")
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("_label") + 1)
    mover = at(before) + F.col("_index")
    ends = F.array(*[F.lit(v).cast("long") for v in room[1:]])
    target = F.size(F.filter(ends, lambda end: end <= mover))
    return numbered.withColumn("_shard", F.when(F.col("_index") < at(surplus), target).otherwise(F.col("_label")).cast("int")).drop("_index")


def shard(docs: DataFrame, shards: int = 24, text: str = "text", id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """_id, _size (UTF-8 bytes and 8), _crc32, _key (digest of the text), _shard, _slot for all rows under the law ``rows``: the counts of
    any two shards differ by one at most.

    Rows of equal text are linked. They start in the shard that their id's hash gives, label propagation brings each group together
    under the shards' quotas (``propagate``), and what the quotas left uneven is settled by moving the rows with the fewest links. Null
    texts are empty texts; rows that repeat are rows of their own; null ids start in one shard, which settling evens out; an empty
    table gives an empty result. Other columns are not read. ``cut`` counts the links that are cut.
    """
    prepare(docs.sparkSession)
    value = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(id).cast("long").alias("_id"), (F.octet_length(value).cast("long") + 8).alias("_size"), F.crc32(value).alias("_crc32"), F.unhex(F.sha2(value, 256)).alias("_key"))
    # rows are numbered so that even those that are equal in everything can be told apart, dealt and sorted
    base = stored(base.withColumn("_start", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")).withColumn("_row", F.monotonically_increasing_id()))
    total = base.count()
    counts = base.groupBy("_key", "_start").agg(F.count(F.lit(1)).alias("_n"))
    linked = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy("_key"))).where("_all > 1").drop("_all")
    labels = propagate(stored(linked), shards, total, rounds)
    strength = labels.groupBy("_key", "_label").agg(F.sum("_n").alias("_strength"))
    homes = labels.join(strength, ["_key", "_label"]).select("_key", "_start", "_label", "_strength")
    # by key and start, so the rows of one text come from as many keys as there are shards
    placed = base.join(homes, ["_key", "_start"], "left").withColumns({"_label": F.coalesce("_label", "_start"), "_strength": F.coalesce("_strength", F.lit(1))})
    cut_ = settle(stored(placed.drop("_start")), shards, total).drop("_label", "_strength")
    return number(cut_, ["_id", "_key", "_row"], by="_shard").drop("_row").withColumnRenamed("_index", "_slot")


def cut(sharded: DataFrame) -> DataFrame:
    """One row: groups of more than one row, groups that stand in several shards, and cut_edges (rows outside their group's fullest shard)."""
    parts = sharded.groupBy("_key", "_shard").agg(F.count(F.lit(1)).alias("n")).groupBy("_key").agg(F.sum("n").alias("all"), F.max("n").alias("most")).where(F.col("all") > 1)
    return parts.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("most") < F.col("all")).alias("split_groups"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut_edges"))
