"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds every string that stands in two places."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint_folder, chunks, eights, mix, pack_bytes, prepare, release, stored, unpack_bytes, utf8

#: Length in bytes of the strings that must not stand in two places.
LENGTH = 200
#: Depth in bytes to which the levels' suffix arrays are sorted.
DEPTH = 24
#: Batches in which a table is added to the index family.
BATCHES = 4
#: Input bytes for one shard of the index.
SHARD_BYTES = 16 << 20
#: Documents, and suffixes of each, from which the borders of the shards are taken: they only decide how even shards are.
BORDER_DOCUMENTS, BORDER_SUFFIXES = 2000, 64
#: Ranges of beginnings at most; where more shards are wanted, each range is cut further by hash.
RANGES = 1024
#: Suffixes that a task holds before it writes them.
FLUSH = 1 << 20
#: Candidate suffixes for one shard of contexts, and the contexts from which a shard is not compared in one task.
PER_SHARD = 20_000
CONTEXTS = 50_000
#: Bytes of one shard's positions that one task looks up.
LOOKUP_BYTES = 64 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    return pack_bytes(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def identity(id: str, text: str) -> list[Column]:
    """a and b, which tell documents apart: the id, or another hash of the text where there is none, and the text's hash."""
    value = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(id).cast("long"), F.xxhash64(F.lit(7), value)).alias("a"), F.xxhash64(F.col(id).isNull(), value).alias("b")]


# --- sampled suffixes ---


def sample(d: np.ndarray, o: np.ndarray, length: int = LENGTH, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes of documents (bytes ``d``, offsets ``o``): position, first and last start of the windows that it stands for,
    and a hash of its first ``depth`` bytes.

    Each window of ``length`` bytes is stood for by the suffix in it whose first ``depth`` bytes hash lowest (the leftmost of equal
    ones). The choice depends on the window's bytes alone, so equal windows choose equal suffixes at equal distances: a string stands in two
    places only if a sampled suffix begins alike in both. About 2 of (length - depth) suffixes are sampled.
    """
    none = np.zeros(0, np.int64)
    if len(d) < length:
        return none, none, none, none.astype(np.uint64)
    span, m = length - depth + 1, len(d) - depth + 1
    view, h = eights(d), np.zeros(m, np.uint64)
    for k in range(0, depth, 8):
        h = mix(h ^ view[k : k + m])
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // span)
    grid = np.full(rows * span, np.uint64(2**64 - 1))
    grid[:m] = packed
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()[:m]
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()[:m]
    low = np.minimum(back[: m - span + 1], ahead[span - 1 :])
    start, stop = o[:-1], o[1:] - length + 1
    has = stop > start
    edge = np.zeros(len(low) + 1, np.int8)
    np.add.at(edge, start[has], 1)
    np.add.at(edge, stop[has], -1)
    p = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(p):
        return none, none, none, none.astype(np.uint64)
    at = (low[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(p) - 1]])
    return at[new], p[new], p[last], h[at[new]]


def _keys(d: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` bytes of suffixes as rows of big-endian words, whose order is the bytes' order."""
    return np.ascontiguousarray(d[at[:, None] + np.arange(depth)]).view(">u8").astype(np.uint64)


def _key_hash(keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys), np.uint64)
    for j in range(keys.shape[1]):
        h = mix(h ^ keys[:, j])
    return h


def _sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different suffix beginnings in order, and the sums of their counts."""
    if not len(keys):
        return keys, n
    order = np.lexsort(keys.T[::-1])
    k = keys[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
    return k[new], np.add.reduceat(n[order], new)


def _borders(docs: DataFrame, text: str, id: str, shards: int, length: int, depth: int) -> list[int]:
    """Borders between ranges of beginnings (their first eight bytes), from a bounded sample of documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            d, o = utf8(batch, "_text")
            some = []
            for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                at, _, _, h = sample(d[a:b], np.array([0, b - a]), length, depth)
                some.append(_keys(d[a:b], at[np.argsort(h, kind="stable")[:BORDER_SUFFIXES]], depth)[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64))], names=["key"])

    some = bounded_sample(docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_id", BORDER_DOCUMENTS)
    keys = np.sort(np.array([r[0] for r in some.select("_text").mapInArrow(run, "key long").collect()], np.int64).view(np.uint64))
    if not len(keys):
        return []
    n = min(shards, RANGES)
    return np.unique(keys[np.arange(1, n) * len(keys) // n]).tolist()


RUNS = "batch int, part int, shard int, arr binary, docs binary, places binary"


def suffix_runs(docs: DataFrame, text: str, id: str, borders: list[int], subs: int, batches: int, length: int, depth: int) -> DataFrame:
    """Each task's suffixes by shard, in byte order: arr (different beginnings and counts), and docs and places (of all suffixes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0
        for batch in it:
            data, offsets = utf8(batch, "_text")
            a_, b_ = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            for a, b in chunks(offsets):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                at, lo, hi, _ = sample(d, o, length, depth)
                doc = np.searchsorted(o, at, "right") - 1
                held.append((_keys(d, at, depth), a_[a:b][doc], b_[a:b][doc], at - o[doc], at - lo, at - hi))
                size += len(at)
            if size >= FLUSH:
                yield from runs(part, held)
                held, size = [], 0
        if size:
            yield from runs(part, held)

    def runs(part: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, a, b, at, far, near = (np.concatenate([h[i] for h in held]) for i in range(6))
        shard = np.searchsorted(np.array(borders, np.uint64), keys[:, 0], "right").astype(np.int32) * np.int32(subs)
        if subs > 1:
            shard += (_key_hash(keys) % np.uint64(subs)).astype(np.int32)
        order = np.lexsort((*keys.T[::-1], shard))
        cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]]))
        rows = []
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            own = order[x:y]
            different, n = _sorted(keys[own], np.ones(len(own), np.int64))
            _, first, which = np.unique(np.stack([a[own], b[own]], 1), axis=0, return_index=True, return_inverse=True)
            some = own[first]
            rows.append((part % batches, part, int(shard[own[0]]), _pack(different.T, n), _pack(a[some], b[some]), _pack(np.repeat(np.arange(len(different)), n).astype(np.int32), which.ravel().astype(np.int32), at[own].astype(np.int64), far[own].astype(np.int16), near[own].astype(np.int16))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["batch", "part", "shard", "arr", "docs", "places"])

    return docs.select(*identity(id, text), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, RUNS)


def _array(blob: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(unpack_bytes(blob), np.uint64)
    n = len(raw) // (words + 1)
    return raw[: n * words].reshape(words, n).T, raw[n * words :].view(np.int64)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class IndexFamily:
    """Sparse suffix arrays of 1, 2, 4, ... batches in a folder that all executors share; a later session opens it and adds to it.

    A level is cut into shards by ranges of the suffixes' beginnings (and by hash, where there are more shards than ranges). In a shard it
    has the array of its different beginnings in byte order, and runs of positions in the same order: documents, places, and the
    windows that each suffix stands for. ``add`` merges a new batch's beginnings, scans them against every level in byte order for
    beginnings that stand there too, notes these, and merges levels of equal size, as a binary counter carries. So a beginning is
    rewritten about log2(batches) times, however many batches come; runs go over to the new level as they are.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH, depth: int = DEPTH):
        assert depth % 8 == 0 and depth <= length < 1 << 15
        self.spark, self.folder, self.words = spark, folder, depth // 8
        #: levels: number to (array's path, runs); runs and found: (path, batch in it)
        self.state = {"version": 0, "length": length, "depth": depth, "borders": None, "subs": 1, "levels": {}, "found": []}
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            newest = spark.read.schema("version int, state string").parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
            self.state = json.loads(newest["state"])

    def add_documents(self, docs: DataFrame, text: str = "text", id: str = "doc_id", batches: int = 1) -> None:
        """Add a table, in so many batches of its partitions. Its suffixes are sampled and sorted in one pass."""
        s = self.state
        if s["borders"] is None:  # the first table decides the shards
            total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
            shards = int(max(total // SHARD_BYTES, 8))
            s["borders"] = _borders(docs, text, id, shards, s["length"], s["depth"])
            s["subs"] = -(-shards // RANGES)
        path = f"{self.folder}/runs-{uuid.uuid4().hex}"
        suffix_runs(docs, text, id, s["borders"], s["subs"], batches, s["length"], s["depth"]).write.parquet(path)
        for k in range(batches):
            self.add(path, k)

    def _runs(self, runs: list) -> DataFrame:
        out = None
        for path, batch in runs:
            one = self.spark.read.schema(RUNS).parquet(path).where(F.col("batch") == batch)
            out = one if out is None else out.union(one)
        return out

    def runs(self) -> DataFrame:
        """The positions of all levels."""
        return self._runs([r for _, runs in self.state["levels"].values() for r in runs])

    def found(self) -> DataFrame:
        """Beginnings (hashed) that stand in two places: shard, arr."""
        out = self.spark.read.schema("shard int, found boolean, arr binary").parquet(*self.state["found"])
        return out.where("found").select("shard", "arr")

    def add(self, path: str, batch: int) -> None:
        """Add one batch of the runs in ``path``."""
        words, s = self.words, self.state
        levels = {int(k): v for k, v in s["levels"].items()}
        carry = 0
        while carry in levels:
            carry += 1
        whole = self._runs([(path, batch)]).select("shard", "arr", F.lit(-1).alias("level"))
        for k, (array, _) in levels.items():
            whole = whole.union(self.spark.read.schema("shard int, found boolean, arr binary").parquet(array).where("not found").select("shard", "arr", F.lit(k).alias("level")))

        def scan(table: pa.Table) -> pa.Table:
            shard, rows = table["shard"][0].as_py(), list(zip(table["level"].to_pylist(), table["arr"].to_pylist(), strict=True))
            none = np.zeros((0, words), np.uint64)
            new = [_array(b, words) for k, b in rows if k < 0]
            old = [(k, np.frombuffer(unpack_bytes(b), np.uint64).reshape(words, -1).T) for k, b in rows if k >= 0]
            own, n = _sorted(np.concatenate([none, *(x for x, _ in new)]), np.concatenate([np.zeros(0, np.int64), *(m for _, m in new)]))
            # one scan over the new beginnings and all levels': low bits count new suffixes, high bits levels
            every, count = _sorted(np.concatenate([own, *(x for _, x in old)]), np.concatenate([n, *(np.full(len(x), 1 << 40) for _, x in old)]))
            fresh = count & ((1 << 40) - 1)
            again = every[(fresh > 1) | ((fresh > 0) & (count >= 1 << 40))]
            merged = np.concatenate([own, *(x for k, x in old if k < carry)])
            level, _ = _sorted(merged, np.ones(len(merged), np.int64))
            return pa.table({"shard": pa.array([shard] * 2, pa.int32()), "found": [False, True], "arr": pa.array([_pack(level.T), _pack(_key_hash(again))], pa.binary())})

        out = f"{self.folder}/scan-{uuid.uuid4().hex}"
        whole.groupBy("shard").applyInArrow(scan, "shard int, found boolean, arr binary").write.parquet(out)
        runs = [[path, batch]]
        for k in range(carry):
            runs += levels.pop(k)[1]
        levels[carry] = [out, runs]
        s |= {"version": s["version"] + 1, "levels": levels, "found": [*s["found"], out]}
        self.spark.createDataFrame([(s["version"], json.dumps(s))], "version int, state string").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        release(self.spark)

    def drop(self) -> None:
        _delete(self.spark, self.folder)


# --- contexts of suffixes that begin alike ---

CANDIDATES = "a long, b long, place long, far int, near int"


def _candidates(runs: DataFrame, found: DataFrame, lookup: int, words: int) -> DataFrame:
    """Places of all suffixes whose beginning was found twice. A shard is looked up in as many tasks as its size asks for, so that a
    beginning that very many documents share is spread over tasks.
    """
    size = runs.groupBy("shard").agg(F.sum(F.length("places") + F.length("docs")).alias("bytes")).select("shard", F.ceil(F.col("bytes") / lookup).cast("int").alias("salts"))
    empty = F.lit(None).cast("binary")
    asked = found.join(size.hint("shuffle_hash"), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = asked.select("shard", "salt", F.lit(0).alias("kind"), F.col("arr"), empty.alias("docs"), empty.alias("places"))
    held = runs.join(size.hint("shuffle_hash"), "shard").select("shard", F.pmod(F.col("part"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"), "arr", "docs", "places")
    together = asked.union(held).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for batch in it:
            for shard, salt, kind, arr, docs, places in zip(*(batch.column(i) for i in range(6)), strict=True):
                if (now := (shard.as_py(), salt.as_py())) != key:
                    key, known = now, []
                if kind.as_py() == 0:
                    known.append(np.frombuffer(unpack_bytes(arr.as_py()), np.uint64))
                    continue
                table = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
                known = [table]
                keys, _ = _array(arr.as_py(), words)
                is_in = np.isin(_key_hash(keys), table)
                raw = unpack_bytes(places.as_py())
                n = len(raw) // 20
                which, doc = (np.frombuffer(raw, np.int32, n, 4 * n * i) for i in range(2))
                at = np.frombuffer(raw, np.int64, n, 8 * n)
                far, near = (np.frombuffer(raw, np.int16, n, 16 * n + 2 * n * i) for i in range(2))
                a, b = np.frombuffer(unpack_bytes(docs.as_py()), np.int64).reshape(2, -1)
                take = np.flatnonzero(is_in[which])
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(a[doc[take]]), pa.array(b[doc[take]]), pa.array(at[take]), pa.array(far[take].astype(np.int32)), pa.array(near[take].astype(np.int32))], names=["a", "b", "place", "far", "near"])

    return together.mapInArrow(run, CANDIDATES)


CONTEXT = "shard int, n int, settled boolean, blob binary"
_PLACE = np.dtype([("a", "<i8"), ("b", "<i8"), ("place", "<i8"), ("far", "<i2"), ("near", "<i2"), ("twice", "?")])
_SPAN = np.dtype([("a", "<i8"), ("b", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _packed_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with their last column, _text, compressed: texts shuffle at about two thirds of what the shuffle's own compression leaves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed = pa.array([pack_bytes(b) for b in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(run, ", ".join([*kinds, "_text binary"]))


def _contexts(docs: DataFrame, candidates: DataFrame, text: str, id: str, shards: int, length: int, depth: int) -> DataFrame:
    """The windows of candidate suffixes, as one string for each, by shard; those that are equal within a task are settled there."""
    # a set: rows that repeat an id and a text have the same places, each of which is noted once
    places = candidates.groupBy("a", "b").agg(F.collect_set(F.struct("place", "far", "near")).alias("places"))
    rows = _packed_texts(docs.select(*identity(id, text), F.coalesce(F.col(text), F.lit("")).alias("_text")))
    # rows that repeat are two places of all their strings
    joined = rows.join(places.hint("shuffle_hash"), ["a", "b"]).select("a", "b", "places", "_text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for a, b, at, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw, v = unpack_bytes(t), at.values
                for place, far, near in zip(*(v.field(i).to_pylist() for i in range(3)), strict=True):
                    c = raw[place - far : place - near + length]
                    held.append((c, far, near, a, b, place))
                    size += len(c)
            if size > 32 << 20:
                yield from write(held)
                held, size = [], 0
        if held:
            yield from write(held)

    def write(held: list) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        count = [0] * len(held)
        for i, h in enumerate(held):
            count[seen.setdefault(h[:2], i)] += 1
        first = sorted(seen.values())
        # of rows that repeat, one span will do
        again = list(dict.fromkeys((a, b, place - far, place - near + length) for c, far, near, a, b, place in held if count[seen[c, far]] > 1))
        rows = [(-1, len(again), True, _pack(np.array(again, _SPAN)))] if again else []
        by: dict[int, list[int]] = {}
        for i in first:
            c, far = held[i][0], held[i][1]
            k = int.from_bytes(hashlib.blake2b(c[far : far + depth], digest_size=8).digest(), "little") % shards
            by.setdefault(k, []).append(i)
        for k, own in by.items():
            places = np.array([(a, b, place, far, near, count[i] > 1) for i in own for _, far, near, a, b, place in (held[i],)], _PLACE)
            rows.append((k, len(own), False, len(own).to_bytes(8, "little") + _pack(places, np.frombuffer(b"".join(held[i][0] for i in own), np.uint8))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["shard", "n", "settled", "blob"])

    return joined.mapInArrow(run, CONTEXT)


def _read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(blob[:8], "little"), unpack_bytes(blob[8:])
    return np.frombuffer(raw, _PLACE, n), np.frombuffer(raw, np.uint8, offset=n * _PLACE.itemsize)


def _ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bytes in order: the order, the length of the beginning that each shares with the row before it (0 for the first), and the
    longest that each row (in its old place) shares with any other."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    sorted_ = rows[order]
    differ = sorted_[1:] != sorted_[:-1]
    shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)])
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    return order, shared, longest


def repeated(places: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Spans of the windows that stand in two of the contexts (``data``, one after another; at least one).

    The suffixes that the contexts are about are sorted by what follows them, and by what stands before them, read backwards, each with
    the lengths that neighbours share. Two windows at a distance o before their suffixes are equal if the ``length`` - o bytes that
    follow and the o bytes before are: if no neighbours between them share less. Only distances that a suffix's longest shared
    lengths allow are looked at. Bytes of other contexts, which stand beyond a context's ends, order suffixes but are never within such a length.
    """
    far, near = places["far"].astype(np.int64), places["near"].astype(np.int64)
    size = far - near + length
    at = np.cumsum(size) - size + far
    after, before = length - int(near.min()), max(int(far.max()), 1)
    ahead = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(after, np.uint8)), after)
    back = np.lib.stride_tricks.sliding_window_view(np.append(data[::-1], np.zeros(before, np.uint8)), before)
    order, shared, most = _ordered(ahead[at])
    order_, shared_, most_ = _ordered(back[len(data) - at])
    low, high = np.maximum(near, length - most), np.minimum(far, most_)
    mark = np.zeros((len(places), int(far.max()) + 1), bool)
    for o in range(int(low.min()), int(high.max()) + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        follows, precedes = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        follows[order] = np.cumsum(shared < length - o)
        precedes[order_] = np.cumsum(shared_ < o)
        both = precedes[own] * (len(places) + 1) + follows[own]
        by = np.argsort(both, kind="stable")
        same = np.flatnonzero(both[by[1:]] == both[by[:-1]])
        mark[own[by[same]], o] = mark[own[by[same + 1]], o] = True
    return _spans(places, mark, length)


def _spans(places: np.ndarray, mark: np.ndarray, length: int) -> np.ndarray:
    wide = np.zeros((len(places), mark.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mark
    wide[places["twice"]] = 0  # settled before
    step = np.diff(wide, axis=1)
    row, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    out = np.zeros(len(row), _SPAN)
    for name in ("a", "b"):
        out[name] = places[name][row]
    out["start"], out["end"] = places["place"][row] - (hi - 1), places["place"][row] - lo + length
    return out


SPANS = "a long, b long, start long, end long"


def _span_batch(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in _SPAN.names], names=list(_SPAN.names))


def _compare(contexts: DataFrame, length: int, most: int) -> DataFrame:
    """Spans that stand elsewhere too."""

    def settled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for blob in batch.column(0).to_pylist():
                yield _span_batch(np.frombuffer(unpack_bytes(blob), _SPAN))

    def shard(table: pa.Table) -> pa.Table:
        got = [_read(b) for b in table["blob"].to_pylist()]
        spans = repeated(np.concatenate([p for p, _ in got]), np.concatenate([d for _, d in got]), length)
        return pa.Table.from_batches([_span_batch(spans)])

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for blob in batch.column(0).to_pylist():
                places, data = _read(blob)
                far, near = places["far"].astype(np.int64), places["near"].astype(np.int64)
                size = far - near + 1
                row = np.repeat(np.arange(len(places)), size)
                o = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + near[row]
                start = np.concatenate([[0], np.cumsum(size + length - 1)[:-1]])[row] + far[row] - o
                raw = data.tobytes()
                for x in range(0, len(row), 1 << 15):
                    cut = slice(x, x + (1 << 15))
                    wide = [hashlib.blake2b(raw[q : q + length], digest_size=16).digest() for q in start[cut].tolist()]
                    p = places[row[cut]]
                    yield pa.RecordBatch.from_arrays([pa.array(wide, pa.binary()), pa.array(p["a"]), pa.array(p["b"]), pa.array(p["place"] - o[cut]), pa.array(p["twice"])], names=["window", "a", "b", "start", "twice"])

    sizes = contexts.where("not settled").groupBy("shard").agg(F.sum("n").alias("total"))
    rest = contexts.where("not settled").join(sizes.hint("shuffle_hash"), "shard")
    out = contexts.where("settled").select("blob").mapInArrow(settled, SPANS)
    out = out.union(rest.where(F.col("total") <= most).select("shard", "blob").groupBy("shard").applyInArrow(shard, SPANS))
    # a beginning with more contexts than one task can hold: its windows are counted by their digests, combined before they are shuffled
    each = rest.where(F.col("total") > most).select("blob").mapInArrow(windows, "window binary, a long, b long, start long, twice boolean")
    twice = each.groupBy("window").agg((F.count(F.lit(1)) + F.max(F.col("twice").cast("int"))).alias("m")).where("m > 1").select(F.col("window").alias("_w"))
    hot = each.where("not twice").join(twice, F.col("window") == F.col("_w")).select("a", "b", "start", (F.col("start") + length).alias("end"))
    return out.union(hot)


# --- the operator ---


def repeats(family: IndexFamily, docs: DataFrame, text: str = "text", id: str = "doc_id", most: int = CONTEXTS) -> DataFrame:
    """Spans of documents that strings of the family's length cover which start at another place too: a, b (see ``identity``) and spans
    (start, end). ``docs``: all documents that were added to the family.
    """
    spark, length, depth = family.spark, family.state["length"], family.state["depth"]
    candidates = stored(_candidates(family.runs(), family.found(), LOOKUP_BYTES, depth // 8))
    groups = max(candidates.count() // PER_SHARD, 8)
    contexts = stored(_contexts(docs, candidates, text, id, groups, length, depth))
    del candidates
    release(spark)
    spans = stored(_compare(contexts, length, most))
    del contexts
    release(spark)
    return spans.groupBy("a", "b").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def suffix_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, batches: int = BATCHES, most: int = CONTEXTS) -> DataFrame:
    """All rows and columns of ``docs``, the text being what is kept, with _n_bytes, _n_removed, _n_spans and _kept_sha256: each byte goes
    that a string of ``length`` bytes covers which also starts anywhere else, in the same document or another; all occurrences go.

    1. Suffixes are sampled (``sample``), sorted by each task, and added to an ``IndexFamily`` in batches.
    2. Suffixes that begin alike in two places are looked up, and their windows are cut out of the texts.
    3. The suffixes are sorted to full length in both directions, and shared lengths tell which windows are equal (``repeated``). A
       shard of more than ``most`` contexts is too large for a task: its windows are counted by 128-bit digests, with the same result.
    4. Spans are joined in each document and removed.

    Strings are those of the input, matches don't cross documents, and null texts are empty and become empty. Rows that repeat an id and
    a text are two places; null ids are documents too. The kept text leaves out parts of characters that a cut leaves; the digest is of the
    bytes as they remain. An empty table gives an empty result. Columns that clash with the four names are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    family = IndexFamily(spark, f"{checkpoint_folder(spark)}/suffixes-{uuid.uuid4().hex}", length)
    family.add_documents(docs, text, id, batches)
    found = repeats(family, docs, text, id, most)
    family.drop()
    names = [c for c in docs.columns if c not in ("_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")]
    at, value = names.index(text), F.coalesce(F.col(text), F.lit(""))
    other = [c for c in names if c != text]
    rows = _packed_texts(docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("_row"), *identity(id, text), value.alias("_text")))
    joined = rows.join(found.hint("shuffle_hash"), ["a", "b"], "left").select("_row", "spans", "_text")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, removed, runs, digest, kept = [], [], [], [], []
            row = batch.column(0)
            for t, spans in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
                b, end, parts = unpack_bytes(t), 0, []
                k = 0
                if spans.is_valid:
                    v = spans.values
                    for lo, hi in sorted(zip(v.field(0).to_pylist(), v.field(1).to_pylist(), strict=True)):
                        if lo > end or not k:
                            parts.append(b[end:lo])
                            k += 1
                        end = max(end, hi)
                parts.append(b[end:])
                rest = b"".join(parts)
                n.append(len(b))
                removed.append(len(b) - len(rest))
                runs.append(k)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append("".join(p.decode("utf-8", "ignore") for p in parts))
            fields = [row.field(i) for i in range(len(other))]
            fields.insert(at, pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, names=names), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(digest, pa.string())], names=["_row", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"])

    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")).schema["_row"].dataType.simpleString()
    return joined.mapInArrow(cut, f"_row {kind}, _n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string").select("_row.*", "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
