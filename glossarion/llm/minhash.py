"""MinHash near-dedup with min-max hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, pack_bytes, prepare, release, span_hash, stored, unpack_bytes, utf8, windows_hash, words
from .components import components

WORDS = 5
#: Values of a band, and bands. Each permutation gives two values, its least and its greatest.
ROWS, BANDS = 5, 26
#: Documents of a candidate group that are linked in one task; larger groups are split into blocks of this size.
BLOCK = 1024


#: Shingles of texts of so many bytes are kept for the next comparison; those of longer ones are made anew, as a few would fill a task's memory.
CACHED = 1 << 14
#: A hot key of a join is spread over so many salts.
SALTS = 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Each document's sorted different 64-bit shingle hashes; fewer words than ``size`` are one shingle, none are none."""
    out: list[np.ndarray] = []
    for a, b in chunks(offsets):
        d, o = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        start, end, first = words(d, o)
        w = span_hash(d, start, end)
        g = windows_hash(w, size)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            out.append(np.unique(g[first[i] : first[i + 1] - size + 1]) if n >= size else windows_hash(w[first[i] : first[i + 1]], int(n))[: min(n, 1)])
    return out


def normalised(text: bytes) -> bytes:
    """The lower-cased words with one blank between them: texts that are equal here have equal shingles."""
    return b" ".join(text.lower().split())


def whole_shingles(text: bytes, size: int = WORDS) -> frozenset[bytes]:
    """The shingles of a normalised text as they are; words have no blanks, so joining them loses nothing."""
    w = text.split()
    return frozenset(b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """Band hashes of non-empty sets. A permutation is evaluated once and gives its minimum and its maximum, each of which two sets share
    with the probability of their similarity; the two are negatively correlated, so that a signature of both varies less.
    """
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = -(-rows * bands // 2)
    a, c = _permutations(n)
    values = np.empty((2 * n, len(sets)), np.uint64)
    done = 0
    while done < len(sets):  # so many elements at once that they stay in the cache
        stop = max(done + 1, int(np.searchsorted(at, at[done] + (1 << 16), "right")) - 1) if at[-1] > at[done] + (1 << 16) else len(sets)
        x = np.concatenate(sets[done:stop])
        bounds = at[done:stop] - at[done]
        y, z = np.empty_like(x), np.empty_like(x)
        with np.errstate(over="ignore"):
            for i in range(n):
                np.multiply(x, a[i], out=y)
                np.right_shift(y, np.uint64(29), out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, a[i] ^ c[i] | np.uint64(1), out=y)
                values[2 * i, done:stop] = np.minimum.reduceat(y, bounds)
                values[2 * i + 1, done:stop] = np.maximum.reduceat(y, bounds)
        done = stop
    out = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands):
            h = np.full(len(sets), np.uint64(k + 1))
            for j in range(rows):
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + values[(k + j * bands) % (2 * n)])
            out[:, k] = h
    return out


def _class(text: bytes) -> bytes:
    """128-bit digest of a normalised text; empty for a text without words."""
    return hashlib.blake2b(text, digest_size=16).digest() if text else b""


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = utf8(batch, name)
    raw = memoryview(np.ascontiguousarray(data))
    return data, offsets, [normalised(bytes(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _sketch(docs: DataFrame, text: str, id: str, rows: int, bands: int) -> DataFrame:
    """id, key (hash of the text), n (set size), set (digest of its words; empty without words), bands (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, texts = _texts(batch, "_text")
            sets = shingles(data, offsets)
            full = [i for i, x in enumerate(sets) if len(x)]
            size = np.array([bands if len(x) else 0 for x in sets], np.int32)
            flat = signatures([sets[i] for i in full], rows, bands).view(np.int64).ravel() if full else np.zeros(0, np.int64)
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([_class(t) for t in texts], pa.binary()), hashes], names=["id", "key", "n", "set", "bands"])

    return docs.select(F.col(id).cast("long").alias("id"), text_key(text).alias("key"), F.col(text).alias("_text")).mapInArrow(run, "id long, key long, n long, set binary, bands array<long>")


def text_key(text: str) -> Column:
    """What tells rows of one id, or without one, apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted sets without repeats."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def link(texts: list[bytes], bands: np.ndarray, percent: int, label: np.ndarray, left: int | None = None) -> list[tuple[int, int]]:
    """Links that join all documents (normalised texts) which share a band and are similar, without those that join nothing new.

    ``label``: documents of one label are joined already. ``left``: only pairs of one of the first ``left`` documents and one of the
    others. Pairs are looked at within each band's documents; joined documents are skipped, and a pair is compared once: by its
    shingles' hashes, and if these are similar, by the shingles themselves. Memory: a byte for each pair of the task's documents, which
    are at most two blocks, their sets, and the shingles of 256 texts of at most ``CACHED`` bytes and of the two that are compared.
    """
    n, found = len(texts), []
    sets = shingles(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    cached = lru_cache(maxsize=256)(lambda i: whole_shingles(texts[i]))
    whole = lambda i: cached(i) if len(texts[i]) <= CACHED else whole_shingles(texts[i])
    size = np.array([len(x) for x in sets])
    _, group = np.unique(label, return_inverse=True)  # the component of each document, renamed as components join
    side = np.zeros(n, np.int8) if left is None else (np.arange(n) >= left).astype(np.int8)
    open_ = np.ones((n, n), bool) if left is None else side[:, None] != side[None, :]  # pairs that may be compared
    order = np.argsort(bands, axis=None, kind="stable")
    keys, doc = bands.ravel()[order], order // bands.shape[1]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    shared = {doc[a:b].tobytes(): doc[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1}
    for members in sorted(shared.values(), key=len):
        if (group[members] == group[members[0]]).all():
            continue
        for k, i in enumerate(members[:-1]):
            rest = members[k + 1 :]
            rest = rest[open_[i, rest] & (group[rest] != group[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
            for j in rest:
                if group[j] == group[i]:
                    continue
                open_[i, j] = open_[j, i] = False
                if similar(sets[i], sets[j], percent) and _alike(whole(int(i)), whole(int(j)), percent):
                    group[group == group[j]] = group[i]
                    found.append((int(i), int(j)))
    return found


def _alike(x: frozenset[bytes], y: frozenset[bytes], percent: int) -> bool:
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, percent: int = 80, text: str = "text", id: str = "doc_id", rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component_id, kept, key (``text_key``) and first for every row of ``docs``: documents are linked if 100 times the
    size of the intersection of their shingle sets is at least ``percent`` times that of the union.

    1. One pass makes each document's set, a digest of its words and its band hashes from min-max signatures; texts are not kept.
    2. Documents of the same words are one class, with or without ids, and numbered. Classes that share a band are candidates, and
       connected candidates form a group (components over links from each class to the least class of its band, never all pairs).
    3. Texts of classes in groups are fetched. A group of up to ``block`` classes is linked in one task; a larger one is cut into
       blocks by hash, and each is linked in a task, alone and with the next. Where classes that share a band are then still apart, the
       band's classes are compared (in pairs of blocks that hold any, if they are many). A task compares only classes that are still
       apart, their shingles' hashes first and the shingles themselves before it links. So no candidate is dropped however large
       its group is, and a class goes to the tasks of its own bands and not to all of its group.
    4. Links give components, each named by its least id.

    The first row of a component has its least id, which any id is before null, and then the least key; only rows that repeat it are first
    as well. ``kept`` have all rows of the least id, and of a component without ids the first. Null texts and texts without words have the
    empty set, and each is a component of its own. A component of null ids only has the id null. Rows that repeat belong to one class. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    sketch = stored(_sketch(docs, text, id, rows, bands))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = sketch.where("n > 0").groupBy("set").agg(F.min(place).alias("first"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    band_rows = classes.select("rep", F.explode("bands").alias("band"))
    least = band_rows.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select(F.col("band").alias("b"), "low")
    star = stored(band_rows.join(least, F.col("band") == F.col("b")).where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    release(spark)
    groups = components(star).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    members = stored(_blocks(groups.join(classes.select("rep", "set", "bands", "first.id", "first.key"), "rep"), block))
    release(spark)
    linked = _linked(_with_texts(docs, members, text, id), percent, block).join(classes.select("rep", "first"), "rep")
    least = linked.groupBy("component").agg(F.min("first").alias("_least"))
    linked = _salted(linked, least, "component").select("rep", "_least")
    named = classes.select("set", "rep", "first").join(linked, "rep", "left").select(F.col("set").alias("_set"), F.coalesce("_least", "first").alias("_first"))
    release(spark)
    first = F.coalesce("_first", place)
    same_id, same_key = F.col("id").eqNullSafe(first["id"]), F.col("key") == first["key"]
    return sketch.join(stored(named), F.col("set") == F.col("_set"), "left").select(
        "id", F.col("n").alias("n_shingles"), first["id"].alias("component_id"), (same_id & (F.col("id").isNotNull() | same_key)).alias("kept"), "key", (same_id & same_key).alias("first")
    )


def _salted(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (which have rep) joined with ``few`` on ``key``, the rows of each key being spread over the salts."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(spread, [key, "_salt"], how).drop("_salt")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` with blocks (of their group) and at (their own); only groups of more than one block are joined."""
    large = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("group", F.ceil(F.col("_n") / block).cast("int").alias("blocks"))
    joined = _salted(members, large, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return joined.withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def _with_texts(docs: DataFrame, members: DataFrame, text: str, id: str) -> DataFrame:
    """``members`` with their normalised texts (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            _, _, texts = _texts(batch, "_text")
            rep, want = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # another text of the same hash is not the one that was asked for, and of rows that repeat one will do
            keep = [i for i, t in enumerate(texts) if rep[i] not in seen and _class(t) == want[i] and not seen.add(rep[i])]
            take = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column(0), *(take.column(k) for k in range(2, 6)), pa.array([pack_bytes(texts[i]) for i in keep], pa.binary())], names=["rep", "group", "bands", "blocks", "at", "words"])

    asked = members.select(F.col("rep").alias("_rep"), "set", "group", "bands", "blocks", "at", F.col("id").alias("_of"), F.col("key").alias("_asked"))
    rows = docs.select(F.col(id).cast("long").alias("_id"), text_key(text).alias("_key"), F.col(text).alias("_text"))
    rows = rows.join(asked.hint("shuffle_hash"), (F.col("_key") == F.col("_asked")) & F.col("_id").eqNullSafe(F.col("_of"))).select("_rep", "set", "group", "bands", "blocks", "at", "_text")
    return rows.mapInArrow(run, "rep long, group long, bands array<long>, blocks int, at int, words binary")


def _linked(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """rep and component of all classes that similar candidates of their group join."""
    spark = rows.sparkSession
    rows = stored(rows)
    at, n = F.col("at"), F.col("blocks")
    # each block alone, and with the next; most groups are one block
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    near = F.array_distinct(F.array(pair(at, at), pair(at, F.pmod(at + 1, n)), pair(F.pmod(at - 1, n), at)))
    first = rows.withColumns({"label": F.col("rep"), "p": F.explode(near)}).withColumns({"i": F.col("p.i"), "j": F.col("p.j")})
    known = components(stored(_run(first, percent))).select(F.col("node").alias("rep"), "component")
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return known
    now = large.select("rep", "group", "bands").join(known.hint("shuffle_hash"), "rep", "left").select("rep", "group", F.coalesce("component", "rep").alias("label"), "bands")
    each = stored(now.select("rep", "group", "label", F.explode("bands").alias("band")))
    pairs = stored(_open_pairs(each, block))
    more = stored(_run(pairs.join(rows.select("rep", "words"), "rep"), percent))
    release(spark)
    if more.isEmpty():
        return known
    return components(known.toDF("a", "b").union(more)).select(F.col("node").alias("rep"), "component")


def _open_pairs(each: DataFrame, block: int) -> DataFrame:
    """Where classes (rep, group, label, band) of one band have different labels: its rows, dealt to pairs (i, j) of the band's blocks.

    Pairs of blocks in which all classes have the band's most frequent label are left out.
    """
    count = each.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"))
    bands = count.groupBy("band").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    bands = bands.select("band", "main", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    open_ = _salted(each, bands, "band").withColumn("at", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    rest = open_.where("label <> main").groupBy("band").agg(F.collect_set("at").alias("rest"))  # numbers of blocks
    placed = _salted(open_.drop("main"), rest, "band")
    at, n = F.col("at"), F.col("blocks")
    other = F.when(F.array_contains("rest", at), F.sequence(F.lit(0), n - 1)).otherwise(F.col("rest"))
    pairs = placed.withColumn("k", F.explode(other)).withColumns({"i": F.least("at", "k"), "j": F.greatest("at", "k")})
    return pairs.select("rep", F.col("band").alias("group"), F.array("band").alias("bands"), "label", "at", "i", "j")


def _run(rows: DataFrame, percent: int) -> DataFrame:
    def task(table: pa.Table) -> pa.Table:
        t = table.sort_by("rep").to_pydict()
        order = sorted(range(len(t["rep"])), key=lambda k: (t["at"][k] != t["i"][k], t["rep"][k]))
        bands = np.array([t["bands"][k] for k in order], np.int64)
        rep = [t["rep"][k] for k in order]
        left = None if t["i"][0] == t["j"][0] else sum(t["at"][k] == t["i"][k] for k in order)
        found = link([unpack_bytes(t["words"][k]) for k in order], bands, percent, np.array([t["label"][k] for k in order]), left)
        return pa.table({"a": pa.array([rep[i] for i, _ in found], pa.int64()), "b": pa.array([rep[j] for _, j in found], pa.int64())})

    # dealt by block pair: the joins before have dealt the rows by group, which would do for the grouping and put all pairs of a group in one task
    dealt = rows.select("group", "i", "j", "at", "rep", "label", "bands", "words").repartition("group", "i", "j")
    return dealt.groupBy("group", "i", "j").applyInArrow(task, "a long, b long")
