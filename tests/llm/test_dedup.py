"""Exact, near and suffix dedup, and sharding, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from glossarion.llm import exact_dedup, minhash, sharding, suffix_dedup
from glossarion.llm.components import components

from . import helpers


@pytest.fixture(scope="module")
def rows():
    return helpers.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, helpers.DDL).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], helpers.DDL)


def test_exact(docs, rows):
    got = exact_dedup.exact_dedup(docs.withColumnRenamed("source", "_keep").withColumnRenamed("lang", "_d")).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        ids = groups[r["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["_keep_id"], r["_group_size"], r["_kept"]) == (keep, len(ids), r["doc_id"] == keep)
        assert r["_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_exact_compares_texts_where_a_digest_has_several(docs, rows):
    """A digest that is the length only: the result is that of the texts."""
    from pyspark.sql import functions as F

    more = helpers.clashing(docs, "_own", "_found", "_won", "_row", "_id", "_s", "_t", "_n", "_salts")
    want = Counter((r["doc_id"], r["text"], r["_keep_id"], r["_group_size"], r["_kept"]) for r in exact_dedup.exact_dedup(docs).collect())
    got = exact_dedup.exact_dedup(more, digest=lambda t: F.length(t).cast("string"))
    assert set(more.columns) < set(got.columns)
    assert Counter((r["doc_id"], r["text"], r["_keep_id"], r["_group_size"], r["_kept"]) for r in got.collect()) == want


def test_different_words_of_one_polynomial_hash_are_not_linked(spark):
    x, y = helpers.thue_morse(10)
    rows = [(1, x, "en", "s", 1), (2, y, "en", "s", 1), (3, f"a b {x} c d e f", "en", "s", 1), (4, f"a b {y} c d e f", "en", "s", 1), (5, x.upper(), "en", "s", 1)]
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, helpers.DDL), 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_links_are_confirmed_on_words(monkeypatch):
    """Where the hashes say that two sets are equal, the words decide."""
    texts = [b"a b c d e f", b"a b c d e g", b"a b c d e f h"]
    monkeypatch.setattr(minhash, "similar", lambda x, y, percent: True)
    bands = np.zeros((3, 1), np.int64)
    assert minhash.link(texts, bands, 60, np.arange(3)) == [(0, 2)]


def test_links_do_not_depend_on_what_is_kept(monkeypatch):
    """Long texts, whose shingles are made anew for each comparison, are linked like short ones."""
    rng, texts = random.Random(3), []
    for _ in range(6):
        base = helpers.words(rng, 80).split()
        for k in range(4):
            base[rng.randrange(80)] = f"z{k}"
            texts.append(minhash.normalised(" ".join(base).encode()))
    data = np.frombuffer(b"".join(texts), np.uint8)
    bands = minhash.signatures(minhash.shingles(data, np.cumsum([0, *map(len, texts)]))).view(np.int64)
    want = minhash.link(texts, bands, 80, np.arange(len(texts)))
    assert len(want) >= 12
    monkeypatch.setattr(minhash, "CACHED", 0)
    assert minhash.link(texts, bands, 80, np.arange(len(texts))) == want


def test_near_columns(docs):
    more = helpers.clashing(docs, "id", "key", "n", "set", "bands", "rep", "group", "_text", "_id", "_key")
    plain = Counter(map(tuple, minhash.near_duplicates(docs).collect()))
    assert Counter(map(tuple, minhash.near_duplicates(more).collect())) == plain


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [1024, 8])
def test_near(docs, rows, percent, block):
    """Blocks of 8 classes make the chain of near copies a group that is too large for one task."""
    got = minhash.near_duplicates(docs, percent, block=block).collect()
    assert len(got) == len(rows)
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(helpers.shingles(t))
    known = [(i, s) for i, ss in sets.items() for s in ss]
    pairs = [(i, j) for a, (i, s) in enumerate(known) for j, x in known[:a] if s and x and 100 * len(s & x) >= percent * len(s | x)]
    want = helpers.components(pairs, sets)
    assert 60 in want.values() and sum(c == 60 for c in want.values()) == 30
    by_set = {s: want[i] for i, s in sorted(known, reverse=True)}
    sizes = Counter((r["id"], r["n_shingles"]) for r in got)
    assert sizes == Counter((i, len(helpers.shingles(t))) for i, t, *_ in rows)
    for r in got:
        if r["id"] is not None:
            assert r["component_id"] == want[r["id"]] and r["kept"] == (want[r["id"]] == r["id"])
    null = [r["component_id"] for r in got if r["id"] is None]
    assert sorted(null, key=str) == sorted([by_set.get(helpers.shingles(rows[5][1])), None], key=str)


def test_shingles_of_few_words():
    """A chunk of few words in all: a table of one document, and one that a long document puts in a chunk of its own."""
    big = "ab " * 400_000
    for n in range(7):
        text = " ".join("abcdefg"[:n])
        for before in ((), (big,)):
            data = [t.encode() for t in (*before, text)]
            got = minhash.shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
            assert [len(x) for x in got] == [len(helpers.shingles(t)) for t in (*before, text)]


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    a = minhash.signatures([x, y], rows=1, bands=2000)
    assert abs((a[0] == a[1]).mean() - want) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 1, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_suffix(rows, length=200):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = Counter()
    for (i, *_), b in zip(rows, texts, strict=True):
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[(i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("batches", "most"), [(4, 50_000), (1, 50_000), (5, 3)])
def test_suffix(docs, rows, batches, most):
    """most=3: the shards' windows are counted instead of being compared in one task."""
    got = suffix_dedup.suffix_dedup(docs.withColumnRenamed("source", "_content").withColumnRenamed("lang", "a"), batches=batches, most=most)
    assert got.columns[:5] == ["doc_id", "text", "a", "_content", "n_chars"]
    found = got.collect()
    assert Counter((r["doc_id"], r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"]) for r in found) == brute_suffix(rows)
    for r in found:
        assert "�" not in r["text"] and len(r["text"].encode()) <= r["_n_bytes"] - r["_n_removed"]


def test_suffix_batches_added_one_after_another(spark, rows, tmp_path):
    """Three tables are added to one index, which is opened anew for each; equal-sized levels merge; all matches are found."""
    data = [r for r in rows if r[0] != 113]
    tables = [spark.createDataFrame(data[k::3], helpers.DDL) for k in range(3)]
    levels = []
    for t in tables:
        family = suffix_dedup.IndexFamily(spark, str(tmp_path / "index"))
        family.add_documents(t)
        levels.append(sorted(map(int, family.state["levels"])))
    assert levels == [[0], [1], [0, 1]]
    family = suffix_dedup.IndexFamily(spark, str(tmp_path / "index"))
    for _, (array, runs) in family.state["levels"].items():  # beginnings stand in byte order, in shards and from shard to shard
        shards = spark.read.parquet(array).where("not found").orderBy("shard").collect()
        keys = [tuple(k) for r in shards for k in np.frombuffer(suffix_dedup.unpack_bytes(bytes(r["arr"])), np.uint64).reshape(3, -1).T.tolist()]
        assert keys == sorted(set(keys)) and len(runs) in (1, 2)
    whole = tables[0].union(tables[1]).union(tables[2])
    found = {(r["a"], r["b"]): r["spans"] for r in suffix_dedup.repeats(family, whole).collect()}
    removed = Counter()
    for r in whole.select("doc_id", "text", *suffix_dedup.identity("doc_id", "text")).collect():
        gone = np.zeros(len((r["text"] or "").encode()), bool)
        for s in found.get((r["a"], r["b"]), []):
            gone[s["start"] : s["end"]] = True
        removed[r["doc_id"], len(gone), int(gone.sum())] += 1
    want = Counter()
    for k, n in brute_suffix(data).items():
        want[k[:3]] += n
    assert removed == want


def test_suffix_rows_that_repeat(spark):
    """Places of rows that repeat are noted once, however many they are."""
    text = helpers.words(random.Random(1), 300)
    rows = [(1, text, "en", "s", 1)] * 40 + [(None, text, "en", "s", 1)] * 40 + [(2, "alone " + text[:150], "en", "s", 1)]
    docs = spark.createDataFrame(rows, helpers.DDL).repartition(3)
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert Counter((r["doc_id"], r["_n_bytes"], r["_n_removed"], r["_n_spans"], r["_kept_sha256"]) for r in got) == brute_suffix(rows)
    family = suffix_dedup.IndexFamily(spark, f"{suffix_dedup.checkpoint_folder(spark)}/repeat")
    family.add_documents(docs)
    assert max(len(r["spans"]) for r in suffix_dedup.repeats(family, docs).collect()) <= 2 * len(text) // 100


def test_repeated_windows_by_shared_lengths():
    """Contexts of random bytes from a small alphabet, zeros included, against all windows."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        length, n = 8, 60
        far, near = rng.integers(0, 5, n), np.zeros(n, int)
        near = np.minimum(far, rng.integers(0, 5, n))
        parts = [rng.integers(0, 2, f - m + length).astype(np.uint8) for f, m in zip(far, near, strict=True)]
        places = np.zeros(n, suffix_dedup._PLACE)
        places["a"], places["place"], places["far"], places["near"] = np.arange(n), 100, far, near
        windows = Counter((o, parts[i][far[i] - o : far[i] - o + length].tobytes()) for i in range(n) for o in range(near[i], far[i] + 1))
        want = {(i, 100 - o, 100 - o + length) for i in range(n) for o in range(near[i], far[i] + 1) if windows[o, parts[i][far[i] - o : far[i] - o + length].tobytes()] > 1}
        got = suffix_dedup.repeated(places, np.concatenate(parts), length)
        flat = {(int(s["a"]), x, x + length) for s in got for x in range(int(s["start"]), int(s["end"]) - length + 1)}
        assert flat == want


def test_suffix_samples_choose_alike():
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 600).astype(np.uint8)
    picked = []
    for before in (0, 37, 411):
        d = np.concatenate([rng.integers(97, 123, before).astype(np.uint8), passage])
        at, lo, hi, _ = suffix_dedup.sample(d, np.array([0, len(d)]))
        assert (hi - lo + 1).sum() == len(d) - 199 and (at >= lo[:]).all()
        picked.append({(p - before, a - before) for a, x, y in zip(at, lo, hi, strict=True) for p in range(x, y + 1) if p >= before})
    assert picked[0] == picked[1] == picked[2]


def test_sharding(docs, rows):
    got = sharding.shard(docs, 24).collect()
    assert Counter((r["_id"], r["_size"], r["_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r["_shard"] for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r["_slot"] for r in got if r["_shard"] == s) == list(range(counts[s]))


def test_propagation_cuts_fewer_links(spark):
    """Groups of many sizes, one of a third of all rows; null ids and rows that repeat, with clashing columns."""
    rows = [(g * 100 + k, f"text {g}", "en", "s", 1) for g in range(60) for k in range(2 + g % 9)] + [(20_000 + k, "hot", "en", "s", 1) for k in range(350)]
    rows += [(30_000 + k, f"alone {k}", "en", "s", 1) for k in range(250)] + [(None, "none", "en", "s", 1)] * 60 + [(5, "again", "en", "s", 1)] * 20
    docs = helpers.clashing(spark.createDataFrame(rows, helpers.DDL), "_key", "_label", "_n", "_id", "_shard", "_index").repartition(5)
    cuts = {}
    for rounds in (0, 3):
        out = sharding.shard(docs, 8, rounds=rounds)
        got = out.collect()
        counts = Counter(r["_shard"] for r in got)
        assert Counter((r["_id"], r["_crc32"]) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t, *_ in rows)
        assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
        assert all(sorted(r["_slot"] for r in got if r["_shard"] == s) == list(range(counts[s])) for s in range(8))
        cuts[rounds] = sharding.cut(out).first()
        where = {}
        for r in got:
            where.setdefault(r["_crc32"], Counter())[r["_shard"]] += 1
        many = [c for c in where.values() if sum(c.values()) > 1]
        assert tuple(cuts[rounds]) == (len(many), sum(len(c) > 1 for c in many), sum(sum(c.values()) - max(c.values()) for c in many))
    least = 350 + 20 - 2 * -(-len(rows) // 8)  # the hot group doesn't fit into one shard
    assert cuts[0]["cut_edges"] > 2 * cuts[3]["cut_edges"] and cuts[3]["split_groups"] <= 8 and cuts[3]["cut_edges"] >= least
    plan = sharding.shard(docs, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_sharding_keeps_groups_together(spark):
    copies = [(g * 100 + k, f"text {g}", "en", "s", 1) for g in range(40) for k in range(5)] + [(10_000 + k, f"alone {k}", "en", "s", 1) for k in range(200)]
    got = sharding.shard(spark.createDataFrame(copies, helpers.DDL), 8).collect()
    where = {}
    for r in got:
        if r["_id"] < 10_000:
            where.setdefault(r["_id"] // 100, set()).add(r["_shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 7


def test_empty(spark):
    none = empty(spark)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert sharding.shard(none).count() == 0
