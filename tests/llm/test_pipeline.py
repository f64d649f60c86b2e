"""The stages of the pipeline, each against brute force on its own input."""

import random
from collections import Counter

import pytest

from glossarion.llm import minhash

from . import helpers

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rows = [r for r in helpers.documents() if r[0] is not None]
    spark.createDataFrame(rows, helpers.DDL).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, [tuple(r) for r in docs.select("doc_id", *([] if name == "packing" else ["text"])).collect()])
    before, after = kept["language_id"]
    assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))
    before, after = kept["exact_dedup"]
    best = {}
    for i, t in before:
        best[t] = max(i, best.get(t, i))
    assert {(i, t) for i, t in after} == {(i, t) for t, i in best.items()}
    before, after = kept["near_dedup"]
    sets = [(i, helpers.shingles(t)) for i, t in before]
    pairs = [(i, j) for a, (i, s) in enumerate(sets) for j, x in sets[:a] if s and 100 * len(s & x) >= 80 * len(s | x)]
    want = helpers.components(pairs, {i for i, _ in sets})
    assert {i for i, _ in after} == {i for i, c in want.items() if i == c}
    before, after = kept["suffix_dedup"]
    from .test_dedup import brute_suffix

    sizes = Counter((i, n - gone) for (i, n, gone, _, _), k in brute_suffix([(i, t) for i, t in before]).items() for _ in range(k))
    assert len(after) == len(before) and all(any(0 <= n - len(t.encode()) <= 3 * 2 * 10 for j, n in sizes if j == i) for i, t in after)
    assert {i for (i,) in kept["packing"][1]} == {i for i, _ in kept["packing"][0]}


def test_run(spark, tmp_path):
    spark.createDataFrame(helpers.documents()[:60], helpers.DDL).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 40


def test_exact_keeps_one_row_of_each_text(spark):
    """Rows that repeat, and rows without an id, are one document; the kept rows are compared as a multiset."""
    rows = helpers.documents() + [(None, "only without an id", lang, "u", 1) for lang in ("en", None, "en")] + [(900, "", "en", "u", 0)] + [(901, "ab " * 90, "en", "u", 1)] * 5
    out = corpus_pipeline.exact(spark, spark.createDataFrame(rows, helpers.DDL).repartition(3), "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max((x for x in (i, best.get(t or "")) if x is not None), default=None)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter((i, t) for t, i in best.items())
    assert all(tuple(r) in rows for r in got if r["text"])


@pytest.mark.parametrize("labels", ["none", "on null texts", "on null ids"])
def test_language_stage_without_labels(spark, labels):
    """Where no language can be learned, all texts with a letter stay."""
    used = {"none": lambda r: False, "on null texts": lambda r: r[1] is None, "on null ids": lambda r: r[0] is None}[labels]
    rows = [(i, t, "en" if used((i, t)) else None, s, n) for i, t, _, s, n in helpers.documents()] + [(902, "12 34 _", None, "s", 1), (903, "Это", None, "s", 1)]
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, helpers.DDL), "")
    assert Counter(map(tuple, out.collect())) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_near_links_rows_without_ids(spark):
    """One row stays of each component of near copies, whether all, some or none of its rows have an id."""
    rng, rows = random.Random(8), []
    for c in range(30):
        base = helpers.words(rng, 120).split()
        for k in range(4):
            base[rng.randrange(120)] = f"y{c}-{k}"
            rows.append((None if c % 3 == 0 or (c % 3 == 1 and k < 2) else 10 * c + k, " ".join(base), "en", "s", 1))
    rows += [(None, "ab cd", "en", "s", 1), (None, "AB  cd", "en", "s", 1), (None, "of its own", "en", "s", 1), (20, "another text of this id, which is alone", "en", "s", 1)]
    docs = spark.createDataFrame(rows, helpers.DDL).repartition(5)
    sets = [helpers.shingles(t) for _, t, *_ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    parts = {}
    for n, c in helpers.components(pairs, range(len(rows))).items():
        parts.setdefault(c, []).append(n)
    least = {n: min((rows[m][0] for m in p if rows[m][0] is not None), default=None) for p in parts.values() for n in p}
    got = minhash.near_duplicates(docs, 80).collect()
    assert Counter((r["id"], r["component_id"]) for r in got) == Counter((rows[n][0], least[n]) for n in least)
    assert sum(r["kept"] for r in got) == len(parts) == 33
    at = {tuple(r): n for n, r in enumerate(rows)}
    kept = [at[tuple(r)] for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert all(len(set(p) & set(kept)) == 1 for p in parts.values()) and len(kept) == len(parts)
    assert all(rows[n][0] == least[n] for n in kept)
