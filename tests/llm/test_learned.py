"""Language ID, toxicity and quality rules: held-out accuracy and brute-force counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossarion.llm import langid, quality, rules, toxicity
from glossarion.llm.common import held_out

from . import helpers

SYLLABLES = {"aa": "ka lo mi tu pe sa", "bb": "schr unt ich eng auf zer", "cc": "eau oux que ion elle ent"}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4)))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        lang = rng.choice(list(SYLLABLES))
        toxic, bad = rng.random() < 0.2, rng.random() < 0.15
        w = [word(rng, lang) for _ in range(rng.randrange(25, 120))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "glorfed", "glorfing", "moron"]))
        if bad:
            w = [x + "$$$" for x in w]
        rows.append((i, " ".join(w), lang, "s", 1))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    odd = [(1004, "½ ² ③", "aa", "s", 1), (1005, "½ é", "aa", "s", 1), (1000, None, None, None, None), (1001, "", "aa", "s", 0), (1002, "12 34 !!", "aa", "s", 1), (None, "ka lo mi", "aa", "s", 1), (1003, "ka lo " * 30000, "aa", "s", 1), (3, "ka lo", "bb", "s", 1)]
    return rows + odd, labels + [(None, 1, 1), (5000, 1, 0), (7, None, None)]


@pytest.fixture(scope="module")
def tables(spark, corpus):
    return spark.createDataFrame(corpus[0], helpers.DDL).repartition(3).cache(), spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int")


def test_language(tables, corpus):
    docs, _ = tables
    model = langid.fit(docs, ~held_out(3, 1))
    assert model.langs == ("aa", "bb", "cc")
    got = langid.identify(docs, model, keep=("doc_id", "lang")).withColumn("held", held_out(3, 1)).collect()
    assert len(got) == len(corpus[0])
    held = [r for r in got if r["held"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002, 1004)) and by_id[1005]["lang_pred"] != "und"
    assert by_id[1003]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got)


def test_language_mixture(spark, tables):
    docs, _ = tables
    model = langid.fit(docs, F.lit(True))
    rng = random.Random(4)
    half = " ".join([word(rng, "aa") for _ in range(150)] + [word(rng, "bb") for _ in range(150)])
    row = langid.identify(spark.createDataFrame([(1, half, None, None, None)], helpers.DDL), model).first()
    assert set(row["proportions"]) == {"aa", "bb"} and abs(row["proportions"]["aa"] - 0.5) < 0.1
    assert langid.fit(docs.where("false"), F.lit(True)) is None
    assert langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_toxicity(tables, corpus):
    docs, labels = tables
    model = toxicity.fit(docs, labels.where(~held_out(4, 2)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect() if r["doc_id"] != 3}
    truth = {i: t for i, _, t in corpus[1] if i is not None and t is not None and i < 900}
    import zlib

    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2 and i in got]
    hits = Counter((truth[i], got[i] >= 0.3) for i in held)
    assert len(held) > 80 and hits[(1, True)] >= 0.95 * (hits[(1, True)] + hits[(1, False)]) and hits[(0, True)] <= 0.03 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1001] < 0.3 and got[1000] < 0.3
    assert toxicity.fit(docs, labels.where("false")) is None
    assert toxicity.score(docs, None).where("score <> 0").count() == 0


def test_extra_columns_and_rows_that_repeat(spark, tables, corpus):
    """Columns of names that operators use themselves change nothing; rows that repeat, null ids and nulls get the score of their text."""
    docs, labels = tables
    more = helpers.clashing(docs, "_text", "_lang", "_id", "_label", "_y", "score", "lang_pred", "anomaly", "_counts")
    model = toxicity.fit(docs, labels)
    assert Counter(map(tuple, toxicity.score(more, toxicity.fit(more, labels)).collect())) == Counter(map(tuple, toxicity.score(docs, model).collect()))
    by_text = {}
    for r in toxicity.score(docs, model, keep=("doc_id", "text")).collect():
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    spoken = langid.fit(docs, F.lit(True))
    assert Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(more, langid.fit(more, F.lit(True))).collect()) == Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs, spoken).collect())
    assert Counter(map(tuple, quality.quality_rules(more, labels).collect())) == Counter(map(tuple, quality.quality_rules(docs, labels).collect()))


def test_bounded_samples(tables, corpus):
    """A sample that is smaller than the labelled rows: the rows of least hash, whatever the order and partitions; models still work."""
    from glossarion.llm.common import bounded_sample

    docs, labels = tables
    rows = labels.where("doc_id is not null and toxic is not null").select("doc_id")
    some = [r[0] for r in bounded_sample(rows, "doc_id", 60).collect()]
    hashed = [r[0] for r in rows.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).collect()]
    assert some == hashed[:60] == [r[0] for r in bounded_sample(rows.repartition(7), "doc_id", 60).collect()]
    model = langid.fit(docs, F.lit(True), sample=60)
    assert langid.identify(docs, model, keep=("doc_id", "lang")).where("doc_id < 900 and doc_id <> 3 and lang = lang_pred").count() > 0.95 * 900
    assert toxicity.score(docs, toxicity.fit(docs, labels, sample=200)).where("score is null").count() == 0


def test_forest_against_plain_recursion():
    """Path lengths and verdicts of the array form against trees that are walked row by row."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 2)), [[9, 9], [-8, 7]]])
    forest = quality.grow(x, trees=16, rows=64)

    def depth(t, i, row):
        c = forest.column[t, i]
        return forest.value[t, i] if c < 0 else depth(t, forest.child[t, i] + int(row[c] >= forest.value[t, i]), row)

    mean = np.array([np.mean([depth(t, 0, r) for t in range(16)]) for r in x])
    assert np.allclose(forest.score(x), 2.0 ** (-mean / quality._usual(64)))
    assert set(np.argsort(forest.score(x))[-2:]) == {400, 401}
    good = rng.random(len(x)) < 0.9
    limit, score = quality.threshold(forest.score(x), good), forest.score(x)
    cost = lambda t: quality.GOOD_COST * (good & (score >= t)).sum() + (~good & (score < t)).sum()
    assert cost(limit) == min(cost(t) for t in [*score, np.inf])


def test_mixture_against_all_proportions():
    """Expectation-maximisation of two languages against a search over all proportions, and the penalty against the count of words."""
    import numpy as np

    rng = np.random.default_rng(6)
    like = np.exp(rng.normal(size=(80, 2)) * 2)
    pi, ll = langid._mixture(like, np.array([0]), np.array([80]), np.array([[0.5, 0.5]]))
    grid = np.linspace(0, 1, 2001)
    every = np.log(like[:, :1] * grid + like[:, 1:] * (1 - grid)).sum(axis=0)
    assert abs(ll[0] - every.max()) < 0.05 and abs(pi[0, 0] - grid[every.argmax()]) < 0.05


def test_label_model_against_its_definition():
    """The posterior of independent voters is Bayes' rule on the estimated tables."""
    import numpy as np

    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.3
    votes = np.column_stack([np.where(rng.random(3000) < 0.8, np.where(y, 1, -1), 0) for _ in range(3)]).astype(np.int8)
    model = toxicity.label_model(votes, 0.3)
    for row, got in zip(votes[:50], model.posterior(votes[:50]), strict=True):
        one, none = 0.3, 0.7
        for j, v in enumerate(row):
            one *= np.exp(model.weight[j] * model.table[j, 1, v + 1])
            none *= np.exp(model.weight[j] * model.table[j, 0, v + 1])
        assert abs(got - one / (one + none)) < 1e-9


def test_correlated_voters_count_less():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda p: np.where(rng.random(4000) < p, np.where(y, 1, -1), np.where(y, -1, 1))
    one = vote(0.7)
    model = toxicity.label_model(np.column_stack([one, one, one, vote(0.85), vote(0.8)]).astype(np.int8), 0.3)
    assert model.weight[:3].sum() < 1.6 and model.weight[3] > 0.7
    p = model.posterior(np.column_stack([one, one, one, vote(0.85), vote(0.8)]).astype(np.int8))
    assert ((p > 0.5) == y).mean() > 0.8


def brute(text):
    w = helpers.WORD.findall(text)
    runs = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    marked = {k for j in range(len(w) - 7) if runs[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    lines = [x for x in text.split("\n") if helpers.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(marked)


def test_rule_counts(spark):
    rows = helpers.documents()
    x, y = helpers.thue_morse(10)
    rows += [(3000, f"{x}\n{y}\n" + f"{x} {y} " * 9, "en", "s", 1), (3001, "\n".join([x, y, x]), "en", "s", 1)]
    rng = random.Random(9)
    alphabet = "ab \n\t#$é日|.\x0b\x1c"
    rows += [(2000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))), "en", "s", 1) for k in range(300)]
    docs = spark.createDataFrame(rows, helpers.DDL)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs, labels).collect()
    names = rules.BASE
    want = Counter((i, *brute(t or "")) for i, t, *_ in rows)
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == want
    for r in got:
        fails = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == fails and r["kept"] == (not fails)


def test_quality(tables, corpus):
    docs, labels = tables
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    truth = {i: q for i, q, _ in corpus[1] if i is not None and q is not None and i < 900 and i != 3}
    judged = Counter((q, got[i]["kept"]) for i, q in truth.items() if not got[i]["base_failed"])
    assert judged[(1, False)] <= 0.01 * judged[(1, True)] and judged[(0, True)] <= 0.05 * judged[(0, False)]


def test_empty(spark):
    docs, labels = spark.createDataFrame([], helpers.DDL), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, labels).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert langid.identify(docs, langid.fit(docs, F.lit(True))).count() == 0
