"""Candidates, lexicon, language model, selection, reranking, review, sources and streams."""

import itertools
import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossarion.functions.udfs import indel_ratio, osa
from glossarion.operators import audit, candidates, evaluation, lexicon, morph, ngrams, ranks, rerank, review, selector
from glossarion.sources import cases, sinks
from glossarion.streaming.clean import start_clean

WORDS = ["молоко", "молока", "корова", "карова", "кот", "кто", "ток", "окт", "трава", "трова", "травы", "а", "аб", "ба", "лес", "лось", "по-русски"]


@pytest.mark.parametrize("distance", [1, 2])
def test_within_finds_all_pairs(spark, distance):
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)], "term string, rank int")
    tokens = spark.createDataFrame([(w,) for w in WORDS + ["млоок", "ктоо", "zz"]], "token string")
    got = {(r["token"], r["term"], r["distance"]) for r in candidates.within(tokens, terms, distance).collect()}
    assert got == {(t, w, osa(t, w)) for t in WORDS + ["млоок", "ктоо", "zz"] for w in WORDS if osa(t, w) <= distance}


def brute_rapid(token, words, limit, distance):
    scored = sorted(((-indel_ratio(token, w), i, w) for i, w in enumerate(words)))[:limit]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    near = sorted((lev(token, w), s, w) for s, _, w in scored if w != token and lev(token, w) <= distance)
    if not near:
        return "rejected", None
    if len(near) > 1 and near[0][:2] == near[1][:2]:
        return "ambiguous", None
    return "generated", near[0][2]


@pytest.mark.parametrize(("limit", "distance"), [(1, 1), (3, 1), (3, 2), (10, 2)])
def test_suggestions(spark, limit, distance):
    terms = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)], "term string, rank int")
    asked = [w for w in WORDS if len(w) >= 3] + ["малоко", "каров", "тока", "жжжжжж", "травв"]
    got = {r["token"]: (r["status"], r["term"]) for r in candidates.suggest(spark.createDataFrame([(w,) for w in asked], "token string"), terms, "rapidfuzz", limit, distance).collect()}
    assert got == {w: brute_rapid(w, WORDS, limit, distance) for w in asked}
    sym = {r["token"]: (r["status"], r["term"]) for r in candidates.suggest(spark.createDataFrame([(w,) for w in asked], "token string"), terms, "symspell", limit, distance).collect()}
    for w in asked:
        near = sorted((osa(w, t), i, t) for i, t in enumerate(WORDS) if osa(w, t) <= distance)
        closest = [x for x in near if x[0] == near[0][0]][:limit] if near else []
        closest = [x for x in closest if x[2] != w]
        assert sym[w] == (("generated", closest[0][2]) if closest else ("rejected", None))


def test_morph_expressions(spark):
    rows = [("столы", "стола"), ("стол", "столб"), ("кот", "код"), ("мама", "рама"), ("длинная", "длинный"), ("слово", "слово")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", morph.common_prefix(F.col("a"), F.col("b")), morph.suffix_shift(F.col("a"), F.col("b"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {"столы": (4, True), "стол": (4, True), "кот": (2, False), "мама": (0, False), "длинная": (5, False), "слово": (5, False)}


def test_lexicon(spark):
    tokens = spark.createDataFrame([("тест",), ("*весна*",), ("порусски",), ("щетка",), ("#дом",), ("english",), (None,)], "token string")
    terms = spark.createDataFrame([("тёст", 0), ("текст", 1), ("вёсна", 2), ("весло", 3), ("по-русски", 4), ("щётка", 5), ("дом", 6), ("том", 7)], "term string, rank int")
    got = {}
    for r in lexicon.top_k(tokens, terms).orderBy("token", "position").collect():
        got.setdefault(r["token"], []).append((r["term"], r["distance"]))
    assert got["тест"][:2] == [("тёст", 0), ("текст", 1)] and got["щетка"] == [("щётка", 0)]
    assert got["порусски"] == [("по-русски", 1)] and ("том", 1) in got["#дом"] and "english" not in got


def brute_model(texts):
    import re

    chains = [["<s>", *re.findall(r"\b[\w-]+\b", t.lower()), "</s>"] for t in texts if re.findall(r"\b[\w-]+\b", t)]
    uni, bi = Counter(w for c in chains for w in c), Counter(p for c in chains for p in itertools.pairwise(c))
    left = Counter()
    for (a, _), n in bi.items():
        left[a] += n
    uni.setdefault("<unk>", 0)
    total = sum(uni.values()) + len(uni)
    up = {w: math.log10((n + 1) / total) for w, n in uni.items()}
    bp = {p: math.log10((n + 1) / (left[p[0]] + len(uni))) for p, n in bi.items()}
    return up, bp


def brute_score(words, up, bp, end=True):
    chain = ["<s>", *words, *(["</s>"] if end else [])]
    return sum(bp.get((a, b), math.log10(0.4) + up.get(b, up["<unk>"])) for a, b in itertools.pairwise(chain))


TEXTS = ["Мама мыла раму", "мама мыла пол", "Папа мыл раму!", "", "  ", "one-two three", "мама мама мама"]


def test_language_model(spark, tmp_path):
    uni, bi = ngrams.train(spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string"))
    up, bp = brute_model(TEXTS)
    assert {r["w"]: pytest.approx(r["logp"]) for r in uni.collect()} == up
    assert {(r["l"], r["r"]): pytest.approx(r["logp"]) for r in bi.collect()} == bp
    said = [("a", ["мама", "мыла", "раму"]), ("b", ["нет", "мама"]), ("c", []), ("d", ["мама", "мыла", "неё"])]
    got = {r["id"]: r["score"] for r in ngrams.score(spark.createDataFrame(said, "id string, words array<string>"), uni, bi, ["id"], "words").collect()}
    assert all(got[i] == pytest.approx(brute_score(w, up, bp)) for i, w in said)
    sinks.arpa(ngrams.arpa(uni, bi), len(up), len(bp), str(tmp_path / "lm"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "lm")).collect()]
    assert f"ngram 2={len(bp)}" in lines and "\\end\\" in lines


def test_rerank(spark):
    uni, bi = ngrams.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    up, bp = brute_model(TEXTS)
    options = [(1, "мама мыла рамк", ["мама", "мыла", "рамк"], [[], [("мыл", -1.0)], [("раму", -1.0), ("рама", -1.15)]]), (2, "ничего!", ["ничего"], [[]]), (3, "", [], [])]
    opts = spark.createDataFrame(options, f"case_id int, text string, tokens array<string>, found {rerank.OPTIONS}")
    got = {r["case_id"]: r for r in rerank.rerank(opts, uni, bi, 0.05, -100.0, width=10).collect()}
    lists = [[("мама", 0.0)], [("мыла", 0.0), ("мыл", -1.0)], [("рамк", 0.0), ("раму", -1.0), ("рама", -1.15)]]
    ways = sorted(((sum(b for _, b in w) + brute_score([t for t, _ in w], up, bp)), [t for t, _ in w]) for w in itertools.product(*lists))
    best = " ".join(ways[-1][1]) if ways[-1][0] - ways[-2][0] >= 0.05 else "мама мыла рамк"
    assert got[1]["v2_output"] == best and got[2]["v2_output"] == "ничего!" and got[3]["v1_output"] == ""
    text = spark.createDataFrame([("a, b-c (d)!",)], "t string").select(rerank.recombine(F.col("t"), F.array(F.lit("X"), F.lit("Y"), F.lit("Z")))).first()[0]
    assert text == "X, Y (Z)!"


def test_heuristics(spark):
    row = spark.createDataFrame([(["sing", "nomn"], ["sing", "gent"], ["plur", "nomn"], "мой", "кот")], "g array<string>, l array<string>, r array<string>, lw string, c string")
    none = F.struct(F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("lemma"), F.lit(None).cast("int").alias("variants"))
    got = row.select(rerank.agreement(F.col("g"), F.col("l"), F.col("r")), rerank.heuristic_score(F.lit("кто"), F.lit("кот"), F.lit(1), F.lit(1), none, none, F.lit(0.1)), selector.context_score(F.lit("щенок"), F.lit(2), F.col("lw"), F.lit(None).cast("string"))).first()
    assert got[0] == pytest.approx(0.3) and got[1] == pytest.approx(1 - 0.35 - 0.3 - 0.35 + 0.1) and got[2] == pytest.approx(-0.02 + 0.4)


def test_selection(spark):
    terms = spark.createDataFrame([("молоко", 5), ("молока", 9), ("кот", 1)], "term string, count long")
    got = [(r["candidate"], r["rank"]) for r in selector.candidates(spark.createDataFrame([("малоко",)], "token string"), terms).orderBy("position").collect()]
    assert got == [("молоко", 5), ("малоко", 0)]
    rows = [("a", "x", "y", 1.0), ("a", "x", "z", 0.5), ("b", "x", "y", -9.0), ("c", "x", "y", 0.2), ("c", "x", "z", 0.15), ("d", "x", "x", 1.0), ("e", "x", None, None)]
    picked = {r["case_id"]: (r["reason"], r["output"]) for r in selector.research_pick(spark.createDataFrame(rows, "case_id string, original string, candidate string, score double"), 0.1, -5.0).collect()}
    assert picked == {"a": ("applied", "y"), "b": ("low_abs_score", "x"), "c": ("low_margin", "x"), "d": ("same_as_original", "x"), "e": ("no_candidates", "x")}
    decided = spark.createDataFrame([("x", "x", "apply_candidate", True), ("y", "x", "low_margin", False)], "selected string, expected string, reason string, changed boolean")
    s = selector.summary(decided).first()
    assert (s["total_cases"], s["expected_match_rate"], s["decision_reason_counts"]) == (2, 0.5, {"apply_candidate": 1, "low_margin": 1})
    with pytest.raises(Exception, match="different totals"):
        selector.compare(decided, decided.limit(1)).collect()


def test_evaluation(spark):
    rows = spark.createDataFrame([("in", "in", "a", "b", False), ("in", "b", "b", "in", True), ("x", "y", "z", "y", False)], "input_text string, expected_clean_text string, v1 string, current_apply_output string, rolled boolean")
    got = {r["mode"]: r for r in evaluation.research_summary(rows, {"v1": "v1", "current_apply": "current_apply_output"}, rolled={"current_apply": "rolled"}).collect()}
    assert (got["v1"]["exact_match_pass_count"], got["v1"]["wrong_change"], got["v1"]["smart_regresses_expected_match"]) == (1, 2, 1)
    assert got["current_apply"]["rollback_related"] == 1
    b = evaluation.beats(rows, {"v1": "v1"}).first()
    assert (b["beats"], b["worse"]) == (1, 1)
    status = spark.createDataFrame([(True, False, False, False, False, False), (True, True, False, False, False, False), (True, True, True, False, False, False), (True, True, True, True, False, False), (False, True, True, True, False, False), (True, False, False, False, True, False), (True, False, False, False, False, True)], "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean")
    assert [r[0] for r in status.select(evaluation.root_cause(*map(F.col, "abcdef"))).collect()] == ["other", "candidate_exists_but_gold_absent_topk", "gold_present_in_topk_but_not_selected", "selected", "token_rejected_before_retrieval", "candidate_polluted_by_punctuation_wrappers", "no_candidate_due_to_token_shape"]
    c = evaluation.coverage(spark.createDataFrame([(1, True, False), (1, True, True), (2, False, False)], "case_id int, has_candidate boolean, gold_in_top_k boolean")).first()
    assert (c["cases"], c["cases_any"], c["cases_gold"], c["gold_rate"], c["tokens_any"]) == (2, 1, 1, 0.5, 2)
    d = evaluation.delta_rows(spark.createDataFrame([("a", "b", "b", "a"), ("a", "c", "b", "c"), ("a", "a", "a", "a"), ("a", "q", "x", "y")], "input_text string, expected_clean_text string, output_smart_baseline string, output_safe_default string"))
    assert [r["user_visible_delta_reason"] for r in d.collect()] == ["smart_improves_expected_match", "smart_regresses_expected_match", None, "profile_outputs_differ_need_human_review"]
    assert evaluation.delta_summary(d).first()["cases_needing_human_look"] == 1
    assert Counter(r["class"] for r in review.showcase(d.withColumn("pos", F.lit(1)), 5).collect()) == {"improvement": 1, "caution": 2, "preservation": 1}
    h = evaluation.hints(spark.createDataFrame([(0, 0, 0, 0, 0, None)], "unchanged_when_expected_change int, candidate_generated_not_applied int, wrong_change int, unsafe_rejected int, rollback_related int, top_slice string")).first()
    assert h["hints"] == ["keep_baseline"]


def test_review(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "z", 2)], "input_text string, expected_clean_text string, pos int")
    b = spark.createDataFrame([("x", None, 0), ("x", "q", 1), ("x", "q", 2)], "input_text string, expected_clean_text string, pos int")
    got = {(r["input_text"], r["expected_clean_text"], r["pos"]) for r in review.union_first([a, b]).collect()}
    assert got == {("x", None, 1), ("y", "z", 2), ("x", "q", 1)}
    rows = spark.createDataFrame([(1, "long text", ["user_visible_change"]), (2, "b", ["rollback_related", "user_visible_change"]), (3, "c", []), (4, "a", ["user_visible_change"])], "pos int, input_text string, reasons array<string>")
    packed = review.pack(rows, 2)
    assert [r["pos"] for r in packed.collect()] == [2, 4]
    assert {r["reason"]: r["n"] for r in review.reason_counts(packed).collect()} == {**{r: 0 for r in review.REASONS}, "rollback_related": 1, "user_visible_change": 2}
    judged = spark.createDataFrame([(0, 0, 0, 0), (5, 1, 0, 0), (5, 0, 0, 0), (5, 0, 0, 3), (5, 0, 1, 4), (5, 0, 0, 5)], "n int, b int, c int, a int")
    assert [r[0]["outcome"] for r in judged.select(review.adjudication(*map(F.col, "nbca"))).collect()] == ["blocked", "blocked", "needs_follow_up", "needs_follow_up", "needs_follow_up", "approved_for_controlled_apply_review"]
    warn = review.config_warnings(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "key string, value string"))
    assert {r[0] for r in warn.collect()} == {"config_drift:b", "config_drift:c"}


def test_global_ranks(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert {r["x"]: r["rank"] for r in ranks.ranked(df, [F.asc("x")]).collect()} == {i: i for i in range(500)}


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_sources(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", json.dumps({"input": "x", "expected_clean_text": "y"}), "", json.dumps({"input_text": "z", "expected_clean_text": "w", "left_context": ["q"]}))
    assert {r["input_text"] for r in cases.cases(spark, good, input_alias=True).collect()} == {"x", "z"}
    with pytest.raises(Exception, match="input_text"):
        cases.jsonl_cases(spark, good).collect()
    with pytest.raises(ValueError):
        cases.cases(spark, str(tmp_path / "a.csv"))
    yml = write(tmp_path / "p.yml", "smart:", "  - input: а", "    expected_clean_text: б", "    category: c", "  - input: only")
    assert cases.yaml_cases(spark, yml, lenient=True).count() == 1
    with pytest.raises(ValueError):
        cases.yaml_cases(spark, yml)
    pilot = write(tmp_path / "pilot.jsonl", json.dumps({"input_text": "x", "tag": "t"}))
    assert cases.pilot_cases(spark, pilot).first()["tag"] == "t"
    with pytest.raises(Exception, match="unknown keys"):
        cases.pilot_cases(spark, write(tmp_path / "bad.jsonl", json.dumps({"input_text": "x", "other": 1}))).collect()
    replay = write(tmp_path / "r.jsonl", json.dumps({"case_id": "1", "original_token": "a", "expected_token": "b", "candidates": [{"token": "b", "rank": 1}], "scores": {"b": 0.5}}))
    assert cases.replay_cases(spark, replay).first()["scores"] == {"b": 0.5}
    words = write(tmp_path / "d.txt", "# comment", "молоко", "Молоко", "кот", "молоко", "x1", "по-русски")
    assert {r["term"]: r["rank"] for r in cases.dictionary(spark, words).collect()} == {"молоко": 0, "кот": 1, "по-русски": 2}
    lex = cases.research_lexicon(spark, [write(tmp_path / "l1.txt", "Ёж\t5", "#x", "кот"), write(tmp_path / "l2.txt", "кот", "дом")])
    assert {r["term"]: r["rank"] for r in lex.collect()} == {"ёж": 0, "кот": 1, "дом": 2}
    assert {tuple(r) for r in cases.counted_dictionary(spark, write(tmp_path / "c.txt", "кот 5", "дом", "лес x")).collect()} == {("кот", 5)}
    assert cases.lm_corpus(spark, write(tmp_path / "lm.txt", "a", " ", "b")).count() == 2
    with pytest.raises(ValueError):
        cases.lm_corpus(spark, write(tmp_path / "none.txt", ""))
    gold = cases.gold_corpus(spark, write(tmp_path / "g.jsonl", json.dumps({"source": "a", "correction": "b"})))
    sinks.jsonl(gold, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"input_text": "a", "expected_clean_text": "b"}
    assert cases.review_cases(spark, write(tmp_path / "rev.jsonl", json.dumps({"input_text": "a"}))).first()["source"] == "custom_jsonl"
    table = sinks.markdown(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), ["k", "v"], ["k"]).first()[0]
    assert table.splitlines() == ["| k | v |", "|---|---|", "| 1 | a |", "| 2 | b |"]


def test_stream_equals_batch(spark, tmp_path):
    from glossarion.plans.clean import clean

    rows = spark.createDataFrame([(i, f"слово ,слово{i} и ещё немного слов чтобы доля была мала") for i in range(20)], "id int, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_clean(source, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "clean_text")
    want = clean(rows).select("id", "clean_text")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_heuristic_replay(spark, tmp_path):
    terms = spark.createDataFrame([("корова", 0), ("молоко", 1), ("короба", 2), ("кот", 3)], "term string, rank int")
    rows = [(1, "белая карова и моолоко https://x.org/карова кошка"), (2, "корава"), (3, None), (4, "(карова) #карова"), (5, "a@b.org карова")]
    got = {r["id"]: r for r in rerank.heuristic_replay(spark.createDataFrame(rows, "id int, text string"), terms, id="id").collect()}
    assert got[1]["output"] == "белая корова и молоко https://x.org/карова кошка" and (got[1]["generated"], got[1]["applied"]) == (2, 2)
    assert got[2]["output"] == "корова" and got[3]["output"] == "" and got[3]["generated"] == 0
    assert got[4]["output"] == "(карова) #карова" and got[5]["output"] == "a@b.org корова"
    morph_rows = spark.createDataFrame([("карова", "PREP", "x", None, True, 0.1), ("корова", "NOUN", "y", ["sing", "nomn"], True, 0.9)], "form string, pos string, lemma string, grammemes array<string>, is_known boolean, score double")
    kept = {r["id"]: r for r in rerank.heuristic_replay(spark.createDataFrame(rows[:1], "id int, text string"), terms, morph_rows, id="id").collect()}
    assert "карова и молоко" in kept[1]["output"] and kept[1]["not_applied"] == 1
    stored = sinks.reused(terms, str(tmp_path / "held"), 4)
    assert stored.count() == 4 and sinks.reused(terms.limit(1), str(tmp_path / "held"), 4).count() == 4


def test_the_language_model_of_documents(spark, tmp_path):
    """Counts and smoothed probabilities of all documents against plain Python."""
    from glossarion import queries

    texts = ["Müller sah die Tür, die Tür.", "well-known words - and WELL", "", None, " .. ", "die Tür", "日本 x_1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    chains = [["<s>", *w, "</s>"] for w in (re.findall(r"\w(?:[\w-]*\w)?", (t or "").lower()) for t in texts) if w]
    uni, bi = Counter(w for c in chains for w in c), Counter(p for c in chains for p in itertools.pairwise(c))
    left = Counter(c for p in bi.elements() for c in p[:1])
    v, t = len(uni) + 1, sum(uni.values())
    assert {(r["l"], r["r"]): r["n"] for r in queries.document_bigrams(spark, str(tmp_path)).collect()} == bi
    got = {r["w"]: (r["n"], r["logp"]) for r in queries.document_unigram_model(spark, str(tmp_path)).collect()}
    assert got == {w: (uni[w], pytest.approx(math.log10((uni[w] + 1) / (t + v)), abs=2e-6)) for w in [*uni, "<unk>"]}
    got = {(r["l"], r["r"]): r["logp"] for r in queries.document_bigram_model(spark, str(tmp_path)).collect()}
    assert got == {p: pytest.approx(math.log10((n + 1) / (left[p[0]] + v)), abs=2e-6) for p, n in bi.items()}


def test_words_of_all_scripts_and_counts(spark, tmp_path):
    """Whole words with any letters, and a dictionary with rare words, against plain Python."""
    from glossarion import queries

    texts = ["Müller mahlt, Muller und Mülelr nicht", "für fur fü", "niño nino nin\u0303o", None, "Straße strasse x_1 x_2", "молоко молока", "für Müller"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    n = Counter(w for t in texts for w in re.findall(r"[\w\u0303]+", (t or "").lower()))
    rank = {w: i for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w.encode())))}
    assert {(r["term"], r["n"], r["rank"]) for r in queries.word_vocabulary(spark, str(tmp_path)).collect()} == {(w, n[w], rank[w]) for w in n}
    near = {(a, b): osa(a, b) for a in n for b in n if osa(a, b) <= 1}
    assert {(r["token"], r["term"]): (r["rank"], r["distance"]) for r in queries.near_words(spark, str(tmp_path)).collect()} == {p: (rank[p[1]], d) for p, d in near.items()}
    best = {}
    for a, b in near:
        if a != b:
            best.setdefault(a, []).append((rank[b], b))
    assert {r["token"]: (r["term"], r["distance"], r["ambiguous"]) for r in queries.best_words(spark, str(tmp_path)).collect()} == {a: (min(x)[1], 1, len(x) > 1) for a, x in best.items()}


def test_readers_refuse_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "lines.jsonl")
    for read, good, bad in (
        (cases.review_cases, '{"input_text": "a", "x": [1]}', ['{"input_text": ""}', '{"input_text": 5}', "{bad", "[1]", '{"x": 1}', '{"input_text": "a", "source": 3}', '"s"', '{"input_text": "a", "category": {}}']),
        (cases.gold_corpus, '{"source": "a", "correction": "", "domain": null}', ['{"source": "a"}', '{"correction": "b"}', '{"source": "", "correction": "b"}', '{"source": "a", "correction": "b", "domain": 7}', "{"]),
    ):
        write(tmp_path / "lines.jsonl", good + "\n\n" + good)
        assert read(spark, path).count() == 2
        for line in bad:
            write(tmp_path / "lines.jsonl", good + "\n" + line)
            with pytest.raises(Exception, match="a line is no"):
                read(spark, path).collect()
        write(tmp_path / "lines.jsonl", "\n")
        with pytest.raises(ValueError):
            read(spark, path)


def test_root_causes(spark):
    rows = [
        (1, "мама мыла рамму", "мама мыла раму", "мама мыла раму"), (2, "мама «карова»!! тут", "мама «корова»!! тут", "мама «карова»!! тут"), (3, "слово  сабака2", "слово  собака2", "слово  сабака2"),
        (4, "два слова", "двас лова вот", "два слова"), (5, "так", "так", "как"), (6, "*щетка*", "*щётка*", "*щетка*"), (7, "кяяяяк", "как", "кяяяяк"),
    ]
    terms = spark.createDataFrame([("рама", 0), ("раму", 1), ("корова", 2), ("собака", 3), ("корона", 4), ("щётка", 5)], "term string, rank int")
    got = audit.root_causes(spark.createDataFrame(rows, "case_id int, input_text string, expected_clean_text string, clean_text string"), terms)
    by = {(r["case_id"], r["token"]): r for r in got.collect()}
    assert {k: r["status"] for k, r in by.items()} == {
        (1, "рамму"): "selected", (2, "карова"): "gold_present_in_topk_but_not_selected", (3, "сабака2"): "token_rejected_before_retrieval", (4, None): "segmentation_tokenization_mismatch",
        (6, "щетка"): "selected", (7, "кяяяяк"): "other",
    }
    r = by[2, "карова"]
    assert r["quote_bracket_adjacency"] and r["punctuation_adjacency"] and r["repeated_punctuation"] and not r["wrapper_no_touch_style"] and by[6, "щетка"]["wrapper_no_touch_style"] and by[3, "сабака2"]["missing_extra_spaces"]
    slices = [(r["slice"], r["count"], round(r["rate"], 3)) for r in audit.cause_slices(got).collect()]
    assert slices == [("gold_present_in_topk_but_not_selected", 1, 0.2), ("other", 1, 0.2), ("segmentation_tokenization_mismatch", 1, 0.2), ("token_rejected_before_retrieval", 1, 0.2)]
    assert audit.noise_breakdown(got).where("noise = 'repeated_punctuation' and status = 'any'").first()["n"] == 1
    assert audit.normalization_lifts(got).first()["baseline_gold_in_topk"] == 3


def test_fallback_counts_a_swap_as_two(spark):
    words = spark.createDataFrame([("весан",), ("дом",), ("Рамa",)], "token string")
    terms = spark.createDataFrame([("весна", 0), ("дом", 1), ("том", 2), ("молоко", 3)], "term string, rank int")
    assert [tuple(r) for r in lexicon.fallback(words, terms, 5, 2).orderBy("token", "position").collect()] == [("весан", "весна", 2, 0)]
    assert lexicon.fallback(words, terms, 5, 1).count() == 0


def test_harness_and_token_replay(spark):
    rows = spark.createDataFrame([(1, "карова тут", "корова тут"), (2, "дом", "дом"), (3, "сабака", "собака")], "case_id int, input_text string, expected_clean_text string")
    terms = spark.createDataFrame([("корова", 0), ("собака", 1), ("дом", 2), ("тут", 3)], "term string, rank int")
    totals = audit.harness(rows, terms, modes=("baseline", "symspell_shadow", "symspell_apply")).cache()
    got = {r["mode"]: r for r in totals.collect()}
    assert [got[m]["exact_match_pass_count"] for m in ("baseline", "symspell_shadow", "symspell_apply")] == [1, 1, 3]
    assert [got[m]["candidate_applied_total"] for m in got if m != "symspell_apply"] == [0, 0] and got["symspell_shadow"]["candidate_shadow_skipped_total"] == got["symspell_apply"]["candidate_applied_total"] == 2
    lines = audit.baseline_report(totals.withColumn("corpus", F.lit("inline")))
    assert lines[-2:] == ["- lift on every corpus: yes", "- safe on every corpus: yes"] and "## inline" in lines
    found = spark.createDataFrame([("ab", "ax", 5, 0), ("ab", "ay", 3, 1), ("cd", "cd", 0, 0)], "token string, candidate string, rank int, position int")
    tokens = spark.createDataFrame([("1", " ab ", "ax"), ("2", "cd", "cd"), ("3", "ef", "gh")], "case_id string, input_text string, expected_clean_text string")
    best = lambda k, scorer: {r["case_id"]: (r["best"], r["reason"]) for r in audit.token_replay(tokens, found, scorer, k).collect()}
    assert best(5, "rank") == {"1": ("ax", "apply_candidate"), "2": ("cd", "original_wins"), "3": ("ef", "original_wins")}
    assert best(5, "reverse_rank")["1"] == ("ab", "original_wins") and best(2, "reverse_rank")["1"] == ("ay", "low_confidence")  # a full list has no original
    with pytest.raises(ValueError):
        audit.token_replay(tokens, found, k=0)
    assert audit.challenger("lm") == ("reverse_rank", "the language model's path is missing") and audit.challenger("lm", "m") == ("lm", None) and audit.challenger("heuristic")[0] == "context"
    assert audit.scorer_source({"scorer_type": "lm", "training_corpus_path": "a"}, "b") == ("corpus", "a")
    for config in ({"scorer_type": "x"}, {"scorer_type": "lm"}, {"scorer_type": "lm", "training_corpus_path": "b"}):
        with pytest.raises(ValueError):
            audit.scorer_source(config, "b")
