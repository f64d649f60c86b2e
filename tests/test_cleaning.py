"""Zones, stages and the whole pipeline, against plain Python written from their definitions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossarion import config
from glossarion.functions import regex, udfs, zones
from glossarion.operators import punctuation, spelling, stages
from glossarion.plans.clean import body_too_large, bounds, clean, events

#: The zones' definitions in Python's dialect.
PYTHON = {
    "url": r"(?i:https?)://[^\s]+",
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "phone": r"\+?\d[\d\s().-]{6,}\d",
    "date": r"\b\d{2}[./-]\d{2}[./-]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b",
    "time": r"\b\d{1,2}:\d{2}\b",
    "number": r"\b\d[\d\s,.-]*\d\b",
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "ticket": r"\b[A-Z]{2,10}-\d{1,6}\b",
    "path": r"\b(?:[A-Za-z]:\\|/)[^\s]+",
    "command": r"\b(?:sudo|git|docker|kubectl|python|pip)\b[^\n]*",
    "code": r"```[\s\S]*?```|<code>[\s\S]*?</code>|\{\s*\"[^\"]+\"\s*:\s*[^}]+\}",
}

PIECES = [
    "https://example.org/a?b=1", "HTTP://x", "a.b+c@mail.example.com", "+1 (555) 123-4567", "2024-01-31", "31.01.2024", "9:30", "1 234 567", "42", "7", "12,5",
    "123e4567-e89b-12d3-a456-426614174000", "ABC-123", "C:\\temp\\x", "/var/log", "word/path", "git push", "sudoku", "```x y```", "<code>a</code>", '{"k": 1}',
    "слово", "word", " ", "\n", ",", ".", "(", ")", "é", "日本", "٣٤", "_", "-", "\u00a0", "\u2028", "\x1c", "⟦PZ0⟧", "\u200b", "ﬁ", "\r\n", "\t", "  ", "ё",
]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)
MANY = st.lists(TEXTS, min_size=60, max_size=120)
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, texts, **columns):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r.asDict(recursive=True) for r in df.select("id", "t", *[c.alias(n) for n, c in columns.items()]).orderBy("id").collect()]


def raw(text):
    return sorted((m.start(), m.end(), i, k) for i, (k, p) in enumerate(PYTHON.items()) for m in re.finditer(p, text))


def merged(text):
    out = []
    for a, b, _, k in raw(text):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, k])
    return [tuple(x) for x in out]


@SLOW
@given(MANY)
def test_spans_are_those_of_python(spark, texts):
    for r in column(spark, texts, raw=zones.raw_spans(F.col("t")), zones=zones.zones(F.col("t")), tokens=regex.tokens(F.col("t"), 2)):
        assert [(s["start"], s["end"], s["ord"], s["label"]) for s in r["raw"]] == raw(r["t"]), r["t"]
        assert [(z["start"], z["end"], z["label"]) for z in r["zones"]] == merged(r["t"])
        assert [(s["start"], s["value"]) for s in r["tokens"]] == [(m.start(), m[0]) for m in re.finditer(r"\b[\w-]{2,}\b", r["t"])]


@SLOW
@given(MANY)
def test_masking_is_undone(spark, texts):
    t = F.col("t")
    found = zones.zones(t)
    values = zones.originals(t, found)
    for r in column(spark, texts, v=values, m=zones.mask(t, found), back=zones.restore(zones.mask(t, found), values), ok=zones.all_restored(t, values), same=zones.still_detected(t, values)):
        if "⟦PZ" not in r["t"]:
            assert r["back"] == r["t"] and r["m"].count("⟦PZ") == len(r["v"])
        assert r["ok"] and r["same"]


@SLOW
@given(MANY)
def test_normalisation_is_that_of_python(spark, texts):
    for r in column(spark, texts, n=stages.normalized(F.col("t")), lines=stages.tidy_lines(F.col("t"))):
        assert r["n"] == udfs.normalized(r["t"]) and r["lines"] == udfs.normalized_lines(r["t"])


def brute_clean(text, smart, typo=(), buffer=None):
    """The pipeline in plain Python: mask, normalise, edit, guard, assemble, guard."""
    from difflib import SequenceMatcher

    limit, most = (0.1, 10) if smart else (0.02, 5)
    buffer = buffer if buffer is not None else 1 if smart else 2
    values, masked, at = [], "", 0
    for i, (a, b, _) in enumerate(merged(text)):
        values.append(text[a:b])
        masked, at = masked + text[at:a] + f"⟦PZ{i}⟧", b
    masked += text[at:]

    def restore(s):
        for i, v in enumerate(values):
            s = s.replace(f"⟦PZ{i}⟧", v)
        return s

    snapshot = now = udfs.normalized(masked)
    edits = 0
    if smart:
        for wanted, skip in ((digraphs, True), (marks, False)):
            spans = [m.span() for m in re.finditer(r"⟦PZ\d+⟧", now)]
            shift, last = 0, -1
            for a, b, new in wanted(now):
                if skip and a < last:
                    continue
                x, y = a + shift, b + shift
                if any(x < q + buffer and y > p - buffer for p, q in spans):
                    continue
                now, shift, last, edits = now[:x] + new + now[y:], shift + len(new) - (b - a), b, edits + 1
        now = re.sub(r"[ \t\f\v]+", " ", now).strip(" \t")
    reasons = []
    base = snapshot or text
    if any(f"⟦PZ{i}⟧" not in now for i in range(len(values))):
        reasons.append("placeholders_missing")
    if 1 - SequenceMatcher(None, base, now).ratio() > limit:
        reasons.append("changed_ratio_exceeded")
    if edits > most:
        reasons.append("edits_limit_exceeded")
    if reasons:
        now = restore(base)
    now = udfs.normalized_lines(restore(now))
    late, rest = [], now
    if re.search(r"⟦PZ\d+⟧", now):
        late.append("placeholders_left")
    for i, v in enumerate(values):
        if v not in rest:
            late.append("protected_mismatch")
            break
        rest = rest.replace(v, f"⟦PZ{i}⟧", 1)
    have = [now[a:b] for a, b, _ in merged(now)]
    if any(have.count(v) < values.count(v) for v in values):
        late.append("protected_detector_mismatch")
    return (restore(base) if late else now), reasons + late


def digraphs(text):
    rules = spelling.digraphs()
    return [(m.start(), m.end(), rules[m[0]]) for m in re.finditer("|".join(rules), text)]


def marks(text):
    found = [(m.start(), m.end(), m[1]) for m in re.finditer(r"[ \t\f\v]+([,.:;!?])", text)]
    return sorted(found + [(m.start(), m.end(), m[1] + " ") for m in re.finditer(r"([,.:;!?])(?=[A-Za-zА-Яа-яЁё])", text)], key=lambda e: e[0])


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(MANY)
@pytest.mark.parametrize("mode", ["strict", "smart"])
def test_pipeline_is_that_of_plain_python(spark, mode, texts):
    texts = [*texts, "жызнь , чяща", "слово ,слово.слово", "a.b" * 12, "plain", "", "x" * 300 + " ,y"]
    df = clean(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), mode)
    for r in df.orderBy("id").collect():
        want = brute_clean(r["text"], mode == "smart")
        assert (r["clean_text"], r["audit"]["rollback_reasons"]) == want, r["text"]


def test_golden(spark):
    rows = [
        ("Привет ,мир!Как дела?", "Привет, мир! Как дела?"),
        ("жызнь и шыло, а потом ещё несколько слов", "жизнь и шило, а потом ещё несколько слов"),
        ("жызнь", "жызнь"),  # too large a share changes
        ("почта a@b.org ,да", "почта a@b.org , да"),  # the blank is too near a zone to go
        ("строка   один\n\n\n\nстрока два \n", "строка один\n\nстрока два\n"),
        ("⟦PZ0⟧ literal", "⟦PZ0⟧ literal"),
    ]
    got = {r["text"]: r for r in clean(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()}
    for t, want in rows:
        assert got[t]["clean_text"] == want
    assert got["⟦PZ0⟧ literal"]["audit"]["rollback_reasons"] == ["placeholders_left"]
    assert got["Привет ,мир!Как дела?"]["audit"]["punctuation_fixes_count"] == 3


def test_candidates_in_the_pipeline(spark):
    rules = config.from_mapping({"rulepack": {"enable_candidate_generation_ru": True, "candidate_backend": "symspell", "typo_map_smart": {"превет": "привет"}}})
    shadow = config.from_mapping({"rulepack": {"enable_candidate_generation_ru": True, "candidate_backend": "symspell", "candidate_shadow_mode_ru": True}})
    words = spark.createDataFrame([("молоко", 0), ("корова", 1), ("трава", 2)], "term string, rank int")
    df = spark.createDataFrame([(1, "превет, карова пьёт молоко и малако, длинная строка для доли правок вот тут"), (2, "трава"), (3, None)], "id int, text string")
    got = {r["id"]: r for r in clean(df, "smart", rules, dictionary=words).collect()}
    assert got[1]["clean_text"].startswith("привет, корова пьёт молоко и малако")
    a = got[1]["audit"]
    assert (a["candidate_generated_count"], a["candidate_applied_count"], a["typo_corrections_count"]) == (1, 1, 2)
    assert a["candidate_rejected_count"] == a["candidate_rejected_no_result_count"] >= 2
    dark = {r["id"]: r for r in clean(df, "smart", shadow, dictionary=words).collect()}
    base = {r["id"]: r for r in clean(df, "smart", config.from_mapping({"rulepack": {"typo_map_smart": {"zzzz": "yyyy"}}})).collect()}
    assert dark[1]["clean_text"] == base[1]["clean_text"] and dark[1]["audit"]["candidate_shadow_skipped_count"] == 1
    with pytest.raises(ValueError):
        clean(df, "smart", rules)
    plain = {r["id"]: r["clean_text"] for r in clean(df, "strict", rules).collect()}
    assert plain[1] == df.where("id = 1").first()["text"] and plain[3] == ""


def test_morphology_guards(spark):
    rules = config.from_mapping({"rulepack": {"enable_candidate_generation_ru": True, "candidate_backend": "symspell", "enable_morph_safety_ru": True}})
    words = spark.createDataFrame([("корова", 0), ("молоко", 1), ("стола", 2)], "term string, rank int")
    ddl = "form string, is_known boolean, score double, pos string, lemma string, grammemes array<string>"
    morph = spark.createDataFrame(
        [("карова", False, 0.1, None, None, None), ("корова", True, 0.9, None, None, None), ("малоко", True, 0.5, None, None, None), ("молоко", True, 0.9, None, None, None), ("столы", True, 0.1, "NOUN", "стол", ["plur", "nomn"]), ("стола", True, 0.2, "NOUN", "стол", ["sing", "gent"])], ddl
    )
    text = "карова пьёт малоко, а столы стоят рядом с длинной стеной у самой реки"
    r = clean(spark.createDataFrame([(text,)], "text string"), "smart", rules, dictionary=words, morph=morph).first()
    assert r["clean_text"] == text.replace("карова", "корова")
    assert r["audit"]["morph_blocked_count"] == 1 and r["audit"]["candidate_rejected_morph_blocked_count"] == 2


def test_stage_of_ones_own_is_guarded(spark):
    if "s9_test" not in stages.REGISTRY:
        stages.register("s9_test", lambda df, ctx: df.withColumn("_text", F.replace(F.col("_text"), F.lit("⟦PZ0⟧"), F.lit("gone"))))
    r = clean(spark.createDataFrame([("see https://x.org now",)], "text string"), "smart", extra=("s9_test",)).first()
    assert r["clean_text"] == "see https://x.org now" and "placeholders_missing" in r["audit"]["rollback_reasons"]
    with pytest.raises(ValueError):
        stages.build(("nope",))


def test_bounds_and_events(spark):
    df = spark.createDataFrame([(1, " \u00a0\n"), (2, "ok"), (3, "x" * 11), (4, None)], "id int, text string")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", bounds(F.col("text"), 10), body_too_large(F.col("text"), 10)).collect()}
    assert got == {1: ("empty", False), 2: ("ok", False), 3: ("too_long", True), 4: ("empty", None)}
    log = events(clean(df.withColumn("text", F.lit("a ,b and some more words to keep the share low"))), "smart").collect()
    assert len(log) == 4 and {r["name"] for r in log} == {"punctuation_fixes_count"}


def test_colon_keeps_its_glue(spark):
    r = column(spark, ["key:превет a:b"], e=punctuation.punct_edits(F.col("t"), typo_keys=("превет",)))[0]
    assert [(e["start"], e["after"]) for e in r["e"]] == [(12, ": ")]


def test_configuration(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("policies:\n  smart:\n    max_changed_char_ratio: 0.5\nlexicon:\n  allowlist: []\n", encoding="utf-8")
    c = config.load(path)
    assert config.policy("smart", c).max_changed_ratio == 0.5 and config.policy("other", c).mode == "strict"
    assert c.lexicon.untouched() == {"TODO", "FIXME"}
    for bad in ({"nope": 1}, {"limits": {"max_text_chars": 0}}, {"rulepack": {"max_edit_distance_ru": 3}}, {"rulepack": {"candidate_backend": "x"}}, {"policies": {"smart": {"enabled_stages": ["s8"]}}}, {"rulepack": {"typo_map_smart": {"a": 1}}}, {"limits": 3}, {"rulepack": {"enable_candidate_generation_ru": True}}):
        with pytest.raises(config.ConfigError):
            config.from_mapping(bad)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.yml")


@pytest.mark.parametrize("candidates", [False, True])
def test_the_gate_judges_what_replaces_a_mapped_token(spark, candidates):
    """Blocked where the token is a good word, allowed where the replacement is clearly better, unknown else; with candidates and without."""
    rules = {"typo_map_smart_ru": {"слово": "злово", "каровва": "корова", "нечто": "ничто"}, "enable_morph_safety_ru": True}
    rules |= {"enable_candidate_generation_ru": True, "candidate_backend": "symspell"} if candidates else {}
    readings = [("слово", True, 0.9), ("злово", True, 0.5), ("каровва", False, 0.1), ("корова", True, 0.8)]
    morph = spark.createDataFrame([(f, k, s, "NOUN", f, ["sing"]) for f, k, s in readings], "form string, is_known boolean, score double, pos string, lemma string, grammemes array<string>")
    words = spark.createDataFrame([("совсем", 0)], "term string, rank int")
    text = "слово каровва нечто и ещё много других слов без ошибок в этом длинном тексте для проверки"
    r = clean(spark.createDataFrame([(text,)], "text string"), "smart", config.from_mapping({"rulepack": rules}), dictionary=words if candidates else None, morph=morph).first()
    assert r["clean_text"] == text.replace("каровва", "корова")
    assert (r["audit"]["morph_blocked_count"], r["audit"]["morph_allowed_count"], r["audit"]["morph_unknown_count"]) == (1, 1, 1)


def test_columns_of_the_table_survive(spark):
    names = ["_text", "_raw", "_n", "row", "raw", "_zones", "_suggested", "_digest"]
    df = spark.createDataFrame([("a  b", *names)], ", ".join(f"`{n}` string" for n in ["text", *names]))
    r = clean(df, "smart").first()
    assert r["clean_text"] == "a b" and [r[n] for n in names] == names
    with pytest.raises(ValueError):
        clean(df.withColumnRenamed("row", "audit"))


def test_long_texts_and_many_matches(spark):
    """Matches on both sides of the borders at which offsets are added up anew."""
    for n in (0, 1, 31, 32, 33, 63, 64, 65, 200):
        text = "x" + " 12 é" * n
        got = spark.createDataFrame([(text,)], "t string").select(regex.spans(F.col("t"), "[0-9]+").alias("s"), regex.neighbours(F.col("t"), "[0-9]+").alias("n")).first()
        want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
        assert [tuple(s) for s in got["s"]] == want
        assert [(s["before"], s["value"], s["after"]) for s in got["n"]] == [(text[a - 1], v, text[b : b + 1]) for a, b, v in want]
    assert spark.createDataFrame([(None,)], "t string").select(regex.spans(F.col("t"), "a").alias("s")).first()["s"] is None


def test_pairs_that_are_never_written():
    """All pairs of a hushing consonant and a vowel, in lower, title and upper case, and what they become."""
    lower = {"жы": "жи", "шы": "ши", "чя": "ча", "щя": "ща", "жя": "жа", "чю": "чу", "щю": "щу", "жю": "жу", "шю": "шу"}
    assert spelling.digraphs() == lower | {k.title(): v.title() for k, v in lower.items()} | {k.upper(): v.upper() for k, v in lower.items()}
