"""Audits of whole runs: root causes of missed corrections, decision buckets, replays of token cases, and comparisons of configurations."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, from_mapping
from ..functions.regex import BLANK, DIGIT, WORD, neighbours, token_pattern
from . import evaluation, lexicon, selector

#: Characters beside a token that wrap it or quote it, and marks that a text may repeat or crowd. Fixed values.
WRAPPING = "*_`~|<>{}[]()"
QUOTING = "\"'«»()[]{}"
OUTER = ("`", "*", "_")
MARKS = "!?.,;:"

LOCAL_FLAGS = ("punctuation_adjacency", "quote_bracket_adjacency", "wrapper_no_touch_style", "mixed_alnum_non_ru_shape")
CASE_FLAGS = ("repeated_punctuation", "missing_extra_spaces", "newline_line_break_noise", "hashtags_mentions_urls")


def local_flags(token: Column) -> dict[str, Column]:
    """What surrounds a token (before, value, after), and its own shape."""
    before, after, value = token["before"], token["after"], token["value"]
    odd = lambda c: (c != "") & ~c.rlike(rf"[\p{{L}}\p{{N}}{BLANK}]")
    among = lambda c, marks: c.isin(*marks)
    edge = F.lit(False)
    for mark in OUTER:
        edge = edge | F.startswith(value, F.lit(mark)) | F.endswith(value, F.lit(mark))
    return {
        "punctuation_adjacency": odd(before) | odd(after),
        "quote_bracket_adjacency": among(before, QUOTING) | among(after, QUOTING),
        "wrapper_no_touch_style": among(before, WRAPPING) | among(after, WRAPPING) | edge,
        "mixed_alnum_non_ru_shape": value.rlike(DIGIT) | (value.rlike("[A-Za-z]") & value.rlike("[А-Яа-яЁё]")),
    }


def case_flags(text: Column) -> dict[str, Column]:
    return {
        "repeated_punctuation": text.rlike(rf"([{MARKS}])\1+"),
        "missing_extra_spaces": F.contains(text, F.lit("  ")) | text.rlike(rf"[,.!?;:][^{BLANK}]"),
        "newline_line_break_noise": F.contains(text, F.lit("\n")),
        "hashtags_mentions_urls": text.rlike(rf"(?:\A|[{BLANK}])[#@][{WORD}-]+") | text.rlike(r"https?://|www\."),
    }


def shape_allowed(token: Column) -> Column:
    return lexicon.key(token).rlike(r"\A[а-яе-]+\z")


def probes(token: Column) -> dict[str, Column]:
    """Other spellings under which a token could be looked up: in lower case, with е for ё, without marks, and without stretched letters."""
    bare = F.regexp_replace(token, rf"[^{WORD}-]", "")
    return {
        "lowercase_gold_in_topk": F.lower(token),
        "yo_to_e_gold_in_topk": F.translate(token, "ёЁ", "еЕ"),
        "strip_punct_gold_in_topk": bare,
        "chat_noise_cleanup_gold_in_topk": F.regexp_replace(F.lower(bare), r"(.)\1{2,}", "$1$1"),
    }


def changed_tokens(cases: DataFrame, id: str = "case_id", output: str = "clean_text") -> DataFrame:
    """Tokens of cases (``id``, input_text, expected_clean_text, ``output``) that should change: ``id``, position, token, gold, applied, the
    flags; and of cases whose token counts differ one row with a null position. Cases that expect no change are left out."""
    flags = [c.alias(n) for n, c in case_flags(F.col("input_text")).items()]
    rows = cases.where("input_text <> expected_clean_text").select(id, *flags, *[neighbours(F.col(c), token_pattern()).alias(f"_{k}") for k, c in (("in", "input_text"), ("gold", "expected_clean_text"), ("out", output))])
    pairs = F.transform("_in", lambda t, i: F.struct(i.alias("position"), t.alias("t"), F.get("_gold", i)["value"].alias("gold"), F.coalesce(F.get("_out", i)["value"], F.lit("")).alias("applied")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.lit(None).cast("struct<before:string,value:string,after:string,hit:boolean>").alias("t"), F.lit(None).cast("string").alias("gold"), F.lit(None).cast("string").alias("applied")))
    wanted = F.when(F.size("_in") != F.size("_gold"), none).otherwise(F.filter(pairs, lambda p: p["t"]["value"] != p["gold"]))
    found = rows.select(id, *CASE_FLAGS, F.explode(wanted).alias("p"))
    return found.select(id, "p.position", F.col("p.t.value").alias("token"), "p.gold", "p.applied", *CASE_FLAGS, *[c.alias(n) for n, c in local_flags(F.col("p.t")).items()])


def root_causes(cases: DataFrame, terms: DataFrame, k: int = 5, distance: int = 2, normalize: bool = True, id: str = "case_id", output: str = "clean_text") -> DataFrame:
    """``changed_tokens`` with has_candidate, gold_in_top_k, selected_gold, status and, for each of ``probes``, whether the gold token is among its
    candidates. Each different spelling is looked up once."""
    rows = changed_tokens(cases, id, output)
    asked = {"own": F.col("token"), **probes(F.col("token"))}
    spelled = rows.where("position is not null").select(F.explode(F.array(*asked.values())).alias("token")).where("token <> ''").distinct()
    found = lexicon.top_k(spelled, terms, k, distance, normalize).groupBy("token").agg(F.collect_set(lexicon.key(F.col("term"))).alias("terms"))
    for name, column in asked.items():
        rows = rows.withColumn(f"_{name}", column).join(found.select(F.col("token").alias(f"_t_{name}"), F.col("terms").alias(f"_k_{name}")), F.col(f"_{name}") == F.col(f"_t_{name}"), "left")
    gold = lexicon.key(F.col("gold"))
    inside = lambda name: F.coalesce(F.array_contains(F.col(f"_k_{name}"), gold), F.lit(False))
    has, top, same = F.col("_k_own").isNotNull(), inside("own"), F.coalesce(lexicon.key(F.col("applied")) == gold, F.lit(False))
    cause = evaluation.root_cause(shape_allowed(F.col("token")), has, top, same, F.col("wrapper_no_touch_style"), F.col("mixed_alnum_non_ru_shape"))
    status = F.when(F.col("position").isNull(), "segmentation_tokenization_mismatch").otherwise(cause)
    return rows.select(id, "position", "token", "gold", "applied", *CASE_FLAGS, *LOCAL_FLAGS, has.alias("has_candidate"), top.alias("gold_in_top_k"), same.alias("selected_gold"), status.alias("status"), *[inside(n).alias(n) for n in asked if n != "own"])


def cause_slices(causes: DataFrame) -> DataFrame:
    """Slices by size: slice, count, rate over the changed tokens (a segmentation mismatch is a case and no token)."""
    n = causes.agg(F.greatest(F.count("position"), F.lit(1)).alias("_n"))  # a single row
    counted = causes.where("status <> 'selected'").groupBy(F.col("status").alias("slice")).agg(F.count(F.lit(1)).alias("count"))
    return counted.crossJoin(F.broadcast(n)).select("slice", "count", (F.col("count") / F.col("_n")).alias("rate")).orderBy(F.desc("count"), "slice")


def noise_breakdown(causes: DataFrame) -> DataFrame:
    """noise, status, n: how often each flag stands at changed tokens that weren't corrected, and under status ``any`` at all of them."""
    flags = F.explode(F.array(*[F.struct(F.lit(f).alias("noise"), F.col(f).alias("on")) for f in (*CASE_FLAGS, *LOCAL_FLAGS)]))
    rows = causes.where("position is not null").select("status", flags.alias("f")).where("f.on")
    each = rows.select("f.noise", F.explode(F.when(F.col("status") == "selected", F.array(F.lit("any"))).otherwise(F.array(F.lit("any"), F.col("status")))).alias("status"))
    return each.groupBy("noise", "status").agg(F.count(F.lit(1)).alias("n"))


def normalization_lifts(causes: DataFrame) -> DataFrame:
    """One row: how many changed tokens have the gold one among their candidates as they are, and under each probe."""
    base = F.count_if(F.col("gold_in_top_k") & shape_allowed(F.col("token")))
    return causes.where("position is not null").agg(base.alias("baseline_gold_in_topk"), *[F.count_if(F.col(n)).alias(n) for n in probes(F.lit(""))])


# --- decisions ---

#: Buckets of a decision audit. Fixed values.
BUCKETS = (
    "baseline_correct_lm_keep_current_apply_wrong", "baseline_wrong_lm_keep_expected_needs_change", "baseline_wrong_lm_corrects_successfully",
    "current_apply_correct_lm_keeps_original", "lm_applies_but_still_misses",
)
TOP_CASES = ("too_conservative", "avoids_current_apply_harm")


def _bucket_tests() -> dict[str, Column]:
    c = F.col
    i, e, b, a, k = (c(n) for n in ("input_text", "expected_clean_text", "baseline_output", "current_apply_output", "lm_output"))
    return dict(zip((*BUCKETS, *TOP_CASES), ((b == e) & (k == i) & (a != e), (b != e) & (k == i) & (e != i), (b != e) & (k == e), (a == e) & (k == i), (k != i) & (k != e), (a == e) & (k == i), (k == e) & (a != e)), strict=True))


def decision_buckets(rows: DataFrame) -> DataFrame:
    """bucket and n for every bucket, from rows (input_text, expected_clean_text, baseline_output, current_apply_output, lm_output)."""
    tests = _bucket_tests()
    sums = rows.agg(*[F.count_if(tests[b]).alias(b) for b in BUCKETS])
    return evaluation.melted(sums, BUCKETS, "bucket")


def decision_examples(rows: DataFrame, n: int = 20, order: str = "case_id") -> DataFrame:
    """The first ``n`` rows (by ``order``) of each of ``TOP_CASES``, with their list's name."""
    tests = _bucket_tests()
    listed = F.explode(F.array_compact(F.array(*[F.when(tests[t], F.lit(t)) for t in TOP_CASES])))
    return evaluation.examples(rows.withColumn("list", listed), "list", [order], n)


def shortlist_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """run (before, after) with a run's matches, wrong changes, kept originals, and what became of cases whose gold token was in the list.

    Rows: input_text, expected_clean_text, output, gold_in_top_k, outcome (selected, original_wins, other_wins or blocked)."""
    both = before.withColumn("run", F.lit("before")).unionByName(after.withColumn("run", F.lit("after")))
    c, n = F.col, F.count(F.lit(1))
    right, kept = c("output") == c("expected_clean_text"), c("output") == c("input_text")
    return both.groupBy("run").agg(
        n.alias("total_cases"), F.count_if(right).alias("exact_match_pass_count"), F.count_if(~right & ~kept).alias("wrong_change"), F.count_if(kept).alias("keep_original_count"),
        F.count_if(c("gold_in_top_k") & (c("outcome") == "selected")).alias("gold_in_topk_selected_count"), F.count_if(c("gold_in_top_k") & (c("outcome") != "selected")).alias("gold_present_in_topk_but_not_selected"),
    )


# --- replays ---


def token_replay(cases: DataFrame, found: DataFrame, scorer: str = "rank", k: int = 5, min_confidence: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """Decisions for token cases (case_id, input_text, expected_clean_text) with candidates ``found`` (token, candidate, rank, position).

    The original token is appended with rank 0 where it isn't among a case's candidates, and then the list is cut to ``k``; so a full list
    has no original. A case without a token or an expected one is an error."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    token, want = F.trim("input_text"), F.trim("expected_clean_text")
    whole = F.when((token != "") & (want != ""), token).otherwise(F.raise_error(F.lit("a token case is not complete")).cast("string"))
    listed = found.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(F.col("candidate").alias("token"), F.col("rank").cast("int").alias("rank")).alias("c")))).alias("_all"))
    rows = cases.select("case_id", whole.alias("original"), want.alias("expected"))
    rows = rows.join(listed.select(F.col("token").alias("_of"), F.transform("_all", lambda x: x["c"]).alias("_c")), F.col("original") == F.col("_of"), "left")
    own = F.struct(F.col("original").alias("token"), F.lit(0).alias("rank"))
    options = F.coalesce("_c", F.expr("cast(array() as array<struct<token:string,rank:int>>)"))
    options = F.when(F.exists(options, lambda o: o["token"] == F.col("original")), options).otherwise(F.concat(options, F.array(own)))
    ready = rows.select("case_id", "original", "expected", F.slice(options, 1, k).alias("candidates"), F.expr("cast(map() as map<string,double>)").alias("scores"))
    return selector.replay(ready, scorer, min_confidence, min_margin)


def available(module: str) -> bool:
    """Whether an optional module is installed."""
    return find_spec(module) is not None


def challenger(mode: str, model: str | None = None) -> tuple[str, str | None]:
    """The scorer that a comparison runs against ranks, and why the one that was asked for can't run: without a model, or one that can't
    be used, the comparison falls back to reversed ranks."""
    if mode == "lm":
        return ("lm", None) if model else ("reverse_rank", "the language model's path is missing")
    return ("context" if mode == "heuristic" else "reverse_rank"), None


def scorer_source(config: dict, evaluated: str) -> tuple[str, str]:
    """(kind, path) of the language model that a configuration names: a model, or a corpus to train one on, which may not be the
    evaluated table."""
    kind = config.get("scorer_type")
    if kind != "lm":
        raise ValueError(f"unsupported scorer_type: {kind}")
    if config.get("model_path"):
        return "model", config["model_path"]
    corpus = config.get("training_corpus_path")
    if not corpus or corpus == evaluated:
        raise ValueError("the scorer needs a model, or a training corpus other than the evaluated one")
    return "corpus", corpus


# --- harness ---

#: Modes of the candidate harness: candidates on, shadow, backend. Fixed values.
MODES = {"baseline": (False, False, "none"), "rapidfuzz_shadow": (True, True, "rapidfuzz"), "rapidfuzz_apply": (True, False, "rapidfuzz"), "symspell_shadow": (True, True, "symspell"), "symspell_apply": (True, False, "symspell")}
SUMMED = ("generated", "applied", "rejected", "ambiguous", "rejected_no_result", "rejected_unsafe_candidate", "rejected_morph_blocked", "rejected_morph_unknown", "ambiguous_tie", "shadow_skipped")


def mode_config(mode: str, source: str = "dictionary") -> Config:
    on, shadow, backend = MODES[mode]
    stages = ["s1_normalize", "s2_segment", "s3_spelling", "s6_guardrails", "s7_assemble"]
    rules = {"enable_candidate_generation_ru": on, "candidate_shadow_mode_ru": shadow, "candidate_backend": backend, "max_candidates_ru": 3, "max_edit_distance_ru": 1, "dictionary_source_ru": source, "typo_min_token_len": 2, "no_touch_prefixes_ru": ["@"]}
    return from_mapping({"policies": {"smart": {"enabled_stages": stages, "max_changed_char_ratio": 1.0}}, "rulepack": rules})


def run_mode(cases: DataFrame, mode: str, dictionary: DataFrame | None, morph: DataFrame | None = None) -> DataFrame:
    """Cases (input_text, expected_clean_text) cleaned as a mode of the harness does, with the mode's name."""
    from ..plans.clean import clean

    return clean(cases, "smart", mode_config(mode), text="input_text", dictionary=dictionary, morph=morph).withColumn("mode", F.lit(mode))


def harness_totals(runs: DataFrame, by: str = "mode") -> DataFrame:
    """By mode: cases, the sums of the ten candidate counters, rollbacks, exact matches and their rate."""
    n, right = F.count(F.lit(1)), F.count_if(F.col("clean_text") == F.col("expected_clean_text"))
    sums = [F.sum(F.col("audit")[f"candidate_{c}_count"]).alias(f"candidate_{c}_total") for c in SUMMED]
    return runs.groupBy(by).agg(n.alias("total_cases"), *sums, F.count_if("audit.rollback_applied").alias("rollback_total"), right.alias("exact_match_pass_count"), evaluation.rate(right, n).alias("exact_match_pass_rate"))


def harness(cases: DataFrame, dictionary: DataFrame, morph: DataFrame | None = None, modes: tuple[str, ...] = tuple(MODES)) -> DataFrame:
    """``harness_totals`` of all modes in one aggregation."""
    runs = None
    for mode in modes:
        one = run_mode(cases, mode, dictionary, morph).select("mode", "expected_clean_text", "clean_text", "audit")
        runs = one if runs is None else runs.unionByName(one)
    return harness_totals(runs)


def experiment(rows: DataFrame, runs: dict[str, str], baseline: str, id: str = "case_id") -> DataFrame:
    """By run: matches, wrong changes, and cases that the run spoils which the ``baseline`` run had right. ``runs`` maps names to columns."""
    c = F.col
    long = evaluation.unpivoted(rows, runs, [id, "input_text", "expected_clean_text", runs[baseline]]) if runs[baseline] not in ("input_text", "expected_clean_text") else evaluation.unpivoted(rows, runs, [id, "input_text", "expected_clean_text"])
    right, before = c("output") == c("expected_clean_text"), c(runs[baseline]) == c("expected_clean_text")
    n = F.count(F.lit(1))
    return long.groupBy("mode").agg(n.alias("total_cases"), F.count_if(right).alias("exact_match_pass_count"), evaluation.rate(F.count_if(right), n).alias("exact_match_pass_rate"), F.count_if(~right & (c("output") != c("input_text"))).alias("wrong_change"), F.count_if(before & ~right).alias("regresses_expected_match"))


def baseline_report(totals: DataFrame, spark: SparkSession | None = None) -> list[str]:
    """Markdown lines of ``harness_totals`` rows with a corpus column: a table for each corpus, and whether every corpus gains and none is unsafe."""
    names = ("mode", "exact_match_pass_count", "exact_match_pass_rate", "candidate_applied_total", "rollback_total")
    rows = sorted(totals.select("corpus", *names, "candidate_rejected_unsafe_candidate_total").collect(), key=lambda r: (r["corpus"], list(MODES).index(r["mode"])))
    lines, lift, safe = ["# Candidate baseline"], True, True
    for corpus in sorted({r["corpus"] for r in rows}):
        own = [r for r in rows if r["corpus"] == corpus]
        lines += ["", f"## {corpus}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in own)]
        base = next(r for r in own if r["mode"] == "baseline")
        applied = [r for r in own if r["mode"].endswith("_apply")]
        lift &= any(r["exact_match_pass_rate"] > base["exact_match_pass_rate"] for r in applied)
        safe &= all(r["candidate_rejected_unsafe_candidate_total"] == 0 and r["rollback_total"] == 0 for r in applied)
    return [*lines, "", "## Verdict", "", f"- lift on every corpus: {'yes' if lift else 'no'}", f"- safe on every corpus: {'yes' if safe else 'no'}"]
