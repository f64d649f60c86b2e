"""More registered queries: runs, decisions and tokens are derived from the tables by expressions that Spark and the SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import from_mapping
from .functions import regex, zones
from .operators import audit, candidates, evaluation, lexicon, morph, punctuation, review, selector, spelling, stages
from .plans.clean import body_too_large
from .queries import _read, query

# --- runs over conversations: a turn is a case, what it should become and what each run makes of it are functions of it ---

_RUN = (
    "conv_id * 1000 + turn AS case_id", "text AS input_text", "CASE WHEN length(text) % 4 = 0 THEN text ELSE lower(text) END AS expected_clean_text",
    "CASE WHEN conv_id % 3 = 0 THEN lower(text) ELSE text END AS baseline_output", "CASE WHEN conv_id % 5 < 2 THEN lower(text) WHEN conv_id % 5 = 2 THEN upper(text) ELSE text END AS current_apply_output",
    "CASE WHEN turn % 2 = 0 THEN lower(text) WHEN conv_id % 7 = 0 THEN upper(text) ELSE text END AS lm_output", "conv_id % 11 = 0 AS rolled", "turn % 3 AS generated", "turn % 2 AS applied", "conv_id % 4 AS ambiguous", "conv_id % 13 AS unsafe",
    "CASE WHEN conv_id % 2 = 0 THEN 'product_regression_pack' ELSE 'custom_jsonl' END AS source", "CASE WHEN turn % 4 = 1 THEN 'protected zones' ELSE 'other' END AS category",
)
_R = f"WITH r AS (SELECT {', '.join(_RUN)} FROM conversations WHERE text IS NOT NULL)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").where("text IS NOT NULL").selectExpr(*_RUN)


_OUT = ("baseline_output", "current_apply_output", "lm_output")
_LONG = f"{_R}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS mode, {c} AS output, r.* FROM r" for c in _OUT)})"


def _long(rows: DataFrame) -> DataFrame:
    return evaluation.unpivoted(rows, {c: c for c in _OUT}, ["case_id", "input_text", "expected_clean_text"])


@query(f"""{_LONG} SELECT mode, count(*) AS total_cases, count(*) FILTER (WHERE output = expected_clean_text) AS exact_match_count, count(*) FILTER (WHERE output <> input_text) AS changed_count,
count(*) FILTER (WHERE output = input_text AND expected_clean_text <> input_text) AS unchanged_when_expected_change_count, count(*) FILTER (WHERE output <> input_text AND output <> expected_clean_text) AS wrong_change_count,
count(*) FILTER (WHERE output = input_text AND expected_clean_text = input_text) AS no_change_as_expected_count, round(count(*) FILTER (WHERE output = expected_clean_text) / count(*), 6) AS exact_match_rate FROM l GROUP BY mode""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mode_summary(evaluation.outcomes(_long(_runs(spark, sf_dir)), output="output"), ["mode"])


@query(f"""{_LONG} SELECT mode, count(*) AS total_cases, count(*) FILTER (WHERE output = expected_clean_text) AS exact_match_pass_count, round(count(*) FILTER (WHERE output = expected_clean_text) / count(*), 9) AS exact_match_pass_rate,
count(*) FILTER (WHERE output <> expected_clean_text AND output <> input_text) AS wrong_change, count(*) FILTER (WHERE output <> expected_clean_text AND current_apply_output = expected_clean_text) AS smart_regresses_expected_match,
count(*) FILTER (WHERE rolled AND mode = 'lm_output') AS rollback_related FROM l GROUP BY mode""")
def research_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.research_summary(_runs(spark, sf_dir), {c: c for c in _OUT}, rolled={"lm_output": "rolled"})
    return out.withColumn("exact_match_pass_rate", F.round("exact_match_pass_rate", 9))


@query(f"""{_LONG} SELECT mode, count(*) FILTER (WHERE output = expected_clean_text AND current_apply_output <> expected_clean_text) AS beats,
count(*) FILTER (WHERE output <> expected_clean_text AND current_apply_output = expected_clean_text) AS worse FROM l WHERE mode <> 'current_apply_output' GROUP BY mode""")
def challengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.beats(_runs(spark, sf_dir), {c: c for c in ("baseline_output", "lm_output")})


@query(f"""{_LONG} SELECT mode, count(*) AS total_cases, count(*) FILTER (WHERE output = expected_clean_text) AS exact_match_pass_count, round(count(*) FILTER (WHERE output = expected_clean_text) / count(*), 6) AS exact_match_pass_rate,
count(*) FILTER (WHERE output <> expected_clean_text AND output <> input_text) AS wrong_change, count(*) FILTER (WHERE output <> expected_clean_text AND baseline_output = expected_clean_text) AS regresses_expected_match FROM l GROUP BY mode""")
def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.experiment(_runs(spark, sf_dir), {c: c for c in _OUT}, "baseline_output")


_FLAGS = "output = expected_clean_text AS exact_match, output = input_text AND expected_clean_text <> input_text AS unchanged_when_expected_change, output <> input_text AND output <> expected_clean_text AS wrong_change"


@query(f"""{_LONG}, m AS (SELECT case_id, mode, applied, {_FLAGS} FROM l), p AS (SELECT a.exact_match AS ae, b.exact_match AS be,
a.unchanged_when_expected_change <> b.unchanged_when_expected_change OR a.wrong_change <> b.wrong_change AS d FROM m a JOIN m b ON a.case_id = b.case_id AND a.mode = 'baseline_output' AND b.mode = 'lm_output')
SELECT count(*) FILTER (WHERE be AND NOT ae) AS smart_improves_expected_match, count(*) FILTER (WHERE ae AND NOT be) AS smart_regresses_expected_match, count(*) FILTER (WHERE d) AS cases_with_behavior_delta FROM p""")
def modes_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumnRenamed("applied", "candidate_applied_count")
    return evaluation.compare_modes(*[evaluation.outcomes(rows, output=c) for c in ("baseline_output", "lm_output")])


_SLICE = """CASE WHEN s = '' THEN 'mismatch_without_candidate_signal' ELSE s END"""


@query(f"""{_LONG}, m AS (SELECT case_id, rolled, generated, applied, ambiguous, unsafe, {_FLAGS} FROM l WHERE mode = 'lm_output'),
t AS (SELECT case_id, concat_ws(' + ', CASE WHEN unchanged_when_expected_change THEN 'unchanged_when_expected_change' END, CASE WHEN wrong_change THEN 'wrong_change' END, CASE WHEN generated > 0 AND applied = 0 THEN 'candidate_generated_not_applied' END,
CASE WHEN generated = 2 THEN 'candidate_rejected_no_result' END, CASE WHEN ambiguous > 0 THEN 'candidate_ambiguous' END, CASE WHEN unsafe = 3 THEN 'morph_blocked' END, CASE WHEN unsafe = 4 THEN 'morph_unknown' END, CASE WHEN unsafe > 6 THEN 'unsafe_rejected' END, CASE WHEN rolled THEN 'rollback_related' END) AS s FROM m WHERE NOT exact_match)
SELECT {_SLICE} AS slice, count(*) AS count FROM t GROUP BY 1 ORDER BY count(*) DESC, min(case_id) LIMIT 5""")
def top_mismatch_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = evaluation.outcomes(_runs(spark, sf_dir), output="lm_output").withColumns({
        "candidate_generated_count": c("generated"), "candidate_applied_count": c("applied"), "candidate_rejected_no_result_count": (c("generated") == 2).cast("int"), "candidate_ambiguous_count": c("ambiguous"), "candidate_ambiguous_tie_count": F.lit(0),
        "candidate_rejected_morph_blocked_count": (c("unsafe") == 3).cast("int"), "candidate_rejected_morph_unknown_count": (c("unsafe") == 4).cast("int"), "candidate_rejected_unsafe_candidate_count": (c("unsafe") > 6).cast("int"), "rollback_applied": c("rolled"),
    })
    return evaluation.slices(rows)


@query(f"""{_R}, s AS (SELECT count(*) FILTER (WHERE baseline_output = expected_clean_text AND lm_output = input_text AND current_apply_output <> expected_clean_text) AS b0,
count(*) FILTER (WHERE baseline_output <> expected_clean_text AND lm_output = input_text AND expected_clean_text <> input_text) AS b1, count(*) FILTER (WHERE baseline_output <> expected_clean_text AND lm_output = expected_clean_text) AS b2,
count(*) FILTER (WHERE current_apply_output = expected_clean_text AND lm_output = input_text) AS b3, count(*) FILTER (WHERE lm_output <> input_text AND lm_output <> expected_clean_text) AS b4 FROM r)
{' UNION ALL '.join(f"SELECT '{b}' AS bucket, b{i} AS n FROM s" for i, b in enumerate(audit.BUCKETS))}""")
def decision_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decision_buckets(_runs(spark, sf_dir))


@query(f"""{_R}, t AS (SELECT 'too_conservative' AS list, case_id FROM r WHERE current_apply_output = expected_clean_text AND lm_output = input_text UNION ALL SELECT 'avoids_current_apply_harm', case_id FROM r WHERE lm_output = expected_clean_text AND current_apply_output <> expected_clean_text)
SELECT list, case_id FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY case_id) AS n FROM t) WHERE n <= 20""")
def decision_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decision_examples(_runs(spark, sf_dir)).select("list", "case_id")


_SHORT = "CASE WHEN unsafe = 0 THEN 'blocked' WHEN {0} = expected_clean_text THEN 'selected' WHEN {0} = input_text THEN 'original_wins' ELSE 'other_wins' END"


@query(f"""{_R}, t AS ({' UNION ALL '.join(f"SELECT '{n}' AS run, input_text AS i, expected_clean_text AS e, {c} AS o, ambiguous > 0 AS top, {_SHORT.format(c)} AS outcome FROM r" for n, c in (("before", "baseline_output"), ("after", "lm_output")))})
SELECT run, count(*) AS total_cases, count(*) FILTER (WHERE o = e) AS exact_match_pass_count, count(*) FILTER (WHERE o <> e AND o <> i) AS wrong_change, count(*) FILTER (WHERE o = i) AS keep_original_count,
count(*) FILTER (WHERE top AND outcome = 'selected') AS gold_in_topk_selected_count, count(*) FILTER (WHERE top AND outcome <> 'selected') AS gold_present_in_topk_but_not_selected FROM t GROUP BY run""")
def shortlist_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    side = lambda c: rows.selectExpr("input_text", "expected_clean_text", f"{c} AS output", "ambiguous > 0 AS gold_in_top_k", f"{_SHORT.format(c)} AS outcome")
    return audit.shortlist_audit(side("baseline_output"), side("lm_output"))


_COUNTERS = {"generated": "generated", "applied": "applied", "rejected": "unsafe", "ambiguous": "ambiguous", "rejected_no_result": "generated", "rejected_unsafe_candidate": "unsafe", "rejected_morph_blocked": "applied", "rejected_morph_unknown": "ambiguous", "ambiguous_tie": "ambiguous", "shadow_skipped": "applied"}


@query(f"""{_LONG} SELECT mode, count(*) AS total_cases, {', '.join(f"CAST(sum({c}) AS BIGINT) AS candidate_{k}_total" for k, c in _COUNTERS.items())}, count(*) FILTER (WHERE rolled) AS rollback_total,
count(*) FILTER (WHERE output = expected_clean_text) AS exact_match_pass_count, round(count(*) FILTER (WHERE output = expected_clean_text) / count(*), 6) AS exact_match_pass_rate FROM l GROUP BY mode""")
def harness_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    stats = F.struct(*[F.col(c).alias(f"candidate_{k}_count") for k, c in _COUNTERS.items()], F.col("rolled").alias("rollback_applied"))
    long = evaluation.unpivoted(rows.withColumn("audit", stats), {c: c for c in _OUT}, ["expected_clean_text", "audit"])
    return audit.harness_totals(long.withColumnRenamed("output", "clean_text"))


@query(f"""{_R}, t AS ({' UNION ALL '.join(f"SELECT '{k}' AS role, generated, unsafe FROM r WHERE {c}" for k, c in (("won", "lm_output = expected_clean_text"), ("lost", "lm_output <> expected_clean_text"), ("rolled", "rolled")))})
SELECT role, CAST(sum(generated) AS BIGINT) AS generated_sum, CAST(sum(unsafe) AS BIGINT) AS unsafe_sum FROM t GROUP BY role""")
def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumns({"won": F.expr("lm_output = expected_clean_text"), "lost": F.expr("lm_output <> expected_clean_text")})
    return evaluation.contributions(rows, ["won", "lost", "rolled"], ["generated", "unsafe"])


@query("""WITH t AS (SELECT conv_id, turn % 3 > 0 AS any_, turn % 3 = 2 AS gold FROM conversations), c AS (SELECT conv_id, bool_or(any_) AS a, bool_or(gold) AS g, count(*) AS n, count(*) FILTER (WHERE any_) AS na, count(*) FILTER (WHERE gold) AS ng FROM t GROUP BY conv_id)
SELECT count(*) AS cases, count(*) FILTER (WHERE a) AS cases_any, count(*) FILTER (WHERE g) AS cases_gold, round(count(*) FILTER (WHERE g) / count(*), 6) AS gold_rate, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(na) AS BIGINT) AS tokens_any, CAST(sum(ng) AS BIGINT) AS tokens_gold FROM c""")
def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").selectExpr("conv_id AS case_id", "turn % 3 > 0 AS has_candidate", "turn % 3 = 2 AS gold_in_top_k")
    return evaluation.coverage(rows)


@query(f"""{_R}, t AS (SELECT input_text AS i, CASE WHEN unsafe > 2 THEN expected_clean_text END AS e, lm_output AS o FROM r)
SELECT count(*) AS total, count(*) FILTER (WHERE o <> i) AS changed, count(*) FILTER (WHERE o = i) AS unchanged, count(e) AS with_expectation, count(*) FILTER (WHERE o = e) AS exact, round(count(*) FILTER (WHERE o = e) / count(e), 6) AS exact_rate FROM t""")
def pilot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).selectExpr("input_text", "lm_output AS clean_text", "CASE WHEN unsafe > 2 THEN expected_clean_text END AS expected_clean_text")
    return evaluation.pilot_summary(rows)


_DELTA = """CASE WHEN a = b THEN NULL WHEN b = e AND a <> e THEN 'smart_improves_expected_match' WHEN a = e AND b <> e THEN 'smart_regresses_expected_match' WHEN a = e AND b = e THEN 'both_match_expected_but_different_output' ELSE 'profile_outputs_differ_need_human_review' END"""
_D = f"{_R}, d AS (SELECT case_id, input_text AS i, expected_clean_text AS e, baseline_output AS a, current_apply_output AS b, {_DELTA.replace('a =', 'baseline_output =').replace('b =', 'current_apply_output =').replace('= b', '= current_apply_output').replace('<> e', '<> expected_clean_text').replace('= e ', '= expected_clean_text ').replace('a <>', 'baseline_output <>').replace('b <>', 'current_apply_output <>')} AS why FROM r)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumnsRenamed({"baseline_output": "output_safe_default", "current_apply_output": "output_smart_baseline"})
    return evaluation.delta_rows(rows)


@query(f"{_D} SELECT coalesce(why, 'none') AS reason, count(*) AS n FROM d GROUP BY 1")
def product_delta_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).groupBy(F.coalesce("user_visible_delta_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_D} SELECT count(*) AS total_cases, count(*) FILTER (WHERE a = b) AS unchanged_across_profiles, count(*) FILTER (WHERE a <> b) AS changed_only_in_smart_baseline, count(*) FILTER (WHERE b = e) AS smart_expected_matches,
count(*) FILTER (WHERE a = e) AS safe_expected_matches, count(*) FILTER (WHERE a <> b AND (a = e) = (b = e)) AS cases_needing_human_look FROM d""")
def product_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.delta_summary(_deltas(spark, sf_dir))


@query(f"""{_D}, k AS (SELECT case_id, CASE WHEN why = 'smart_improves_expected_match' THEN 'improvement' WHEN a = b AND i = a AND i = b AND i = e THEN 'preservation' WHEN why IS NOT NULL THEN 'caution' END AS class FROM d)
SELECT class, case_id FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY case_id) AS n FROM k WHERE class IS NOT NULL) WHERE n <= 7""")
def showcase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.showcase(_deltas(spark, sf_dir), 7, "case_id").select("class", "case_id")


_WHY = {
    "rollback_related": "rolled", "candidate_rejected_unsafe": "unsafe > 6", "candidate_ambiguous": "ambiguous > 0", "candidate_generated_not_applied": "generated > 0 AND applied = 0", "expected_mismatch": "lm_output <> expected_clean_text",
    "user_visible_change": "lm_output <> input_text", "protected_context_case": "source = 'product_regression_pack' AND category = 'protected zones'", "complex_user_like": "source = 'product_regression_pack' AND category = 'protected zones'",
}
_W = f"{_R}, w AS (SELECT case_id, input_text, list_filter([{', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _WHY.items())}], lambda x: x IS NOT NULL) AS reasons FROM r)"


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = F.col, _runs(spark, sf_dir)
    stats = F.struct(c("rolled").alias("rollback_applied"), (c("unsafe") > 6).cast("int").alias("candidate_rejected_unsafe_candidate_count"), c("ambiguous").alias("candidate_ambiguous_count"), F.lit(0).alias("candidate_ambiguous_tie_count"), c("generated").alias("candidate_generated_count"), c("applied").alias("candidate_applied_count"))
    return rows.withColumn("reasons", review.reasons(c("input_text"), c("lm_output"), c("expected_clean_text"), c("source"), c("category"), stats))


@query(f"""{_W} SELECT case_id, reasons[1] AS primary_reason, len(reasons) - 1 AS others FROM w WHERE len(reasons) > 0 ORDER BY list_position([{', '.join(f"'{k}'" for k in _WHY)}], reasons[1]), length(input_text), case_id LIMIT 60""")
def review_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pack(_reviewed(spark, sf_dir), 60, "case_id").select("case_id", "primary_reason", F.size("secondary_reasons").cast("long").alias("others"))


@query(f"{_W} SELECT x AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS x FROM w) GROUP BY x")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reason_counts(_reviewed(spark, sf_dir)).select("reason", "n")


# --- selection over conversations: the words around a turn are its candidates ---

_WORDS = """w AS (SELECT conv_id AS case_id, turn AS pos, role AS token, CAST(length(text) % 9 AS INT) AS rank, length(text) % 101 / 100.0 AS score FROM conversations WHERE text IS NOT NULL),
c AS (SELECT case_id, token, min(pos) AS pos, arg_min(rank, pos) AS rank, arg_min(score, pos) AS score FROM w GROUP BY case_id, token)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose candidates are the roles of a conversation, each once, in the order of their first turn."""
    talks = _read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    first = talks.groupBy("conv_id", "role").agg(F.min(F.struct("turn", (F.length("text") % 9).cast("int").alias("rank"), (F.length("text") % 101 / 100.0).cast("double").alias("score"))).alias("f"))
    listed = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("f.turn", "role", "f.rank", "f.score"))).alias("x"))
    return listed.select(F.col("conv_id").cast("string").alias("case_id"), F.lit("user").alias("original"), F.lit("assistant").alias("expected"), F.transform("x", lambda e: F.struct(e["role"].alias("token"), e["rank"].alias("rank"))).alias("candidates"), F.map_from_entries(F.transform("x", lambda e: F.struct(e["role"], e["score"]))).alias("scores"))


_DECIDED = """{p}r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {s} DESC, pos) AS rn, lead({s}) OVER (PARTITION BY case_id ORDER BY {s} DESC, pos) AS nxt FROM c),
{p}d AS (SELECT case_id, token, CASE WHEN {s} < 0.1 THEN 'low_confidence' WHEN nxt IS NOT NULL AND {s} - nxt < 0.05 THEN 'low_margin' WHEN token = 'user' THEN 'original_wins' ELSE 'apply_candidate' END AS reason FROM {p}r WHERE rn = 1),
{p}s AS (SELECT count(*) AS total_cases, count(*) FILTER (WHERE sel = 'assistant') AS matched, count(*) FILTER (WHERE reason = 'apply_candidate') AS changed, count(*) FILTER (WHERE reason = 'apply_candidate' AND sel = 'assistant') AS mc FROM (SELECT *, CASE WHEN reason = 'apply_candidate' THEN token ELSE 'user' END AS sel FROM {p}d))"""


@query(f"""WITH {_WORDS}, {_DECIDED.format(p='a', s='score')} SELECT reason, count(*) AS n FROM ad GROUP BY reason""".replace("\nas AS", "\n\"as\" AS"))
def replay_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector.replay(_scored(spark, sf_dir), "table", 0.1, 0.05).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_WORDS}, {_DECIDED.format(p='a', s='score')} SELECT total_cases, matched AS expected_match_count, round(matched / total_cases, 6) AS expected_match_rate, changed AS changed_count, total_cases - changed AS kept_original_count,
mc AS expected_match_when_changed_count, round(CASE WHEN changed > 0 THEN mc / changed ELSE 0 END, 6) AS expected_match_when_changed_rate FROM as_""".replace("FROM as_", "FROM \"as\"").replace("\nas AS", "\n\"as\" AS"))
def replay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector.summary(selector.replay(_scored(spark, sf_dir), "table", 0.1, 0.05)).drop("decision_reason_counts")


_NAMED = {"expected_match_count": "matched", "changed_count": "changed", "kept_original_count": "total_cases - changed", "expected_match_when_changed_count": "mc", "total_cases": "total_cases"}


@query(f"""WITH {_WORDS}, {_DECIDED.format(p='a', s='score')}, {_DECIDED.format(p='b', s='rank')}, rr AS (SELECT coalesce(x.reason, y.reason) AS reason, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM (SELECT reason, count(*) AS n FROM ad GROUP BY 1) x FULL JOIN (SELECT reason, count(*) AS n FROM bd GROUP BY 1) y ON x.reason = y.reason)
SELECT 'reason:' || reason AS name, CAST(delta AS DOUBLE) AS delta FROM rr UNION ALL {' UNION ALL '.join(f"SELECT '{k}', CAST((SELECT {e} FROM bs) - (SELECT {e} FROM \"as\") AS DOUBLE)" for k, e in _NAMED.items())}
UNION ALL SELECT 'expected_match_rate', round((SELECT round(matched / total_cases, 6) FROM bs) - (SELECT round(matched / total_cases, 6) FROM "as"), 6)
UNION ALL SELECT 'expected_match_when_changed_rate', round((SELECT round(CASE WHEN changed > 0 THEN mc / changed ELSE 0 END, 6) FROM bs) - (SELECT round(CASE WHEN changed > 0 THEN mc / changed ELSE 0 END, 6) FROM "as"), 6)""".replace("\nas AS", "\n\"as\" AS"))
def scorer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _scored(spark, sf_dir)
    return selector.compare(selector.replay(cases, "table", 0.1, 0.05), selector.replay(cases, "rank", 0.1, 0.05))


@query(f"""WITH {_WORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS p FROM c WHERE token <> 'user'), x AS (SELECT case_id, token, rank, p FROM k UNION ALL SELECT DISTINCT case_id, 'user', 0, 99 FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p) AS q FROM x), z AS (SELECT * FROM y WHERE q <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank DESC, q) AS rn FROM z)
SELECT case_id, token AS best, CASE WHEN token = 'user' THEN 'original_wins' ELSE 'apply_candidate' END AS reason FROM b WHERE rn = 1""")
def token_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token cases with the original appended and the list cut to two; each conversation's token is its own."""
    talks = _scored(spark, sf_dir)
    name = lambda role: F.concat_ws(":", role, F.col("case_id"))
    found = talks.select("case_id", F.posexplode(F.filter("candidates", lambda x: x["token"] != "user")).alias("position", "c")).select(name(F.lit("user")).alias("token"), name(F.col("c.token")).alias("candidate"), F.col("c.rank").alias("rank"), "position")
    cases = talks.select("case_id", name(F.lit("user")).alias("input_text"), name(F.lit("assistant")).alias("expected_clean_text"))
    return audit.token_replay(cases, found, "rank", 2).select(F.col("case_id").cast("long").alias("case_id"), F.split("best", ":")[0].alias("best"), "reason")


# --- truth tables ---


@query("""WITH b AS (SELECT i, i % 2 = 1 AS shape, i // 2 % 2 = 1 AS has, i // 4 % 2 = 1 AS top, i // 8 % 2 = 1 AS sel, i // 16 % 2 = 1 AS wrap, i // 32 % 2 = 1 AS mixed FROM range(64) t(i))
SELECT i, CASE WHEN NOT shape THEN 'token_rejected_before_retrieval' WHEN has THEN CASE WHEN NOT top THEN 'candidate_exists_but_gold_absent_topk' WHEN NOT sel THEN 'gold_present_in_topk_but_not_selected' ELSE 'selected' END
WHEN wrap THEN 'candidate_polluted_by_punctuation_wrappers' WHEN mixed THEN 'no_candidate_due_to_token_shape' WHEN top AND NOT sel THEN 'gold_present_in_topk_but_not_selected' ELSE 'other' END AS status FROM b""")
def root_cause_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda k: F.col("i").bitwiseAND(1 << k) > 0
    return spark.range(64).withColumnRenamed("id", "i").select("i", evaluation.root_cause(*[bit(k) for k in range(6)]).alias("status"))


_GRID = "WITH g AS (SELECT i, i % 3 AS x, i // 3 % 3 AS y, i // 9 % 3 AS z, i // 27 % 3 AS u FROM range(81) t(i))"


@query(f"""{_GRID}, s AS (SELECT i, ['ok', 'fail', 'missing'][x + 1] AS config, ['ok', 'failed', 'unknown'][y + 1] AS regression, ['present', 'generated', 'missing'][z + 1] AS delta, ['present', 'generated', 'missing'][u + 1] AS manual FROM g)
SELECT i, CASE WHEN config = 'fail' OR regression = 'failed' THEN 'not_ready' WHEN config = 'ok' AND regression = 'ok' AND delta <> 'missing' AND manual <> 'missing' THEN 'ready_for_review' ELSE 'review_needed' END AS status FROM s""")
def readiness_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda names, k: F.get(F.array(*map(F.lit, names)), (F.floor(F.col("i") / 3**k) % 3).cast("int"))
    made = ("present", "generated", "missing")
    return spark.range(81).withColumnRenamed("id", "i").select("i", review.readiness(of(("ok", "fail", "missing"), 0), of(("ok", "failed", "unknown"), 1), of(made, 2), of(made, 3)).alias("status"))


@query(f"""{_GRID} SELECT i, CASE WHEN x = 0 OR y > 0 THEN 'blocked' WHEN y + z + u = 0 THEN 'needs_follow_up' WHEN x * 2 > y + z + u OR z > 0 THEN 'needs_follow_up' ELSE 'approved_for_controlled_apply_review' END AS outcome,
CASE WHEN x = 0 OR y > 0 THEN 'inspect_blocking_cases' WHEN y + z + u = 0 THEN 'keep_shadow_only' WHEN x * 2 > y + z + u OR z > 0 THEN 'rerun_manual_review_after_changes' ELSE 'proceed_to_controlled_apply_review' END AS follow_up FROM g""")
def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: (F.floor(F.col("i") / 3**k) % 3).cast("int")
    return spark.range(81).withColumnRenamed("id", "i").select("i", review.adjudication(part(0) * 2, part(1), part(2), part(3)).alias("o")).select("i", "o.outcome", "o.follow_up")


@query(f"""{_GRID} SELECT i, CASE WHEN x < y AND z >= u THEN 'promising' WHEN x > y AND z < u THEN 'not_promising' ELSE 'inconclusive' END AS verdict FROM g""")
def experiment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.floor(F.col("i") / 3**k) % 3
    return spark.range(81).withColumnRenamed("id", "i").select("i", review.experiment_verdict(part(0), part(2), part(1), part(3)).alias("verdict"))


# --- texts ---

_TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"


@query(rf"""WITH m AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '{_TOKEN}', chr(1) || '\0' || chr(2), 'g'), '[\x01\x02]') AS p FROM documents WHERE text IS NOT NULL),
t AS (SELECT text, unnest(list_transform(range(2, len(p) + 1, 2), lambda i: {{'t': p[i], 'b': right(p[i - 1], 1), 'a': left(p[i + 1], 1)}})) AS s FROM m),
f AS (SELECT (s.b <> '' AND NOT regexp_matches(s.b, '[\p{{L}}\p{{N}}\s]')) OR (s.a <> '' AND NOT regexp_matches(s.a, '[\p{{L}}\p{{N}}\s]')) AS punctuation_adjacency, regexp_matches(s.b || s.a, '["''«»()\[\]{{}}]') AS quote_bracket_adjacency,
regexp_matches(s.b || s.a, '[*_`~|<>{{}}\[\]()]') OR regexp_matches(s.t, '^[`*_]|[`*_]$') AS wrapper_no_touch_style, regexp_matches(s.t, '\p{{Nd}}') OR (regexp_matches(s.t, '[A-Za-z]') AND regexp_matches(s.t, '[А-Яа-яЁё]')) AS mixed_alnum_non_ru_shape,
regexp_matches(text, '!!|\?\?|\.\.|,,|;;|::') AS repeated_punctuation, contains(text, '  ') OR regexp_matches(text, '[,.!?;:]\S') AS missing_extra_spaces, contains(text, chr(10)) AS newline_line_break_noise,
regexp_matches(text, '(?:^|\s)[#@][\p{{L}}\p{{N}}_-]+') OR regexp_matches(text, 'https?://|www\.') AS hashtags_mentions_urls FROM t)
{' UNION ALL '.join(f"SELECT '{n}' AS noise, count(*) FILTER (WHERE {n}) AS n FROM f" for n in (*audit.CASE_FLAGS, *audit.LOCAL_FLAGS))}""")
def token_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of all documents have each of the eight flags."""
    text = F.col("text")
    # the flags of a text are found once, before its tokens are told apart
    rows = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select(*[c.alias(n) for n, c in audit.case_flags(text).items()], regex.neighbours(text, regex.token_pattern()).alias("ts"))
    rows = rows.select(*audit.CASE_FLAGS, F.explode("ts").alias("t"))
    flags = {**{n: F.col(n) for n in audit.CASE_FLAGS}, **audit.local_flags(F.col("t"))}
    return evaluation.melted(rows.agg(*[F.count_if(c).alias(n) for n, c in flags.items()]), tuple(flags), "noise")


@query(r"""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '\b[0-9][0-9\s,.-]*[0-9]\b')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n AS placeholders, true AS intact, true AS restored, n = 0 AS intact_without FROM d""")
def placeholder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers masked in all documents: as many placeholders as numbers, all intact, all restored, and none intact in a text without them."""
    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("z", zones.merged(zones.raw_spans(F.col("text"), ("number",))))
    docs = docs.withColumns({"v": zones.originals(F.col("text"), F.col("z")), "m": zones.mask(F.col("text"), F.col("z"))})
    return docs.select("doc_id", zones.count_placeholders(F.col("m")).cast("long").alias("placeholders"), zones.intact(F.col("m"), F.col("v")).alias("intact"), zones.all_restored(zones.restore(F.col("m"), F.col("v")), F.col("v")).alias("restored"), zones.intact(F.lit("no mark"), F.col("v")).alias("intact_without"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n, md5(array_to_string(regexp_extract_all(text, '\S+'), ' ')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", stages.segments(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: x["value"]), " ")).alias("text_md5"))


@query("SELECT lang, octet_length(encode(text)) > 2000 AS too_large, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.groupBy("lang", body_too_large(F.col("text"), 2000).alias("too_large")).agg(F.count(F.lit(1)).alias("n"))


# --- words of the documents in the corrected alphabet ---

_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувщшыз"
_V = f"WITH v AS (SELECT translate(w, '{_LATIN}', '{_CYRILLIC}') AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) AS w FROM documents) GROUP BY 1)"


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9-]+"), F.lit(0))).alias("w"))
    return words.groupBy(F.translate("w", _LATIN, _CYRILLIC).alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""{_V} SELECT w, regexp_full_match(w, '[а-яё]+') AS safe, regexp_full_match(w, '[а-яё]+(-[а-яё]+)*') AS candidate, length(w) >= 4 AND regexp_matches(w, '[ыи]$') AS plural, regexp_full_match(replace(w, 'ё', 'е'), '[а-яе-]+') AS shape FROM v""")
def word_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return _vocabulary(spark, sf_dir).select("w", spelling.safe_token(w).alias("safe"), spelling.safe_candidate(w).alias("candidate"), spelling.plural_drop(w, w.substr(F.lit(1), F.length(w) - 1)).alias("plural"), audit.shape_allowed(w).alias("shape"))


_PAIRED = f"""{_V}, o AS (SELECT w AS a, lead(w) OVER (ORDER BY n DESC, hash_) AS b FROM (SELECT w, n, md5(w) AS hash_ FROM v WHERE regexp_full_match(w, '[а-яё]+'))), p AS (SELECT * FROM o WHERE b IS NOT NULL),
m AS (SELECT a, b, length(a) % 3 > 0 AS ka, length(a) % 7 / 10.0 AS sa, length(b) % 4 > 0 AS kb, length(b) % 7 / 10.0 AS sb FROM p)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.ranks import ranked

    words = ranked(_vocabulary(spark, sf_dir).where(spelling.safe_token(F.col("w"))).select("w", "n", F.md5("w").alias("h")), [F.desc("n"), F.asc("h")])
    return words.select(F.col("w").alias("a"), (F.col("rank") + 1).alias("r")).join(words.select(F.col("w").alias("b"), F.col("rank").alias("r")), "r").select("a", "b")


@query(f"""{_PAIRED} SELECT a, b, CASE WHEN ka AND sa >= 0.25 THEN 'blocked' WHEN kb AND (NOT ka OR sb >= sa + 0.15) THEN 'allowed' ELSE 'unknown' END AS decision FROM m""")
def morph_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's decision on each word and the next frequent one, from a table of readings that is made from the words."""
    pairs = _pairs(spark, sf_dir)
    n = F.length("form")
    own = pairs.select(F.col("a").alias("form")).withColumns({"is_known": n % 3 > 0, "score": (n % 7) / 10.0})
    other = pairs.select(F.col("b").alias("form")).withColumns({"is_known": n % 4 > 0, "score": (n % 7) / 10.0})
    mark = lambda df, p: df.distinct().select(F.concat(F.lit(p), F.col("form")).alias("form"), "is_known", "score", F.lit("X").alias("pos"), F.lit("x").alias("lemma"), F.expr("cast(array() as array<string>)").alias("grammemes"))
    hints = pairs.select(F.concat(F.lit("a"), "a").alias("token"), F.lit("generated").alias("status"), F.concat(F.lit("b"), "b").alias("term"))
    out = morph.decisions(hints, mark(own, "a").unionByName(mark(other, "b")), True)
    return out.select(F.expr("substr(token, 2)").alias("a"), F.expr("substr(term, 2)").alias("b"), F.col("gate").alias("decision"))


@query(f"""{_PAIRED}, x AS (SELECT a, b, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k))), 0) AS p FROM p)
SELECT a, b, p AS shared, a <> b AND least(length(a), length(b)) > 3 AND abs(length(a) - length(b)) <= 1 AND p >= least(length(a), length(b)) - 1 AND greatest(length(a), length(b)) - p BETWEEN 1 AND 2 AS shift FROM x""")
def suffix_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", morph.common_prefix(F.col("a"), F.col("b")).cast("long").alias("shared"), morph.suffix_shift(F.col("a"), F.col("b")).alias("shift"))


_MAP = {"тге": "тот", "анд": "ант", "дер": "дар", "инг": "инга", "унд": "уед", "лес": "леса", "щас": "час", "дие": "дия", "вас": "вы-с", "лас": "лоск", "ден": "день"}
_SPOKEN = f"translate(lower(text), '{_LATIN}', '{_CYRILLIC}')"


@query(rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_SPOKEN}, '[а-я]+|[^а-я]+') AS p FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^a-zA-Z \n.,]'))
SELECT doc_id, md5(array_to_string(list_transform(p, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MAP.items())} ELSE x END), '')) AS text_md5, CAST(len(list_filter(p, lambda x: x IN ({', '.join(f"'{k}'" for k in _MAP)}))) AS INT) AS n_edits FROM d""")
def mapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typo map over all documents of plain prose, in the corrected alphabet; the tests cover texts with wrappers and zones."""
    docs = _read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\A[a-zA-Z \n.,]*+\z")).select("doc_id", F.translate(F.lower("text"), _LATIN, _CYRILLIC).alias("text"))
    text = F.col("text")
    wanted = spelling.edits(spelling.outcomes(spelling.eligible(text, 2, frozenset(), (), only=_MAP), _MAP, None, False))
    folded = docs.withColumn("f", spelling.apply_edits(text, wanted, zones.placeholder_spans(text), 1, True))
    return folded.select("doc_id", F.md5("f.text").alias("text_md5"), F.size("f.applied").alias("n_edits"))


@query(rf"""{_V}, k AS (SELECT DISTINCT w FROM v WHERE w <> '') SELECT w, regexp_replace(replace(w, '-', ''), '^по', 'по-') AS compact, w <> replace(w, '-', '') AS hyphened FROM k WHERE regexp_matches(w, '^по-?[а-я]{{3,}}$')""")
def hyphen_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form with its hyphen put back, among the forms under which a word is looked up."""
    words = _vocabulary(spark, sf_dir).where(F.col("w").rlike("^по-?[а-я]{3,}$"))
    forms = lexicon.variants(F.col("w"))
    return words.select("w", F.element_at(F.filter(forms, lambda v: v.rlike("^по-")), -1).alias("compact"), (F.element_at(forms, 1) != F.replace("w", F.lit("-"), F.lit(""))).alias("hyphened"))


@query("""SELECT a.i AS distance, b.i AS position, round(-(a.i + 0.15 * b.i), 9) AS base, round(-0.5 * (a.i + 0.15 * b.i) + 2.0 * (-1.5 * b.i), 9) AS combined FROM range(5) a(i), range(7) b(i)""")
def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(5).select(F.col("id").alias("distance"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("position"))
    base = lexicon.base_score(F.col("distance"), F.col("position"))
    return rows.select("distance", "position", F.round(base, 9).alias("base"), F.round(lexicon.combined(base, -1.5 * F.col("position"), 0.5, 2.0), 9).alias("combined"))
