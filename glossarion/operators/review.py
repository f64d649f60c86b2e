"""Review packs and rollout decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons for a case to be reviewed, the most urgent first. Fixed values.
REASONS = (
    "rollback_related", "candidate_rejected_unsafe", "candidate_ambiguous", "candidate_generated_not_applied", "expected_mismatch", "user_visible_change",
    "protected_context_case", "complex_user_like",
)
PRODUCT_PACK = "product_regression_pack"
PROTECTED = ("protected zones", "wrapped/no-touch")


def union_first(sources: list[DataFrame], keys: tuple[str, ...] = ("input_text", "expected_clean_text"), order: str = "pos") -> DataFrame:
    """All sources one after the other; of rows with equal keys (nulls equal) the first by source and ``order`` stays.

    The first is found by an aggregation that combines in each task, so a key with very many rows stays cheap.
    """
    whole = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        whole = s if whole is None else whole.unionByName(s, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in keys]
    kept = whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_source", order)).alias("_row"))
    return kept.select(*keys, "_row.*").drop("_source")


def reasons(input: Column, output: Column, expected: Column, source: Column, category: Column, audit: Column) -> Column:
    """Why a case is reviewed, the most urgent reason first; empty if it needn't be."""
    protected = F.coalesce((source == PRODUCT_PACK) & category.isin(*PROTECTED), F.lit(False))
    tests = {
        "rollback_related": audit["rollback_applied"],
        "candidate_rejected_unsafe": audit["candidate_rejected_unsafe_candidate_count"] > 0,
        "candidate_ambiguous": (audit["candidate_ambiguous_count"] > 0) | (audit["candidate_ambiguous_tie_count"] > 0),
        "candidate_generated_not_applied": (audit["candidate_generated_count"] > 0) & (audit["candidate_applied_count"] == 0),
        "expected_mismatch": F.coalesce(output != expected, F.lit(False)),
        "user_visible_change": output != input,
        "protected_context_case": protected,
        "complex_user_like": protected,
    }
    return F.array_compact(F.array(*[F.when(tests[r], F.lit(r)) for r in REASONS]))


def pack(rows: DataFrame, limit: int, order: str = "pos") -> DataFrame:
    """The ``limit`` most urgent rows with reasons: by their first reason, then the shorter input, then ``order``."""
    urgency = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reasons")[0])
    chosen = rows.where(F.size("reasons") > 0).orderBy(urgency, F.length("input_text"), order).limit(limit)
    return chosen.withColumns({"primary_reason": F.col("reasons")[0], "secondary_reasons": F.slice("reasons", 2, len(REASONS))})


def reason_counts(packed: DataFrame) -> DataFrame:
    """reason and n for every reason, also those without rows."""
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(r).alias("reason")) for i, r in enumerate(REASONS)]))
    listed = packed.sparkSession.range(1).select(every.alias("e")).select("e.ord", "e.reason")
    counted = packed.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counted, "reason", "left").select("ord", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def showcase_class() -> Column:
    """improvement, preservation, caution or null, for rows of ``evaluation.delta_rows``."""
    c = F.col
    reason = c("user_visible_delta_reason")
    kept = ~c("changed_between_profiles") & (c("input_text") == c("output_safe_default")) & (c("input_text") == c("output_smart_baseline")) & (c("input_text") == c("expected_clean_text"))
    doubtful = reason.isin("smart_regresses_expected_match", "both_match_expected_but_different_output", "profile_outputs_differ_need_human_review")
    return F.when(reason == "smart_improves_expected_match", "improvement").when(kept, "preservation").when(doubtful, "caution")


def showcase(rows: DataFrame, n: int, order: str = "pos") -> DataFrame:
    w = Window.partitionBy("class").orderBy(order)
    return rows.withColumn("class", showcase_class()).where("class is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def config_warnings(actual: DataFrame, required: DataFrame) -> DataFrame:
    """Warnings ``config_drift:key`` for required keys (key, value) that are missing or have another value."""
    both = required.join(actual.select(F.col("key").alias("_k"), F.col("value").alias("_v")), F.col("key") == F.col("_k"), "left")
    return both.where(~F.col("value").eqNullSafe(F.col("_v"))).select(F.concat(F.lit("config_drift:"), F.col("key")).alias("warning"))


def readiness(config: Column, regression: Column, delta: Column, manual: Column) -> Column:
    done = lambda c: c.isin("present", "generated")
    return F.when((config == "fail") | (regression == "failed"), "not_ready").when((config == "ok") & (regression == "ok") & done(delta) & done(manual), "ready_for_review").otherwise("review_needed")


def merged_warnings(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def rollout(final: Column, complete: Column, warnings: Column, review: Column, config: Column, regression: Column) -> Column:
    """(verdict, next_action) of a rollout."""
    blocking = F.exists(warnings, lambda w: w.startswith("config_missing") | w.startswith("config_invalid_yaml") | (w == "bundle_incomplete"))
    out = lambda v, a: F.struct(F.lit(v).alias("verdict"), F.lit(a).alias("next_action"))
    return (
        F.when((final == "not_ready") | (config == "fail") | (regression == "failed"), out("hold_not_ready", "fix_config_drift"))
        .when(blocking | ~complete, out("hold_not_ready", "regenerate_missing_artifacts"))
        .when((final == "ready_for_review") & (F.size(review) == 0), out("eligible_for_controlled_apply", "proceed_to_controlled_apply_review"))
        .when(final == "ready_for_review", out("review_before_apply", "inspect_manual_review_pack"))
        .when(F.array_contains(review, "product_regression_not_run"), out("review_before_apply", "rerun_product_regression"))
        .when(F.size(review) > 0, out("review_before_apply", "inspect_manual_review_pack"))
        .otherwise(out("review_before_apply", "regenerate_missing_artifacts"))
    )


def adjudication(candidates: Column, blocking: Column, caution: Column, accepted: Column) -> Column:
    """(outcome, follow_up) from the number of cases in a pack and of those judged."""
    judged = blocking + caution + accepted
    open_ = F.greatest(candidates - judged, F.lit(0))
    out = lambda v, a: F.struct(F.lit(v).alias("outcome"), F.lit(a).alias("follow_up"))
    return (
        F.when((candidates == 0) | (blocking > 0), out("blocked", "inspect_blocking_cases"))
        .when(judged == 0, out("needs_follow_up", "keep_shadow_only"))
        .when((open_ > 0) | (caution > 0), out("needs_follow_up", "rerun_manual_review_after_changes"))
        .otherwise(out("approved_for_controlled_apply_review", "proceed_to_controlled_apply_review"))
    )


def experiment_verdict(wrong: Column, rate: Column, base_wrong: Column, base_rate: Column) -> Column:
    """An experiment is promising with fewer wrong changes at no lower match rate, and not with more of them at a lower one."""
    return F.when((wrong < base_wrong) & (rate >= base_rate), "promising").when((wrong > base_wrong) & (rate < base_rate), "not_promising").otherwise("inconclusive")


def lift_verdict(rows: DataFrame) -> DataFrame:
    """One row from rows (corpus, baseline_rate, apply_rate, unsafe, rollbacks): lift on every corpus, and safety on every one."""
    return rows.agg(F.bool_and(F.col("apply_rate") > F.col("baseline_rate")).alias("lift_on_all"), F.bool_and((F.col("unsafe") == 0) & (F.col("rollbacks") == 0)).alias("safe_on_all"))


def short_tokens(text: Column) -> Column:
    """Words of one to three letters."""
    return F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{1,3}(?![\p{L}\p{N}_])"))
