"""Evaluation of cleaned texts against expectations: outcomes, summaries, comparisons, slices and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of mismatch signals in the order in which they are joined to a slice. Fixed values.
SIGNALS = (
    "unchanged_when_expected_change", "wrong_change", "candidate_generated_not_applied", "candidate_rejected_no_result", "candidate_ambiguous",
    "morph_blocked", "morph_unknown", "unsafe_rejected", "rollback_related",
)


def rate(part: Column, whole: Column, digits: int | None = 6) -> Column:
    """part / whole, 0 for an empty whole, rounded to ``digits`` (None: as it is)."""
    out = F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return out if digits is None else F.round(out, digits)


def outcomes(df: DataFrame, input: str = "input_text", output: str = "clean_text", expected: str = "expected_clean_text") -> DataFrame:
    """``df`` with exact_match, changed, expected_change, unchanged_when_expected_change, wrong_change and no_change_as_expected."""
    same_in, same_out, want = F.col(output) == F.col(input), F.col(output) == F.col(expected), F.col(expected) != F.col(input)
    return df.withColumns(
        {
            "exact_match": same_out,
            "changed": ~same_in,
            "expected_change": want,
            "unchanged_when_expected_change": same_in & want,
            "wrong_change": ~same_in & ~same_out,
            "no_change_as_expected": same_in & ~want,
        }
    )


def mode_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the outcomes and their rates by ``by``, in one aggregation for all modes."""
    n = F.count(F.lit(1))
    names = ("exact_match", "changed", "unchanged_when_expected_change", "wrong_change", "no_change_as_expected")
    return rows.groupBy(*by).agg(n.alias("total_cases"), *[F.count_if(c).alias(f"{c}_count") for c in names], rate(F.count_if("exact_match"), n).alias("exact_match_rate"))


def melted(row: DataFrame, names: tuple[str, ...], key: str, value: str = "n") -> DataFrame:
    """A row of counts as rows (``key``, ``value``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names]))
    return row.select(pairs.alias("_p")).select(f"_p.{key}", f"_p.{value}")


def unpivoted(rows: DataFrame, outputs: dict[str, str], keep: list[str]) -> DataFrame:
    """One row for each mode: ``outputs`` maps modes to output columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("output")) for m, c in outputs.items()]))
    return rows.select(*keep, pairs.alias("_p")).select(*keep, F.col("_p.mode").alias("mode"), F.col("_p.output").alias("output"))


def research_summary(rows: DataFrame, outputs: dict[str, str], reference: str = "current_apply_output", rolled: dict[str, str] | None = None) -> DataFrame:
    """By mode: exact matches, wrong changes, cases that the reference output had right, and rollbacks; rates are not rounded."""
    n = F.count(F.lit(1))
    flags = rolled or {}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("output"), (F.col(flags[m]) if m in flags else F.lit(False)).alias("rolled")) for m, c in outputs.items()]))
    long = rows.select("input_text", "expected_clean_text", F.col(reference).alias("_ref"), pairs.alias("p"))
    right = F.col("p.output") == F.col("expected_clean_text")
    return long.groupBy(F.col("p.mode").alias("mode")).agg(
        n.alias("total_cases"),
        F.count_if(right).alias("exact_match_pass_count"),
        rate(F.count_if(right), n, None).alias("exact_match_pass_rate"),
        F.count_if(~right & (F.col("p.output") != F.col("input_text"))).alias("wrong_change"),
        F.count_if(~right & (F.col("_ref") == F.col("expected_clean_text"))).alias("smart_regresses_expected_match"),
        F.count_if("p.rolled").alias("rollback_related"),
    )


def beats(rows: DataFrame, challengers: dict[str, str], reference: str = "current_apply_output") -> DataFrame:
    """By challenger: how often it alone, and the reference alone, gives the expected text."""
    long = unpivoted(rows, challengers, ["expected_clean_text", reference])
    new, old = F.col("output") == F.col("expected_clean_text"), F.col(reference) == F.col("expected_clean_text")
    return long.groupBy("mode").agg(F.count_if(new & ~old).alias("beats"), F.count_if(~new & old).alias("worse"))


def slices(rows: DataFrame, n: int = 5, id: str = "case_id") -> DataFrame:
    """The ``n`` most frequent combinations of signals of rows that miss, of equal ones the first seen (by ``id``) first.

    Columns: exact_match, the outcome flags, rollback_applied and the candidate counters.
    """
    c = F.col
    tests = {
        "unchanged_when_expected_change": c("unchanged_when_expected_change"),
        "wrong_change": c("wrong_change"),
        "candidate_generated_not_applied": (c("candidate_generated_count") > 0) & (c("candidate_applied_count") == 0),
        "candidate_rejected_no_result": c("candidate_rejected_no_result_count") > 0,
        "candidate_ambiguous": (c("candidate_ambiguous_count") > 0) | (c("candidate_ambiguous_tie_count") > 0),
        "morph_blocked": c("candidate_rejected_morph_blocked_count") > 0,
        "morph_unknown": c("candidate_rejected_morph_unknown_count") > 0,
        "unsafe_rejected": c("candidate_rejected_unsafe_candidate_count") > 0,
        "rollback_related": c("rollback_applied"),
    }
    tag = F.concat_ws(" + ", *[F.when(tests[s], s) for s in SIGNALS])
    tag = F.when(tag == "", "mismatch_without_candidate_signal").otherwise(tag)
    counted = rows.where(~c("exact_match")).groupBy(tag.alias("slice")).agg(F.count(F.lit(1)).alias("count"), F.min(id).alias("_first"))
    return counted.orderBy(F.desc("count"), "_first").limit(n).select("slice", "count")


def compare_modes(safe: DataFrame, smart: DataFrame, id: str = "case_id") -> DataFrame:
    """One row: cases that the second run improves, spoils, or treats otherwise. Runs are joined on ``id``."""
    cols = ("exact_match", "unchanged_when_expected_change", "wrong_change", "candidate_applied_count")
    a, b = (x.select(id, *[F.col(c).alias(f"{c}_{s}") for c in cols]) for x, s in ((safe, "a"), (smart, "b")))
    other = F.lit(False)
    for name in cols[1:]:
        other = other | (F.col(f"{name}_a") != F.col(f"{name}_b"))
    both = a.join(b, id)
    x, y = F.col("exact_match_a"), F.col("exact_match_b")
    return both.agg(F.count_if(y & ~x).alias("smart_improves_expected_match"), F.count_if(x & ~y).alias("smart_regresses_expected_match"), F.count_if(other).alias("cases_with_behavior_delta"))


def hints(counts: DataFrame) -> DataFrame:
    """What to look at next, in a fixed order, from one row of counts (unchanged_when_expected_change, candidate_generated_not_applied,
    wrong_change, unsafe_rejected, rollback_related, top_slice)."""
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(c("unchanged_when_expected_change") > 0, "review_missing_changes"),
            F.when(c("candidate_generated_not_applied") > 0, "review_blocked_candidates"),
            F.when(c("wrong_change") > 0, "review_wrong_changes"),
            F.when((c("unsafe_rejected") > 0) | (c("rollback_related") > 0), "review_safety_signals"),
        )
    )
    fallback = F.when(c("top_slice").isNotNull(), F.concat(F.lit("review_slice: "), c("top_slice"))).otherwise("keep_baseline")
    return counts.select(F.when(F.size(found) > 0, found).otherwise(F.array(fallback)).alias("hints"))


def histogram(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Counts by each label column on its own, as one aggregation: dimension, value, n. Null labels are not counted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in labels]))
    return rows.select(pairs.alias("p")).where("p.value is not null").groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def contributions(rows: DataFrame, roles: list[str], scores: list[str]) -> DataFrame:
    """Sums of score columns over the rows in each boolean role: role, and a sum for each score."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("on")) for r in roles]))
    return rows.select(*scores, pairs.alias("p")).where("p.on").groupBy("p.role").agg(*[F.sum(s).alias(f"{s}_sum") for s in scores])


def sweep(chosen: DataFrame, min_abs: list[float], min_margin: list[float]) -> DataFrame:
    """The research gate for each pair of thresholds, from rows (original, expected, candidate, score, second): scored once, gated per pair.

    The grid is a literal array in each row, so its size is that of the two lists.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("min_abs"), F.lit(float(m)).alias("min_margin")) for a in min_abs for m in min_margin]))
    rows = chosen.select("*", grid.alias("g")).select("*", "g.min_abs", "g.min_margin")
    passes = (F.col("score") >= F.col("min_abs")) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= F.col("min_margin")))
    output = F.when(F.coalesce(passes, F.lit(False)), F.col("candidate")).otherwise(F.col("original"))
    return rows.groupBy("min_abs", "min_margin").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(output == F.col("expected")).alias("exact"), F.count_if((output != F.col("expected")) & (output != F.col("original"))).alias("wrong")
    )


def against_first(rows: DataFrame, first: str, variant: str = "variant", keys: tuple[str, ...] = ("case_id", "position"), value: str = "output") -> DataFrame:
    """By variant: how many rows differ from the ``first`` variant's."""
    base = rows.where(F.col(variant) == first).select(*keys, F.col(value).alias("_base"))
    return rows.join(base, list(keys)).groupBy(variant).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col(value).eqNullSafe(F.col("_base"))).alias("changed"))


def aligned(rows: DataFrame, left: Column, right: Column, keep: list[str]) -> DataFrame:
    """Tokens of two arrays side by side by position, as far as the longer goes: ``keep``, position, left, right."""
    pairs = F.arrays_zip(left.alias("left"), right.alias("right"))
    return rows.select(*keep, F.posexplode(pairs).alias("position", "p")).select(*keep, "position", F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def coverage(tokens: DataFrame, case: str = "case_id") -> DataFrame:
    """One row: cases and tokens, and how many have any candidate or the gold one, from rows (case, has_candidate, gold_in_top_k)."""
    per_case = tokens.groupBy(case).agg(F.bool_or("has_candidate").alias("any"), F.bool_or("gold_in_top_k").alias("gold"), F.count(F.lit(1)).alias("n"), F.count_if("has_candidate").alias("na"), F.count_if("gold_in_top_k").alias("ng"))
    n = F.count(F.lit(1))
    return per_case.agg(n.alias("cases"), F.count_if("any").alias("cases_any"), F.count_if("gold").alias("cases_gold"), rate(F.count_if("gold"), n).alias("gold_rate"), F.sum("n").alias("tokens"), F.sum("na").alias("tokens_any"), F.sum("ng").alias("tokens_gold"))


def root_cause(shape_ok: Column, has_candidate: Column, gold_in_top_k: Column, selected_gold: Column, wrapper: Column, mixed: Column) -> Column:
    """Why a changed token didn't become the expected one; ``selected`` if it did."""
    return (
        F.when(~shape_ok, "token_rejected_before_retrieval")
        .when(~has_candidate & wrapper, "candidate_polluted_by_punctuation_wrappers")
        .when(~has_candidate & mixed, "no_candidate_due_to_token_shape")
        .when(has_candidate & ~gold_in_top_k, "candidate_exists_but_gold_absent_topk")
        .when(gold_in_top_k & ~selected_gold, "gold_present_in_topk_but_not_selected")
        .when(~has_candidate, "other")
        .otherwise("selected")
    )


def cross_tab(rows: DataFrame, flags: list[str], status: str = "status") -> DataFrame:
    """noise, status, n for every boolean flag."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("noise"), F.col(f).alias("on")) for f in flags]))
    return rows.select(status, pairs.alias("p")).where("p.on").groupBy(F.col("p.noise").alias("noise"), F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def examples(rows: DataFrame, by: str, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each class; each task keeps at most ``n`` of a class before they meet."""
    top = F.expr(f"slice(array_sort(collect_list(x)), 1, {n})")
    key = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rows.columns if c not in order]).alias("rest"))
    first = rows.select(F.col(by).alias("_by"), key.alias("x"), F.spark_partition_id().alias("_p")).withColumn("_r", F.row_number().over(Window.partitionBy("_by", "_p").orderBy("x"))).where(F.col("_r") <= n)
    return first.groupBy("_by").agg(top.alias("x")).select(F.explode("x").alias("x")).select(*[F.col(f"x.{c}") for c in order], "x.rest.*")


def cumulative(rows: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Histogram buckets as exporters give them: by ``by`` and bound, how many values are not greater, and the total as +Inf."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*sums, F.count(value).alias("all"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))))
    return wide.select(*by, pairs.alias("p")).select(*by, "p.le", "p.n")


def pilot_summary(rows: DataFrame) -> DataFrame:
    """One row; the rate counts rows with an expectation only (input_text, clean_text, expected_clean_text)."""
    has = F.col("expected_clean_text").isNotNull()
    right = has & (F.col("clean_text") == F.col("expected_clean_text"))
    changed = F.col("clean_text") != F.col("input_text")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("changed"), F.count_if(~changed).alias("unchanged"), F.count_if(has).alias("with_expectation"), F.count_if(right).alias("exact"), rate(F.count_if(right), F.count_if(has)).alias("exact_rate"))


def delta_rows(rows: DataFrame) -> DataFrame:
    """Rows (expected_clean_text, output_safe_default, output_smart_baseline) with what separates the two profiles."""
    a, b, want = F.col("output_safe_default"), F.col("output_smart_baseline"), F.col("expected_clean_text")
    safe, smart, changed = a == want, b == want, a != b
    reason = (
        F.when(~changed, F.lit(None).cast("string"))
        .when(smart & ~safe, "smart_improves_expected_match")
        .when(safe & ~smart, "smart_regresses_expected_match")
        .when(smart & safe, "both_match_expected_but_different_output")
        .otherwise("profile_outputs_differ_need_human_review")
    )
    return rows.withColumns({"changed_between_profiles": changed, "smart_matches_expected": smart, "safe_matches_expected": safe, "user_visible_delta_reason": reason})


def delta_summary(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(~c("changed_between_profiles")).alias("unchanged_across_profiles"),
        F.count_if("changed_between_profiles").alias("changed_only_in_smart_baseline"),
        F.count_if("smart_matches_expected").alias("smart_expected_matches"),
        F.count_if("safe_matches_expected").alias("safe_expected_matches"),
        F.count_if(c("changed_between_profiles") & (c("smart_matches_expected") == c("safe_matches_expected"))).alias("cases_needing_human_look"),
    )
