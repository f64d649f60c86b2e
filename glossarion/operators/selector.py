"""Choice among scored candidates, with reasons for every decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import closest, within

MINUS_INFINITY = float("-inf")

#: Endings that a neighbour speaks for: side, neighbour, ending, bonus. Fixed values.
HINTS = (
    ("left", "до", "а", 0.7),
    ("left", "эту", "у", 0.7),
    ("left", "иду", "й", 0.6),
    ("left", "наша", "а", 0.6),
    ("left", "мой", "к", 0.4),
    ("right", "встречи", "а", 0.4),
    ("right", "решили", "у", 0.4),
    ("right", "дождь", "я", 0.3),
    ("right", "план", "к", 0.3),
)


def candidates(tokens: DataFrame, dictionary: DataFrame, k: int = 5, distance: int = 2, original: bool = True) -> DataFrame:
    """token, candidate, rank and position of the best ``k`` candidates: the closest terms of a dictionary (term, count) with their count as
    rank (or less their distance where it is 0), and the token itself with rank 0; the higher rank, then the later term, first.
    """
    found = closest(within(tokens, dictionary.select("term", F.col("count").alias("rank")), distance))
    rows = found.select("token", F.col("term").alias("candidate"), F.when(F.col("rank") > 0, F.col("rank")).otherwise(-F.col("distance")).cast("long").alias("rank"))
    if original:
        own = tokens.select("token").distinct().select("token", F.col("token").alias("candidate"), F.lit(0).cast("long").alias("rank"))
        rows = rows.unionByName(own).groupBy("token", "candidate").agg(F.max_by("rank", F.struct(F.col("rank") != 0, "rank")).alias("rank"))
    order = Window.partitionBy("token").orderBy(F.desc("rank"), F.desc("candidate"))
    return rows.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < k)


def context_score(candidate: Column, rank: Column, left: Column, right: Column) -> Column:
    """-0.01 rank, with a bonus for endings that the neighbours speak for, and less for a repeated neighbour. Null neighbours give nothing."""
    token = F.lower(candidate)
    out = -0.01 * rank.cast("double")
    for side, near in (("left", F.lower(left)), ("right", F.lower(right))):
        bonus = F.lit(0.0)
        for s, word, ending, value in HINTS:
            if s == side:
                bonus = F.when((near == word) & F.endswith(token, F.lit(ending)), value).otherwise(bonus)
        out = out + bonus - F.when(near == token, 0.25).otherwise(0.0)
    return out


def choose(scored: DataFrame, id: str = "case_id") -> DataFrame:
    """``id``, best, best_score and second_score (minus infinity if there is no second) from rows (id, candidate, position, score)."""
    order = Window.partitionBy(id).orderBy(F.desc("score"), "position")
    ranked = scored.select(id, "candidate", "score", F.row_number().over(order).alias("_r"), F.lead("score").over(order).alias("_next"))
    return ranked.where("_r = 1").select(id, F.col("candidate").alias("best"), F.col("score").alias("best_score"), F.coalesce("_next", F.lit(MINUS_INFINITY)).alias("second_score"))


def decide(chosen: DataFrame, min_confidence: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """``chosen`` (original, best, best_score, second_score) with reason, changed, selected and margin.

    Reasons in order: no_candidate, low_confidence, low_margin, original_wins, apply_candidate. A single candidate has an infinite margin.
    """
    best, top = F.col("best"), F.coalesce("best_score", F.lit(0.0))
    none = best.isNull() | (best == "")
    margin = F.when(none, 0.0).otherwise(top - F.coalesce("second_score", F.lit(MINUS_INFINITY)))
    reason = (
        F.when(none, "no_candidate")
        .when(top < min_confidence, "low_confidence")
        .when(margin < min_margin, "low_margin")
        .when(best == F.col("original"), "original_wins")
        .otherwise("apply_candidate")
    )
    out = chosen.withColumns({"reason": reason, "margin": margin})
    return out.withColumn("changed", F.col("reason") == "apply_candidate").withColumn("selected", F.when(F.col("changed"), best).otherwise(F.col("original")))


def research_pick(scored: DataFrame, min_margin: float, min_abs: float, id: str = "case_id") -> DataFrame:
    """The research gate on rows (id, original, candidate, score): no_candidates, low_abs_score, low_margin (not for a single
    candidate), same_as_original, applied. Ties go to the lesser term; a row with a null candidate stands for none.
    """
    order = Window.partitionBy(id).orderBy(F.desc_nulls_last("score"), "candidate")
    ranked = scored.select(id, "original", "candidate", "score", F.row_number().over(order).alias("_r"), F.lead("score").over(order).alias("_next"))
    best = ranked.where("_r = 1")
    reason = (
        F.when(F.col("candidate").isNull(), "no_candidates")
        .when(F.col("score") < min_abs, "low_abs_score")
        .when(F.col("_next").isNotNull() & (F.col("score") - F.col("_next") < min_margin), "low_margin")
        .when(F.col("candidate") == F.col("original"), "same_as_original")
        .otherwise("applied")
    )
    return best.select(id, "original", reason.alias("reason"), F.when(reason == "applied", F.col("candidate")).otherwise(F.col("original")).alias("output"))


def replay(cases: DataFrame, scorer: str = "table", min_confidence: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """Decisions for cases (case_id, original, expected, candidates array<struct<token,rank>>, scores map<string,double>).

    ``scorer``: table (the scores, 0 where there is none), rank, or reverse_rank.
    """
    rows = cases.select("case_id", "scores", F.posexplode("candidates").alias("position", "c")).select("case_id", "position", F.col("c.token").alias("candidate"), F.col("c.rank").alias("rank"), "scores")
    score = {"table": F.coalesce(F.col("scores")[F.col("candidate")], F.lit(0.0)), "rank": F.col("rank").cast("double"), "reverse_rank": -F.col("rank").cast("double")}[scorer]
    best = choose(rows.withColumn("score", score))
    return decide(cases.select("case_id", "original", "expected").join(best, "case_id", "left"), min_confidence, min_margin)


def summary(decisions: DataFrame) -> DataFrame:
    """One row: totals, match rates (six digits) and the histogram of reasons."""
    right = F.col("selected") == F.col("expected")
    n = F.count(F.lit(1))
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    counts = decisions.agg(
        n.alias("total_cases"),
        F.count_if(right).alias("expected_match_count"),
        rate(F.count_if(right), n).alias("expected_match_rate"),
        F.count_if("changed").alias("changed_count"),
        (n - F.count_if("changed")).alias("kept_original_count"),
        F.count_if(right & F.col("changed")).alias("expected_match_when_changed_count"),
        rate(F.count_if(right & F.col("changed")), F.count_if("changed")).alias("expected_match_when_changed_rate"),
    )
    reasons = decisions.groupBy("reason").agg(n.alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("decision_reason_counts"))
    return counts.crossJoin(reasons)


NUMBERS = ("expected_match_count", "expected_match_rate", "expected_match_when_changed_count", "expected_match_when_changed_rate", "changed_count", "kept_original_count")


def compare(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    """name and delta of two decision tables: the summary's numbers and each reason's count; different totals are an error."""

    def long(decisions: DataFrame, side: str) -> DataFrame:
        s = summary(decisions)
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in ("total_cases", *NUMBERS)])
        reasons = F.transform(F.map_entries("decision_reason_counts"), lambda e: F.struct(F.concat(F.lit("reason:"), e["key"]).alias("name"), e["value"].cast("double").alias("v")))
        return s.select(F.explode(F.concat(pairs, reasons)).alias("p")).select(F.col("p.name").alias("name"), F.col("p.v").alias(side))

    both = long(baseline, "a").join(long(challenger, "b"), "name", "full_outer")
    delta = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6)
    checked = F.when((F.col("name") == "total_cases") & (delta != 0), F.raise_error(F.lit("the two runs have different totals"))).otherwise(delta)
    return both.select("name", checked.alias("delta")).where("name <> 'total_cases' or delta is not null")
