"""Morphological guards of candidates, from a table of word forms.

``morph``: form, is_known, score, pos, lemma, grammemes; a row for each reading, the first of a form being that of the highest score.
A form without rows blocks nothing, so an empty table switches the guards off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of speech that decline, those that never take a candidate of another kind, and cases in the order of preference. Fixed values.
NOMINAL = ("NOUN", "ADJF", "ADJS", "PRTF", "PRTS")
FUNCTION_WORDS = ("PREP", "CONJ", "PRCL", "INTJ")
CASES = ("nomn", "gent", "datv", "accs", "ablt", "loct", "voct", "gen1", "gen2", "acc2", "loc1", "loc2")


def decision(known_a: Column, score_a: Column, known_b: Column, score_b: Column) -> Column:
    """``blocked`` if the token itself is a good word, ``allowed`` if the candidate is clearly better, else ``unknown``."""
    return (
        F.when(known_a.isNull() | known_b.isNull(), "unknown")
        .when(known_a & (score_a >= 0.25), "blocked")
        .when(known_b & (~known_a | (score_b >= score_a + 0.15)), "allowed")
        .otherwise("unknown")
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: a.substr(k, F.lit(1)) != b.substr(k, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n))


def suffix_shift(a: Column, b: Column) -> Column:
    """Whether words of more than three letters differ in little more than their last letter."""
    a, b = F.lower(a), F.lower(b)
    p, short = common_prefix(a, b), F.least(F.length(a), F.length(b))
    tail = F.greatest(F.length(a), F.length(b)) - p
    return (a != b) & (short > 3) & (F.abs(F.length(a) - F.length(b)) <= 1) & (p >= short - 1) & (tail >= 1) & (tail <= 2)


def _first_of(grammemes: Column, names: tuple[str, ...]) -> Column:
    return F.try_element_at(F.array_intersect(F.array(*map(F.lit, names)), grammemes), F.lit(1))


def inflection_drift(token: Column, term: Column, a: Column, b: Column) -> Column:
    """Whether a declining word only changes number or case. ``a`` and ``b``: first readings (pos, lemma, grammemes)."""
    number = _first_of(a["grammemes"], ("sing", "plur")) != _first_of(b["grammemes"], ("sing", "plur"))
    case = _first_of(a["grammemes"], CASES) != _first_of(b["grammemes"], CASES)
    drift = F.coalesce(number, F.lit(False)) | F.coalesce(case, F.lit(False))
    return (F.length(token) > 3) & a["pos"].isin(*NOMINAL) & b["pos"].isin(*NOMINAL) & drift & suffix_shift(token, term)


def guarded(token: Column, term: Column, a: Column, b: Column) -> Column:
    """Whether a candidate is blocked: inflection drift, or another part of speech or lemma for a short or function word."""
    drift = F.coalesce(a["pos"] != b["pos"], F.lit(False)) | F.coalesce(a["lemma"] != b["lemma"], F.lit(False))
    return F.coalesce(inflection_drift(token, term, a, b), F.lit(False)) | (drift & ((F.length(token) <= 3) | F.coalesce(a["pos"].isin(*FUNCTION_WORDS), F.lit(False))))


def pair_decisions(pairs: dict[str, str], morph: DataFrame) -> dict[str, str]:
    """The gate's decision for each token of a map and its replacement; as many rows come to the driver as the map has entries."""
    if not pairs:
        return {}
    rows = morph.sparkSession.createDataFrame([(a, "generated", b) for a, b in sorted(pairs.items())], "token string, status string, term string")
    return {r["token"]: "unknown" if r["gate"] is None else r["gate"] for r in decisions(rows, morph, True).select("token", "gate").collect()}


def decisions(hints: DataFrame, morph: DataFrame, primary: bool) -> DataFrame:
    """``hints`` (token, status, term) with gate (blocked, unknown, allowed or null) and morph: guard, or what the gate says."""
    best = morph.groupBy("form").agg(F.bool_or("is_known").alias("known"), F.max("score").alias("score"), F.max_by(F.struct("pos", "lemma", "grammemes"), "score").alias("first"))
    a, b = (best.select(F.col("form").alias(f"_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("known", "score", "first")]) for x in "ab")
    both = hints.join(a, hints["token"] == a["_a"], "left").join(b, F.col("term") == F.col("_b"), "left")
    block = F.col("first_a").isNotNull() & F.col("first_b").isNotNull() & guarded(F.col("token"), F.col("term"), F.col("first_a"), F.col("first_b"))
    gate = decision(F.col("known_a"), F.col("score_a"), F.col("known_b"), F.col("score_b")) if primary else F.lit(None).cast("string")
    return both.select("token", "status", "term", gate.alias("gate"), F.when(F.coalesce(block, F.lit(False)), "guard").otherwise(gate).alias("morph"))
