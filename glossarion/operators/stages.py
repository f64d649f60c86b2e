"""Stages of the cleaning pipeline: each takes and returns a DataFrame with the working columns of ``start``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, Policy
from ..functions import udfs, zones
from ..functions.regex import spans
from . import punctuation, spelling

#: Characters that leave a text as it is under compatibility normalisation and split no line; other texts take the slow path.
_PLAIN = r"[^\x00-\x0A\x0D-\x1B\x20-\x84\x86-\xA0\xAB\xBB\xC0-\xFF\x{0400}-\x{045F}\x{200B}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}-\x{201E}\x{27E6}\x{27E7}]"
#: Line ends and blanks that the fast way to trim lines doesn't know.
_ODD_LINES = r"[\r\x0B\x0C\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

COUNTERS = (
    "normalize_changes_count", "typo_corrections_count", "punctuation_fixes_count", "morph_blocked_count", "morph_allowed_count", "morph_unknown_count",
    "candidate_generated_count", "candidate_applied_count", "candidate_rejected_count", "candidate_ambiguous_count", "candidate_rejected_no_result_count",
    "candidate_rejected_unsafe_candidate_count", "candidate_rejected_morph_blocked_count", "candidate_rejected_morph_unknown_count", "candidate_ambiguous_tie_count", "candidate_shadow_skipped_count",
)


@dataclass(frozen=True)
class Context:
    policy: Policy
    config: Config
    #: map column from token to (status, term, morph), where candidates are on
    suggestions: str | None = None
    #: morphological decision for each token of the typo maps, where that is asked for
    gate: dict[str, str] | None = None


Stage = Callable[[DataFrame, Context], DataFrame]


def start(df: DataFrame, text: str) -> DataFrame:
    """Working columns: _raw, _text (masked), _values (zone texts), _zones, _snapshot, _applied, _rejected, _rollbacks and _n (counters)."""
    df = df.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_zones", zones.zones(F.col("_raw")))
    df = df.withColumns({"_values": zones.originals(F.col("_raw"), F.col("_zones")), "_text": zones.mask(F.col("_raw"), F.col("_zones"))})
    empty = F.expr(spelling.NONE)
    return settled(df).withColumns({"_snapshot": F.col("_text"), "_applied": empty, "_rejected": empty, "_rollbacks": F.expr("cast(array() as array<string>)"), "_n": F.struct(*[F.lit(0).alias(c) for c in COUNTERS])})


WORKING = ("_raw", "_text", "_zones", "_values", "_snapshot", "_applied", "_rejected", "_rollbacks", "_n")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its working columns evaluated here. They go through a generator of one row each, which the optimizer doesn't merge
    projections across; else the texts' expressions are copied into each use, Python functions above them included, and grow with each stage.
    """
    other = [F.col(f"`{c}`") for c in df.columns if c not in WORKING]
    return df.select(*other, F.explode(F.array(F.struct(*[c for c in WORKING if c in df.columns]))).alias("_w")).select(*other, "_w.*")


def _count(**add: Column) -> Column:
    return F.struct(*[((F.col("_n")[c] + add[c]) if c in add else F.col("_n")[c]).cast("int").alias(c) for c in COUNTERS])


def normalized(text: Column, collapse: bool = True, trim: bool = True, blank_lines: bool = True) -> Column:
    """Compatibility forms, no zero-width spaces, one kind of blank and line end, lines collapsed and trimmed, few empty lines."""
    slow = text.rlike(_PLAIN)
    fast = F.regexp_replace(F.regexp_replace(F.translate(text, "\u00a0\u200b", " "), "\r\n", "\n"), "\r", "\n")
    fast = F.regexp_replace(fast, r"[ \t]{2,}|\t", " ") if collapse else fast
    fast = F.regexp_replace(fast, r"(?md)^[ \t]+|[ \t]+$", "") if trim else fast
    fast = F.regexp_replace(fast, r"\n{3,}", "\n\n") if blank_lines else fast
    return F.when(slow, udfs.normalize_udf(collapse, trim, blank_lines)(F.when(slow, text))).otherwise(fast)


def tidy_lines(text: Column) -> Column:
    slow = text.rlike(_ODD_LINES)
    fast = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r"(?md)^[ \t]+|[ \t]+$", "")
    return F.when(slow, udfs.tidy_lines(F.when(slow, text))).otherwise(fast)


def s1_normalize(df: DataFrame, ctx: Context) -> DataFrame:
    """Normalises the masked text; its result is what a rollback returns to."""
    rules = ctx.config.rulepack.safe_normalize
    df = df.withColumn("_new", normalized(F.col("_text"), rules.collapse_spaces, rules.trim_line_edges, rules.collapse_blank_lines))
    return df.withColumns({"_n": _count(normalize_changes_count=(F.col("_new") != F.col("_text")).cast("int")), "_text": F.col("_new"), "_snapshot": F.col("_new")}).drop("_new")


def s2_segment(df: DataFrame, ctx: Context) -> DataFrame:
    """Nothing later reads segments; ``segments`` gives them as a relation."""
    return df


def segments(text: Column) -> Column:
    """Runs without blanks: array of (start, end, value)."""
    return spans(text, r"[^\s\x1C-\x1F\x85\p{Z}]+")


def s3_spelling(df: DataFrame, ctx: Context) -> DataFrame:
    rules, mode, text = ctx.config.rulepack, ctx.policy.mode, F.col("_text")
    typo_map, generate = rules.typo_map(mode), mode == "smart" and ctx.suggestions is not None
    if typo_map or generate:
        untouched = rules.no_touch(mode) | ctx.config.lexicon.untouched()
        df = df.withColumn("_found", spelling.eligible(text, rules.typo_min_token_len, untouched, rules.no_touch_prefixes()))
        df = df.withColumn("_exits", spelling.outcomes(F.col("_found"), typo_map, F.col(ctx.suggestions) if generate else None, rules.candidate_shadow_mode_ru, gate=ctx.gate))
        df = df.withColumns({"_n": _count(**spelling.counters(F.col("_exits"))), "_edits": spelling.edits(F.col("_exits"))})
        if not typo_map:  # pairs are corrected only where no map is set and no token was
            df = df.withColumn("_edits", F.when(F.size("_edits") > 0, F.col("_edits")).otherwise(spelling.digraph_edits(text)))
    else:
        df = df.withColumn("_edits", spelling.digraph_edits(text))
    df = df.withColumn("_fold", spelling.apply_edits(text, F.col("_edits"), zones.placeholder_spans(text), ctx.policy.zone_buffer, True))
    return _folded(df, "typo_corrections_count").withColumn("_text", F.col("_fold.text")).drop("_found", "_exits", "_edits", "_fold")


def _folded(df: DataFrame, counter: str) -> DataFrame:
    return df.withColumns({"_applied": F.concat("_applied", "_fold.applied"), "_rejected": F.concat("_rejected", "_fold.rejected"), "_n": _count(**{counter: F.size("_fold.applied")})})


def s4_grammar(df: DataFrame, ctx: Context) -> DataFrame:
    return df


def s5_punct(df: DataFrame, ctx: Context) -> DataFrame:
    rules, text = ctx.config.rulepack, F.col("_text")
    flags, keys = rules.spacing(), tuple(sorted(rules.typo_map(ctx.policy.mode)))
    df = df.withColumn("_edits", punctuation.punct_edits(text, flags.fix_space_before, flags.fix_space_after, keys))
    df = df.withColumn("_fold", spelling.apply_edits(text, F.col("_edits"), zones.placeholder_spans(text), ctx.policy.zone_buffer, False))
    return _folded(df, "punctuation_fixes_count").withColumn("_text", punctuation.tidy(F.col("_fold.text"))).drop("_edits", "_fold")


def _reasons(**bad: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in bad.items()]))


def _back() -> Column:
    snapshot = F.when(F.col("_snapshot") == "", F.col("_raw")).otherwise(F.col("_snapshot"))
    return zones.restore(snapshot, F.col("_values"))


def s6_guardrails(df: DataFrame, ctx: Context) -> DataFrame:
    """Back to the snapshot if a placeholder is lost, too much has changed, or too many edits were made."""
    base = F.when(F.col("_snapshot") == "", F.col("_raw")).otherwise(F.col("_snapshot"))
    df = df.withColumn("_share", udfs.changed_ratio(base, F.col("_text")))
    df = df.withColumn(
        "_why",
        _reasons(
            placeholders_missing=~zones.intact(F.col("_text"), F.col("_values")),
            changed_ratio_exceeded=F.col("_share") > ctx.policy.max_changed_ratio,
            edits_limit_exceeded=F.size("_applied") > ctx.policy.max_edits,
        ),
    )
    return _rolled(df).drop("_share")


def _rolled(df: DataFrame) -> DataFrame:
    return df.withColumns({"_text": F.when(F.size("_why") > 0, _back()).otherwise(F.col("_text")), "_rollbacks": F.concat("_rollbacks", "_why")}).drop("_why")


def s7_assemble(df: DataFrame, ctx: Context) -> DataFrame:
    return df.withColumn("_text", tidy_lines(zones.restore(F.col("_text"), F.col("_values"))))


def final_guardrails(df: DataFrame, ctx: Context) -> DataFrame:
    """Back to the snapshot if a placeholder is left, or a zone isn't there or isn't found any more."""
    text, values = F.col("_text"), F.col("_values")
    df = df.withColumn("_why", _reasons(placeholders_left=zones.count_placeholders(text) > 0, protected_mismatch=~zones.all_restored(text, values), protected_detector_mismatch=~zones.still_detected(text, values)))
    return _rolled(df)


#: Stages by name; ``register`` adds others.
REGISTRY: dict[str, Stage] = {f.__name__: f for f in (s1_normalize, s2_segment, s3_spelling, s4_grammar, s5_punct, s6_guardrails, s7_assemble)}


def register(name: str, stage: Stage) -> None:
    """A stage of one's own; whatever it does, the guardrails run after it."""
    if name in REGISTRY:
        raise ValueError(f"stage {name} exists")
    REGISTRY[name] = stage


def build(names: tuple[str, ...]) -> list[Stage]:
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown stage: {unknown[0]}")
    return [REGISTRY[n] for n in names]
