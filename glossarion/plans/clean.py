"""The cleaning pipeline as one plan: mask, stages, guardrails, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config, policy
from ..functions import udfs
from ..operators import stages, spelling
from ..operators.candidates import suggest
from ..operators.morph import decisions, pair_decisions

def bounds(text: Column, max_chars: int = 20_000) -> Column:
    """``empty``, ``too_long`` or ``ok``."""
    return F.when(text.isNull() | (F.length(F.regexp_replace(text, r"[\s\x1C-\x1F\x85\p{Z}]+", "")) == 0), "empty").when(F.length(text) > max_chars, "too_long").otherwise("ok")


def body_too_large(text: Column, max_bytes: int = 1_048_576) -> Column:
    return F.octet_length(text) > max_bytes


def clean(df: DataFrame, mode: str = "smart", config: Config = Config(), text: str = "text", dictionary: DataFrame | None = None, morph: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with clean_text and audit (a struct without any text), and edits (applied and rejected); its other columns pass through, whatever
    their names, and a column of one of these three names is an error.

    ``dictionary`` (term, rank) is used where the configuration turns candidates on, and ``morph`` (form, is_known, score, pos, lemma,
    grammemes) for its guards. ``extra`` stages run before the first guardrails. Nulls are cleaned as empty texts. Candidates are looked
    up once for each different token, and joined to the texts that have one; everything else is a projection without a shuffle.
    """
    rules, chosen = config.rulepack, policy(mode, config)
    generate = chosen.mode == "smart" and rules.enable_candidate_generation_ru
    names = df.columns
    if taken := {"clean_text", "audit", "edits"} & set(names):
        raise ValueError(f"the table has columns that cleaning adds: {sorted(taken)}")
    df = stages.start(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("raw")), "raw").drop("raw")
    gate = None
    if rules.enable_morph_safety_ru and morph is not None:
        mapped = rules.typo_map(chosen.mode)
        gate = pair_decisions({**(spelling.SAFE_TOKENS if generate else {}), **{k: v for k, v in mapped.items() if v}}, morph)
    if generate:
        if dictionary is None:
            raise ValueError("candidate generation needs a dictionary")
        df = _with_suggestions(df, config, dictionary, morph)
    ctx = stages.Context(chosen, config, "_suggested" if generate else None, gate)
    steps = list(chosen.stages)
    at = steps.index("s6_guardrails") if "s6_guardrails" in steps else len(steps)
    for stage in [*stages.build(tuple(steps[:at])), *stages.build(extra), *stages.build(tuple(steps[at:])), stages.final_guardrails]:
        df = stages.settled(stage(df, ctx))
    share = F.round(F.least(F.greatest(udfs.changed_ratio(F.col("_raw"), F.col("_text")), F.lit(0.0)), F.lit(1.0)), 6)
    audit = F.struct(
        F.length("_raw").alias("input_len_chars"),
        F.length("_text").alias("output_len_chars"),
        share.alias("changed_ratio"),
        F.lit(1.0).alias("confidence"),
        (F.size("_rollbacks") > 0).alias("rollback_applied"),
        F.col("_rollbacks").alias("rollback_reasons"),
        F.size("_zones").alias("pz_spans_count"),
        *[F.col("_n")[c].alias(c) for c in stages.COUNTERS],
        F.lit(rules.v2_selector_scaffold_enabled).alias("v2_selector_scaffold_enabled"),
        F.lit(rules.v2_selector_scaffold_enabled).alias("v2_selector_scaffold_available"),
    )
    return df.select("row.*", F.col("_text").alias("clean_text"), audit.alias("audit"), F.struct(F.col("_applied").alias("applied"), F.col("_rejected").alias("rejected")).alias("edits"))


def _with_suggestions(df: DataFrame, config: Config, dictionary: DataFrame, morph: DataFrame | None) -> DataFrame:
    rules = config.rulepack
    untouched = rules.no_touch("smart") | config.lexicon.untouched()
    # tokens are those of the normalised text; normalisation may change them, so it is repeated here
    flags = rules.safe_normalize
    norm = stages.normalized(F.col("_text"), flags.collapse_spaces, flags.trim_line_edges, flags.collapse_blank_lines)
    found = F.array_distinct(F.transform(spelling.eligible(norm, rules.typo_min_token_len, untouched, rules.no_touch_prefixes()), lambda t: t["value"]))
    # texts are known by a digest, so only digests and tokens are shuffled to make the maps
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    per_text = df.where(F.col("_text").rlike(f"[{spelling.LETTERS}]")).select(digest.alias("_of"), F.explode(found).alias("_token")).distinct()
    hints = suggest(per_text.select(F.col("_token").alias("token")).distinct(), dictionary, rules.candidate_backend, rules.max_candidates_ru, rules.max_edit_distance_ru)
    if morph is not None:
        hints = decisions(hints, morph, rules.enable_morph_safety_ru)
    else:
        hints = hints.withColumn("morph", F.lit(None).cast("string"))
    entry = F.struct(F.col("token"), F.struct("status", "term", "morph"))
    maps = per_text.join(hints, per_text["_token"] == hints["token"]).groupBy("_of").agg(F.map_from_entries(F.collect_list(entry)).alias("_suggested"))
    nothing = F.expr("cast(map() as map<string,struct<status:string,term:string,morph:string>>)")
    return df.withColumn("_digest", digest).join(maps, F.col("_digest") == F.col("_of"), "left").withColumn("_suggested", F.coalesce("_suggested", nothing)).drop("_of", "_digest")


def events(cleaned: DataFrame, mode: str) -> DataFrame:
    """The audit as an event log without texts: event, mode, name, n."""
    counts = ["normalize_changes_count", "typo_corrections_count", "punctuation_fixes_count"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col("audit")[c].alias("n")) for c in counts]))
    return cleaned.select(F.lit("stage_corrections_applied").alias("event"), F.lit(mode).alias("mode"), pairs.alias("e")).select("event", "mode", "e.name", "e.n").where("n > 0")
