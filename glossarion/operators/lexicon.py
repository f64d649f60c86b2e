"""Research retrieval: normalised lexicons and the best candidates of a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .candidates import within

#: Characters that wrap tokens in user texts, prefixes whose hyphen is often left out, and what a key may hold. Fixed values.
WRAPPERS = "`*_~|<>{}[]()\"'"
HYPHENATED = ("по", "из")
KEY = r"\A[а-яё-]+\z"


def surface(token: Column) -> Column:
    return F.lower(F.trim(token))


def key(token: Column) -> Column:
    """The token trimmed, in lower case, with е for ё."""
    return F.translate(surface(token), "ё", "е")


def variants(token: Column) -> Column:
    """Forms under which a token is looked up: as it is, without wrappers, without # or @, without hyphens, with a hyphen put back."""
    token = F.trim(token)
    bare = F.trim(token, F.lit(WRAPPERS)) if WRAPPERS else token
    untagged = F.when(token.rlike("^[#@]."), token.substr(F.lit(2), F.length(token)))
    compact = F.replace(F.when(bare == "", token).otherwise(bare), F.lit("-"), F.lit(""))
    back = [F.when(F.startswith(compact, F.lit(p)) & (F.length(compact) >= len(p) + 3), F.concat(F.lit(f"{p}-"), compact.substr(F.lit(len(p) + 1), F.length(compact)))) for p in HYPHENATED]
    return F.array_distinct(F.filter(F.array(token, bare, untagged, compact, *back), lambda v: v.isNotNull() & (v != "")))


def index(terms: DataFrame) -> DataFrame:
    """term and rank of the different keys of a lexicon (term, rank), in the order of first use."""
    keyed = terms.select(key(F.col("term")).alias("term"), "rank").where("term <> ''")
    first = keyed.groupBy("term").agg(F.min("rank").alias("_r"))
    return first.select("term", F.col("_r").alias("rank"))


def yo_variants(terms: DataFrame) -> DataFrame:
    """Surface terms with ё by their key: key, term."""
    return terms.select(surface(F.col("term")).alias("term")).where(F.contains("term", F.lit("ё"))).distinct().select(key(F.col("term")).alias("key"), "term")


def top_k(tokens: DataFrame, terms: DataFrame, k: int = 5, distance: int = 2, normalize: bool = True) -> DataFrame:
    """token, term, distance and position (from 0) of the best ``k`` candidates of every different token.

    Each variant of a token is looked up in the lexicon's keys and cut to its own best ``k`` (by distance, then term); a key of its own is
    no candidate, its spellings with ё are, at distance 0. The variants' candidates are merged at their least distance and ordered by
    distance, difference in length, and term.
    """
    tokens = tokens.select("token").distinct()
    forms = F.explode(variants(F.col("token"))) if normalize else F.col("token")
    asked = tokens.select("token", forms.alias("_v")).select("token", key(F.col("_v")).alias("_key")).where(F.col("_key").rlike(KEY)).distinct()
    keys = asked.select(F.col("_key").alias("token")).distinct()
    near = within(keys, index(terms), distance).where("distance > 0").select(F.col("token").alias("_k"), "term", "distance")
    if normalize:
        near = near.unionByName(yo_variants(terms).join(keys, F.col("key") == F.col("token"), "left_semi").select(F.col("key").alias("_k"), "term", F.lit(0).alias("distance")))
    cut = near.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("distance", "term"))).where(F.col("_n") <= k)
    if normalize:  # spellings with ё are added again after the cut
        cut = cut.select("_k", "term", "distance").unionByName(near.where("distance = 0").select("_k", "term", "distance"))
    merged = asked.join(cut, asked["_key"] == cut["_k"]).groupBy("token", "term").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("token").orderBy("distance", F.abs(F.length("term") - F.length(key(F.col("token")))), "term")
    return merged.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < k)


def fallback(tokens: DataFrame, terms: DataFrame, k: int = 5, distance: int = 2) -> DataFrame:
    """token, term, distance and position of the best ``k`` keys by plain Levenshtein distance, in which a swap of neighbours is two edits; a
    token whose key is in the lexicon has none. Words that close share a deletion, so the join is that of ``top_k``."""
    keys = tokens.select("token", key(F.col("token")).alias("_key")).distinct()
    lexical = index(terms)
    unknown = keys.join(lexical.select("term"), F.col("_key") == F.col("term"), "left_anti")
    near = within(unknown.select(F.col("_key").alias("token")), lexical, distance).select(F.col("token").alias("_k"), "term", F.levenshtein("token", "term").alias("distance")).where(F.col("distance") <= distance)
    order = Window.partitionBy("token").orderBy("distance", F.abs(F.length("term") - F.length("_key")), "term")
    return unknown.join(near, F.col("_key") == F.col("_k")).withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < k).select("token", "term", "distance", "position")


def base_score(distance: Column, position: Column) -> Column:
    return -(distance + 0.15 * position)


def combined(base: Column, lm: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return alpha * base + beta * lm
