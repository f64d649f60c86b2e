"""Spelling candidates from a dictionary, by a join on deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udfs import indel, osa_distance
from .spelling import safe_candidate


def deletions(term: Column, distance: int) -> Column:
    """The term and all that is left of it after up to ``distance`` single deletions."""
    one = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda k: F.concat(s.substr(F.lit(1), k - 1), s.substr(k + 1, F.length(s))))
    out = F.array(term)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.when(F.length(s) > 0, one(s)).otherwise(F.array(s))))))
    return out


def swapped(a: Column, b: Column) -> Column:
    """Whether the texts, of one length, differ by one swap of neighbours."""
    differs = F.filter(F.sequence(F.lit(1), F.length(a)), lambda k: a.substr(k, F.lit(1)) != b.substr(k, F.lit(1)))
    i = F.try_element_at(differs, F.lit(1))
    at = lambda s, k: s.substr(k, F.lit(1))
    return (F.length(a) == F.length(b)) & (F.length(a) > 0) & (F.size(differs) == 2) & (F.try_element_at(differs, F.lit(2)) == i + 1) & (at(a, i) == at(b, i + 1)) & (at(a, i + 1) == at(b, i))


def within(tokens: DataFrame, dictionary: DataFrame, distance: int) -> DataFrame:
    """Pairs (token, term, rank, distance) at most ``distance`` edits apart, a swap of neighbours being one.

    Two words that close share a deletion of up to ``distance`` letters, so an equi-join on deletions finds them all. Each word is
    exploded on its own side; only pairs that share a deletion are compared.
    """
    left = tokens.select("token").distinct().select("token", F.explode(deletions(F.col("token"), distance)).alias("_key"))
    right = dictionary.select("term", "rank").select("term", "rank", F.explode(deletions(F.col("term"), distance)).alias("_key"))
    pairs = left.join(right, "_key").select("token", "term", "rank").distinct()
    if distance <= 1:
        d = F.when(F.col("token") == F.col("term"), 0).when((F.levenshtein("token", "term") <= 1) | swapped(F.col("token"), F.col("term")), 1)
    else:
        d = F.when(F.col("token") == F.col("term"), 0).otherwise(osa_distance(F.col("token"), F.col("term")))
    return pairs.withColumn("distance", d.cast("int")).where(F.col("distance") <= distance)


def closest(pairs: DataFrame) -> DataFrame:
    """Only the pairs at the least distance of their token."""
    return pairs.withColumn("_least", F.min("distance").over(Window.partitionBy("token"))).where("distance = _least").drop("_least")


def suggest(tokens: DataFrame, dictionary: DataFrame, backend: str = "symspell", limit: int = 3, distance: int = 1) -> DataFrame:
    """token, status (generated, ambiguous or rejected) and term, for every different token.

    symspell: the closest terms, the more frequent (lower rank) first, cut to ``limit``. rapidfuzz: the ``limit`` terms of the highest
    indel ratio, then those within ``distance`` by Levenshtein. In both the token itself and unsafe terms drop out, and a tie of the two best is ambiguous.
    """
    tokens = tokens.select("token").distinct()
    if backend == "none":
        return tokens.select("token", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("term"))
    if backend == "symspell":
        first = closest(within(tokens, dictionary, distance)).withColumn("_score", -F.col("rank").cast("double"))
        cut = Window.partitionBy("token").orderBy("distance", F.desc("_score"), "term")
        kept = first.withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= limit)
    elif backend == "rapidfuzz":
        first = ratios(tokens, dictionary, distance)
        cut = Window.partitionBy("token").orderBy(F.desc("_score"), "rank")
        kept = first.withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= limit).withColumn("distance", F.levenshtein("token", "term")).where(F.col("distance") <= distance)
    else:
        raise ValueError(f"unknown backend {backend!r}")
    kept = kept.where((F.col("term") != F.col("token")) & safe_candidate(F.col("term")))
    order = Window.partitionBy("token").orderBy("distance", F.desc("_score"), "term")
    ranked = kept.select("token", "term", F.row_number().over(order).alias("_r"), ((F.lead("distance").over(order) == F.col("distance")) & (F.lead("_score").over(order) == F.col("_score"))).alias("_tie"))
    best = ranked.where("_r = 1").select(F.col("token").alias("_t"), "term", F.coalesce("_tie", F.lit(False)).alias("_tie"))
    status = F.when(F.col("_t").isNull(), "rejected").when(F.col("_tie"), "ambiguous").otherwise("generated")
    return tokens.join(best, tokens["token"] == best["_t"], "left").select("token", status.alias("status"), F.when(status == "generated", F.col("term")).alias("term"))


def ratios(tokens: DataFrame, dictionary: DataFrame, distance: int) -> DataFrame:
    """Pairs (token, term, rank, _score) of all terms whose indel ratio can reach that of a term within ``distance`` of the token.

    The best terms are wanted over the whole dictionary, so this compares different tokens with terms, as far as their lengths allow:
    a term at Levenshtein distance d of a token of n letters has a ratio of at least 200 (n - d) / (2 n + d), and letters that only
    one of two words has bound their ratio. The join runs on the length.
    """
    n, d = F.length("token"), F.lit(distance)
    least = F.greatest(200.0 * (n - d) / (2 * n + d), F.lit(1.0))
    lowest, highest = F.greatest(F.ceil(n * least / (200 - least) - 1e-9), F.lit(1)).cast("int"), F.floor(n * (200 - least) / least + 1e-9).cast("int")
    most = F.least(highest, F.lit(10) + 4 * n)  # a token no longer than ``distance`` can have any length beside it
    left = tokens.select("token", F.explode(F.sequence(lowest, F.greatest(most, lowest))).alias("_size"))
    right = dictionary.select("term", "rank", F.length("term").alias("_length"))
    return left.join(right, F.col("_size") == F.col("_length")).select("token", "term", "rank", indel(F.col("token"), F.col("term")).alias("_score"))
