"""A bigram language model as two tables, trained and applied with joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import BORDER, WORD

BEGIN, END, OTHER = "<s>", "</s>", "<unk>"
BACKOFF = 0.4


def sentence(text: Column, latin: bool = False) -> Column:
    """Lower-case words of a sentence between its marks; empty where there is no word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"{BORDER}[{WORD}-]+{BORDER}"), F.lit(0))
    return F.when(F.size(words) > 0, F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END)))).otherwise(F.expr("cast(array() as array<string>)"))


def unigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(sentence(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Pairs of neighbours inside a sentence. They are zipped within the row: no window, and no shuffle but that of the counts."""
    chain = sentence(F.col(text))
    pairs = F.zip_with(F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0))), F.slice(chain, 2, F.greatest(F.size(chain) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.count(F.lit(1)).alias("n"))


def train(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Unigrams (w, n, logp, backoff) and bigrams (l, r, n, logp), with one added to every count; logs have base 10.

    The vocabulary has all words, both marks and a word for all others. Nothing is added up on one machine but two totals.
    """
    uni = unigram_counts(df, text)
    extra = df.sparkSession.createDataFrame([(OTHER, 0)], "w string, n long")
    uni = uni.unionByName(extra.join(uni.select("w"), "w", "left_anti"))
    totals = uni.agg(F.count(F.lit(1)).alias("_v"), F.sum("n").alias("_t"))  # a single row
    uni = uni.crossJoin(F.broadcast(totals)).select("w", "n", F.log10((F.col("n") + 1) / (F.col("_t") + F.col("_v"))).alias("logp"), F.lit(BACKOFF).alias("_b")).withColumn("backoff", F.log10("_b")).drop("_b")
    pairs = bigram_counts(df, text)
    left = pairs.groupBy("l").agg(F.sum("n").alias("_left"))
    bi = pairs.join(left, "l").crossJoin(F.broadcast(totals)).select("l", "r", "n", F.log10((F.col("n") + 1) / (F.col("_left") + F.col("_v"))).alias("logp"))
    return uni, bi


def score(df: DataFrame, uni: DataFrame, bi: DataFrame, id: list[str], words: str, end: bool = True) -> DataFrame:
    """``id`` columns and score: the sum of log10 P(word | word before) of the array column ``words``.

    A pair that was not seen costs its left word's back-off and its right word's own probability; unknown words are one word.
    """
    chain = F.concat(F.array(F.lit(BEGIN)), F.col(words), F.array(F.lit(END))) if end else F.concat(F.array(F.lit(BEGIN)), F.col(words))
    pairs = F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain) - 1), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    rows = df.select(*id, F.explode(pairs).alias("p")).select(*id, "p.l", "p.r")
    # each different pair is looked up once, however often it stands in the texts
    seen = rows.groupBy("l", "r").agg(F.count(F.lit(1)).alias("_times"))
    lefts = uni.select(F.col("w").alias("_lw"), "backoff")
    rights = uni.select(F.col("w").alias("_rw"), F.col("logp").alias("_ulogp"))
    other = uni.where(F.col("w") == OTHER).select(F.col("logp").alias("_ologp"), F.col("backoff").alias("_oback"))
    priced = (
        seen.join(bi.select("l", "r", F.col("logp").alias("_blogp")), ["l", "r"], "left")
        .join(lefts, F.col("l") == F.col("_lw"), "left")
        .join(rights, F.col("r") == F.col("_rw"), "left")
        .crossJoin(F.broadcast(other))
        .select(F.col("l").alias("_l"), F.col("r").alias("_r"), F.coalesce("_blogp", F.coalesce("backoff", "_oback") + F.coalesce("_ulogp", "_ologp")).alias("_p"))
    )
    return rows.join(priced, (F.col("l") == F.col("_l")) & (F.col("r") == F.col("_r"))).groupBy(*id).agg(F.sum("_p").alias("score"))


def arpa(uni: DataFrame, bi: DataFrame) -> DataFrame:
    """The model's lines in ARPA order as (section, line), seven decimals each, for a text export."""
    one = uni.select(F.lit(1).alias("section"), F.format_string("%.7f\t%s\t%.7f", "logp", "w", "backoff").alias("line"))
    two = bi.select(F.lit(2).alias("section"), F.format_string("%.7f\t%s %s", "logp", "l", "r").alias("line"))
    return one.unionByName(two)
