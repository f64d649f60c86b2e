"""A pipeline from raw documents to packed sequences; part of the package ``llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
Columns of the table other than those of ``documents`` are not read; an empty table goes through all stages and gives no piece. What a
stage does with nulls and with rows that repeat is said where it differs from its operator.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarion.llm import exact_dedup, langid, minhash, packing, suffix_dedup
from glossarion.llm.common import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language go: null texts and texts without a letter. Where no row has a label, all others are of one language."""
    model = langid.fit(docs, F.lit(True)) or langid.Model(("any",), np.zeros((langid.CELLS, 1)))
    return langid.identify(docs, model, keep=COLUMNS, with_text=True).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: that with the largest id. Rows that share that id, or have none, are merged, within tasks first."""
    kept = exact_dedup.exact_dedup(docs).where("_kept")
    several = kept.where("_group_size > 1").groupBy("doc_id", "_sha256", F.coalesce("text", F.lit("")).alias("_t"))
    one = several.agg(F.min(F.struct("lang", "source", "n_chars")).alias("_rest"), F.count("text").alias("_texts"))
    one = one.select("doc_id", F.when(F.col("_texts") > 0, F.col("_t")).alias("text"), "_rest.*")
    return kept.where("_group_size = 1").select(*COLUMNS).unionByName(one).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, at a similarity of 0.8 of their five-word shingles, one stays: that with the least id, where any has one."""
    kept = minhash.near_duplicates(docs, NEAR_PERCENT).where("first").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (minhash.text_key("text") == kept["_key"]), "left_semi").select(*COLUMNS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand in two places go from the texts; the documents stay, those that are left without any text too."""
    return suffix_dedup.suffix_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences; a document without text is its end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", suffixes), ("packing", pack)]

#: SQL can't express language models, signatures, suffixes or tokenizers; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = checkpoint_folder(spark)
    for name, stage in STAGES:
        path = f"{home}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
