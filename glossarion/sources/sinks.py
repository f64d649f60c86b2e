"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode(mode).json(path)


def report(df: DataFrame) -> DataFrame:
    """A one-row summary as one JSON document."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("report"))


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A small aggregate as a Markdown table in one row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = df.select(F.struct(*order).alias("k"), line.alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return rows.select(F.concat_ws("\n", F.concat(F.array(F.lit(head)), "lines")).alias("markdown"))


def audit(cleaned: DataFrame, keep: list[str]) -> DataFrame:
    """The audit as columns, without any text."""
    return cleaned.select(*keep, "audit.*")


def arpa(lines: DataFrame, unigrams: int, bigrams: int, path: str) -> None:
    """An ARPA text file of ``ngrams.arpa`` lines: sections in order, lines sorted."""
    spark = lines.sparkSession
    head = [(0, 0, "\\data\\"), (0, 1, f"ngram 1={unigrams}"), (0, 2, f"ngram 2={bigrams}"), (0, 3, ""), (0, 4, "\\1-grams:"), (1, 1 << 30, ""), (1, (1 << 30) + 1, "\\2-grams:"), (2, 1 << 30, ""), (2, (1 << 30) + 1, "\\end\\")]
    fixed = spark.createDataFrame(head, "section int, place int, line string")
    body = lines.select("section", F.lit(0).alias("place"), "line")
    fixed.unionByName(body).orderBy("section", "place", "line").select("line").write.text(path)


def reused(df: DataFrame, path: str, least: int) -> DataFrame:
    """What is stored at ``path`` if it has ``least`` rows at least; else ``df``, stored there."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        held = spark.read.parquet(path)
        if held.count() >= least:
            return held
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
