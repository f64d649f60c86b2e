"""Readers of case files and lexicons; what is wrong with a file is an error and never a dropped row, unless said so."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "input_text string, expected_clean_text string, left_context array<string>, right_context array<string>, domain string"
REPLAY = "case_id string, original_token string, expected_token string, left_context array<string>, right_context array<string>, candidates array<struct<token:string,rank:int>>, scores map<string,double>"
PILOT = "input_text string, expected_clean_text string, tag string, note string"


def _or_fail(value: Column, ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def jsonl_cases(spark: SparkSession, path: str, input_alias: bool = False, require_input: bool = True) -> DataFrame:
    """Text cases from JSON lines; blank lines are skipped, and ``input`` may stand for ``input_text`` where that is allowed."""
    raw = spark.read.schema(f"input string, {CASE}").option("mode", "FAILFAST").json(path)
    text = F.coalesce("input_text", "input") if input_alias else F.col("input_text")
    ok = (F.trim(text) != "") if require_input else text.isNotNull()
    out = raw.select(_or_fail(text, ok, "a case has no input_text").alias("input_text"), _or_fail(F.col("expected_clean_text"), F.col("expected_clean_text").isNotNull(), "a case has no expected_clean_text").alias("expected_clean_text"), "left_context", "right_context", "domain")
    return _not_empty(out, "cases")


def yaml_cases(spark: SparkSession, path: str, section: str = "smart", lenient: bool = False) -> DataFrame:
    """Cases of a small YAML file: a list of mappings under ``section``. ``lenient`` leaves out rows without both texts."""
    import yaml

    rows = (yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}).get(section)
    if not isinstance(rows, list):
        raise ValueError(f"{section} is not a list")
    fields = ("input", "expected_clean_text", "category", "note")
    good = [r for r in rows if isinstance(r, dict) and isinstance(r.get("input"), str) and isinstance(r.get("expected_clean_text"), str)]
    if not lenient and (len(good) < len(rows) or not rows):
        raise ValueError("a case is not complete")
    return spark.createDataFrame([tuple(r.get(f) for f in fields) + (i,) for i, r in enumerate(good)], "input_text string, expected_clean_text string, category string, note string, pos int")


READERS = {".jsonl": jsonl_cases, ".json": jsonl_cases, ".yml": yaml_cases, ".yaml": yaml_cases}


def cases(spark: SparkSession, path: str, **options) -> DataFrame:
    reader = READERS.get(Path(path).suffix.lower())
    if reader is None:
        raise ValueError(f"no reader for {Path(path).suffix!r}")
    return reader(spark, path, **options)


def replay_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(REPLAY).option("mode", "FAILFAST").json(path)
    ok = F.col("case_id").isNotNull() & F.col("original_token").isNotNull() & F.col("expected_token").isNotNull()
    return _not_empty(raw.withColumn("case_id", _or_fail(F.col("case_id"), ok, "a replay case is not complete")), "replay cases")


def pilot_cases(spark: SparkSession, path: str) -> DataFrame:
    """Pilot rows; keys other than the four of ``PILOT`` are an error."""
    names = [f.split()[0] for f in PILOT.split(", ")]
    raw = spark.read.text(path).where(F.trim("value") != "")
    extra = F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("?"))), F.array(*map(F.lit, names))))
    row = F.from_json(F.when(extra == 0, F.col("value")).otherwise(F.raise_error(F.lit("a pilot row has unknown keys")).cast("string")), PILOT, {"mode": "FAILFAST"})
    return raw.select(row.alias("r")).select("r.*")


def _strict(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], what: str) -> DataFrame:
    """JSON lines of ``schema`` (strings). A line that is no JSON object, a value that is no string, or a required one that is missing or
    empty, is an error; so is a file without rows. Blank lines are skipped; other keys are not read."""
    names = [f.split()[0] for f in schema.split(", ")]
    raw = spark.read.text(path).where(F.trim("value") != "")
    # a line is parsed once as a variant, which knows the kind of each value
    value = F.try_parse_json("value")
    kind = F.schema_of_variant(value)
    row = raw.select(value.alias("v"), kind.alias("k"))
    fields = {n: F.expr(f"try_variant_get(v, '$.{n}', 'string')") for n in names}
    shape = {n: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(v, '$.{n}', 'variant'))"), F.lit("VOID")) for n in names}
    ok = F.coalesce(F.startswith("k", F.lit("OBJECT")), F.lit(False))
    for n in names:
        ok = ok & (shape[n].isin("STRING") & (fields[n] != "") if n in required else shape[n].isin("STRING", "VOID"))
    checked = row.select(F.when(ok, F.struct(*[fields[n].alias(n) for n in names])).otherwise(F.raise_error(F.lit(f"a line is no {what}")).cast(", ".join(f"{n}: string" for n in names).join(["struct<", ">"]))).alias("r"))
    return _not_empty(checked.select("r.*"), what)


def review_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases for review; a source that isn't given is ``custom_jsonl``."""
    raw = _strict(spark, path, "input_text string, expected_clean_text string, source string, category string", ("input_text",), "review case")
    return raw.withColumn("source", F.coalesce("source", F.lit("custom_jsonl")))


def gold_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Raw gold rows (source, correction, domain) as cases; the correction may be empty."""
    raw = _strict(spark, path, "source string, correction string, domain string", ("source",), "gold row")
    return raw.select(F.col("source").alias("input_text"), _or_fail(F.col("correction"), F.col("correction").isNotNull(), "a line is no gold row").alias("expected_clean_text"), "domain")


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their order in a file, and the file."""
    paths = [path] if isinstance(path, str) else list(path)
    out = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).select(F.lit(i).alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def ranked(lines: DataFrame) -> DataFrame:
    """term and rank (from 0) of the different terms of rows (file, line, term), in the order of their first line."""
    from ..operators.ranks import ranked as global_rank

    first = lines.groupBy("term").agg(F.min(F.struct("file", "line")).alias("_at_line"))
    return global_rank(first, [F.asc("_at_line")]).select("term", "rank")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Plain dictionary: one safe term a line, # comments; rank is the order of the file."""
    from ..operators.spelling import safe_candidate

    lines = _numbered(spark, path).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    return ranked(lines.where(safe_candidate(F.col("value"))).withColumnRenamed("value", "term"))


def research_lexicon(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First fields of tab-separated lines of all files, in lower case."""
    lines = _numbered(spark, paths).select("file", "line", F.lower(F.trim(F.split("value", "\t")[0])).alias("term"))
    return ranked(lines.where((F.col("term") != "") & ~F.startswith("term", F.lit("#"))))


def counted_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``term count``; lines without a count are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts[0].alias("term"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 1) as long)").alias("count")).where("count is not null and term <> ''")


def lm_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _not_empty(spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''"), "sentences")


def vocabulary(docs: DataFrame, pattern: str, text: str = "text", least: int = 1) -> DataFrame:
    """A dictionary made from a corpus: terms that match ``pattern`` with count, rank 0 being the most frequent (then the lesser term)."""
    from ..operators.ranks import ranked as global_rank

    terms = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least)
    return global_rank(terms, [F.desc("count"), F.asc("term")])


def model_file(spark: SparkSession, source: str) -> tuple[str, str]:
    """A key for a model's source (its SHA-256) and the name under which ``SparkFiles`` finds the file on every executor."""
    import hashlib

    spark.sparkContext.addFile(source)
    return hashlib.sha256(source.encode()).hexdigest(), Path(source).name
