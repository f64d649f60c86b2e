"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import prepare, stored

#: What is left of one text after the tasks' own combining meets in so many groups before the global one.
SALTS = 64
NAMES = ("_keep_id", "_group_size", "_kept", "_sha256")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def winners(rows: DataFrame) -> DataFrame:
    """One row per different text of ``rows`` (_id, _t, _d, _s): _d (its digest), _t (the text), _keep (its largest id), _n (its rows) and
    _salts (those in which it stands, at most as many as there are).

    1. Each task combines its own rows of a text (the map side of the first aggregation).
    2. What is left of a text is merged in each salt, so that no task gets all copies of a hot text.
    3. The salt winners, at most one row per salt and text, are combined globally.
    Every stage groups by digest and full text: rows are merged only after a comparison of their content.
    """
    salted = rows.groupBy("_d", "_s", "_t").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return salted.repartition("_d").groupBy("_d", "_t").agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.collect_set("_s").alias("_salts"))


def exact_dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """All rows of ``docs`` with _keep_id, _group_size, _kept and _sha256 (the digest); of equal texts the row with the largest id stays.

    The winners are joined back by digest and salt, so the rows of a hot text are spread over the salts here as well. The digest alone
    stands for the text only where the third stage, which compares texts, has found one text for every digest; else the join compares
    the texts too.

    Null texts count as empty. A null id loses against any other, and a group of null ids only keeps all of its rows. Rows that repeat
    the winning id and text are all kept. An empty table gives an empty result. Other columns pass through, whatever their names,
    except that columns of the four names above are replaced.
    """
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in NAMES]
    value = F.coalesce(F.col(text), F.lit(""))
    # rows without an id, which a third of all may be, are told apart by their other columns
    apart = F.xxhash64(F.col(id), *[F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id, text) and isinstance(f.dataType, AtomicType)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id).cast("long").alias("_id"), value.alias("_t"), F.pmod(apart, F.lit(salts)).alias("_s"))
    rows = rows.withColumn("_d", digest(F.col("_t")))
    texts = winners(rows.drop("_row"))
    found = stored(texts.groupBy("_d").agg(F.count(F.lit(1)).alias("_texts"), F.first("_keep").alias("_keep"), F.first("_n").alias("_n"), F.first("_salts").alias("_salts")))
    keys = ["_d", "_s"]
    if not found.where("_texts > 1").isEmpty():
        keys, found = ["_d", "_s", "_t"], texts
    spread = found.withColumn("_s", F.explode("_salts")).select(*keys, "_keep", "_n")
    return rows.join(spread, keys).select(
        "_row.*", F.col("_keep").alias("_keep_id"), F.col("_n").alias("_group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("_kept"), F.col("_d").alias("_sha256")
    )
