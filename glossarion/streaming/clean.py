"""Cleaning of streams with the plan of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.clean import clean


def clean_stream(source: DataFrame, mode: str = "smart", config: Config = Config(), text: str = "text") -> DataFrame:
    """The stream with clean_text and audit. Without candidates cleaning is a projection and keeps no state; with them use ``start_clean``."""
    return clean(source, mode, config, text)


def start_clean(source: DataFrame, out: str, checkpoint: str, mode: str = "smart", config: Config = Config(), text: str = "text", dictionary: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Cleans each micro-batch as a batch and appends it to Parquet; candidates join with a static dictionary."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own files
        clean(batch, mode, config, text, dictionary).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
