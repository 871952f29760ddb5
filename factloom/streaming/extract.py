"""Extraction as a stream. Every step up to facts works on a single row, so a stream of documents goes
through the same functions as a table; no state is kept and no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def documents(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """New Parquet files under ``path``, at most ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run(docs: DataFrame, steps: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends what ``steps`` makes of the stream to Parquet files under ``out``."""
    writer = steps(docs).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
