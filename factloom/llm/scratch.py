"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a folder of our own only where the setting is missing and all runs
    in one process (tests). On a cluster a folder of one machine would be lost to the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet to the shared folder and reads it back: later stages neither
    recompute it nor depend on any executor that may be lost meanwhile."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, count: str, k: int) -> DataFrame:
    """The rows of largest ``count`` (positive), k at most: whole classes of counts that lie within
    1/16 of a power of two. Counted by class, so no task has to send its k largest anywhere."""
    level = F.floor(F.log2(count) * 16)
    total, bar = 0, None
    for value, n in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        total += n
        if total > k:
            break
        bar = value
    return counts.where(level >= bar) if bar is not None else counts.where("false")


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by ``table`` once no later step reads them."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
