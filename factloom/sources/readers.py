"""Document sources: every reader gives doc_id or a path, and text, and what else the format tells.

Defined cases: missing files are Spark's error; empty files and folders give no row or an empty text; archives and
record files are read a file a task, members and records one after the other, so memory holds one of them and its file."""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_VALUE = 1 << 27


def one_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one document, with id 0."""
    files = spark.read.text(path, wholetext=True)
    if len(files.inputFiles()) > 1:
        raise ValueError(f"{path} is more than one file; folder() reads them all")
    return files.select(F.lit(0).cast("long").alias("doc_id"), F.col("value").alias("text"))


def per_line(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """A document a line; a leading integer and TAB give the id, else the line's number does; empty lines are skipped.
    ``last``: the number of the last line that is read. Lines are numbered by the counts of the partitions before."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_id"))
    part = F.shiftright("_id", 33)
    counts = sorted((r[0], r[1]) for r in lines.groupBy(part.alias("p")).count().collect())  # a row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets += [F.lit(p).cast("long"), F.lit(before).cast("long")]
        before += n
    start = F.try_element_at(F.create_map(*offsets), part) if offsets else F.lit(0).cast("long")
    df = lines.select(F.col("value"), (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line")).where(F.length("value") > 0)
    own = F.regexp_extract("value", r"^(-?\d+)\t", 1)
    df = df.where(F.col("line") <= last) if last else df
    return df.select(F.coalesce(F.nullif(own, F.lit("")).try_cast("long"), "line").alias("doc_id"), F.when(own != "", F.expr("substring(value, locate('\t', value) + 1)")).otherwise(F.col("value")).alias("text"))


def archives(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """Every file in the tar archives under ``path``: archive, name and text (null if it is not in the charset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    for member in tar:
                        if member.isfile():
                            raw = tar.extractfile(member).read()
                            try:
                                text = raw.decode(charset)
                            except UnicodeDecodeError:
                                text = None
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member.name]), pa.array([text], pa.string())], ["archive", "name", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "archive string, name string, text string")


def records(spark: SparkSession, path: str, subkey: str | None = None) -> DataFrame:
    """Length-value records: key, subkey and value, each after its length (4 bytes, little-endian). Only records
    with the given subkey, if any; source is the url up to the first /, text the value. Longer values than 2**27 bytes are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, at = memoryview(content.as_buffer()), 0
                while at < len(data):
                    parts = []
                    for _ in range(3):
                        (size,) = struct.unpack_from("<I", data, at)
                        if size > MOST_VALUE or at + 4 + size > len(data):
                            raise ValueError(f"a record of {size} bytes at {at} does not end in its file")
                        parts.append(bytes(data[at + 4 : at + 4 + size]).decode("utf-8", "replace"))
                        at += 4 + size
                    if subkey is None or parts[1] == subkey:
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (parts[0], parts[0].split("/", 1)[0], parts[1], parts[2])], ["url", "source", "subkey", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, "url string, source string, subkey string, text string")


def folder(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Every file under a folder, decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", charset).alias("text"), F.col("modificationTime").alias("date"))


def textset(spark: SparkSession, path: str) -> DataFrame:
    """XML <textset><text id="..">..</text></textset>: the id is the url."""
    rows = spark.read.format("xml").option("rowTag", "text").schema("_id string, _VALUE string").load(path)
    return rows.select(F.col("_id").alias("url"), F.col("_VALUE").alias("text"))


def with_agency(docs: DataFrame, agencies: DataFrame) -> DataFrame:
    """Adds agency columns by doc_id."""
    return docs.join(agencies, "doc_id", "left")


def with_hero(docs: DataFrame, heroes: DataFrame) -> DataFrame:
    """Adds the interviewed person by address, leading http:// removed."""
    return docs.withColumn("address", F.regexp_replace("url", "^(http://)+", "")).join(heroes.withColumnRenamed("url", "address"), "address", "left").drop("address")
