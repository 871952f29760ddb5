"""The corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of ``documents``. Stage by stage: documents without letters, or in a language that
was not learned, go; of the rest, the share that is good among the labelled documents is sampled by quality;
of each group of near duplicates the one with the smallest id stays; documents that hold a benchmark item
go; the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, langid, packing, quality, scratch, setjoin
from factloom.llm.queries import bpe_path, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, and those less familiar than the bar that training sets for texts
    in the learned languages."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.keep_known(docs, model, least=0.0, familiar=model.bar)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a hundredth of the rows more than the labelled share, as good documents are not to be lost."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), spare=0.01)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setjoin.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, bpe_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_classifier", good),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", clean),
    ("packing", packed),
]

#: no stage but the fourth can be told in SQL; the tests hold run() against a plain version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written, and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
