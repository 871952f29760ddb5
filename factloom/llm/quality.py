"""Quality by importance resampling: log ratio of two hashed n-gram models, then Gumbel top-k.

Words and runs of punctuation, and pairs of neighbours, are hashed into ``BUCKETS`` buckets. The raw model counts all
documents; the target model counts documents labelled as good without the quarter that is held out, of
which about ``target_rows`` (by the hash of the id) are taken at most. Both have add-one smoothing and a fixed size. A document's log weight is
the sum over its n-grams of log p_target - log p_raw. Adding standard Gumbel noise and taking the k
largest samples k documents without replacement in proportion to their weights.

k: a number of rows, a share of them, or None: the share of good ones among the labelled documents, and
``spare`` (of the rows) more, where a lost good document weighs more than a bad one that stays. The
key is log weight / ``temperature`` + noise, with the sum of the log ratios as it is (not divided by the
length). At temperature 1 rows are drawn in proportion to their ratios, which is importance resampling; as
the weights of long texts are large, chance decides near the bar only. Larger temperatures let it decide
more widely. The k-th largest key is found by histograms of fixed size, refined until
its bin is small; ties with it are all kept.

The noise of a row is a hash of its id, text length and the seed, so retries give the same sample.
Defined cases: texts without a word or sign, null ones included, weigh 0 and are never selected; null
doc_ids and null labels count as unlabelled; repeated rows are all scored, equal rows alike; other columns are dropped
(``score``, ``resample``); without labelled good documents both models are equal and all weights 0;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import scratch
from factloom.llm import textops as X

BITS = 14
BUCKETS = 1 << BITS
HELD_OUT = "crc32(cast(doc_id AS string)) % 4 = 0"
_KIND = np.full(256, 1, np.int8)
_KIND[[i for i in range(128) if not chr(i).isalnum()]] = 2
_KIND[X.SPACE] = 0


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of runs of signs, and the first of each text (len + 1)."""
    data, at = X.flat(texts)
    n = len(data)
    if not n:
        return np.zeros(0, X.U), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[at] = True
    cut = np.flatnonzero(edge)
    some = kind[cut[:-1]] != 0
    start = cut[:-1][some]
    return X.span_hashes(data, start, cut[1:][some]), np.searchsorted(start, at)


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of every token and pair of neighbours, and the tokens of each text."""
    token, first = _tokens(texts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = X.grams(token, 2)
    inside = row[1:] == row[:-1]
    bucket = np.concatenate([token >> X.U(64 - BITS), pair[inside] >> X.U(64 - BITS)]).astype(np.int64)
    return bucket, np.concatenate([row, row[1:][inside]]), np.diff(first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for block in X.blocks(batch, "text"):
            bucket, row, _ = ngram_buckets(block.column("text"))
            target = block.column("target").to_numpy(zero_copy_only=False)[row].astype(bool)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            counts[1] += np.bincount(bucket[target], minlength=BUCKETS)
    some = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_pydict({"bucket": some, "raw": counts[0][some], "target": counts[1][some]})


def _text(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _good(labels: DataFrame) -> DataFrame:
    return _labelled(labels, 1)


def _labelled(labels: DataFrame, quality: int) -> DataFrame:
    return labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = 20_000) -> np.ndarray:
    """log p_target - log p_raw of every bucket. ``labels``: doc_id, quality (1: good)."""
    good = _good(labels).where(f"NOT ({HELD_OUT})")
    share = min(1.0, target_rows / max(1, good.count()))
    good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("doc_id", F.lit(True).alias("target"))
    rows = _text(docs).join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = np.zeros((2, BUCKETS))
    for r in rows.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        counts[:, r[0]] = r[1], r[2]
    if not counts[1].any():
        return np.zeros(BUCKETS)
    p = (counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[1]) - np.log(p[0])


def _score(ratio: np.ndarray, weight: str = "log_weight", tokens: str = "n_tokens") -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch, "text"):
                bucket, row, n = ngram_buckets(block.column("text"))
                sums = np.bincount(row, ratio[bucket], block.num_rows).astype(float)
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(sums), pa.array(n)], [*block.schema.names, weight, tokens])

    return run


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024, small: int = 4096) -> float:
    """The k-th largest finite value of the column (k from 1 to their number), by counting."""
    value = F.col(column)
    low, high = values.agg(F.min(value), F.max(value)).first()
    above = 0  # values over high
    while low < high:
        here = values.where(value.between(low, high))
        width = (high - low) / bins
        counts = {r[0]: (r[1], r[2], r[3]) for r in here.groupBy(F.least(F.floor((value - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*"), F.min(value), F.max(value)).collect()}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if above + n >= k:
                break
            above += n
        low, high = least, most
        if n <= small:
            return sorted((r[0] for r in values.where(value.between(low, high)).select(value).collect()), reverse=True)[k - above - 1]
    return low


def _key(seed: int | Column, temperature: float = 1.0, weight: str = "log_weight", tokens: str = "n_tokens") -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), tokens, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.col(weight) / F.lit(float(temperature)) - F.log(-F.log(u))


def _scored(docs: DataFrame, labels: DataFrame, ratio: np.ndarray, k: int | float | None, seed: int, temperature: float, spare: float) -> tuple[DataFrame, float]:
    """Keys of all rows, and the k-th largest of them."""
    scored = _text(docs).mapInArrow(lambda x: (b.drop_columns(["text"]) for b in _score(ratio)(x)), "doc_id long, log_weight double, n_tokens long")
    scored = scratch.table(scored.withColumn("gumbel_key", _key(seed, temperature)), "weights")
    return scored, _bar(scored, labels, k, spare)


def resample(docs: DataFrame, labels: DataFrame, k: int | float | None = None, seed: int = 7, target_rows: int = 20_000, temperature: float = 1.0, spare: float = 0.0) -> DataFrame:
    """doc_id, log_weight, n_tokens, gumbel_key and selected for every row of ``docs`` (doc_id, text)."""
    scored, bar = _scored(docs, labels, fit(docs, labels, target_rows), k, seed, temperature, spare)
    return scored.withColumn("selected", (F.col("n_tokens") > 0) & (F.col("gumbel_key") >= F.lit(bar)))


def _bar(scored: DataFrame, labels: DataFrame, k: int | float | None, spare: float) -> float:
    rows = scored.where("n_tokens > 0")
    n = rows.count()
    if k is None:
        good, bad = (rows.join(_labelled(labels, q), "doc_id", "left_semi").count() for q in (1, 0))
        k = min(1.0, good / (good + bad) + spare) if good else 1.0
    if isinstance(k, float):
        k = round(k * n)
    return kth_largest(rows, "gumbel_key", min(k, n)) if n and k > 0 else float("inf")


def keep_good(docs: DataFrame, labels: DataFrame, k: int | float | None = None, seed: int = 7, target_rows: int = 20_000, temperature: float = 1.0, spare: float = 0.0) -> DataFrame:
    """The selected rows of ``docs``, with all their columns: rows are scored again as they are
    filtered, which gives the same keys, and saves a join by row."""
    ratio = fit(docs, labels, target_rows)
    _, bar = _scored(docs, labels, ratio, k, seed, temperature, spare)
    weight, tokens = (next(n for n in (base + "_" * i for i in range(1, 99)) if n not in docs.columns) for base in ("log_weight", "n_tokens"))
    schema = T.StructType([*docs.schema.fields, T.StructField(weight, T.DoubleType()), T.StructField(tokens, T.LongType())])
    kept = docs.mapInArrow(_score(ratio, weight, tokens), schema)
    return kept.where((F.col(tokens) > 0) & (_key(seed, temperature, weight, tokens) >= F.lit(bar))).select(*[F.col(f"`{c}`") for c in docs.columns])
