import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import quality as Q
from factloom.llm.queries import op10_quality


def test_buckets_count_words_signs_and_pairs():
    bucket, row, n = Q.ngram_buckets(pa.array(["A b a!! 12", None, "é"]))
    want = [len(re.findall(r"[A-Za-z0-9é]+|[^\sA-Za-z0-9é]+", t)) for t in ("A b a!! 12", "", "é")]
    assert n.tolist() == want and Counter(row.tolist()) == {0: 9, 2: 1}
    one, _, _ = Q.ngram_buckets(pa.array(["a"]))
    assert (bucket[:5] == one[0]).sum() == 2


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_weights_are_those_of_the_two_models(tables):
    docs, labels = tables
    rows = Q.resample(docs, labels).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    target = {r.doc_id for r in labels.where(f"quality = 1 AND NOT ({Q.HELD_OUT})").collect()}
    counts, own = np.zeros((2, Q.BUCKETS)), {}
    for i, t in text.items():
        own[i] = np.bincount(Q.ngram_buckets(pa.array([t]))[0], minlength=Q.BUCKETS)
        counts[0] += own[i]
        counts[1] += own[i] * (i in target)
    p = (counts + 1) / (counts.sum(1, keepdims=True) + Q.BUCKETS)
    ratio = np.log(p[1] / p[0])
    assert len(rows) == len(text) and all(abs(own[r.doc_id] @ ratio - r.log_weight) < 1e-6 * (1 + abs(r.log_weight)) for r in rows)


def test_good_documents_stay_and_bad_ones_go(tables):
    docs, labels = tables
    rows = Q.resample(docs, labels).join(labels, "doc_id").where(Q.HELD_OUT).collect()
    good, bad = [r.selected for r in rows if r.quality == 1], [r.selected for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15


def test_exactly_k_are_sampled_and_retries_agree(tables):
    docs, labels = tables
    a = Q.resample(docs, labels, k=123).where("selected").select("doc_id").collect()
    b = Q.resample(docs.repartition(7), labels, k=123).where("selected").select("doc_id").collect()
    assert len(a) == 123 and sorted(a) == sorted(b)
    assert sorted(r.doc_id for r in Q.keep_good(docs, labels, k=123).collect()) == sorted(r.doc_id for r in a)


def test_kth_largest(spark):
    values = [1.5, 1.5, -3.0, 7.25, 0.0, 1.5, 1e9, -1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert Q.kth_largest(df, "x", k, bins=3, small=1) == sorted(values, reverse=True)[k - 1]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (7, 0, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    rows = Q.resample(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r.selected for r in rows if r.doc_id in (1, 2, 3))
    kept = Q.keep_good(odd, labels, k=1.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert Q.resample(empty, labels).count() == 0 and Q.keep_good(odd, labels.limit(0)).count() == odd.count() - 3


def test_small_tables_lose_few_good_and_most_bad_documents(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = Q.resample(docs, labels).join(labels, "doc_id").withColumn("held_out", F.expr(Q.HELD_OUT)).collect()
    good, bad = [r.selected for r in rows if r.quality == 1 and r.held_out], [r.selected for r in rows if r.quality == 0]
    assert len(good) - sum(good) <= 2 and sum(bad) < 0.35 * len(bad)


@pytest.mark.parametrize("temperature", [1.0, 4.0])
def test_inclusion_follows_the_weights_over_many_seeds(spark, temperature):
    weights = [0.0, -1.0, 1.5, 2.0, 0.5, -3.0]
    rows = spark.createDataFrame([(i, w, 5 + i) for i, w in enumerate(weights)], "doc_id long, log_weight double, n_tokens long")
    seeds = spark.range(6000).select(F.col("id").cast("int").alias("seed"))
    keyed = rows.crossJoin(seeds).withColumn("key", Q._key(F.col("seed"), temperature))
    first = {r.doc_id: r.n for r in keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    p = np.exp(np.array(weights) / temperature) / np.exp(np.array(weights) / temperature).sum()
    for i, share in enumerate(p):
        assert abs(first.get(i, 0) - 6000 * share) < 5 * math.sqrt(6000 * share * (1 - share)) + 1


def spark_hash(*values):
    h = 42
    for v, size in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), seed=h)
    return h


def test_query_against_plain_code(spark, small):
    rows = op10_quality(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    own = {r.doc_id: np.bincount(Q.ngram_buckets(pa.array([r.text]))[0], minlength=Q.BUCKETS) for r in docs}
    target = {i for i, q in quality.items() if q == 1 and zlib.crc32(str(i).encode()) % 4}
    counts = np.array([sum(own.values()), sum(v for i, v in own.items() if i in target)])
    p = (counts + 1) / (counts.sum(1, keepdims=True) + Q.BUCKETS)
    ratio = np.log(p[1] / p[0])
    keys = {}
    for r in docs:
        n = len(re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^\sA-Za-z0-9\u0080-\U0010ffff]+", r.text))
        u = ((spark_hash((r.doc_id, 8), (n, 8), (7, 4)) >> 11) + 0.5) / 2**53
        if n:
            keys[r.doc_id] = own[r.doc_id] @ ratio - math.log(-math.log(u))
    good, bad = (sum(i in keys for i, q in quality.items() if q == k) for k in (1, 0))
    k = round((good / (good + bad)) * len(keys))
    assert {r.doc_id for r in rows if r.selected} == set(sorted(keys, key=keys.get, reverse=True)[:k]) and len(rows) == len(docs)


def test_ties_at_the_bar_stay_together(spark):
    docs = spark.createDataFrame([(1, "same text here")] * 3 + [(2, "other words")], "doc_id long, text string")
    kept = Q.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), k=1)
    assert kept.count() in (1, 3)
