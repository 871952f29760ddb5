import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import setjoin as S
from factloom.llm.queries import op4_ngram_jaccard_join


def shingles(t, n=5, lower=True):
    w = (t or "").lower().split() if lower else (t or "").split(" ") if t else []
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, percent=80, lower=True):
    sets = [shingles(t, lower=lower) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for (d, _), x in zip(docs, label, strict=True):
        least[x] = min(d, least.get(x, d))
    return sorted((d, len(s), least[x]) for (d, _), s, x in zip(docs, sets, label, strict=True))


def copies(seed, n=160):
    rng, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(12))
    base = [[rng.choice(words) for _ in range(rng.choice([3, 4, 7, 9, 15, 40, 90]))] for _ in range(12)]
    for d in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice(words)], [w[i], rng.choice(words)]])
            w = w or ["x"]
        docs.append((d, " ".join(w) + (" " + line if rng.random() < 0.3 else "")))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, small", [(1, 32), (2, 1), (3, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, small):
    monkeypatch.setattr(S, "SMALL", small)  # with few sets in small buckets, the large ones' path does the work
    monkeypatch.setattr(S, "_ROWS_IN_BLOCK", 5 if small == 1 else 4096)
    monkeypatch.setattr(S, "HOT_ROWS", 3 if small == 1 else 1 << 16)  # busy subsets are dealt to several tasks
    monkeypatch.setattr(S, "FILTER_BITS", 8 if small == 3 else 1 << 24)  # a join in place of the filter
    docs = copies(seed)
    got = S.components_of(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)


def test_every_similar_pair_shares_a_published_subset():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(600):
        n = int(rng.integers(4, 90))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        keep = a[rng.random(len(a)) > 0.1]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            every = np.concatenate(S.signatures(a, 80, np.zeros(0, np.uint64)) or [np.zeros(0, np.uint64)])
            for hot in (np.zeros(0, np.uint64), np.sort(every[rng.random(len(every)) < 0.5])):
                x, y = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (S.signatures(a, 80, hot), S.signatures(b, 80, hot)))
                assert len(np.intersect1d(x, y)) or np.array_equal(a, b)


def test_odd_rows(spark, odd, empty):
    rows = S.components_of(odd).collect()
    assert len(rows) == odd.count() and S.components_of(empty).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == got[2][:0] + (0, 1) and got[3] == (0, 3) and got[5] == (6, 5) and got[6] == (6, 5) and got[8] == (1, 8) and got[None][1] is None
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 5, 7, 8, 9]


def test_components_of_a_chain(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = S.components(links.union(spark.createDataFrame([(100, 99)], "a long, b long"))).collect()
    assert {r.label for r in rows if r.node <= 40} == {0} and {(r.node, r.label) for r in rows if r.node > 40} == {(99, 99), (100, 99)} and len(rows) == 43


def test_query_against_all_pairs_of_a_real_table(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = op4_ngram_jaccard_join(spark, small).collect()
    words = [(d, " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for d, t in docs]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(words, lower=False)
