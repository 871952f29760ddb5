"""Benchmark decontamination: short test items inside long documents, by containment of word shingles.

Items are parted by size (number of distinct shingles, powers of two). Each part has its own MinHash
sketch size: the k smallest hashes of an item, with k = floor((1 - threshold) * largest size) + 1. A text
that holds at least ``threshold`` of an item's shingles lacks fewer than k of them, so it holds one of
the k: the search loses nothing, however long the text is. Every candidate is verified by the exact
count of the item's shingles in the text.

The items are the query set. They are taken in blocks of ``block_bytes`` of text, so what is sent to
the executors is bounded; documents are read once a block, by a map without a shuffle.

Defined cases: items of fewer than five words are one shingle of all their words and are found in any
text that has this run of words; null or empty items and texts match nothing; repeated items or rows
are each reported; null ids stay null; other columns are dropped (``find_items``) or kept as they are
(``drop_contaminated``); empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import textops as X

_HITS = "doc_id long, item_id long, item_shingles long, shared long, containment double"


class Items:
    """The index of one block of items."""

    def __init__(self, texts: list[str | None], threshold: float, n: int):
        self.n, self.threshold = n, threshold
        data, at = X.flat(pa.array(texts, pa.string()))
        start, _, first = X.words(data, at)
        self.sets = X.shingle_sets(pa.array(texts, pa.string()), n)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.least = np.array([int(np.ceil(round(threshold * s, 9))) for s in self.sizes], np.int64)
        self.short = sorted({int(w) for w in np.diff(first) if 0 < w < n})  # lengths of items below n words
        key, item = [], []
        for i, s in enumerate(self.sets):
            largest = (1 << int(len(s)).bit_length()) - 1
            k = min(len(s), int((1 - threshold) * largest + 1e-9) + 1)
            key.append(s[:k])  # the sets are sorted: these are the k smallest
            item.append(np.full(k, i))
        key, item = np.concatenate([np.zeros(0, X.U), *key]), np.concatenate([np.zeros(0, np.int64), *item])
        order = np.argsort(key, kind="stable")
        self.keys, self.items = key[order], item[order]
        self.some = np.zeros(1 << 22, bool)  # a first look before the search in keys
        self.some[(self.keys >> X.U(42)).astype(np.int64)] = True

    def find(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each text with items: its row, the items, and how many of their shingles it holds."""
        if not len(self.keys):
            return
        data, at = X.flat(texts)
        start, end, first = X.words(data, at)
        word = X.span_hashes(data, start, end)
        runs = [(w, X.grams(word, w)) for w in (*self.short, self.n)]
        near = {w: np.flatnonzero(self.some[(g >> X.U(42)).astype(np.int64)]) for w, g in runs}
        hot = {w: p[self._in(g[p])] for (w, g), p in zip(runs, near.values(), strict=True)}
        for row in np.unique(np.concatenate([np.searchsorted(first, p, side="right") - 1 for p in hot.values()])):
            a, b = first[row], first[row + 1]
            found, have = [], []
            for w, g in runs:
                p = hot[w]
                p = p[(p >= a) & (p <= b - w)]
                if len(p):
                    found.append(self._items(np.unique(g[p])))
                if b - a >= w:
                    have.append(g[a : b - w + 1])
            if not found:
                continue
            item, have = np.unique(np.concatenate(found)), np.unique(np.concatenate(have))
            shared = np.array([np.count_nonzero(have[np.minimum(np.searchsorted(have, self.sets[i]), len(have) - 1)] == self.sets[i]) for i in item])
            good = shared >= self.least[item]
            if good.any():
                yield int(row), item[good], shared[good]

    def _in(self, hashes: np.ndarray) -> np.ndarray:
        return self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] == hashes

    def _items(self, hashes: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, side="right")
        return self.items[X.ragged(a, b - a)]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    rows, held = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        rows.append((r.i, r.t or ""))
        held += len(rows[-1][1])
        if held >= block_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _hits(index: Items, ids: list[int | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch, "text"):
                out = [(block.column("doc_id")[row].as_py(), ids[i], int(index.sizes[i]), int(n), int(n) / int(index.sizes[i])) for row, item, shared in index.find(block.column("text")) for i, n in zip(item, shared, strict=True)]
                if out:
                    types = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _HITS.split(", ")])

    return run


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Pairs (doc_id, item_id, item_shingles, shared, containment) of ``docs`` (doc_id, text) and
    ``items`` (item_id, text) with at least ``threshold`` of the item's shingles in the document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = [rows.mapInArrow(_hits(Items([t for _, t in block], threshold, n), [i for i, _ in block]), _HITS) for block in _blocks(items, block_bytes)]
    if not out:
        return docs.sparkSession.createDataFrame([], _HITS)
    while len(out) > 1:
        out = [a.unionByName(b[0]) if b else a for a, *b in (out[i : i + 2] for i in range(0, len(out), 2))]
    return out[0]


def _clean(index: Items) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch, "text"):
                bad = [row for row, _, _ in index.find(block.column("text"))]
                if bad:
                    keep = np.ones(block.num_rows, bool)
                    keep[bad] = False
                    block = block.filter(pa.array(keep))
                yield block

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item."""
    for block in _blocks(items, block_bytes):
        docs = docs.mapInArrow(_clean(Items([t for _, t in block], threshold, n)), docs.schema)
    return docs
