"""Concatenate and cut: all documents as one token stream, cut into windows of equal length.

Pass one tokenizes every document once and writes its ids with the count of ids before it in its
partition. The totals of the partitions (one row each) give, as prefix sums, every partition's offset
in the stream. Pass two is a map without a shuffle: a document's first place in the stream is the
partition's offset plus its own, and boundary records say which part of which window it fills. Only
the last window is padded.

Order: partitions of the input, and rows within them. Pass two reads what pass one has written, so a
retried task cannot move a boundary.

Defined cases: a null text is an empty one (its end id only); a null doc_id stays null; repeated rows
are packed as often as they occur; other columns are dropped; an empty table gives no piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm import textops as X

SPECIAL = b"<|endoftext|>"
_TOKENS = "part int, doc_id long, before long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def _encoders(path: str):
    """The tokenizer of the file, and the same vocabulary and merges in the faster tiktoken."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t.encode() != SPECIAL}
    fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(path), fast


def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts may be cut without a change of their ids: at text starts, and before a space or
    line feed that follows no white space. The pattern that splits words ahead of the merges never
    runs over such a place, whatever stands around it."""
    n = len(data)
    ok = (data == 0x20) | (data == 0x0A)
    ok[0] = False
    ok[1:] &= ~X.SPACE[data[:-1]] & ((data[:-1] < 0x1C) | (data[:-1] > 0x1F))
    # white space beyond ASCII: U+0085 and U+00A0 (lead byte C2), or of three bytes (E1, E2, E3)
    ok[2:] &= data[:-2] != 0xC2
    lead = data[:-3]
    ok[3:] &= (lead != 0xE1) & (lead != 0xE2) & (lead != 0xE3)
    ok[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(ok)


class Tokens:
    """Ids of whole texts; pieces between cuts are encoded once and remembered by hash."""

    def __init__(self, path: str, end: int):
        self.slow, self.fast = _encoders(path)
        self.end, self.memo, self.checked = end, X.Memo(2, np.int64), 0
        self._reset()

    def _reset(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 1
        self.pool[0] = self.end

    def _encode(self, texts: list[bytes]) -> np.ndarray:
        words = [t.decode() for t in texts]
        ids = [self.fast.encode_ordinary(w) for w in words]
        while self.checked < min(200, len(ids)):  # both libraries must agree on what this task sees first
            if self.slow.encode(words[self.checked], add_special_tokens=False).ids != ids[self.checked]:
                raise ValueError(f"the fast encoder differs from the tokenizer on {words[self.checked]!r}")
            self.checked += 1
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint16, total)
        out = np.stack([self.used + np.cumsum(size) - size, size], 1)
        self.used += total
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the len + 1 offsets between texts."""
        data, at = X.flat(texts)
        raw = data.tobytes()
        if SPECIAL in raw:
            ids = [[*self.slow.encode(t or "", add_special_tokens=False).ids, self.end] for t in texts.to_pylist()]
            return np.array([i for x in ids for i in x], np.uint16), np.cumsum([0, *map(len, ids)])
        if len(data):
            start = _cuts(data, at)
            stop = np.append(start[1:], len(data))
            key, where, back = np.unique(X.span_hashes(data, start, stop, lower=False), return_index=True, return_inverse=True)
            if len(self.memo.keys) + len(key) > self.memo.most:
                self.memo.clear()
                self._reset()
            known, _ = self.memo.find(key)
            new = np.flatnonzero(~known)
            if len(new):
                self.memo.add(key[new], self._encode([raw[a:b] for a, b in zip(start[where[new]].tolist(), stop[where[new]].tolist(), strict=True)]))
            _, i = self.memo.find(key)
            of = self.memo.values[i][back]
        else:
            start, of = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        first = np.searchsorted(start, at)
        of = np.insert(of, first[1:], [0, 1], axis=0)  # the end id stands first in the pool
        size = of[:, 1]
        ids = self.pool[X.ragged(of[:, 0], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[first + np.arange(len(at))]


def _slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    size = data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, before = Tokens(path, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in X.blocks(batch, "text"):
                ids, at = tokens(block.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(block.num_rows, part, np.int32)), block.column("doc_id"), pa.array(before + at[:-1]), pa.array(np.diff(at)), _slices(ids, at)], ["part", "doc_id", "before", "n", "ids"]
                )
                before += int(at[-1])

    return run


def _cut(offsets: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in range(0, whole.num_rows, 512):
                batch = whole.slice(b, 512)
                n = batch.column("n").to_numpy()
                first = offsets[batch.column("part").to_numpy()] + batch.column("before").to_numpy()
                pieces = (first + n - 1) // length - first // length + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                window = X.ragged(first // length, pieces)
                start = np.maximum(window * length, first[doc])
                stop = np.minimum((window + 1) * length, (first + n)[doc])
                ids = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("ids")]).astype("<u4")
                arrays = [batch.column("doc_id").take(pa.array(doc)), start - first[doc], stop - start, _slices(ids, np.concatenate([[0], np.cumsum(stop - start)])), n[doc], window, start - window * length]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], [c.split()[0] for c in _PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids as little-endian unsigned 32-bit, doc_tokens, sequence_id,
    offset) of all ``docs`` (doc_id, text). ``tokenizer``: a byte-level BPE file of the library
    tokenizers, at the same path on every executor. Sequences without the last have ``length`` ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.table(rows.mapInArrow(_tokenize(tokenizer, end), _TOKENS), "tokens")
    totals = {r[0]: r[1] for r in tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n"))).collect()}  # a row a partition
    sizes = np.array([totals.get(i, 0) for i in range(max(totals, default=-1) + 1)], np.int64)
    return tokens.mapInArrow(_cut(np.cumsum(sizes) - sizes, length), _PIECES)
