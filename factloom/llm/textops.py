"""Whole Arrow batches of texts as flat byte arrays: words, word hashes and shingles in numpy.

All functions see whole texts. Nulls count as empty texts. Words are ``[^\\x20\\x09-\\x0D]+`` with
A-Z lower-cased, as the contracts of the operators say. Hashes have 64 bits and no per-process seed,
so every executor and every retry gets the same values; at V distinct values about V*V/2**65 pairs
of them share a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = U(0x9E3779B97F4A7C15)
BLOCK = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _ODD)
_LOW_BYTE = _BYTE[LOWER]
_POWERS = np.multiply.accumulate(np.full(4096, U(0x5851F42D4C957F2D), U))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(2 * n, U(0x5851F42D4C957F2D), U))
    return _POWERS


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the len + 1 offsets between them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (one row at least), which bound the arrays made from them."""
    if batch.num_rows == 0:
        return
    _, at = flat(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back to the system


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (len + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, at)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of the bytes of each span; the spans are in order and do not overlap."""
    if not len(start):
        return np.zeros(0, U)
    base, size = start - start[0], end - start
    n = int(end[-1] - start[0])
    value = np.zeros(n + 1, U)
    np.take(_LOW_BYTE if lower else _BYTE, data[start[0] : end[-1]], out=value[:-1])
    step = np.diff(base, append=n)
    place = np.arange(n, dtype=np.int32)
    place -= np.repeat(base.astype(np.int32), step)
    value[:-1] *= np.take(powers(int(step.max())), place)
    edges = np.empty(2 * len(base), np.int64)
    edges[::2], edges[1::2] = base, base + size
    return mix(np.add.reduceat(value, edges)[::2] + size.astype(U) * _ODD)


_GRAM = mix(np.arange(101, 165, dtype=U) * _ODD) | U(1)

_SIZE = np.arange(65, dtype=U) * _ODD


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive values (len - n + 1 of them)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    out = np.full(size, _SIZE[n], U)
    for i in range(n):
        out += hashes[i : i + size] * _GRAM[i]
    return mix(out)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words the whole
    sequence is the only shingle; without words there is none."""
    data, at = flat(texts)
    start, end, first = words(data, at)
    word = span_hashes(data, start, end)
    whole = grams(word, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            if len(s) > 1:
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            out.append(s)
        else:
            out.append(grams(word[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of the runs start[i] .. start[i] + size[i] - 1, one after another."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    some = size > 0
    start, size = start[some], size[some]
    if not total:
        return out
    out[0] = start[0]
    edge = np.cumsum(size)[:-1]
    out[edge] = start[1:] - (start[:-1] + size[:-1]) + 1
    return np.cumsum(out)


class Memo:
    """Values by 64-bit key, in sorted arrays; emptied when ``most`` keys are passed. A cache only."""

    def __init__(self, width: int, dtype, most: int = 1 << 20):
        self.most, self.width, self.dtype = most, width, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U)
        self.values = np.zeros((0, self.width), self.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it is there, and where."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)), at

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, in ascending order."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values, axis=0)
