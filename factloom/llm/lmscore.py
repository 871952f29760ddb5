"""Language-model scoring: marginal likelihood of texts over a subword lattice.

A text is a sequence of words and an end; a word is a sequence of pieces of an existing vocabulary. All
segmentations of a word count: a forward recursion in log space sums over the lattice of its pieces, and
a text's log probability is the sum over its words and the end. A piece that opens a word closes the one
before it, so the probabilities of all words and of the end sum to one (some words' pieces could never
follow each other in the vocabulary's own tokenizer; no mass is lost by that).

Weights of the pieces. No file at hand has unigram scores: those of ``piece_bpe_32k.model`` are ranks of
merges. They order the pieces, and Zipf's law makes of the order log p = -log(rank + 2.7), bytes (the fallback)
coming last. With these, the vocabulary's own, ``vocabulary_score`` is the marginal. ``score`` is the marginal with
weights that were fitted to the training texts: rounds of expectation maximization, each a pass over all distinct
training words, weighted by how often they occur, with ``prior`` pseudo-counts of the vocabulary's own weights.

Word counts are gathered from all training texts by a shuffle and grow with them. Scoring sends only
the ``hot`` most frequent words (a fixed number) to the executors; all other words of a document meet their counts in
a join by hash. Words are keyed by two 64-bit hashes, 128 bits.

Defined cases: a null text is empty and has the end only; a null doc_id is not held out; repeated rows
are scored each; without training rows N = V = 0, the base score is 0 and the pieces keep the vocabulary's weights; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm import textops as X

MARK = 0x20  # stands before every word; words hold no white space
_BLOCK = 4 << 20


@dataclass
class Pieces:
    """Pieces as bytes, the word mark as a space; the last entry of log_p is the end of a text."""

    names: list[bytes]
    log_p: np.ndarray

    def __post_init__(self) -> None:
        by_size: dict[int, dict[int, int]] = {}
        for i, p in enumerate(self.names):
            by_size.setdefault(len(p), {})
            for k in range(1, len(p)):
                by_size.setdefault(k, {}).setdefault(self._hash(p[:k]), -1)
            by_size[len(p)][self._hash(p)] = i
        self.tables = {n: _Table(x) for n, x in by_size.items()}
        self.starts = np.array([p[0] == MARK for p in self.names], bool)

    @staticmethod
    def _hash(p: bytes) -> int:
        h = X.U(0)
        for i, b in enumerate(p):
            h = (int(h) + int(X._BYTE[b]) * int(X.powers(len(p))[i])) & 0xFFFFFFFFFFFFFFFF
        return int(h)

    def end(self, log_p: np.ndarray) -> float:
        """log P(end) among words and end."""
        return float(log_p[-1] - np.logaddexp.reduce(log_p[np.append(self.starts, True)]))

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end and piece of the lattices' edges, ordered by their end's offset in its word; the
        nodes' offsets in their words; each word's first node. A word of n bytes has n + 2 nodes."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b"".join(b" " + w + b"\0" for w in words), np.uint8)  # a node a byte, and one at the end
        first = np.cumsum(size + 1) - (size + 1)
        left = np.repeat(first + size, size + 1) - np.arange(len(data))  # bytes from a node to the end of its word
        base = X._BYTE[data]
        at = np.flatnonzero(left > 0)
        h, out, n = np.zeros(len(at), X.U), [], 0
        while len(at):
            n += 1
            if n not in self.tables:
                break
            h = h + base[at + n - 1] * X.powers(n)[n - 1]
            piece = self.tables[n].find(h)
            ok = piece >= 0
            out.append((at[ok], np.full(int(ok.sum()), n), piece[ok]))
            on = (piece > -2) & (left[at] > n)
            at, h = at[on], h[on]
        start, length, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        offset = np.arange(len(data)) - np.repeat(first, size + 1)
        order = np.argsort(offset[start + length] * (len(data) + 1) + start + length, kind="stable")
        return start[order], (start + length)[order], piece[order], offset, first

    def forward(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, offset: np.ndarray, first: np.ndarray, log_p: np.ndarray | None = None) -> np.ndarray:
        alpha = np.full(len(offset), -np.inf)
        alpha[first] = 0
        return _sweep(alpha, start, end, (self.log_p if log_p is None else log_p)[piece], offset)

    def log_words(self, words: list[bytes], *others: np.ndarray) -> np.ndarray:
        """log P of each word, over all its segmentations; with ``others``, a column for each of these weights as well."""
        if not words:
            return np.zeros((0, 1 + len(others)) if others else 0)
        start, end, piece, offset, first = self.edges(words)
        last = np.append(first[1:], len(offset)) - 1
        found = [self.forward(start, end, piece, offset, first, log_p)[last] for log_p in (self.log_p, *others)]
        return np.stack(found, 1) if others else found[0]

    def expected(self, words: list[bytes], times: np.ndarray | None = None) -> np.ndarray:
        """The expected number of uses of each piece in ``times`` (1) occurrences of each word."""
        start, end, piece, offset, first = self.edges(words)
        alpha = self.forward(start, end, piece, offset, first)
        last = np.append(first[1:], len(offset)) - 1
        size = np.diff(np.append(first, len(offset))) - 1
        back = np.repeat(size, size + 1) - offset  # the same lattices, from their ends
        order = np.argsort(back[start] * (len(offset) + 1) + start, kind="stable")
        beta = np.full(len(offset), -np.inf)
        beta[last] = 0
        beta = _sweep(beta, end[order], start[order], self.log_p[piece[order]], back)
        total = np.repeat(alpha[last], size + 1)
        use = np.exp(alpha[start] + self.log_p[piece] + beta[end] - total[start])
        if times is not None:
            use *= np.repeat(times, size + 1)[start]
        return np.bincount(piece, use, len(self.names))


def _sweep(value: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sums in log space along edges ordered by their target's offset: all words advance together."""
    step = np.flatnonzero(np.diff(offset[target], prepend=-1))
    for a, b in zip(step.tolist(), [*step[1:].tolist(), len(target)], strict=True):
        to = target[a:b]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        value[to[cut]] = np.logaddexp.reduceat(value[source[a:b]] + weight[a:b], cut)
    return value


class _Table:
    """Values by hash: found by the key's top bits, then compared; -2 where there is none."""

    def __init__(self, values: dict[int, int]):
        self.bits = max(4, (len(values) * 8).bit_length())
        self.keys = np.zeros(1 << self.bits, X.U)
        self.value = np.full(1 << self.bits, -2, np.int64)
        rest = {}
        for k, v in values.items():
            i = k >> (64 - self.bits)
            if self.value[i] == -2:
                self.keys[i], self.value[i] = k, v
            else:
                rest[k] = v
        self.rest_keys = np.array(sorted(rest), X.U)
        self.rest = np.array([rest[int(k)] for k in self.rest_keys], np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        i = (keys >> X.U(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[i] == keys, self.value[i], -2)
        if len(self.rest):
            odd = np.flatnonzero((out == -2) & (self.value[i] != -2))
            j = np.minimum(np.searchsorted(self.rest_keys, keys[odd]), len(self.rest) - 1)
            out[odd] = np.where(self.rest_keys[j] == keys[odd], self.rest[j], -2)
        return out


def load_pieces(path: str) -> Pieces:
    """Of a sentencepiece model file: its normal pieces with at most a leading word mark, and bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            name = model.id_to_piece(i)
            if name and "▁" not in name[1:]:
                found[name.replace("▁", " ").encode()] = model.get_score(i)
    names = sorted(found, key=lambda p: (-found[p], p))
    names += [bytes([b]) for b in range(256) if bytes([b]) not in found]
    prior = np.log(1 / (np.arange(len(names) + 1) + 2.7))
    prior[-1] = prior[: len(names)].max()  # the end, as the most frequent piece
    return Pieces(names, prior - np.logaddexp.reduce(prior))


def _words(block: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, start and end of all words, the first word of each text, and two hashes of each word."""
    data, at = X.flat(block.column("text"))
    start, end, first = X.words(data, at)
    data = X.LOWER[data]
    return data, start, end, first, X.span_hashes(data, start, end), X.span_hashes(data ^ np.uint8(0xA5), start, end, lower=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in X.blocks(batch, "text", _BLOCK):
            data, start, end, _, key, second = _words(block)
            if len(key):
                key, where, n = np.unique(key, return_index=True, return_counts=True)
                words = [data[a:b].tobytes() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(second[where].view(np.int64)), pa.array(words, pa.binary()), pa.array(n)], ["hash", "second", "word", "n"])


def _expect(pieces: Pieces) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pieces.names))
        for batch in batches:
            for i in range(0, batch.num_rows, 20_000):
                total += pieces.expected([w.as_py() for w in batch.column("word").slice(i, 20_000)], batch.column("n").slice(i, 20_000).to_numpy().astype(float))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": some, "n": total[some]})

    return run


@dataclass
class Model:
    pieces: Pieces
    vocabulary: np.ndarray  # the log_p of the pieces before training
    counts: DataFrame | None  # hash, second, word, n of every distinct training word
    tokens: int  # N, with ends
    kinds: int  # V, with the end
    ends: int
    hot: np.ndarray  # hash, second and n of the most frequent words, in the order of the hash

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.kinds + 1))


def fit(training: DataFrame, vocabulary: str, rounds: int = 2, prior: float = 10_000.0, hot: int = 1 << 17) -> Model:
    """Learns from all texts of ``training`` (text)."""
    texts = training.select(F.col("text").cast("string").alias("text"))
    counts = texts.where("text IS NOT NULL").mapInArrow(_count, "hash long, second long, word binary, n long").groupBy("hash", "second", "word").agg(F.sum("n").alias("n"))
    counts = scratch.table(counts, "words")
    ends = texts.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    pieces = load_pieces(vocabulary)
    own = pieces.log_p
    for _ in range(rounds if kinds else 0):
        use = prior * np.exp(own)
        for r in counts.select("word", "n").mapInArrow(_expect(pieces), "piece long, n double").groupBy("piece").agg(F.sum("n")).collect():  # a row a piece
            use[r[0]] += r[1]
        use[-1] += ends
        pieces = Pieces(pieces.names, np.log(use / use.sum()))
    top = np.array(sorted((r.hash, r.second, r.n) for r in scratch.most_frequent(counts, "n", hot).select("hash", "second", "n").collect()), np.int64).reshape(-1, 3)
    return Model(pieces, own, counts, words + ends, kinds + (ends > 0), ends, top[np.argsort(np.ascontiguousarray(top[:, 0]).view(X.U))])


_ROWS = "uid long, doc_id long, held boolean, hash long, second long, n long, known long, base double, score double, own double"


def _score(model: Model) -> Callable:
    """A row with the sums of each text, and one for each of its words whose count is not at hand."""
    pieces, own, ends = model.pieces, model.vocabulary, model.ends
    sizes = Model(pieces, own, None, model.tokens, model.kinds, ends, model.hot)
    hot_key, hot_second = (np.ascontiguousarray(model.hot[:, i]).view(X.U) for i in (0, 1))
    hot_count = model.hot[:, 2]
    end_base = float(sizes.base(np.array([float(ends)]))[0]) if model.tokens else 0.0
    end = np.array([pieces.end(pieces.log_p), pieces.end(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = X.Memo(2, np.float64)
        for batch in batches:
            for block in X.blocks(batch, "text", _BLOCK):
                data, start, stop, first, key, second = _words(block)
                rows = block.num_rows
                key, where, back = np.unique(key, return_index=True, return_inverse=True)
                second = second[where]
                if len(memo.keys) + len(key) > memo.most:
                    memo.clear()
                new = np.flatnonzero(~memo.find(key)[0])
                for i in range(0, len(new), 20_000):
                    some = new[i : i + 20_000]
                    memo.add(key[some], pieces.log_words([data[a:b].tobytes() for a, b in zip(start[where[some]].tolist(), stop[where[some]].tolist(), strict=True)], own))
                log_p = memo.values[memo.find(key)[1]] if len(key) else np.zeros((0, 2))
                row = np.repeat(np.arange(rows), np.diff(first))
                score, by_own = ((np.bincount(row, log_p[back, i], rows) + end[i]) / math.log(10) for i in (0, 1))
                count, hot = np.zeros(len(key)), np.zeros(len(key), bool)
                if len(hot_key):
                    i = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                    hot = (hot_key[i] == key) & (hot_second[i] == second)
                    count = np.where(hot, hot_count[i], 0)
                is_hot = hot[back]
                known = np.bincount(row[is_hot], minlength=rows) + (ends > 0)
                base = (np.bincount(row[is_hot], sizes.base(count)[back[is_hot]], rows) if sizes.tokens else np.zeros(rows)) + end_base
                cold, n = np.unique(row[~is_hot] * len(key) + back[~is_hot], return_counts=True)
                at, word = (cold // len(key), cold % len(key)) if len(key) else (cold, cold)
                k, uid = len(cold), block.column("uid").to_numpy()
                pad = lambda x: np.concatenate([x, np.zeros(k, x.dtype)])
                head = np.arange(rows + k) < rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([uid, uid[at]])),
                        pa.concat_arrays([block.column("doc_id"), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([block.column("held"), pa.nulls(k, pa.bool_())]),
                        pa.array(np.concatenate([X.mix(uid.astype(X.U)).view(np.int64), key[word].view(np.int64)])),  # rows of texts are dealt evenly
                        pa.array(np.concatenate([np.zeros(rows, np.int64), second[word].view(np.int64)]), mask=head),  # and match no word
                        pa.array(np.concatenate([np.diff(first) + 1, n])),
                        pa.array(pad(known)),
                        pa.array(pad(base)),
                        pa.array(pad(score)),
                        pa.array(pad(by_own)),
                    ],
                    [c.split()[0] for c in _ROWS.split(", ")],
                )

    return run


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and vocabulary_score of every
    row of ``docs`` (doc_id, text). What a row needs travels with its number, so no step numbers rows again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"), F.monotonically_increasing_id().alias("uid"))
    parts = rows.mapInArrow(_score(model), _ROWS)
    met = parts.join(model.counts.select("hash", "second", F.col("n").alias("c")), ["hash", "second"], "left")
    word, count = F.col("held").isNull(), F.coalesce(F.col("c"), F.lit(0))
    base = F.log10((count + 1) / F.lit(float(model.tokens + model.kinds + 1))) if model.tokens else F.lit(0.0)
    sums = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held").alias("held_out"),
        F.sum(F.when(word, 0).otherwise(F.col("n"))).alias("n_tokens"),
        F.sum(F.when(~word, F.col("known")).when(count > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.when(word, F.col("n") * base).otherwise(F.col("base"))).alias("base_score"),
        F.max(F.when(~word, F.col("score"))).alias("score"),
        F.max(F.when(~word, F.col("own"))).alias("vocabulary_score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "vocabulary_score")
