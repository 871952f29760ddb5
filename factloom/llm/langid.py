"""Language ID of words in code-switched text: a linear-chain conditional random field.

A word's features are its bytes' n-grams of 1 to 4 with end marks (those with a mark are its affixes),
itself, and the learned lexicons that hold it; between neighbours stand learned transitions. Training maximizes the
likelihood of sequences joined from word windows of documents of different languages, so switches
occur in them; labels are the documents' languages. It runs on the driver on a bounded sample:
``per_lang`` documents of each language (about; picked by hash), ``windows``
windows of ``window`` words spread over each. Prediction is exact forward-backward over whole texts:
long ones are cut into chunks whose transfer matrices carry the messages across, so all chunks of a
block advance together. The model has a fixed size and travels with the function; no shuffle.

A text's language is the one with the largest sum of word posteriors, its score their mean. The set of
languages is closed, so a second number tells whether a text is in any of them: its ``familiarity`` is the
share of its words' n-grams of 3 and 4 bytes that the training windows have, where ``DOUBT`` known n-grams
are added, so a text of few words needs strong evidence to be called foreign. The bar for it is learned too:
midway between what nearly all training windows reach by the other windows alone, and what the same
windows get with the letters of each word shuffled (``Model.bar``).

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first
language in sorted order; without training rows every text is ``und``; repeated rows are predicted
alike; null doc_ids stay null; other columns are dropped (``predict``) or kept (``keep_known``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textops as X

SIZE = 1 << 15
UND = "und"
SEEN = 1 << 20
DOUBT = 16.0
_CHUNK = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (ASCII letters and all bytes beyond ASCII), and the first of each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTER[data]
    edge = inside[1:] != inside[:-1]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a run goes on over the end of a text
    start = np.flatnonzero(edge & inside[1:])
    end = np.flatnonzero(edge & inside[:-1])
    if len(both):
        start, end = np.union1d(start, both), np.union1d(end, both)
    return start, end, np.searchsorted(start, at)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages: hashed n-grams and words, lexicons, bias
    moves: np.ndarray  # log weight of the next word's language after this one's
    lexicon: np.ndarray  # sorted hashes of words
    member: np.ndarray  # for each of them the languages whose lexicon holds it
    seen: np.ndarray  # hashed n-grams of 3 and 4 bytes of the training windows
    bar: float = 0.0  # the familiarity that texts in a learned language reach

    def features(self, words: list[bytes], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of word and feature, and pairs of word and n-gram of 3 or 4 bytes."""
        buffer = np.frombuffer(b"".join(b"^" + w.lower() + b"$" for w in words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(buffer))  # bytes up to the word's end
        base = X._BYTE[buffer]
        who, what = [np.arange(len(words))], [(hashes >> X.U(40)).astype(np.int64) % SIZE]
        long_who, long_what = [], []
        for n in (1, 2, 3, 4):
            g = X.grams(base, n)
            ok = left[: len(g)] >= n
            who.append(word[: len(g)][ok])
            what.append((g[ok] >> X.U(33)).astype(np.int64) % SIZE)
            if n > 2:
                long_who.append(who[-1])
                long_what.append((g[ok] >> X.U(44)).astype(np.int64) % SEEN)
        if len(self.lexicon):
            i = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            w, lang = np.nonzero(self.member[i] & (self.lexicon[i] == hashes)[:, None])
            who.append(w)
            what.append(SIZE + lang)
        who.append(np.arange(len(words)))
        what.append(np.full(len(words), SIZE + len(self.langs)))
        return np.concatenate(who), np.concatenate(what), np.concatenate(long_who), np.concatenate(long_what)

    def scores(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """A row per word: the score of each language, its n-grams that were seen, and all of them."""
        who, what, long_who, long_what = self.features(words, hashes)
        return np.stack([*[np.bincount(who, self.weights[what, i], len(words)) for i in range(len(self.langs))], np.bincount(long_who, self.seen[long_what], len(words)), np.bincount(long_who, minlength=len(words))], 1)


def posteriors(score: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(language of word | text) of all words, texts being the runs between ``first``. Before the
    first word stands one of any language."""
    n, langs = score.shape
    a = np.exp(moves - moves.max())
    e = np.exp(score - score.max(1, keepdims=True)) + 1e-30
    size = np.diff(first)
    parts = -(-size // _CHUNK)
    doc = np.repeat(np.arange(len(size)), parts)
    nth = X.ragged(np.zeros(len(size), np.int64), parts)
    begin = first[doc] + nth * _CHUNK
    length = np.minimum(_CHUNK, first[doc + 1] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, doc, nth = begin[order], length[order], doc[order], nth[order]
    active = np.searchsorted(-length, -np.arange(1, _CHUNK + 1), side="right")  # chunks of at least t words
    enter = np.full((len(begin), langs), 1.0 / langs)
    leave = np.ones((len(begin), langs))
    if len(parts) and parts.max() > 1:
        long = np.flatnonzero(parts[doc] > 1)
        move = np.broadcast_to(np.eye(langs), (len(long), langs, langs)).copy()
        for t in range(int(length[long].max())):
            k = int(np.searchsorted(-length[long], -(t + 1), side="right"))
            x = move[:k] @ a * e[begin[long[:k]] + t][:, None, :]
            move[:k] = x / x.max((1, 2), keepdims=True)
        place = np.full((len(parts), int(parts.max())), -1)
        place[doc[long], nth[long]] = np.arange(len(long))
        for t in range(1, place.shape[1]):
            now = np.flatnonzero(parts > t)
            x = np.einsum("ij,ijk->ik", enter[long[place[now, t - 1]]], move[place[now, t - 1]])
            enter[long[place[now, t]]] = x / x.sum(1, keepdims=True)
        for t in range(place.shape[1] - 2, -1, -1):
            now = np.flatnonzero(parts > t + 1)
            x = np.einsum("ijk,ik->ij", move[place[now, t + 1]], leave[long[place[now, t + 1]]])
            leave[long[place[now, t]]] = x / x.sum(1, keepdims=True)
    alpha = np.empty((n, langs))
    state = enter
    for k, t in zip(active, range(_CHUNK), strict=True):
        if not k:
            break
        x = state[:k] @ a * e[begin[:k] + t]
        state = x / x.sum(1, keepdims=True)
        alpha[begin[:k] + t] = state
    out = np.empty((n, langs))
    state = leave
    for t in range(_CHUNK - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        at = begin[:k] + t
        x = alpha[at] * state[:k]
        out[at] = x / x.sum(1, keepdims=True)
        x = (e[at] * state[:k]) @ a.T
        state[:k] = x / x.sum(1, keepdims=True)
    return out


def _likelihood_gradient(score: np.ndarray, moves: np.ndarray, label: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients, by score and by move, of the log likelihood of sequences that all have one length."""
    langs = score.shape[1]
    e = np.exp(score - score.max(1, keepdims=True)).reshape(-1, length, langs)
    a = np.exp(moves - moves.max())
    alpha, state = np.empty_like(e), np.full((len(e), langs), 1.0 / langs)
    starts = state
    for t in range(length):
        x = state @ a * e[:, t]
        alpha[:, t] = state = x / x.sum(1, keepdims=True)
    post, pairs, state = np.empty_like(e), np.zeros((langs, langs)), np.ones((len(e), langs))
    for t in range(length - 1, -1, -1):
        x = alpha[:, t] * state
        post[:, t] = x / x.sum(1, keepdims=True)
        back = e[:, t] * state
        before = alpha[:, t - 1] if t else starts
        joint = before[:, :, None] * a * back[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        x = back @ a.T
        state = x / x.sum(1, keepdims=True)
    y = label.reshape(-1, length)
    g = -post
    g[np.arange(len(y))[:, None], np.arange(length), y] += 1
    seen = np.zeros((langs, langs))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    np.add.at(seen, (slice(None), y[:, 0]), 1.0 / langs)
    return g.reshape(-1, langs), seen - pairs


def train(windows: list[tuple[str, list[bytes]]], steps: int = 40, rate: float = 0.1, l2: float = 0.02, joined: int = 3, seed: int = 5) -> Model:
    """Adam on the whole sample, from zero. ``windows``: (language, words), all of one length."""
    langs = sorted({lang for lang, _ in windows})
    if not langs:
        return Model([], np.zeros((SIZE + 1, 0)), np.zeros((0, 0)), np.zeros(0, X.U), np.zeros((0, 0), bool), np.zeros(SEEN, bool))
    rng, of = np.random.default_rng(seed), {lang: i for i, lang in enumerate(langs)}
    length = len(windows[0][1])
    windows = [windows[i] for i in rng.permutation(len(windows))]
    windows += windows[: -len(windows) % joined]  # whole sequences
    vocabulary: dict[bytes, int] = {}
    word = np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for _, ws in windows for w in ws])
    label = np.repeat([of[lang] for lang, _ in windows], length)
    words = list(vocabulary)
    hashes = word_hashes(words)
    counts = np.stack([np.bincount(word[label == i], minlength=len(words)) for i in range(len(langs))], 1)
    share = counts / np.maximum(1, counts.sum(0))
    member = (counts >= 3) & (share > 0.5 * share.sum(1, keepdims=True))
    some = np.flatnonzero(member.any(1))
    some = some[np.argsort(hashes[some])]
    model = Model(langs, np.zeros((SIZE + len(langs) + 1, len(langs))), np.zeros((len(langs),) * 2), hashes[some], member[some], np.zeros(SEEN, bool))
    who, what, *long = model.features(words, hashes)
    model.bar = _learn_grams(model, words, word.reshape(-1, length), *long, rng)
    m = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    v = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    for t in range(1, steps + 1):
        score = np.stack([np.bincount(who, model.weights[what, i], len(words)) for i in range(len(langs))], 1)
        by_word, by_move = _likelihood_gradient(score[word], model.moves, label, length * joined)
        by_word = np.stack([np.bincount(word, by_word[:, i], len(words)) for i in range(len(langs))], 1)
        grads = [np.stack([np.bincount(what, by_word[who, i], len(model.weights)) for i in range(len(langs))], 1) - l2 * model.weights, by_move]
        for j, (x, g) in enumerate(zip((model.weights, model.moves), grads, strict=True)):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.99 * v[j] + 0.01 * g * g
            x += rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-8)
    return model


def _learn_grams(model: Model, words: list[bytes], windows: np.ndarray, who: np.ndarray, gram: np.ndarray, rng: np.random.Generator, most: int = 20_000) -> float:
    """Fills ``model.seen`` from all windows and gives the bar, from ``most`` windows at most."""
    model.seen[gram] = True
    some = windows[: most]
    order = np.argsort(who, kind="stable")
    gram, size = gram[order], np.bincount(who, minlength=len(words))
    first = np.cumsum(size) - size
    flat = some.ravel()
    at = X.ragged(first[flat], size[flat])
    window = np.repeat(np.repeat(np.arange(len(some)), some.shape[1]), size[flat])
    pairs = np.unique(window * SEEN + gram[at])
    times = np.bincount(pairs % SEEN, minlength=SEEN)
    known = np.bincount(window, times[gram[at]] > 1) / np.bincount(window)
    shuffled = ["".join(rng.permutation(list(words[w].decode(errors="replace")))).encode() for w in some[:: max(1, len(some) // 500)].ravel()]
    _, _, w, g = model.features(shuffled, word_hashes(shuffled))
    w //= some.shape[1]
    foreign = np.bincount(w, model.seen[g]) / np.bincount(w)
    return float((np.quantile(known, 0.005) + np.median(foreign)) / 2)


def word_hashes(words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    return X.span_hashes(np.frombuffer(b"".join(words), np.uint8), end - size, end)


def _windows(windows: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch, "text"):
                data, at = X.flat(block.column("text"))
                start, end, first = word_spans(data, at)
                raw, rows = data.tobytes(), []
                for lang, a, b in zip(block.column("lang").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if b > a:
                        for i in np.unique(np.linspace(a, max(a, b - window), windows).astype(int)).tolist():
                            some = [i + j if i + j < b else a + (i + j - a) % (b - a) for j in range(window)]  # short texts are repeated
                            rows.append((lang, [raw[start[k] : end[k]] for k in some]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["lang", "words"])

    return run


def fit(labelled: DataFrame, per_lang: int = 250, windows: int = 6, window: int = 24) -> Model:
    """Learns all languages from the texts and non-null lang of ``labelled`` (doc_id, text, lang); doc_id only picks the sample."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return train([])
    shares = F.from_json(F.lit(json.dumps({lang: min(1.0, per_lang / n) for lang, n in counts.items()})), "map<string, double>")
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < share * 1_000_003)
    sample = rows.mapInArrow(_windows(windows, window), "lang string, words array<binary>").collect()
    return train([(r.lang, [bytes(w) for w in r.words]) for r in sample])


class Tagger:
    def __init__(self, model: Model):
        self.model = model
        self.memo = X.Memo(len(model.langs) + 2, np.float32)

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, posteriors of all words, the first word of each text, and its familiarity."""
        start, end, first = word_spans(data, at)
        if not len(start):
            return start, end, np.zeros((0, len(self.model.langs))), first, np.ones(len(at) - 1)
        key, where, back = np.unique(X.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.memo.keys) + len(key) > self.memo.most:
            self.memo.clear()
        new = np.flatnonzero(~self.memo.find(key)[0])
        if len(new):
            words = [data[a:b].tobytes() for a, b in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)]
            self.memo.add(key[new], self.model.scores(words, key[new]).astype(np.float32))
        score = self.memo.values[self.memo.find(key)[1]][back]
        seen, grams = (np.diff(np.concatenate([[0.0], np.cumsum(score[:, i], dtype=float)])[first]) for i in (-2, -1))
        return start, end, posteriors(score[:, :-2].astype(float), self.model.moves, first), first, (seen + DOUBT) / (grams + DOUBT)

    def texts(self, texts: pa.Array, spans: bool = False) -> tuple[list[str], np.ndarray, np.ndarray, list]:
        """Language, score and familiarity of each text, and its runs of words of one language (UTF-8 offsets)."""
        data, at = X.flat(texts)
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[at]
        known = np.diff(letters) > 0
        for row in np.flatnonzero(~known & (np.diff(at) > 0)):
            known[row] = any(c.isalpha() for c in texts[int(row)].as_py())
        if not self.model.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts)), [[] for _ in range(len(texts))]
        start, end, post, first, familiar = self.words(data, at)
        total = np.stack([np.concatenate([[0], np.cumsum(p)])[first] for p in post.T], 1)
        total = np.diff(total, axis=0)
        best = total.argmax(1)
        score = np.where(known, np.clip(total[np.arange(len(best)), best] / np.maximum(1, np.diff(first)), 0, 1), 0.0)
        runs: list = []
        if spans:
            label = post.argmax(1)
            for row in range(len(texts)):
                a, b = first[row], first[row + 1]
                cut = a + np.flatnonzero(np.diff(label[a:b])) + 1 if b > a else []
                edges = [a, *cut, b] if b > a and known[row] else []
                runs.append([{"lang": self.model.langs[label[i]], "start": int(start[i] - at[row]), "end": int(end[j - 1] - at[row])} for i, j in zip(edges[:-1], edges[1:], strict=True)])
        return [self.model.langs[b] if k else UND for b, k in zip(best, known, strict=True)], score, familiar, runs


def _predict(model: Model, spans: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            for block in X.blocks(batch, "text"):
                lang, score, familiar, runs = tagger.texts(block.column("text"), spans)
                arrays = [block.column("doc_id"), pa.array(lang), pa.array(score), pa.array(familiar)]
                names = ["doc_id", "lang_pred", "score", "familiarity"]
                if spans:
                    arrays.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and familiarity of every row of ``docs`` (doc_id, text); with ``spans`` also the
    runs of words of one language, as UTF-8 offsets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model, spans), "doc_id long, lang_pred string, score double, familiarity double" + ", spans array<struct<lang: string, start: long, end: long>>" * spans)


def keep_known(docs: DataFrame, model: Model, langs: list[str] | None = None, least: float = 0.5, familiar: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of ``langs`` (default: any learned one)
    with a score of at least ``least`` and a familiarity of at least ``familiar`` (``model.bar`` drops
    texts in languages that were not learned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        wanted = set(model.langs if langs is None else langs)
        for batch in batches:
            for block in X.blocks(batch, "text"):
                lang, score, known, _ = tagger.texts(block.column("text"))
                yield block.filter(pa.array([x in wanted and s >= least and k >= familiar for x, s, k in zip(lang, score, known, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
