import itertools
import random
import zlib

import numpy as np
import pytest

from factloom.llm import langid as L
from factloom.llm.queries import op1_language_id


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    score, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 9])
    got = L.posteriors(score, moves, first)
    for a, b in ((0, 4), (4, 9)):
        want = np.zeros((b - a, 3))
        for y in itertools.product(range(3), repeat=b - a):
            p = np.exp(sum(score[a + i, k] for i, k in enumerate(y)) + sum(moves[i, j] for i, j in itertools.pairwise(y))) * np.exp(moves[:, y[0]]).sum()
            want[np.arange(b - a), y] += p
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_chunks_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(2)
    score, moves, first = rng.normal(size=(60, 4)), rng.normal(size=(4, 4)), np.array([0, 1, 37, 60])
    whole = L.posteriors(score, moves, first)
    monkeypatch.setattr(L, "_CHUNK", 5)
    assert np.allclose(L.posteriors(score, moves, first), whole)


@pytest.fixture(scope="module")
def model(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return L.fit(docs.where("crc32(cast(doc_id AS string)) % 3 <> 1"))


def test_held_out_accuracy(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("crc32(cast(doc_id AS string)) % 3 = 1")
    rows = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 40 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_switches_inside_a_text_are_found(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    part = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 600").collect()}
    mixed = spark.createDataFrame([(1, part["en"] + "\n" + part["de"])], "doc_id long, text string")
    spans = L.predict(mixed, model, spans=True).first().spans
    assert [s.lang for s in spans if s.end - s.start > 100] == ["en", "de"]
    assert spans[0].start == 0 and all(a.end <= b.start for a, b in itertools.pairwise(spans))


def test_odd_rows(odd, empty, model):
    rows = L.predict(odd, model).collect()
    assert len(rows) == odd.count() and L.predict(empty, model).count() == 0
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {1, 2, 3, 4} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und" or r.lang_pred in model.langs) for r in rows)
    kept = L.keep_known(odd, model, least=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


def test_without_training_rows_all_is_unknown(odd, empty):
    none = L.fit(empty)
    assert {r.lang_pred for r in L.predict(odd, none).collect()} == {"und"}


def test_every_language_is_learned(spark):
    words = {f"l{k:02}": [f"{a}{chr(97 + k % 26)}{b}{chr(97 + k // 26)}" for a, b in itertools.product("bdgk", "aeiou")] for k in range(70)}
    rows = [(i, " ".join(words[lang][i % 2 :]), lang) for i, lang in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model.langs == sorted(words)
    assert {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()} == {i: lang for i, _, lang in rows}


FOREIGN = [
    "Всеобщая декларация прав человека: все люди рождаются свободными и равными в своем достоинстве и правах.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
]


def test_texts_in_no_learned_language_are_told_and_learned_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where("crc32(cast(doc_id AS string)) % 3 <> 1"))
    held = docs.where("crc32(cast(doc_id AS string)) % 3 = 1 AND text RLIKE '[A-Za-z]'")
    assert L.keep_known(held, model, least=0.0, familiar=model.bar).count() >= 0.997 * held.count()
    rng = random.Random(3)
    shuffled = [" ".join("".join(rng.sample(w, len(w))) for w in r.text.lower().split()) for r in held.where("length(text) BETWEEN 300 AND 3000").limit(60).collect()]
    foreign = spark.createDataFrame([(i, t) for i, t in enumerate(FOREIGN + shuffled)], "doc_id long, text string")
    kept = [r.doc_id for r in L.keep_known(foreign, model, least=0.0, familiar=model.bar).collect()]
    assert not kept, (model.bar, kept)


def plain(model, text):
    """The query's row by plain dynamic programming, a word at a time."""
    data, at = L.X.flat(L.pa.array([text]))
    start, end, _ = L.word_spans(data, at)
    words = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    score = model.scores(words, L.X.span_hashes(data, start, end)).astype(np.float32).astype(float)[:, :-2]
    n, k = score.shape
    log = np.logaddexp.reduce
    forward = np.zeros((n, k))
    for t in range(n):
        before = forward[t - 1][:, None] + model.moves if t else model.moves
        forward[t] = score[t] + log(before, axis=0)
    back = np.zeros((n, k))
    for t in range(n - 2, -1, -1):
        back[t] = log(model.moves + score[t + 1] + back[t + 1], axis=1)
    post = np.exp(forward + back - log(forward + back, axis=1)[:, None])
    return post.sum(0)


def test_query_against_plain_code(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit(table.where("crc32(cast(doc_id AS string)) % 3 <> 1").select("doc_id", "text", "lang"))
    rows = {r.doc_id: r for r in op1_language_id(spark, small).collect()}
    docs = table.collect()
    assert len(rows) == len(docs)
    for r in docs:
        got = rows[r.doc_id]
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not any(c.isalpha() for c in r.text or ""):
            assert (got.lang_pred, got.score) == ("und", 0.0)
        elif len(r.text) < 6000:
            total = plain(model, r.text)
            assert got.lang_pred == model.langs[int(total.argmax())]
            assert abs(got.score - total.max() / total.sum()) < 1e-6
    right = [rows[r.doc_id].lang_pred == r.lang for r in docs if rows[r.doc_id].held_out]
    assert sum(right) / len(right) > 0.97


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "abc abd"), (2, "x")], "doc_id long, text string")
    even = L.Model(["aa", "xx"], np.zeros((L.SIZE + 3, 2)), np.zeros((2, 2)), np.zeros(0, np.uint64), np.zeros((0, 2), bool), np.zeros(L.SEEN, bool))
    assert [(r.lang_pred, r.score) for r in L.predict(docs, even).collect()] == [("aa", 0.5)] * 2
