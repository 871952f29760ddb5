import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import lmscore as M
from factloom.llm.queries import op6_lm_scoring

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
PIECES = M.load_pieces(VOCABULARY)
INDEX = {p: i for i, p in enumerate(PIECES.names)}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(word, log_p):
    s = b" " + word
    a = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        a[j] = sum(a[i] * math.exp(log_p[INDEX[s[i:j]]]) for i in range(j) if s[i:j] in INDEX)
    return math.log(a[-1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="athe nds.é漢", min_size=1, max_size=12).map(lambda t: t.replace(" ", "_").encode()), min_size=1, max_size=6))
def test_marginals_sum_all_segmentations(some):
    assert np.allclose(PIECES.log_words(some), [plain(w, PIECES.log_p) for w in some])


def test_expected_uses_are_the_gradient_of_the_marginal():
    use = PIECES.expected([b"the", b"then"])
    for piece in (b" the", b" then", b"n", b" th"):
        step = PIECES.log_p.copy()
        step[INDEX[piece]] += 1e-5
        change = (M.Pieces(PIECES.names, step).log_words([b"the", b"then"]).sum() - PIECES.log_words([b"the", b"then"]).sum()) / 1e-5
        assert abs(change - use[INDEX[piece]]) < 1e-4


def test_long_words_do_not_underflow():
    assert -1e6 < PIECES.log_words([b"x" * 5000])[0] < -1000


def brute(docs, held, model):
    c, ends = Counter(), 0
    for i, t in docs:
        if not held(i):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    for i, t in docs:
        if len(t) >= 3000:
            continue
        w = words(t)
        counts = [c[x] for x in w] + [ends]
        scores = [(sum(plain(x.encode(), log_p) for x in w) + model.pieces.end(log_p)) / math.log(10) for log_p in (model.pieces.log_p, model.vocabulary)]
        yield i, len(w) + 1, sum(k > 0 for k in counts), n, sum(math.log10((k + 1) / (n + v + 1)) for k in counts), *scores


def test_query_against_plain_code(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    held = F.expr("crc32(cast(doc_id AS string)) % 7 = 2")
    model = M.fit(table.where(~held), VOCABULARY, hot=300)
    got = {r.doc_id: r for r in M.score(table, model, held).collect()}
    whole = {r.doc_id: r for r in op6_lm_scoring(spark, small).collect()}
    everything = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert len(got) == len(whole) == len(everything)
    want = list(brute(everything, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, model))
    assert len(want) > 100
    for i, n_tokens, known, n, base, score, own in want:
        for r in (got[i], whole[i]):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, n_tokens, known, n)
            assert abs(r.base_score - base) < 1e-6 * abs(base) and abs(r.score - score) < 1e-6 * abs(score) and abs(r.vocabulary_score - own) < 1e-6 * abs(own)


def test_training_fits_texts_and_the_sum_over_words_is_one(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    held = F.expr("crc32(cast(doc_id AS string)) % 7 = 2")
    model = M.fit(table.where(~held), VOCABULARY)
    rows = M.score(table, model, held).where("held_out").agg(F.sum("score"), F.sum("vocabulary_score")).first()
    assert rows[0] > rows[1]
    for log_p in (model.pieces.log_p, model.vocabulary):
        p, starts = np.exp(log_p), np.append(model.pieces.starts, False)
        opens, inner, end = p[starts].sum(), p[:-1][~model.pieces.starts].sum(), p[-1]
        # words: an opening piece and any number of inner ones; then the end
        assert abs(opens / (1 - inner) + math.exp(model.pieces.end(log_p)) - 1) < 1e-9


def test_rows_of_an_input_that_changes_its_order_keep_their_scores(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    model = M.fit(table, VOCABULARY)
    plain_rows = {r.doc_id: r.score for r in M.score(table, model, F.lit(False)).collect()}
    dealt = {r.doc_id: r.score for r in M.score(table.repartition(5, F.rand()), model, F.lit(False)).collect()}
    assert plain_rows.keys() == dealt.keys() and all(abs(plain_rows[i] - dealt[i]) < 1e-9 for i in dealt)


@pytest.mark.parametrize("train", [True, False])
def test_odd_rows(odd, empty, train):
    model = M.fit(odd if train else empty, VOCABULARY, hot=2)
    rows = M.score(odd, model, F.lit(None).cast("boolean")).collect()
    assert len(rows) == odd.count() and not any(r.held_out for r in rows)
    assert {(r.n_tokens, r.n_known) for r in rows if r.doc_id in (1, 2, 3)} == {(1, int(train))}
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows) and (train or {r.base_score for r in rows} == {0.0})
    assert M.score(empty, model, F.lit(False)).count() == 0
