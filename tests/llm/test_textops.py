import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import textops as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\u00a0漢", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_and_shingles_are_those_of_plain_code(rows):
    array = pa.array(rows, pa.string())
    data, at = X.flat(array)
    start, end, first = X.words(data, at)
    got = [[data[a:b].tobytes().decode() for a, b in zip(start[i:j], end[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in rows]
    want = []
    for t in rows:
        w = WORD.findall(low(t or ""))
        want.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
    assert [len(s) for s in X.shingle_sets(array)] == want


def test_equal_words_have_equal_hashes_wherever_they_stand():
    a = X.shingle_sets(pa.array(["x y z", None, "  X\ny\tz ", "x y"]))
    assert a[0].tolist() == a[2].tolist() and len(a[1]) == 0 and a[3].tolist() != a[0].tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 4)), max_size=12))
def test_ragged(runs):
    start, size = np.array([a for a, _ in runs], np.int64), np.array([n for _, n in runs], np.int64)
    assert X.ragged(start, size).tolist() == [a + i for a, n in runs for i in range(n)]


def test_blocks_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in (3, 0, 50, 2, 2, 100)])})
    parts = list(X.blocks(batch, "text", 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist() and len(parts) > 2
