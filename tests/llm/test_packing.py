import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing as P
from factloom.llm.queries import op2_packing
import pyarrow as pa

PATH = public_tokenizers.path("byte_bpe_50k.json")
SLOW = Tokenizer.from_file(PATH)


def ids(text):
    return [*SLOW.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab'st1 \n\t\r\x1c.é\u00a0\u2003\u3000漢\u0085", max_size=25)), max_size=5))
def test_pieces_between_cuts_give_the_ids_of_whole_texts(rows):
    got, at = P.Tokens(PATH, 1)(pa.array(rows, pa.string()))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids(t) for t in rows]


def check(pieces, want, length):
    rows = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in rows:
        assert r.sequence_id * length + r.offset == place and r.length > 0 and r.offset + r.length <= length
        place += r.length
    assert place == sum(map(len, want))


def test_all_documents_round_trip(spark, small):
    docs = {r.doc_id: ids(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op2_packing(spark, small).collect()
    check(rows, docs.values(), 2048)
    for r in rows:
        part = np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(docs[r.doc_id])


def test_odd_rows(odd, empty):
    rows = P.pack(odd, PATH, length=64).collect()
    want = [ids(r.text) for r in odd.collect()]
    check(rows, want, 64)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        by.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert by[1] == [1] and by[None] == want[1] and by[5] == want[5] * 2 and by[7] == want[8]
    assert P.pack(empty, PATH).count() == 0
