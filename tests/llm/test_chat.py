import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.chat import Template, format_chats, read_back
from factloom.llm.queries import op7_chat_format

T = Template()
pieces = st.lists(st.sampled_from([*T.controls, "\\", "\n", " ", "<", "[", "a", "é", "/", "|>"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces), pieces), max_size=5))
def test_any_turns_round_trip(turns):
    text = "".join(s for i, (r, t) in enumerate(turns) for s, _ in T.turn(r, t, i == 0))
    assert T.parse(text) == turns


def test_machine_and_masks(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (2, 0, "assistant", "x"), (2, 1, "tool", None)]
    out = {(r.conv_id, r.turn_no): r for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[k].valid for k in sorted(out)] == [True, True, True, False, False, False]
    assert [out[1, i].state for i in range(4)] == ["briefed", "asked", "answered", "answered"]
    assert [[s.text for s in out[k].segments if s.loss] for k in sorted(out)] == [[], [], ["a"], ["b"], ["x"], []]


def test_odd_rows(spark):
    rows = [(None, None, None, None, "x"), (None, 1, "user", "", "x"), (3, 2, "assistant", "b", "x"), (3, 2, "assistant", "b", "x"), (3, 1, "user", "\\<s>", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string")
    got = {r.conv_id: r for r in read_back(format_chats(table)).collect()}
    assert got[None].n_turns == 2 and got[None].turns_sha256 == hashlib.sha256(b"\n\nuser\n\n").hexdigest()
    assert got[3].n_turns == 3 and got[3].loss_chars == 2 and got[3].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert read_back(format_chats(table.limit(0))).count() == 0


def test_query_has_every_conversation(spark, small):
    rows = op7_chat_format(spark, small).collect()
    assert {r.conv_id for r in rows} == {r.conv_id for r in spark.read.parquet(f"{small}/conversations.parquet").collect()} | {-7}
