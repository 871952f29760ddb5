from factloom.llm import queries as Q


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
    assert set(Q.ORACLES) <= set(Q.QUERIES)
