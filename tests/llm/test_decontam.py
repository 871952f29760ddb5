from factloom.llm.decontam import drop_contaminated, find_items

ITEM = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1 b2 b3 b4 b5 b6 b7 b8 b9 c1 c2"


def brute(docs, items, threshold=0.8, n=5):
    def grams(t, k):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = []
    for d, t in docs:
        for i, x in items:
            k = min(n, len((x or "").split()))
            own = grams(x, k) if k else set()
            shared = len(own & grams(t, k)) if k else 0
            if own and shared >= round(threshold * len(own), 9):
                out.append((d, i, len(own), shared))
    return sorted(out)


def test_against_plain_code(spark):
    words = ITEM.split()
    docs = [(1, "x y " * 500 + ITEM.upper() + " z" * 900), (2, " ".join(words[:16])), (3, " ".join(words[:17])), (4, ITEM.replace("b5", "zz")), (5, "q r s"), (6, "p q r s t"), (7, None), (8, "q"), (3, ITEM)]
    items = [(10, ITEM), (11, "q r s"), (12, None), (13, ""), (14, ITEM), (None, "q")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (16 << 20, 1):
        got = sorted((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in find_items(d, i, block_bytes=size).where("item_id IS NOT NULL").collect())
        assert got == [x for x in brute(docs, items[:-1])]
    assert {r.doc_id for r in find_items(d, i).where("item_id IS NULL").collect()} == {5, 6, 8}


def test_random_tables_against_plain_code(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    docs = []
    for d in range(120):
        own = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        part = items[rng.randrange(40)][1].split()
        part = [w if rng.random() > 0.04 else "edit" for w in part]
        docs.append((d, " ".join(own[:30] + part + own[30:])))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in find_items(d, i, block_bytes=300).collect())
    assert got == brute(docs, items) and len(got) > 50


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three four five six", "x")], "item_id long, text string, doc_id string")
    assert sorted(r.doc_id for r in find_items(odd, items).collect()) == [5, 5, 6]
    clean = drop_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
    assert find_items(empty, items).count() == 0 and find_items(odd, items.limit(0)).count() == 0 and drop_contaminated(odd, items.limit(0)).count() == odd.count()
