import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom import queries as Q
from factloom.functions import text as T
from factloom.operators import facts as FA
from factloom.operators import gazetteer as GZ
from factloom.operators import grammar as G
from factloom.operators import tokens as TK
from factloom.plans import grammar as PG
from factloom.sources import readers, sinks
from factloom.streaming import extract


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_sentences_and_tokens(spark):
    rows = TK.tokens(docs(spark, 'One "two" 3. Four!\nFive', None, "")).collect()
    assert [(r.sent_id, r.pos, r.tok) for r in rows] == [(0, 0, "One"), (0, 1, '"'), (0, 2, "two"), (0, 3, '"'), (0, 4, "3"), (0, 5, "."), (1, 0, "Four"), (1, 1, "!"), (2, 0, "Five")]
    assert rows[2].prev == rows[2].next == '"' and rows[0].prev is None and rows[8].next is None


@pytest.mark.parametrize("word, want", [("Мocква", "Москва"), ("word", "word"), ("слово", "слово"), ("сode", "code")])
def test_lookalikes(spark, word, want):
    assert one(spark, TK.repair_lookalikes(F.col("w")), w=word) == want


def test_normalization_and_ordinals(spark):
    assert one(spark, TK.normalize(F.col("w")), w="Ёлка") == "елка"
    number, flexion = TK.ordinal(F.col("w"))
    assert (one(spark, number, w="21st"), one(spark, flexion, w="3-я"), one(spark, number, w="x")) == (21, "я", None)


def plain_cover(spans):
    """Best set without overlaps by trying all: tokens, weight, fewest spans."""
    best = (0, 0, 0)
    for n in range(len(spans) + 1):
        for some in itertools.combinations(spans, n):
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)):
                best = max(best, (sum(t - f for f, t, _ in some), sum(w for *_, w in some), -n))
    return best


def test_cover_is_the_best_of_all_sets(spark):
    rng = random.Random(1)
    groups = []
    for g in range(60):
        spans = {}
        for _ in range(rng.randint(0, 7)):
            f = rng.randint(0, 9)
            spans[f, f + rng.randint(1, 4)] = rng.randint(1, 5)
        groups.append((g, [(f, t, w) for (f, t), w in spans.items()]))
    df = spark.createDataFrame(groups, "g long, s array<struct<f: long, t: long, w: long>>")
    for r in df.select("g", "s", G.cover(F.col("s")).alias("c")).collect():
        chosen = [tuple(x) for x in r.c]
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(chosen)))
        assert (sum(t - f for f, t, _ in chosen), sum(w for *_, w in chosen)) == plain_cover([tuple(x) for x in r.s])[:2]


def spans_of(spark, grammar, text):
    return sorted((x.f, x.t) for r in PG.apply(TK.charts(docs(spark, text)), PG.parse(grammar)).collect() for x in r.spans)


@pytest.mark.parametrize(
    "grammar, want",
    [
        ("S -> 'a' 'b';", [(0, 2)]),
        ("S -> 'a' | 'c';", [(0, 1), (3, 4)]),
        ("S -> 'b' ('x') 'B';", [(1, 3)]),
        ("S -> Word<kwset=[a, b]>+;", [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]),
        ("S -> Word<kwset=[a, b]>+ {count=2};", [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)]),
        ("S -> 'a'* 'c';", [(3, 4)]),
        ("S -> Word<h-reg1>;", [(2, 3)]),
        ("S -> Word<~l-reg, ~fw>;", [(2, 3)]),
        ("S -> Word<wff=/[bc]/>;", [(1, 2), (3, 4)]),
        ("A -> 'a'; S -> A Word;", [(0, 2)]),
        ("#define X 'c'\nS -> ${X} Punct;", [(3, 5)]),
        ("#ifdef NO\nS -> 'a';\n#else\nS -> 'b';\n#endif", [(1, 2), (2, 3)]),
        ("#GRAMMAR_ROOT S\nS -> 'c'; // comment\nT -> 'a';", [(3, 4)]),
    ],
)
def test_grammar_language(spark, grammar, want):
    assert spans_of(spark, grammar, "a b B c.") == want


@pytest.mark.parametrize("grammar", ["S -> Foo;", "S -> ('a');", "S -> S;", "S -> A; A -> B; B -> A 'x';", "S -> 'a'<rt> 'b'<rt>;", "S -> ('a'<rt>) 'b';", "S 'a';", "A -> 'a'; B -> 'b';", "S -> Word<nope=1>;", "#ifdef X\nS -> 'a';"])
def test_grammar_errors(grammar):
    with pytest.raises(PG.GrammarError):
        PG.parse(grammar)


def test_coordination_and_filter(spark):
    df = TK.computed(TK.charts(docs(spark, "x, y and z w")), {"w": G.terminal(F.col("toks"), lambda t: t["low"].isin("x", "y", "z")), "c": G.terminal(F.col("toks"), lambda t: t["tok"].isin(",", "and"))})
    r = df.select(G.coordinated(F.col("w"), F.col("c")).alias("s"), G.ordered(F.col("c"), F.col("w"), 0).alias("near"), G.ordered(F.col("w"), F.col("w"), 0).alias("no")).first()
    assert sorted((x.f, x.t) for x in r.s) == [(0, 1), (0, 3), (0, 5), (2, 3), (2, 5), (4, 5)] and r.near and not r.no


def test_gazetteer_forms_and_holes(spark):
    gaz = spark.createDataFrame([("a/x", "t", ["Big", "*", "x"], True, 3, None, None, 1), ("a/y", "t", ["big"], False, 1, "big", "l", 1)], GZ.SCHEMA)
    rows = GZ.lookup(TK.charts(docs(spark, "Big red x big", "big")), gaz).collect()
    assert sorted((r.doc_id, r.f, r.t, r.article, r.head) for r in rows) == [(0, 0, 1, "a/y", 0), (0, 0, 3, "a/x", 2), (0, 3, 4, "a/y", 3), (1, 0, 1, "a/y", 0)]
    assert GZ.lookup(TK.charts(docs(spark, "x")), gaz.limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [("on 05.03.21 and 1/2/1999, 31.02.2000", ["2021-03-05", "1999-02-01"]), ("1.1.85", ["1985-01-01"]), ("5.5.0999", []), (None, None)])
def test_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "w string")
    assert df.select(T.dates(F.col("w"))).first()[0] == want


@pytest.mark.parametrize("words, want", [("two hundred thirty one", 231), ("three thousand five", 3005), ("million", 10**6), ("one x", None), ("two hundred thousand", 200_000)])
def test_number_words(spark, words, want):
    assert one(spark, T.word_number(F.split("w", " ")), w=words) == want


def test_times_quotes_numbers_capitals(spark):
    assert one(spark, T.times(F.col("w")), w="at 9:05 or 23:59, not 24:00") == [545, 1439]
    assert one(spark, T.quoted(F.col("w")), w='he "one two" and "a, b"') == ["one two"]
    assert one(spark, T.numbers(F.col("w")), w="3 and 4,5") == [3.0, 4.5]
    assert [one(spark, T.capitalize(F.col("w"), m), w="ab cd") for m in ("UPPER", "TITLE", "CAMEL", "NONE")] == ["AB CD", "Ab cd", "Ab Cd", "ab cd"]


def test_merging(spark):
    m = lambda a, b: spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(FA.merge(F.col("a"), F.col("b"))).first()[0]
    assert [tuple(x) for x in m([1, 2], [3, 4])] == [(1, 3), (2, 4)] and [tuple(x) for x in m([1], [3, 4])] == [(1, 3), (1, 4)] and m([1, 2], [3, 4, 5]) is None


def test_equal_pairs_stop_at_the_cap(spark):
    facts = spark.createDataFrame([(1, s, 0, "T", "v") for s in range(10)], "doc_id long, sent_id long, f long, fact_type string, v string")
    assert FA.equal_pairs(facts, "v").count() == 45 and FA.equal_pairs(facts, "v", 7).count() == 7


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "d.txt").write_text("7\tseven\n\nplain\n")
    assert [tuple(r) for r in readers.per_line(spark, str(tmp_path / "d.txt")).collect()] == [(7, "seven"), (3, "plain")]
    assert readers.per_line(spark, str(tmp_path / "d.txt"), last=1).count() == 1
    (tmp_path / "x.xml").write_text('<textset><text id="u1">t one</text><text id="u2">t two</text></textset>')
    assert [tuple(r) for r in readers.textset(spark, str(tmp_path / "x.xml")).collect()] == [("u1", "t one"), ("u2", "t two")]
    facts = spark.createDataFrame([(1, 0, 0, "T", "x", None)], "doc_id long, sent_id long, f long, fact_type string, a string, b string")
    assert sinks.text_blocks(facts, ["a", "b"]).first().text == "\tT\n\t{\n\t\ta = x\n\t}\n"
    sinks.write_json(facts, ["a"], str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().fields.a == "x"
    sinks.write_xml(facts, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "fact").load(str(tmp_path / "xml")).first().a == "x"


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    table = docs(spark, "a b. c", "d")
    table.write.parquet(str(tmp_path / "in"))
    extract.run(extract.documents(spark, str(tmp_path / "in"), table.schema), TK.tokens, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(TK.tokens(table).collect())


def test_every_query_has_sql_or_a_reason():
    assert set(Q.ORACLES) == set(Q.QUERIES)


@pytest.mark.parametrize("text", ["#filter &Word\nS -> Word;", "#include <x>\nS -> Word;", "S -> Word {weight=0.5};", "#GRAMMAR_ROOT X\nS -> Word;", "S -> Word Word<rt>;"])
def test_the_native_subset_refuses_what_it_does_not_do(text):
    with pytest.raises(PG.GrammarError):
        PG.parse(text)


def test_a_long_sentence_of_matching_words(spark):
    text = ", ".join('abcdefg'[i % 7] for i in range(2500))
    df = TK.computed(TK.charts(docs(spark, text)), {"w": G.terminal(F.col("toks"), lambda t: t["tok"] != ","), "c": G.terminal(F.col("toks"), lambda t: t["tok"] == ",")})
    assert df.select(F.size(G.chains(F.col("w"), F.col("c"))).alias("n"), F.size(F.element_at(G.chains(F.col("w"), F.col("c")), 1)).alias("m")).first() == (1, 2500)


def test_lookup_in_the_row_and_by_join_agree(spark):
    entries = [("a", "k", ["red", "fox"], False, 2, None, None, 2), ("b", "k", ["the", "*", "fox"], False, 1, "x", "y", 1), ("c", "t", ["Fox"], True, None, None, None, 3), ("d", "k", ["fox"], False, 1, None, None, 4), ("e", "k", ["fox"], False, 1, None, None, 4)]
    gaz = spark.createDataFrame(entries, GZ.SCHEMA)
    charts = TK.charts(docs(spark, "The red fox. Fox the fox", "the big Fox red FOX", None, ""))
    assert sorted(GZ.lookup(charts, gaz).collect(), key=str) == sorted(GZ.joined(charts, gaz, gaz.count()).collect(), key=str)


def test_repeated_ids_and_clashing_columns_do_not_mix(spark):
    table = spark.createDataFrame([(1, "of the cat", "x"), (1, "of the dog", "y"), (None, "of the sun", None)], "doc_id long, text string, toks string")
    df = TK.computed(TK.charts(table), {"a": G.terminal(F.col("toks"), lambda t: t["low"] == "of"), "b": G.terminal(F.col("toks"), lambda t: t["low"] == "the")})
    df = df.select("doc_id", F.inline(G.seq(F.col("a"), F.col("b"))))
    assert sorted(df.collect(), key=str) == sorted([(1, 0, 2), (1, 0, 2), (None, 0, 2)], key=str)


def test_html(spark):
    html = "<html><head><title>t</title></head><BODY class=x><p>one<br>two</p><script>bad()</script><table><tr><td>c</td></tr></table><b>bo</b>ld</body></html>"
    assert one(spark, T.html_to_text(F.col("w")), w=html).split() == ["one", "two", "c", "bold"]
