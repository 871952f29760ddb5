"""Parsing by stretches gives what the chart gives over whole sentences, and parses few words."""

import inspect
import random
import time

import pytest

from factloom import language_queries as Q
from factloom.plans import chart, stretches
from factloom.plans import project as P
from factloom.plans.project import Project
from factloom.queries import QUERIES

LANGUAGE = sorted(n for n in QUERIES if n.startswith("lang_"))
OTHERS = {
    "ties": 'A -> Prep | Prep A; S -> A interp(R.A="a") Noun {weight=0.5} | A interp(R.B="b") | Comma Prep interp(R.C="c") | Prep interp(R.A="d") Comma | "and" A interp(R.A::not_norm) | Noun<gram="nom"> interp(R.A) "and";',
    "texts": 'S -> Word<h-reg1> interp(R.A) Adj<gnc-agr[1]>* Noun<gnc-agr[1], rt> interp(R.B::norm="gen") {trim};',
    "places": 'S -> Word<quoted> interp(R.A) | Word<fw, ~quoted> interp(R.B::not_norm) Word<l-quoted>* | AnyWord<~quoted, lat> interp(R.C) EOSent;',
    "numbers": 'S -> YYDate interp(R.A="y") | Digit<wff=/1.*/> interp(R.B="d") Word<h-reg2> | Percent interp(R.C="p");',
    "whole": 'S -> Prep interp(R.A="$SENT") Adj;',
    "dominance": 'D -> Prep Adj Noun {left_dominant}; S -> Prep interp(R.A="x") Adj {right_recessive} | D interp(R.B="y");',
    "several": 'S -> Prep Word<kwtype="b/of_the"> interp(R.A) | Word<kwtype=big> interp(R.B) Word<kwtype="pair"> interp(R.C from P.X);',
    "marked": 'S -> Word<kwtype=none> interp(R.A="n") AnyWord<kwset=~[small, "x"], GU=~[nom]> Word<label="l">+;',
}
WORDS = [w[0] for w in Q.WORDS] + "of of of the the in la and zork quux Zork ZORK zoRk été X the Of In IS The 1999 17 12345 ² , , . ; % - ( \" \" « » don t x_y of the in the".split()


def made(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.choice((0, 1, 2, 5, 9, 14)))) + r.choice(("", ".", "!")) for _ in range(n)] + ["of in " * 9 + "the", "the and of , in of the in the a of the", '"of the" la']


def grammar(name: str):
    main = OTHERS.get(name) or inspect.getclosurevars(QUERIES[name]).nonlocals["main"]
    return Q.project(main).compile()


@pytest.mark.parametrize("name", [*LANGUAGE, *OTHERS])
def test_as_whole_sentences(name):
    compiled = grammar(name)
    reader = stretches.Reader(compiled)
    for s in made(7, 120) + made(7, 40):
        assert reader.facts(s) == compiled.sentence(s).facts(), s


def test_the_order_of_hits_and_overlaps_of_a_grammar_that_stands_for_words():
    files = Q.FILES | {"main.cxx": 'S -> AnyWord<kwtype="pair"> interp(R.A from P.X) Noun*;', "pair.cxx": "S -> Prep interp(P.X) | Prep interp(P.X) Adj;"}
    compiled = Project.of(files, lexicon=Q.Lexicon(Q.WORDS)).compile()
    reader = stretches.Reader(compiled)
    assert reader.able and [reader.facts(s) for s in made(3, 200)] == [compiled.sentence(s).facts() for s in made(3, 200)]


def few_words(name: str, monkeypatch, most: float) -> None:
    """Invented prose: of its words at most this share comes to a chart."""
    seen = []
    run = chart.Parser.run
    monkeypatch.setattr(chart.Parser, "run", lambda self: seen.append(len(self.units)) or run(self))
    r = random.Random(5)
    text = [" ".join("".join(r.choices("aeiounrstl", k=r.randint(2, 9))) if r.random() < 0.8 else r.choice(WORDS[:40]) for _ in range(11)) + "." for _ in range(2000)]
    reader = stretches.Reader(grammar(name))
    found = sum(len(reader.facts(s)) for s in text)
    assert found and sum(seen) <= most * 12 * len(text)


def test_few_words_cascade(monkeypatch):
    few_words("lang_cascade", monkeypatch, 0.01)


def test_few_words_kwset_not(monkeypatch):
    few_words("lang_kwset_not", monkeypatch, 0.01)


def test_few_words_kwtype_none(monkeypatch):
    few_words("lang_kwtype_none", monkeypatch, 0.01)


def plain_choice(parses: list[chart.Weighed]) -> list[int]:
    """The choice as it is told: every solution against all that it overlaps."""
    done: list[chart.Solution] = []
    for n, x in enumerate(parses):
        base, rival = chart.Solution(), None
        for k in range(n - 1, -1, -1):
            if parses[k].j <= x.i:
                base = done[k]
                break
            if rival is None or done[k].rank > rival.rank:
                rival = done[k]
        mine = base.add(n, x, 0)
        done.append(rival if rival is not None and rival.rank > mine.rank else mine)
    out, at = [], done[-1] if done else None
    while at and at.last >= 0:
        out, at = [at.last, *out], at.before
    return out


def test_the_choice():
    r = random.Random(1)
    for _ in range(400):
        parses = []
        for _ in range(r.randint(0, 12)):
            i = r.randint(0, 7)
            parses.append(chart.Weighed(i, i + r.randint(1, 4), r.randint(1, 3), r.randint(0, 2), r.randint(0, 2), r.choice((chart.SCALE, chart.SCALE // 2))))
        parses.sort(key=lambda x: (x.j, x.i))
        base = chart.Solution()
        assert chart.members(chart.best(parses, base), base) == plain_choice(parses)


LONG = {
    "lists": 'A -> Prep | A Comma Prep | A "and" Prep; S -> A interp(R.A="a") | Comma interp(R.B="c") | "and" Prep interp(R.C) | Prep Comma interp(R.B="d");',
    "limits": 'A -> Prep | Prep A {count=4}; S -> A interp(R.A) A interp(R.B::not_norm) {count=7} | Noun interp(R.C);',
    "facts": 'A -> Prep interp(R.A) | A Prep interp(R.A) | Prep interp(R.A) Prep interp(R.A); B -> Noun interp(R.B) Noun interp(R.B) | Noun interp(R.B) Noun interp(R.B) Noun interp(R.B); S -> A B | A;',
}


@pytest.mark.parametrize("name", ["lang_recursion_right", "lang_recursion_left", "lang_plus_star", "lang_count", *LONG])
def test_long_stretches(name):
    compiled = Q.project(LONG[name]).compile() if name in LONG else grammar(name)
    reader = stretches.Reader(compiled)
    r = random.Random(11)
    for _ in range(60):
        s = " ".join(r.choices("of in de on , and it tion is zork".split(), (9, 9, 5, 5, 3, 3, 4, 4, 1, 1), k=r.randint(5, 30)))
        assert reader.facts(s) == compiled.sentence(s).facts(), s
    assert reader.plans[0].equal


def long_run(name: str, most: float) -> None:
    reader = stretches.Reader(grammar(name))
    began = time.process_time()
    (row,) = reader.facts("of in " * 150)
    assert (row[2], row[3]) == (0, 300) and time.process_time() - began < most  # one run of all words


def test_a_long_run_recursion_right():
    long_run("lang_recursion_right", 5)


def test_a_long_run_plus_star():
    long_run("lang_plus_star", 15)


def test_a_long_run_recursion_left():
    long_run("lang_recursion_left", 5)


def test_a_long_run_is_not_stepped_through_for_each_of_its_words(monkeypatch):
    calls = []
    through = stretches.Spans._through
    monkeypatch.setattr(stretches.Spans, "_through", lambda self, items, here: calls.append(1) or through(self, items, here))
    reader = stretches.Reader(grammar("lang_recursion_left"))
    (row,) = reader.facts("of in " * 150)
    assert (row[2], row[3]) == (0, 300) and len(calls) < 10 * 300  # one for each run before


def test_left_recursion_of_several_terminals():
    compiled = Q.project('A -> Prep | A Comma Prep {count=9} | A "and" | A Prep {count=12} | Comma; S -> A interp(R.A="a") | Comma "and" interp(R.B="c") | A Noun interp(R.C="d");').compile()
    reader = stretches.Reader(compiled)
    r = random.Random(12)
    for _ in range(60):
        s = " ".join(r.choices("of in , and tion zork".split(), (9, 5, 5, 3, 2, 1), k=r.randint(5, 30)))
        assert reader.facts(s) == compiled.sentence(s).facts(), s
    assert reader.plans[0].equal


def test_words_of_ascii_texts():
    r = random.Random(2)
    every = "".join(map(chr, range(128)))
    for s in [every, *("".join(r.choices(every + "ab-1_ ", k=40)) for _ in range(300))]:
        assert P.ASCII_WORD.findall(s) == P.WORD.findall(s) and P.ASCII_PARTS.findall(s) == P.PARTS.findall(s)
