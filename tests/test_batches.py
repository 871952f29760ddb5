"""Sentences read together give what each gives on its own, and few of their words become strings."""

import random

import pyarrow as pa
import pytest

from factloom import language_queries as Q
from factloom.plans import batches, stretches
from factloom.plans.project import WORD, Project
from tests.test_stretches import LANGUAGE, LONG, OTHERS, grammar, made

ODD = "of-the of–in -of in- İN ΣΑΣ σας ñandú Été éTÉ ǅ ﬁn ßa ² x² 12 1999 ١٩٩٩ 𝟙𝟚 中文 𐐀𐐨 ёлка ЕЛКА á _ __ « » \" 😀     \x1c \x00 ' $ 5% of of in the la and was".split(" ")


def odd(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["", " ", "of", "the", ".", *[r.choice((" ", "", "  ")).join(r.choices(ODD, k=r.randint(0, 12))) for _ in range(n)]]


def each(compiled, reader, sentences: list[str]) -> list[tuple]:
    out = []
    for k, text in enumerate(sentences):
        places = [m.span() for m in compiled.word(text).finditer(text)]
        out += [(k, n, places[f][0], places[t - 1][1], f, t, (article, kind, fields, weight)) for n, (article, kind, f, t, fields, weight) in enumerate(reader.facts(text))]
    return out


def together(sieve, column) -> list[tuple]:
    out = []
    for *columns, rest, rests in sieve.blocks(column):
        out += [(*x, rests[n]) for *x, n in zip(*(c.tolist() for c in columns), rest.tolist(), strict=True)]
    return out


@pytest.mark.parametrize("hyphens", [False, True])
@pytest.mark.parametrize("name", [*LANGUAGE, *OTHERS, *LONG])
def test_as_each_sentence(name, hyphens, monkeypatch):
    compiled = Q.project(LONG[name]).compile() if name in LONG else grammar(name)
    compiled.project.hyphens = hyphens
    sieve, reader = batches.Sieve(stretches.Reader(compiled)), stretches.Reader(compiled)
    assert sieve.able or not sieve.reader.able or sieve.plan.inner
    if not sieve.able:
        return
    sentences = made(7, 300) + odd(8, 300)
    wanted = each(compiled, reader, sentences)
    for size in (1 << 20, 300, 1):
        monkeypatch.setattr(batches, "BLOCK", size)
        assert together(sieve, pa.array(["x", *sentences, "of the"])[1:-1]) == wanted
    assert together(sieve, pa.array(["of", None, "the"])) == each(compiled, reader, ["of", "", "the"])


def test_kinds_of_all_characters():
    chars = batches.characters()
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    kinds = chars.kinds(batches.codes_of(text)).tobytes()
    words = [text[i : i + 1] for i, k in enumerate(kinds) if k]
    assert words == [w for x in WORD.findall(text) for w in x]


def test_words_of_other_places_are_no_strings(monkeypatch):
    seen = []
    words = batches.Block.words
    monkeypatch.setattr(batches.Block, "words", lambda self, at: seen.append(len(at)) or words(self, at))
    r = random.Random(5)
    text = [" ".join("".join(r.choices("aeiounrstl", k=r.randint(2, 9))) if r.random() < 0.95 else "of" for _ in range(11)) + "." for _ in range(2000)]
    sieve = batches.Sieve(stretches.Reader(grammar("lang_kwtype_none")))
    assert together(sieve, pa.array(text)) and sum(seen) < 0.25 * 12 * len(text)
    assert len(sieve.plan.masks) < 0.1 * 11 * len(text)


def test_most_facts_and_wanted_ones():
    files = Q.FILES | {"main.cxx": 'S -> Prep interp(R.A="a"; P.X="x") | Noun interp(P.X="y");'}
    files["config.proto"] = files["config.proto"].replace("100000", "3")
    compiled = Project.of(files, lexicon=Q.Lexicon(Q.WORDS)).compile()
    sieve, reader = batches.Sieve(stretches.Reader(compiled)), stretches.Reader(compiled)
    sentences = ["of a in", "of a in a of tion", "of a in a of a in", "tion a tion a tion a of a tion", *made(5, 200)]
    assert sieve.able and together(sieve, pa.array(sentences)) == each(compiled, reader, sentences)
