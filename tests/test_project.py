import pytest

from factloom.operators.morphology import Lexicon
from factloom.plans import dictionary as D
from factloom.plans import language as L
from factloom.plans.project import Project

SENTENCE = "Глокая куздра штеко кудланула бокрёнка."
SUFFIXES = [("ая", "ый", "A", "nom,sg,f"), ("дра", "дра", "S", "nom,sg,f,inan"), ("ко", "ко", "ADV", ""), ("нула", "нуть", "V", "praet,sg,f"), ("енка", "енок", "S", "gen,acc,sg,m,anim"), ("енок", "енок", "S", "nom,sg,m,anim")]


def svo(mode):
    return {
        "config.proto": 'encoding "utf8"; TTextMinerConfig { Dictionary = "d//dic.gzt"; Articles = [ { Name = "one" } ] Facts = [ { Name = "SVO" } ] Output = { Format = text; } BastardMode=%s; }' % mode,
        "d/dic.gzt": 'encoding "utf8"; import "base.proto"; import "types.proto"; TAuxDicArticle "one" { key = { "tomita:g.cxx" type=CUSTOM } }',
        "types.proto": "message SVO: NFactType.TFact { required string S = 1; required string V = 2; required string O = 3; }",
        "g.cxx": "Group -> Adj<gnc-agr[1]> Group<gnc-agr[1], rt>; Group -> Noun;\nAct -> Adv Act<rt>; Act -> Verb;\nS -> Group interp(SVO.S) Act interp(SVO.V) Group interp(SVO.O);",
    }


@pytest.mark.parametrize("mode, facts", [("no", ""), ("outOfDict", "\tSVO\n\t{\n\t\tS = глокая куздра\n\t\tV = штеко кудлануть\n\t\tO = бокренок\n\t}\n"), ("always", "\tSVO\n\t{\n\t\tS = глокая куздра\n\t\tV = штеко кудлануть\n\t\tO = бокренок\n\t}\n")])
def test_invented_words_by_mode(mode, facts):
    project = Project.of(svo(mode), lexicon=Lexicon([], SUFFIXES))
    assert project.text_of(SENTENCE) == "Глокая куздра штеко кудланула бокрёнка . \n" + facts


LEXICON = [
    ("Анна", "Анна", "S", "persn,nom,sg,f,anim", False), ("родилась", "родиться", "V", "praet,sg,f,pf", False), ("Москве", "Москва", "S", "geo,abl,sg,f,inan", False), ("Москва", "Москва", "S", "geo,nom,sg,f,inan", False),
    ("в", "в", "PR", "", False), ("нижнем", "нижний", "A", "abl,sg,m", False), ("нижний", "нижний", "A", "nom,sg,m", False), ("новгороде", "новгород", "S", "abl,sg,m", False), ("новгород", "новгород", "S", "nom,sg,m", False),
    ("вчера", "вчера", "ADV", "", False), ("старого", "старый", "A", "gen,acc,sg,m", False), ("старый", "старый", "A", "nom,sg,m", False), ("у", "у", "PR", "", False),
    ("крокодила", "крокодил", "S", "gen,acc,sg,m,anim", False), ("крокодил", "крокодил", "S", "nom,sg,m,anim", False), ("понедельник", "понедельник", "S", "nom,acc,sg,m", False), ("сентября", "сентябрь", "S", "gen,sg,m", False), ("сентябрь", "сентябрь", "S", "nom,sg,m", False),
]


def born(grammar, more=""):
    return {
        "config.proto": 'TTextMinerConfig { Dictionary = "dic.gzt"; Articles = [{ Name = "run" }] Facts = [{ Name = "Born" }] }',
        "dic.gzt": 'import "kinds.proto"; TAuxDicArticle "run" { key = { "tomita:g.cxx" type=CUSTOM } }\ncity "NN" { key = "Нижний Новгород"; mainword = 2; lemma = "Нижний Новгород" }\ncity "M" { key = "Москва" }\nact "b" { key = "родиться" | "появиться на свет" }' + more,
        "kinds.proto": 'message city : TAuxDicArticle {} message act : TAuxDicArticle {} message Born: NFactType.TFact { required string Who = 1; required string Where = 2; optional string Note = 3 [default = "none", (NFactType.normcase) = UPPER_CASE]; }',
        "g.cxx": grammar,
    }


BORN = 'Act -> Verb<kwtype=act>; City -> Noun<kwtype=city>; S -> AnyWord<gram="имя"> interp(Born.Who) Act "в" City interp(Born.Where);'


def facts(files, text, lexicon=LEXICON):
    return [(kind, dict(fields)) for _, kind, _, _, fields, _ in Project.of(files, lexicon=Lexicon(lexicon)).compile().sentence(text).facts()]


def test_keys_by_lemma_and_spans_of_several_words():
    assert facts(born(BORN), "Анна родилась в Москве.") == [("Born", {"Who": "Анна", "Where": "Москва", "Note": "NONE"})]
    assert facts(born(BORN), "Вчера Анна родилась в Нижнем Новгороде!") == [("Born", {"Who": "Анна", "Where": "Нижний Новгород", "Note": "NONE"})]
    assert facts(born(BORN), "Анна родилась вчера.") == []


def test_files_of_keys_constants_options_and_filters():
    files = born('#filter &Verb [1] &Word<kwtype=beast>\n#define WHO Noun<kwtype=beast>\nS -> Verb interp(Born.Note="seen") "у" (Adj<gnc-agr[1]>) ${WHO}<rt, gnc-agr[1]> interp(Born.Who; Born.Where::not_norm);', '\nbeast "x" { key = { "b.txt" type=FILE } }')
    files["b.txt"] = "крокодил\n\nчерепаха\n"
    files["kinds.proto"] += " message beast : TAuxDicArticle {}"
    assert facts(files, "родилась у крокодила") == [("Born", {"Note": "SEEN", "Who": "крокодил", "Where": "крокодила"})]
    assert facts(files, "родилась вчера там у крокодила") == []
    chained = dict(files) | {"g.cxx": 'Group -> (Adj<gnc-agr[1]>) Noun<kwtype=beast, rt, gnc-agr[1]>; S -> Verb interp(Born.Note="$SENT") "у" Group interp(Born.Who; Born.Where::norm="gen");'}
    assert facts(chained, "родилась у старого крокодила") == [("Born", {"Note": "РОДИЛАСЬ У СТАРОГО КРОКОДИЛА", "Who": "старый крокодил", "Where": "старого крокодила"})]


def test_cascades_hand_facts_on():
    files = born('S -> AnyWord<kwtype="place"> interp(Born.Where from City.Name; Born.Who="x");', '\nTAuxDicArticle "place" { key = { "tomita:p.cxx" type=CUSTOM } }')
    files["p.cxx"] = 'P -> "в" Noun<kwtype=city> interp(City.Name);'
    files["kinds.proto"] += " message City: NFactType.TFact { required string Name = 1; }"
    assert facts(files, "Анна родилась в Москве") == [("Born", {"Where": "Москва", "Who": "x", "Note": "NONE"})]


def test_trim_weight_lists_and_concatenation():
    files = born('Who -> Noun<gram="persn"> interp(Born.Who); S -> Who AnyWord* "в" Noun<kwtype=city> interp(Born.Where) {trim, weight=0.5};')
    done = Project.of(files, lexicon=Lexicon(LEXICON)).compile().sentence("Анна вчера родилась в Москве .").facts()
    assert done == []  # a noun is no first name: the terminal excludes names
    files["g.cxx"] = files["g.cxx"].replace("Noun<gram=\"persn\">", "Word<gram=\"persn\">")
    done = Project.of(files, lexicon=Lexicon(LEXICON)).compile().sentence("Анна вчера родилась в Москве .").facts()
    assert [(f, t, dict(x)) for _, _, f, t, x, _ in done] == [(0, 5, {"Who": "Анна", "Where": "Москва", "Note": "NONE"})]
    files["g.cxx"] = 'A -> Verb interp(Born.Who) Adv; S -> A "в" interp(Born.Where) Noun interp(+Born.Who);'
    assert facts(files, "родилась вчера в Москве") == [("Born", {"Who": "родиться Москва", "Where": "в", "Note": "NONE"})]


@pytest.mark.parametrize(
    "text",
    ["S -> Q;", "S -> S;", "S -> (Word);", "S -> Word<rt> Word<rt>;", "S -> Word<gnc-agr[1]> Word;", "#nothing\nS -> Word;", "S -> Word<what>;", "S -> Word {much};", "S -> (Word<rt>) Word;", "A -> Word; B -> Word;", "#GRAMMAR_ROOT X\nS -> Word;", "S -> Word<wff=/(/>;", "S -> Word", "S -> Word<gztweight=x>;", "#ifdef A\nS -> Word;"],
)
def test_what_is_not_understood_is_an_error(text):
    with pytest.raises(L.GrammarError):
        L.parse(text)


def test_text_of_grammars():
    g = L.parse('#encoding "utf-8"\n// c\n#include <x.cxx>\nS -> A+[c-agr] | B! {count=3, weight=0.7} | (Comma) A<wff=/a>b|c,d/, ~fw, kwset=~[x,"y z"]>;', lambda n: "#GRAMMAR_ROOT A\nA -> Noun; B -> Verb;")
    assert g.root == "S" and {r.count for r in g.rules if r.left == "S"} == {3, 1000}
    tags = next(t for r in g.rules for i in r.items for t in i.tags if t.name == "wff")
    assert tags.value == "a>b|c,d" and any(t.name == "kwset" and t.negated and L.values(t.value) == ["x", "y z"] for r in g.rules for i in r.items for t in i.tags)


def test_dictionary_text():
    d = D.parse('import "a.proto"; /* c */ city "x/y" { key = "a b" | { "f" type=FILE gram="nom,~sg" }; mainword = 2; lemma = { text="t" always=true } pop = 3.5 } // end', lambda n: "message city : base { } message base : NFactType.TFact { optional bool b = 2; } message F: base { required NFactType.TFio q = 1; extensions 3 to 9; }")
    a = d.articles[0]
    assert (a.type, a.name, a.fields["key"][0], a.fields["key"][1]["type"], a.one("mainword"), a.one("pop")) == ("city", "x/y", "a b", ["FILE"], 2, 3.5)
    assert [f.name for f in d.fields("F")] == ["b", "q"] and d.is_a("F", "NFactType.TFact")
    with pytest.raises(D.DictionaryError):
        D.parse('city "x" { key = ')


def test_as_a_table(spark):
    project = Project.of(born(BORN), lexicon=Lexicon(LEXICON))
    docs = spark.createDataFrame([(1, "Анна родилась в Москве. Анна родилась в Нижнем Новгороде.", "x"), (1, None, "y"), (None, "", "z"), (1, "Анна родилась в Москве.", None)], "doc_id long, text string, fields string")
    rows = sorted((r.sent_id, r.f, r.t, r.fields["Where"]) for r in project.facts_of(docs).collect())
    assert rows == [(0, 0, 4, "Москва"), (0, 0, 4, "Москва"), (1, 0, 5, "Нижний Новгород")]
