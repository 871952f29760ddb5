"""Queries about readings, agreement and the grammar language, over ``documents`` with a small lexicon, and their SQL.

The lexicon is made up: the tables hold invented words, so grammemes were dealt out to frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import morphology as MO
from factloom.operators import tokens as TK
from factloom.operators.morphology import Lexicon
from factloom.plans.project import Project
from factloom.queries import TOKS, charts, query, read, tokens

#: form, lemma, part of speech, grammemes, predicted
WORDS = [
    ("the", "the", "APRO", "nom,sg,m", False), ("the", "the", "APRO", "acc,sg,f", False), ("a", "a", "APRO", "nom,sg,n", False), ("la", "la", "APRO", "nom,sg,f", False), ("la", "la", "S", "acc,sg,f", False),
    ("le", "le", "APRO", "nom,sg,m", False), ("les", "le", "APRO", "nom,pl", False), ("der", "der", "APRO", "nom,sg,m", False), ("der", "der", "APRO", "gen,sg,f", False), ("die", "der", "APRO", "nom,sg,f", False),
    ("die", "der", "APRO", "nom,pl", False), ("das", "der", "APRO", "nom,sg,n", False), ("of", "of", "PR", "", False), ("in", "in", "PR", "", False), ("de", "de", "PR", "", False), ("to", "to", "PR", "", False), ("von", "von", "PR", "", False),
    ("for", "for", "PR", "", False), ("on", "on", "PR", "", False), ("on", "on", "ADV", "", False), ("and", "and", "CONJ", "", False), ("und", "und", "CONJ", "", False), ("is", "be", "V", "praes,sg,3p", False), ("are", "be", "V", "praes,pl,3p", False),
    ("was", "be", "V", "praet,sg,m", False), ("be", "be", "V", "inf", False), ("it", "it", "S", "nom,sg,n", False), ("it", "it", "S", "acc,sg,n", False), ("that", "that", "S", "nom,sg,m", False), ("that", "that", "CONJ", "", False),
    ("tion", "tion", "S", "nom,sg,f", True), ("anea", "anea", "S", "nom,sg,f", False), ("anea", "anea", "S", "gen,pl,f", False), ("attion", "attion", "S", "acc,sg,f", False), ("thanea", "thanea", "S", "nom,sg,f,persn,anim", False), ("eriner", "eriner", "S", "nom,sg,m,famn,anim", False),
    ("ther", "ther", "S", "nom,sg,m", True), ("thin", "thin", "S", "gen,pl,m,poss", False), ("than", "than", "ANUM", "nom,sg,m", False), ("then", "then", "ADVPRO", "", False), ("ed", "ed", "V", "partcp,praet,sg,m", False), ("un", "un", "A", "nom,sg,m", False), ("une", "un", "A", "nom,sg,f", False), ("with", "with", "PR", "", False),
]
_ROWS = ", ".join("('{}', '{}', '{}', [{}], {})".format(f, le, p, ", ".join(f"'{g}'" for g in [p, *filter(None, gs.split(","))]), str(pr).upper()) for f, le, p, gs, pr in WORDS)
LEX = f"""{TOKS}, lex(form, lemma, p, g, predicted) AS (VALUES {_ROWS}),
forms AS (SELECT form, list({{'lemma': lemma, 'p': p, 'g': g, 'predicted': predicted}} ORDER BY lemma, p) AS r FROM lex GROUP BY form),
read_ AS (SELECT t.doc_id, t.sent_id, t.pos, t.tok, t.low, coalesce(f.r, []) AS r, coalesce(h.r, []) AS r2, t.next
  FROM tokens t LEFT JOIN forms f ON f.form = t.low LEFT JOIN forms h ON h.form = lower(t.next))"""


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, le, p, [g for g in gs.split(",") if g], pr) for f, le, p, gs, pr in WORDS], "form string, lemma string, pos string, grams array<string>, predicted boolean")


def read_tokens(spark: SparkSession, sf_dir: str, pairs: bool = False) -> DataFrame:
    found = MO.with_readings(tokens(spark, sf_dir, pairs), lexicon(spark), F.col("low"), "r")
    return MO.with_readings(found, lexicon(spark), F.lower("next"), "r2") if pairs else found


@query(f"WITH {LEX} SELECT t.doc_id, t.sent_id, t.pos, l.lemma, l.p AS part, CAST(len(l.g) AS BIGINT) AS n_grams, l.predicted FROM tokens t JOIN lex l ON t.low = l.form")
def morph_readings(spark, sf_dir):
    found = MO.readings(tokens(spark, sf_dir).select("doc_id", "sent_id", F.col("pos").alias("place"), "low"), lexicon(spark))
    return found.select("doc_id", "sent_id", F.col("place").alias("pos"), "lemma", F.col("pos").alias("part"), F.bit_count("g").cast("long").alias("n_grams"), "predicted")


@query(f"WITH {LEX} SELECT low AS word, CAST(count(DISTINCT l.lemma || l.p || l.predicted) AS BIGINT) AS n_homonyms, count(*) AS n_forms FROM (SELECT DISTINCT low FROM tokens) JOIN lex l ON low = l.form GROUP BY low")
def morph_homonyms(spark, sf_dir):
    found = MO.analyze_words(tokens(spark, sf_dir), lexicon(spark))
    return found.select(F.col("form").alias("word"), F.size("homonyms").cast("long").alias("n_homonyms"), F.aggregate("homonyms", F.lit(0).cast("long"), lambda a, h: a + F.size(h["forms"])).alias("n_forms"))


_SUFFIX = [("tion", "tio", "S", ["sg"]), ("ion", "io", "S", ["sg"]), ("ion", "io", "S", ["pl"]), ("ung", "ung", "S", ["sg"]), ("ng", "n", "V", ["ger"]), ("ment", "men", "S", ["sg"])]


@query(
    f"""WITH {TOKS}, s(suffix, ending, part, grams) AS (VALUES {", ".join(f"('{a}', '{b}', '{p}', '{g[0]}')" for a, b, p, g in _SUFFIX)}), w AS (SELECT DISTINCT low AS word FROM tokens)
    SELECT word, left(word, length(word) - length(suffix)) || ending AS lemma, part, grams FROM w JOIN s ON ends_with(word, suffix) AND length(word) > length(suffix)
    QUALIFY row_number() OVER (PARTITION BY word, part, grams ORDER BY length(suffix) DESC) = 1"""
)
def morph_guess(spark, sf_dir):
    """Readings by endings: of each part of speech and grammemes the longest that fits."""
    rules = spark.createDataFrame(_SUFFIX, "suffix string, ending string, pos string, grams array<string>")
    found = MO.guess(tokens(spark, sf_dir).select(F.col("low").alias("word")).distinct(), rules)
    return found.select("word", "lemma", F.col("pos").alias("part"), F.element_at("grams", 1).alias("grams"))


@query(f"WITH {LEX} SELECT low AS word, r[1].lemma AS lemma FROM (SELECT DISTINCT low, list_sort(r, 'ASC') AS r FROM read_ WHERE len(r) > 0)")
def morph_normal_form(spark, sf_dir):
    """Of a word's lemmas the first in order."""
    found = MO.analyze_words(tokens(spark, sf_dir), lexicon(spark))
    return found.select(F.col("form").alias("word"), F.element_at("homonyms", 1)["lemma"].alias("lemma"))


def _any(*grams: str) -> str:
    return "list_has_any(x.g, [" + ", ".join(f"'{g}'" for g in grams) + "])"


_NOT_NAME = f"NOT {_any('persn', 'famn', 'patrn', 'abbr')}"
TERMINALS = {
    "Noun": f"{_any('S')} AND {_NOT_NAME}",
    "Adj": f"{_any('A', 'partcp', 'ANUM', 'APRO')} AND NOT {_any('brev')}",
    "AdjPartOrdNum": _any("A", "partcp", "ANUM", "APRO"),
    "OrdinalNumeral": _any("ANUM"),
    "Adv": _any("ADV", "ADVPRO"),
    "Participle": _any("partcp"),
    "Verb": f"{_any('V')} AND NOT {_any('partcp', 'ger', 'inf')}",
    "Infinitive": _any("inf"),
    "Prep": _any("PR"),
}


def _some(condition: str, column: str = "r") -> str:
    return f"len(list_filter({column}, lambda x: {condition})) > 0"


def _tagged(name: str, spark_test, sql: str) -> None:
    def run(spark, sf_dir):
        return read_tokens(spark, sf_dir).where(spark_test()).select("doc_id", "sent_id", "pos", "tok")

    run.__name__ = f"tag_{name}"
    query(f"WITH {LEX} SELECT doc_id, sent_id, pos, tok FROM read_ WHERE {sql}")(run)


for _name, _sql in TERMINALS.items():
    _tagged(f"{_name.lower()}_terminal", lambda n=_name: F.exists("r", lambda x: MO.is_terminal(n, x["g"])), _some(_sql))
_tagged("unknown_pos_terminal", lambda: (F.size("r") == 0) & F.col("low").rlike(r"^th\p{L}*$"), r"len(r) = 0 AND regexp_matches(low, '^th[\p{L}]*$')")
_tagged("lemma_of_form", lambda: F.exists("r", lambda x: x["lemma"] == "be"), _some("x.lemma = 'be'"))
_tagged("gram", lambda: MO.fits(F.col("r"), "nom,sg"), _some("list_has_all(x.g, ['nom', 'sg'])"))
_tagged("gram_not", lambda: MO.fits(F.col("r"), "nom,~acc"), f"{_some(_any('nom'))} AND NOT {_some(_any('acc'))}")
_tagged("gu", lambda: MO.union_fits(F.col("r"), "[gen,pl]|&[nom,acc]"), f"{_some('''list_has_all(x.g, ['gen', 'pl'])''')} OR len(list_filter(r, lambda x: list_has_all(flatten([y.g for y in r if y.lemma = x.lemma AND y.p = x.p]), ['nom', 'acc']))) > 0")
_tagged("gu_not", lambda: (F.size("r") > 0) & MO.union_fits(F.col("r"), "~[nom,acc,PR]"), f"len(r) > 0 AND NOT {_some(_any('nom', 'acc', 'PR'))}")
_tagged("no_hom", lambda: (F.size("r") > 0) & (F.size(F.array_distinct(F.transform("r", lambda x: x["pos"]))) == 1), "len(r) > 0 AND len(list_distinct([x.p for x in r])) = 1")
_tagged("not_prep", lambda: (F.size("r") > 0) & ~F.exists("r", lambda x: x["pos"] == "PR"), f"len(r) > 0 AND NOT {_some('''x.p = 'PR' ''')}")
_tagged("dict", lambda: F.exists("r", lambda x: ~x["predicted"]), _some("NOT x.predicted"))
_tagged("not_dict", lambda: (F.size("r") > 0) & ~F.exists("r", lambda x: ~x["predicted"]), f"len(r) > 0 AND NOT {_some('NOT x.predicted')}")
_tagged("name", lambda: F.exists("r", lambda x: MO.has(x["g"], "persn,famn,patrn", False)), _some(_any("persn", "famn", "patrn")))


# --- agreement of neighbours --------------------------------------------------------------------------------

def _both(*grams: str) -> str:
    return "(" + " OR ".join(f"(list_contains(a.g, '{g}') AND list_contains(b.g, '{g}'))" for g in grams) + ")"


def _l(side: str, *grams: str) -> str:
    return f"list_has_any({side}.g, [" + ", ".join(f"'{g}'" for g in grams) + "])"


_C, _N = _both("nom", "gen", "dat", "acc", "ins", "loc", "abl", "voc"), _both("sg", "pl")
_G = f"({_both('m', 'f', 'n', 'mf')} OR {_both('pl')})"
_FEM = " OR ".join(f"({_l(s, 'f')} AND {_l(s, 'famn', 'persn')})" for s in "ab")
AGREEMENTS = {
    "gnc-agr": f"{_G} AND {_N} AND {_C}",
    "nc-agr": f"{_N} AND {_C}",
    "c-agr": _C,
    "gn-agr": f"{_G} AND {_N}",
    "gc-agr": f"{_G} AND {_C}",
    "n-agr": _N,
    "sp-agr": f"{_l('a', 'nom')} AND (({_l('b', 'praet', 'brev')} AND {_N} AND ({_G} OR {_l('a', '1p', '2p')})) OR ({_l('b', 'imper')} AND {_l('a', '2p')}) OR (NOT {_l('b', 'praet', 'brev', 'imper')} AND {_N} AND (({_l('b', '3p')} AND NOT {_l('a', '1p', '2p')}) OR {_both('1p', '2p', '3p')})))",
    "fem-c-agr": f"{_C} AND {_N} AND ({_G} OR {_FEM})",
    "after-num-agr": f"({_l('a', 'gen')} AND {_l('b', 'gen')} AND {_l('a', 'pl')}) OR ({_G} AND {_N} AND {_C})",
    "izf-agr": f"{_l('a', 'S')} AND {_l('a', 'nom', 'gen')} AND {_l('b', 'S')} AND {_l('b', 'poss')}",
    "any-agr": "true",
}


def _agreement(kind: str, sql: str, negated: bool = False) -> None:
    def run(spark, sf_dir):
        df = read_tokens(spark, sf_dir, True).where((F.size("r") > 0) & (F.size("r2") > 0))
        test = MO.agreeing(kind, F.col("r"), F.col("r2"))
        return df.where(~test if negated else test).select("doc_id", "sent_id", "pos", "tok", "next")

    run.__name__ = ("agr_not_" if negated else "agr_") + kind.removesuffix("-agr").replace("-", "_")
    some = f"len(list_filter(r, lambda a: len(list_filter(r2, lambda b: {sql})) > 0)) > 0"
    query(f"WITH {LEX} SELECT doc_id, sent_id, pos, tok, next FROM read_ WHERE len(r) > 0 AND len(r2) > 0 AND {'NOT ' if negated else ''}{some}")(run)


for _kind, _sql in AGREEMENTS.items():
    _agreement(_kind, _sql)
_agreement("gnc-agr", AGREEMENTS["gnc-agr"], True)


# --- the grammar language: whole projects, parsed by the chart ------------------------------------------------

FILES = {
    "config.proto": 'TTextMinerConfig { Dictionary = "dic.gzt"; Articles = [ { Name = "main" } ] Facts = [ { Name = "R" } ] MaxFactsCountPerSentence = 100000 BastardMode = always }',
    "dic.gzt": 'import "types.proto"; TAuxDicArticle "main" { key = { "tomita:main.cxx" type=CUSTOM } } TAuxDicArticle "pair" { key = { "tomita:pair.cxx" type=CUSTOM } }\nsmall "s/of" { key = "of"; w = 0.25 } small "s/de" { key = "de" lemma = "DE" } big "b/the" { key = "the" } big "b/of_the" { key = "of the"; mainword = 2 }\nform "f/be" { key = "be" } light "l" { key = "la"; light_kw = true }\nFilmed "x" { key = "in $b/the" }',
    "types.proto": 'message small : TAuxDicArticle {} message big : TAuxDicArticle {} message form : TAuxDicArticle {} message light : TAuxDicArticle {} message R : NFactType.TFact { optional string A = 1; optional string B = 2; optional string C = 3 [ default = "none" ]; } message P : NFactType.TFact { required string X = 1; }',
    "pair.cxx": "S -> Prep<wff=/of|in/> Word<wff=/the|a/> interp(P.X);",
    "part.cxx": "#GRAMMAR_ROOT Q\nQ -> Prep; Art -> Adj;",
}


def project(main: str) -> Project:
    p = Project.of(FILES | {"main.cxx": main}, lexicon=Lexicon(WORDS))
    p.hyphens = False
    return p


def language(name: str, main: str, sql: str, columns: str = "f, t, a, b, c", weight: bool = False) -> None:
    """A query of a grammar: spans, fields A, B, C of its facts, and their weight if asked for. The SQL gives the columns
    doc_id, sent_id, f, t, a, b, c."""

    def run(spark, sf_dir):
        done = project(main).facts_of(read(spark, sf_dir, "documents"))
        fields = [F.col("fields")[x].alias(x.lower()) for x in "ABC"]
        return done.select("doc_id", "sent_id", "f", "t", *fields, *(["weight"] if weight else []))

    run.__name__ = f"lang_{name}"
    query(f"WITH {LEX}, pairs AS (SELECT *, lower(next) AS low2 FROM read_ WHERE next IS NOT NULL) {sql}")(run)


_PREP, _NOUN, _ADJ = (_some(TERMINALS[n]) for n in ("Prep", "Noun", "Adj"))
_NOUN2, _ADJ2 = (_some(TERMINALS[n], "r2") for n in ("Noun", "Adj"))
_AGREE = f"len(list_filter(r, lambda a: list_has_any(a.g, ['A', 'partcp', 'ANUM', 'APRO']) AND NOT list_contains(a.g, 'brev') AND len(list_filter(r2, lambda b: list_contains(b.g, 'S') AND NOT list_has_any(b.g, ['persn', 'famn', 'patrn', 'abbr']) AND ({AGREEMENTS['gnc-agr']}))) > 0)) > 0"
_OUT = "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, low AS a, low2 AS b, 'none' AS c"


def _runs(condition: str, alone: str = "true") -> str:
    """Longest runs of tokens."""
    return f"""SELECT doc_id, sent_id, min(pos) AS f, max(pos) + 1 AS t, string_agg(low, ' ' ORDER BY pos) AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c
      FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS island FROM read_ WHERE {condition}) GROUP BY doc_id, sent_id, island HAVING {alone}"""


_PLAIN = "::not_norm"
language("interp", f"S -> Word<wff=/[oO]f|[iI]n|[dD]e/> interp(R.A{_PLAIN}) Word<wff=/[lL]a|[tT]he/> interp(R.B{_PLAIN});", "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, CASE WHEN pos = 0 AND tok <> upper(tok) THEN low ELSE tok END AS a, next AS b, 'none' AS c FROM pairs WHERE regexp_matches(tok, '^([oO]f|[iI]n|[dD]e)$') AND regexp_matches(next, '^([lL]a|[tT]he)$')")
language("constant", 'S -> "of" interp(R.A="x"; R.B="yes") "be" interp(R.C="is");', "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'x' AS a, 'yes' AS b, 'is' AS c FROM pairs WHERE low = 'of' AND low2 IN ('is', 'are', 'was', 'be')")
language("agreement", 'S -> Adj<gnc-agr[1], l-reg> interp(R.A="adj") Noun<gnc-agr[1], rt, l-reg> interp(R.B="noun");', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'adj' AS a, 'noun' AS b, 'none' AS c, CAST((100000000 + 0 + 100000000) // 3 AS BIGINT) AS weight FROM pairs p WHERE tok = low AND next = low2 AND {_AGREE} AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.doc_id = p.doc_id AND q.sent_id = p.sent_id AND q.pos = p.pos - 1 AND q.tok = q.low AND q.next = q.low2 AND {_AGREE.replace('filter(r,', 'filter(q.r,').replace('filter(r2,', 'filter(q.r2,')})", weight=True)
language("recursion_right", 'A -> Prep | Prep A; S -> A interp(R.A="run");', _runs(_PREP).replace("string_agg(low, ' ' ORDER BY pos) AS a", "'run' AS a"))
language("recursion_left", 'A -> A Prep | Prep; S -> A interp(R.A="run");', _runs(_PREP).replace("string_agg(low, ' ' ORDER BY pos) AS a", "'run' AS a"))
language("plus_star", 'S -> Prep+ interp(R.A="run") Noun*;', f"""SELECT doc_id, sent_id, f, f + n AS t, 'run' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM (SELECT doc_id, sent_id, base + start_ AS f, CAST(length(m) AS BIGINT) AS n FROM (SELECT doc_id, sent_id, 0 AS base, unnest(regexp_extract_all(s, 'P+N*')) AS m, unnest(list_transform(range(len(regexp_extract_all(s, 'P+N*'))), lambda k: length(array_to_string(regexp_split_to_array(s, 'P+N*')[1 : k + 1], '')) + length(array_to_string(regexp_extract_all(s, 'P+N*')[1 : k], '')))) AS start_ FROM (SELECT doc_id, sent_id, string_agg(CASE WHEN {_PREP} THEN 'P' WHEN {_NOUN} THEN 'N' ELSE '.' END, '' ORDER BY pos) AS s FROM read_ GROUP BY doc_id, sent_id)))""")
language("count", 'A -> Prep | Prep A; S -> A interp(R.A="run") Verb {count=2};', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'run' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE {_PREP} AND {_some(TERMINALS['Verb'], 'r2')}")
language("optional_weight", 'S -> Prep interp(R.A="p") (Adj) "be" {weight=0.5};', f"""SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'p' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c, CAST((30000000 + 0 + 50000000) // 3 AS BIGINT) AS weight FROM pairs WHERE {_PREP} AND low2 IN ('is', 'are', 'was', 'be')
 UNION ALL SELECT x.doc_id, x.sent_id, x.pos, x.pos + 3, 'p', NULL, 'none', (10000000 + 0 + 50000000) // 3 FROM pairs x JOIN pairs y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND y.pos = x.pos + 1 WHERE {_PREP.replace('(r,', '(x.r,')} AND {_ADJ.replace('(r,', '(y.r,')} AND y.low2 IN ('is', 'are', 'was', 'be')""", weight=True)
language("outgram", 'A -> Word<wff=/th[a-z]*/, lat> {outgram="nom,sg,S"}; S -> A<gram="nom,S"> interp(R.A="th") Comma;', "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'th' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE regexp_matches(tok, '^th[a-z]*$') AND next = ','")
language("kwtype", 'S -> Word<kwtype=small> interp(R.A="s") Word<kwtype="b/the"> interp(R.B="b");', "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 's' AS a, 'b' AS b, 'none' AS c FROM pairs WHERE low IN ('of', 'de') AND low2 = 'the'")
language("kwtype_none", 'S -> Word<kwtype=none, wff=/[a-z]+/> interp(R.A="w") Word<kwset=[small, "b/the"]> interp(R.B="k");', "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'w' AS a, 'k' AS b, 'none' AS c FROM pairs WHERE regexp_matches(tok, '^[a-z]+$') AND low NOT IN ('of', 'de', 'the') AND low2 IN ('of', 'de', 'the')")
language("kwset_not", 'S -> Prep<kwset=~[small]> interp(R.A="p") Word<kwset=["b/the"]>;', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'p' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE {_PREP} AND low NOT IN ('of', 'de') AND low2 = 'the'")
language("gztweight", 'S -> Word<kwtype="s/of", gztweight="w"> interp(R.A="s") Verb;', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 's' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c, CAST((30000000 + 50000000 + 25000000) // 3 AS BIGINT) AS weight FROM pairs WHERE low = 'of' AND {_some(TERMINALS['Verb'], 'r2')}", weight=True)
language("multiword", 'S -> Word<kwtype="b/of_the", mw> interp(R.A="m") Word<wff=/[a-z]+/> interp(R.B="w");', "SELECT x.doc_id, x.sent_id, x.pos AS f, x.pos + 3 AS t, 'm' AS a, 'w' AS b, 'none' AS c FROM pairs x JOIN pairs y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND y.pos = x.pos + 1 WHERE x.low = 'of' AND x.low2 = 'the' AND regexp_matches(y.next, '^[a-z]+$')")
language("label", 'S -> Word<label="l"> interp(R.A="l") Prep;', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'l' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE low = 'la' AND {_some(TERMINALS['Prep'], 'r2')}")
language("lemma_key", 'S -> Word<kwtype=form> interp(R.A="f") Prep;', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'f' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE low IN ('is', 'are', 'was', 'be') AND {_some(TERMINALS['Prep'], 'r2')}")
language("article_in_key", 'S -> Word<kwtype="x"> interp(R.A="x") Word<wff=/[a-z]+/>;', "SELECT x.doc_id, x.sent_id, x.pos AS f, x.pos + 3 AS t, 'x' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs x JOIN pairs y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND y.pos = x.pos + 1 WHERE x.low = 'in' AND x.low2 = 'the' AND regexp_matches(y.next, '^[a-z]+$')")
language("cascade", 'S -> AnyWord<kwtype="pair"> interp(R.A from P.X; R.B="p");', "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, low2 AS a, 'p' AS b, 'none' AS c FROM pairs WHERE tok IN ('of', 'in') AND next IN ('the', 'a')")
language("filter", '#filter &"of" [1] &"the"\nS -> Verb interp(R.A="v") Prep;', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'v' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs p WHERE {_some(TERMINALS['Verb'])} AND {_some(TERMINALS['Prep'], 'r2')} AND EXISTS (SELECT 1 FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos > a.pos AND b.pos - a.pos - 1 <= 1 WHERE a.doc_id = p.doc_id AND a.sent_id = p.sent_id AND a.low = 'of' AND b.low = 'the')")
language("trim", 'S -> Comma Prep interp(R.A="p") Verb {trim};'.replace('interp(R.A="p")', "interp(R.A::not_norm)").replace("Prep", "Word<wff=/of|in|de|to/>"), f"SELECT doc_id, sent_id, pos + 1 AS f, pos + 2 AS t, next AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs x WHERE tok = ',' AND next IN ('of', 'in', 'de', 'to') AND EXISTS (SELECT 1 FROM pairs y WHERE x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND y.pos = x.pos + 1 AND {_some(TERMINALS['Verb'], 'y.r2')})")
language("not_hreg_fact", "S -> Word<wff=/(?i:of|in)/> interp(R.A::not_norm) Adj {not_hreg_fact};", f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, CASE WHEN pos = 0 THEN low ELSE tok END AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs p WHERE low IN ('of', 'in') AND upper(tok) <> tok AND {_ADJ2}")
language("concatenation", 'A -> "of" interp(R.A::not_norm) Adj; S -> A<l-reg> Prep<l-reg> interp(+R.A::not_norm);', f"SELECT x.doc_id, x.sent_id, x.pos AS f, x.pos + 3 AS t, 'of ' || y.next AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs x JOIN pairs y ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND y.pos = x.pos + 1 WHERE x.tok = 'of' AND {_ADJ.replace('(r,', '(y.r,')} AND y.next = lower(y.next) AND {_some(TERMINALS['Prep'], 'y.r2')}")
language("macros_include", '#define W Word<wff=/thin|ther|then/> interp(R.A="w")\n#include <part.cxx>\nS -> Art ${W};\n#undef W\n#GRAMMAR_ROOT S', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'w' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs p WHERE {_ADJ} AND next IN ('thin', 'ther', 'then')")
language("quoted_edges", 'S -> Word<fw, h-reg1> interp(R.A="first") Prep<~h-reg1>;', rf"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'first' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE pos = 0 AND regexp_matches(tok, '^[\p{{Lu}}][\p{{L}}]*$') AND {_some(TERMINALS['Prep'], 'r2')} AND NOT regexp_matches(next, '^[\p{{Lu}}]')")
language("last_word", 'A -> Prep Word; S -> A<wfl=/the|la/, wff=/of|de/> interp(R.A="x");', "SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'x' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE tok IN ('of', 'de') AND next IN ('the', 'la')")
language("head_word", 'A -> Prep Adj<rt>; S -> A<wfm=/der|the/> interp(R.A="x");', f"SELECT doc_id, sent_id, pos AS f, pos + 2 AS t, 'x' AS a, CAST(NULL AS VARCHAR) AS b, 'none' AS c FROM pairs WHERE {_PREP} AND next IN ('der', 'the')")
