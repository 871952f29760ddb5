"""The queries of the fact extractor, each over its whole table, with the same in SQL where it can be told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import facts as FA
from factloom.operators import gazetteer as GZ
from factloom.operators import grammar as G
from factloom.operators import tokens as TK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.charts(read(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str, neighbours: bool = False) -> DataFrame:
    return TK.tokens(read(spark, sf_dir, "documents"), neighbours=neighbours)


SENTS = r"""sents AS (
  SELECT doc_id, unnest(x) AS sentence, CAST(unnest(range(len(x))) AS BIGINT) AS sent_id
  FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+[.!?]*') AS x FROM documents))"""
TOKS = (
    SENTS
    + r""",
words AS (SELECT doc_id, sent_id, sentence, regexp_extract_all(sentence, '[\p{L}]+|[\p{N}]+|[^\p{L}\p{N}\s]') AS w FROM sents),
tokens AS (
  SELECT *, lower(tok) AS low, CASE WHEN pos > 0 THEN w[pos] END AS prev, w[pos + 2] AS next
  FROM (SELECT doc_id, sent_id, w, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS tok FROM words))"""
)


@query(f"WITH {SENTS} SELECT doc_id, sent_id, sentence FROM sents")
def text_sentences(spark, sf_dir):
    return TK.sentences(read(spark, sf_dir, "documents"))


@query(f"WITH {TOKS} SELECT doc_id, sent_id, pos, tok, low FROM tokens")
def text_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("doc_id", "sent_id", "pos", "tok", "low")


#: texts with what the tables lack (quotations, dates, times), added to ``documents`` by the queries about them
MORE = [(-1, 'She saw "Solaris" on 3.10.2011 at 19:30.'), (-2, 'Read «Dune» and "Ubik" today'), (-3, "Open 9:05-17:45, from 1/2/99 to 28-02-1999"), (-4, "31.02.2020 is no day, 29.2.2020 is; so is 1.1.30"), (-5, 'The "New York" office'), (-6, "25:10 or 12:60 are no times")]
_MORE = "(SELECT doc_id, text FROM documents UNION ALL VALUES " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in MORE) + ") AS more(doc_id, text)"


def and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(MORE, "doc_id long, text string"))


_KIND_SQL = " ".join("WHEN regexp_matches(tok, '{}') THEN '{}'".format(p.replace("'", "''"), k) for k, p in TK.KINDS)


@query(f"WITH {TOKS} SELECT kind, count(*) AS n, count(DISTINCT tok) AS n_distinct FROM (SELECT tok, CASE {_KIND_SQL} ELSE 'Symbol' END AS kind FROM tokens) GROUP BY kind")
def text_token_kinds(spark, sf_dir):
    kinds = tokens(spark, sf_dir).groupBy(TK.kind(F.col("tok")).alias("kind"), "tok").count()
    return kinds.groupBy("kind").agg(F.sum("count").alias("n"), F.count("*").alias("n_distinct"))


# --- tests of tokens: (name, Spark SQL, DuckDB SQL) -------------------------------------------------

def _rx(col: str, pattern: str) -> tuple[str, str]:
    return f"{col} RLIKE '{pattern}'".replace("\\", "\\\\"), f"regexp_matches({col}, '{pattern}')"


def _same(sql: str) -> tuple[str, str]:
    return sql, sql


_SET = "('of', 'in', 'de', 'la', 'und', 'der')"
TAGS: dict[str, tuple[str, str]] = {
    "h_reg1": _rx("tok", r"^[\p{Lu}\p{N}]"),
    "h_reg2": _rx("tok", r"^\p{Lu}(.*[^-])?\p{Lu}"),
    "l_reg": tuple(f"NOT {x}" for x in _rx("tok", r"^\p{Lu}")),
    "lat": _rx("tok", "^[A-Za-z]+$"),
    "not_lat": tuple(f"{w} AND NOT {x}" for w, x in zip(_rx("tok", r"^\p{L}+$"), _rx("tok", "^[A-Za-z]+$"), strict=True)),
    "fw": _same("pos = 0"),
    "not_fw": _same("pos > 0 AND low = 'the'"),
    "l_quoted": _same("""prev IN ('"', '«')"""),
    "r_quoted": _same("""next IN ('"', '»')"""),
    "quoted": _same("""prev IN ('"', '«') AND next IN ('"', '»')"""),
    "wff": _rx("tok", "^(?:th.*tion)$"),
    "wff_not": tuple(f"{w} AND NOT {x}" for w, x in zip(_rx("low", "^th"), _rx("low", "^(?:th.*[aeiou].*)$"), strict=True)),
    "kwset": _same(f"low IN {_SET}"),
    "kwset_not": _same(f"low LIKE 'd%' AND low NOT IN {_SET}"),
    "lemma_terminal": _same("low = 'that'"),
    "comma_terminal": _same("tok = ','"),
    "punct_terminal": _rx("tok", r"^[.,:;!?]$"),
    "bracket_terminal": _rx("tok", r"^[()\[\]{}]$"),
    "percent_dollar_terminal": _same("tok IN ('%', '$')"),
    "conjunction_terminal": _same("low IN ('and', 'et', 'und', 'y')"),
    "end_of_sentence_terminal": _same("next IS NULL AND tok IN ('.', '!', '?')"),
}


def _tag(name: str) -> None:
    spark_sql, duck_sql = TAGS[name]

    quoted = "quoted" in name

    def run(spark, sf_dir):
        found = TK.tokens(and_more(spark, sf_dir)) if quoted else tokens(spark, sf_dir, "prev" in spark_sql or "next" in spark_sql)
        return found.where(spark_sql).select("doc_id", "sent_id", "pos", "tok")

    run.__name__ = f"tag_{name}"
    toks = TOKS.replace("FROM documents", f"FROM {_MORE}") if quoted else TOKS
    query(f"WITH {toks} SELECT doc_id, sent_id, pos, tok FROM tokens WHERE {duck_sql}")(run)


for _name in TAGS:
    _tag(_name)


# --- gazetteer ---------------------------------------------------------------------------------------

#: article, kwtype, words, exact, mainword, lemma, label, weight
ENTRIES = [
    ("prep/of", "prep", ["of"], False, 1, "of", None, 1),
    ("prep/in", "prep", ["in"], False, 1, "in", None, 2),
    ("prep/de", "prep", ["de"], False, 1, "de", "latin", 1),
    ("article/the", "article", ["the"], False, 1, "the", None, 1),
    ("article/The", "title", ["The"], True, 1, "the", None, 1),
    ("article/la", "article", ["la"], False, 1, "la", "latin", 1),
    ("article/der", "article", ["der"], False, 1, "der", None, 1),
    ("conj/and", "conj", ["and"], False, 1, "and", None, 1),
    ("conj/und", "conj", ["und"], False, 1, "und", None, 1),
    ("phrase/of_the", "phrase", ["of", "the"], False, 2, "of the", None, 3),
    ("phrase/and_the", "phrase", ["and", "the"], False, 2, "and the", None, 3),
    ("phrase/in_that", "phrase", ["in", "that"], False, 2, "in that", None, 4),
    ("phrase/de_la", "phrase", ["de", "la"], False, 2, "de la", "latin", 5),
    ("pattern/the_x_of", "pattern", ["the", "*", "of"], False, 2, None, None, 2),
]
_LITERAL = ", ".join("({}, {}, [{}], {}, {}, {}, {}, {})".format(f"'{a}'", f"'{k}'", ", ".join(f"'{x}'" for x in w), e, m, f"'{le}'" if le else "NULL", f"'{la}'" if la else "NULL", wt) for a, k, w, e, m, le, la, wt in ENTRIES)
GAZ = f"gaz(article, kwtype, words, exact, mainword, lemma, label, weight) AS (VALUES {_LITERAL})"
HITS = f"""{TOKS}, {GAZ},
ends AS (SELECT *, CASE WHEN exact THEN 'tok' ELSE 'low' END AS how, len(words) AS n FROM gaz),
hits AS (
  SELECT t.doc_id, t.sent_id, t.pos AS f, t.pos + e.n AS t, e.article, e.kwtype, t.pos + e.mainword - 1 AS head, e.lemma, e.label, CAST(e.weight AS BIGINT) AS weight
  FROM tokens t JOIN ends e ON len(t.w) >= t.pos + e.n
   AND (e.words[1] = '*' OR (CASE WHEN e.exact THEN t.tok ELSE t.low END) = e.words[1])
   AND (e.n < 2 OR e.words[2] = '*' OR (CASE WHEN e.exact THEN t.w[t.pos + 2] ELSE lower(t.w[t.pos + 2]) END) = e.words[2])
   AND (e.n < 3 OR e.words[3] = '*' OR (CASE WHEN e.exact THEN t.w[t.pos + 3] ELSE lower(t.w[t.pos + 3]) END) = e.words[3]))"""


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, GZ.SCHEMA)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GZ.lookup(charts(spark, sf_dir), gazetteer(spark))


@query(f"WITH {HITS} SELECT doc_id, sent_id, f, t, article, kwtype, head FROM hits")
def gaz_phrase_lookup(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", "sent_id", "f", "t", "article", "kwtype", "head")


@query(f"WITH {HITS} SELECT doc_id, sent_id, f, t FROM hits WHERE kwtype = 'title'")
def gaz_exact_form(spark, sf_dir):
    return hits(spark, sf_dir).where("kwtype = 'title'").select("doc_id", "sent_id", "f", "t")


@query(f"WITH {HITS} SELECT doc_id, sent_id, f, t, head FROM hits WHERE kwtype = 'pattern'")
def gaz_wildcard(spark, sf_dir):
    return hits(spark, sf_dir).where("kwtype = 'pattern'").select("doc_id", "sent_id", "f", "t", "head")


@query(f"WITH {HITS} SELECT article, count(*) AS n FROM hits WHERE article LIKE 'phrase/%' GROUP BY article")
def gaz_article_folder(spark, sf_dir):
    return hits(spark, sf_dir).where(GZ.matches("phrase")).groupBy("article").agg(F.count("*").alias("n"))


@query(f"WITH {HITS} SELECT article, count(*) AS n FROM hits WHERE regexp_matches(article, '^.*_th.*$') GROUP BY article")
def gaz_article_mask(spark, sf_dir):
    return hits(spark, sf_dir).where(GZ.matches("*_th*")).groupBy("article").agg(F.count("*").alias("n"))


@query(f"WITH {HITS} SELECT doc_id, sent_id, f, label FROM hits WHERE label IS NOT NULL")
def gaz_light_label(spark, sf_dir):
    return hits(spark, sf_dir).where("label IS NOT NULL").select("doc_id", "sent_id", "f", "label")


@query(f"WITH {HITS} SELECT doc_id, sent_id, f, t FROM hits WHERE t - f > 1")
def tag_mw(spark, sf_dir):
    return hits(spark, sf_dir).where("t - f > 1").select("doc_id", "sent_id", "f", "t")


@query(f"WITH {HITS} SELECT DISTINCT t.doc_id, t.sent_id, t.pos FROM tokens t JOIN hits h ON t.doc_id = h.doc_id AND t.sent_id = h.sent_id AND t.pos = h.f AND h.t = h.f + 1 WHERE h.kwtype = 'prep'")
def tag_kwtype(spark, sf_dir):
    df = GZ.with_hits(charts(spark, sf_dir), gazetteer(spark))
    some = F.filter("toks", lambda x: F.exists("hits", lambda h: (h["f"] == x["pos"]) & (h["t"] == x["pos"] + 1) & (h["kwtype"] == "prep")))
    return df.select("doc_id", "sent_id", F.inline(some)).select("doc_id", "sent_id", "pos")


@query(f"WITH {HITS} SELECT doc_id, sent_id, pos, tok FROM tokens t WHERE low LIKE 'th%' AND NOT EXISTS (SELECT 1 FROM hits h WHERE t.doc_id = h.doc_id AND t.sent_id = h.sent_id AND t.pos = h.f AND h.t = h.f + 1)")
def tag_kwtype_none(spark, sf_dir):
    df = GZ.with_hits(charts(spark, sf_dir), gazetteer(spark))
    some = F.filter("toks", lambda x: x["low"].startswith("th") & ~F.exists("hits", lambda h: (h["f"] == x["pos"]) & (h["t"] == x["pos"] + 1)))
    return df.select("doc_id", "sent_id", F.inline(some)).select("doc_id", "sent_id", "pos", "tok")


@query(f"WITH {HITS} SELECT doc_id, sent_id, f, t, kwtype, CAST(weight * 100000000 AS BIGINT) AS user_weight FROM hits WHERE kwtype IN ('prep', 'phrase')")
def tag_gztweight(spark, sf_dir):
    return hits(spark, sf_dir).where("kwtype IN ('prep', 'phrase')").select("doc_id", "sent_id", "f", "t", "kwtype", (F.col("weight") * 100_000_000).alias("user_weight"))


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the column cover: the chosen spans of their hits."""
    df = TK.computed(GZ.with_hits(charts(spark, sf_dir), gazetteer(spark)).where(F.size("hits") > 0), {"spans": GZ.best(F.col("hits"))})
    return TK.computed(df, {"cover": G.cover(F.col("spans"))})


_COVER = f"""WITH RECURSIVE {HITS},
best AS (SELECT doc_id, sent_id, f, t, max(weight) AS w FROM hits GROUP BY ALL),
sets AS (SELECT doc_id, sent_id, list({{'f': f, 't': t, 'w': w}} ORDER BY t, f) AS s FROM best GROUP BY doc_id, sent_id),
dp AS (
  SELECT doc_id, sent_id, s, 0 AS i, CAST([] AS STRUCT(c BIGINT, w BIGINT, k BIGINT, t BIGINT, chosen BIGINT[])[]) AS sol FROM sets
  UNION ALL
  SELECT doc_id, sent_id, s, i + 1, list_append(sol, CASE WHEN rival IS NOT NULL AND (rival.c > mine.c OR rival.c = mine.c AND (rival.w > mine.w OR rival.w = mine.w AND rival.k < mine.k))
      THEN struct_pack(c := rival.c, w := rival.w, k := rival.k, t := mine.t, chosen := rival.chosen) ELSE mine END)
  FROM (
    SELECT *, struct_pack(c := coalesce(base.c, 0) + x.t - x.f, w := coalesce(base.w, 0) + x.w, k := coalesce(base.k, 0) + 1, t := x.t, chosen := list_append(coalesce(base.chosen, CAST([] AS BIGINT[])), i)) AS mine,
      list_sort([struct_pack(a := -y.c, b := -y.w, k := y.k, j := -list_position(sol, y), y := y) for y in sol if y.t > x.f])[1].y AS rival
    FROM (SELECT *, s[i + 1] AS x, [y for y in sol if y.t <= s[i + 1].f][-1] AS base FROM dp WHERE i < len(s)))
)
SELECT doc_id, sent_id, s[j + 1].f AS f, s[j + 1].t AS t FROM (SELECT doc_id, sent_id, s, unnest(sol[-1].chosen) AS j FROM dp WHERE i = len(s))"""


@query(_COVER)
def gaz_maximal_cover(spark, sf_dir):
    return covers(spark, sf_dir).select("doc_id", "sent_id", F.inline("cover")).select("doc_id", "sent_id", "f", "t")


_SUBSTITUTED = _COVER.replace("SELECT doc_id, sent_id, s[j + 1].f AS f", ", cover AS (SELECT doc_id, sent_id, s[j + 1].f AS f") + """),
placed AS (
  SELECT doc_id, sent_id, pos AS f, low AS word FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.doc_id = t.doc_id AND c.sent_id = t.sent_id AND c.f <= t.pos AND t.pos < c.t)
  UNION ALL
  SELECT c.doc_id, c.sent_id, c.f, string_agg(t.low, ' ' ORDER BY t.pos) FROM cover c JOIN tokens t ON c.doc_id = t.doc_id AND c.sent_id = t.sent_id AND c.f <= t.pos AND t.pos < c.t GROUP BY ALL)
SELECT doc_id, sent_id, CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY f) - 1 AS BIGINT) AS place, word FROM placed"""


@query(_SUBSTITUTED)
def gaz_substitute(spark, sf_dir):
    """The words of each sentence with covered ones replaced by their span."""
    df = TK.computed(GZ.with_hits(charts(spark, sf_dir), gazetteer(spark)), {"spans": GZ.best(F.col("hits"))})
    df = TK.computed(df, {"cover": G.cover(F.col("spans"))})
    return df.select("doc_id", "sent_id", F.posexplode(GZ.substitute(F.col("toks"), F.col("cover"))).alias("place", "x")).select("doc_id", "sent_id", F.col("place").cast("long").alias("place"), "x.word")


# --- grammar -----------------------------------------------------------------------------------------

def _is(*words: str):
    return lambda x: x["low"].isin(*words)


def _like(pattern: str):
    return lambda x: x["low"].rlike(f"^(?:{pattern})$")


TERMINALS = {
    "prep": (_is("of", "in", "de", "von"), "low IN ('of', 'in', 'de', 'von')"),
    "article": (_is("the", "a", "la", "der"), "low IN ('the', 'a', 'la', 'der')"),
    "tion": (_like(".*tion"), "regexp_matches(low, '^(?:.*tion)$')"),
    "th": (_like("th.*"), "regexp_matches(low, '^(?:th.*)$')"),
    "comma": (_is(",", "and"), "low IN (',', 'and')"),
}


def grammar(name: str, sql: str, *steps):
    """A query from functions of the columns so far (terminals, s0, s1, ..) to spans, and SQL over one table per terminal."""
    tables = ", ".join(f"{k} AS (SELECT doc_id, sent_id, pos AS f, pos + 1 AS t FROM tokens WHERE {c})" for k, (_, c) in TERMINALS.items())

    def run(spark, sf_dir):
        df = TK.computed(charts(spark, sf_dir), {k: G.terminal(F.col("toks"), test) for k, (test, _) in TERMINALS.items()})
        for i, step in enumerate(steps):
            df = TK.computed(df, {f"s{i}": step(F.col)})
        return df.select("doc_id", "sent_id", F.inline(f"s{len(steps) - 1}"))

    run.__name__ = f"rule_{name}"
    query(f"WITH RECURSIVE {TOKS}, {tables} {sql}")(run)


_ON = "ON x.doc_id = y.doc_id AND x.sent_id = y.sent_id AND y.f = x.t"


def _pair(a: str, b: str) -> str:
    return f"SELECT x.doc_id, x.sent_id, x.f, y.t FROM {a} x JOIN {b} y {_ON}"


grammar("sequence", _pair("prep", "article"), lambda c: G.seq(c("prep"), c("article")))
grammar("alternation", f"{_pair('prep', 'article')} UNION {_pair('prep', 'tion')}", lambda c: G.alt(G.seq(c("prep"), c("article")), G.seq(c("prep"), c("tion"))))
grammar("optional", f", pa AS ({_pair('prep', 'article')}) {_pair('prep', 'th')} UNION {_pair('pa', 'th')}", lambda c: G.opt_between(c("prep"), c("article"), c("th")))
_RUN = "run AS (SELECT * FROM th UNION SELECT x.doc_id, x.sent_id, x.f, y.t FROM run x JOIN th y " + _ON + ")"
_MAX = "SELECT doc_id, sent_id, min(f) AS f, max(t) AS t FROM (SELECT *, f - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY f) AS g FROM th) GROUP BY doc_id, sent_id, g"
_OUT = "SELECT * FROM tion r WHERE NOT EXISTS (SELECT 1 FROM run d WHERE r.doc_id = d.doc_id AND r.sent_id = d.sent_id AND d.f <= r.f AND r.f < d.t)"
_CO = f"co AS (SELECT * FROM th UNION SELECT x.doc_id, x.sent_id, x.f, z.t FROM co x JOIN comma y {_ON} JOIN th z ON z.doc_id = y.doc_id AND z.sent_id = y.sent_id AND z.f = y.t)"
_TRIM = "SELECT DISTINCT m.doc_id, m.sent_id, min(x.f) AS f, max(x.t) AS t FROM m JOIN tion x ON x.doc_id = m.doc_id AND x.sent_id = m.sent_id AND x.f >= m.f AND x.t <= m.t GROUP BY m.doc_id, m.sent_id, m.f, m.t"
_longest = lambda c: G.islands(c("th"))
grammar("plus", f", {_RUN} SELECT * FROM run", _longest, lambda c: G.token_runs(c("s0")))
grammar("star", f", {_RUN} SELECT * FROM tion UNION {_pair('run', 'tion')}", _longest, lambda c: G.token_runs(c("s0")), lambda c: G.alt(c("tion"), G.seq(c("s1"), c("tion"))))
grammar("coordination", f", {_CO} SELECT * FROM co", lambda c: G.coordinated(c("th"), c("comma")))
grammar("count", f", {_RUN} SELECT * FROM run WHERE t - f <= 2", _longest, lambda c: G.token_runs(c("s0"), 2))
grammar("maximal", _MAX, _longest)
grammar("dominance", f", {_RUN} {_OUT}", _longest, lambda c: G.outside(c("tion"), c("s0")))
grammar("trim", f", m AS ({_MAX}) {_TRIM}", _longest, lambda c: G.trim(c("s0"), c("tion")))


@query(f"WITH {TOKS} SELECT DISTINCT a.doc_id, a.sent_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos > a.pos AND b.pos - a.pos - 1 <= 2 WHERE a.low IN ('of', 'in', 'de', 'von') AND regexp_matches(b.low, '^(?:.*tion)$')")
def rule_filter(spark, sf_dir):
    df = TK.computed(charts(spark, sf_dir), {k: G.terminal(F.col("toks"), TERMINALS[k][0]) for k in ("prep", "tion")})
    return df.where(G.ordered(F.col("prep"), F.col("tion"), 2)).select("doc_id", "sent_id")


# --- facts -------------------------------------------------------------------------------------------

def _relations(spark, sf_dir) -> DataFrame:
    """Sentences with the column r: spans of a word, a preposition, and the word after it."""
    df = charts(spark, sf_dir)
    word = lambda x: x["low"].rlike(r"^\p{L}{3,}$")
    df = TK.computed(df, {"word": G.terminal(F.col("toks"), word), "prep": G.terminal(F.col("toks"), TERMINALS["prep"][0])})
    return TK.computed(df, {"r": G.seq(F.col("word"), F.col("prep"), F.col("word"))})


def _relation(spark, sf_dir, most: int | None = None) -> DataFrame:
    """Relation(what, place, kind)."""
    at = lambda i: (lambda s: F.element_at("toks", (s["f"] + i + 1).cast("int"))["low"])
    return FA.interpret(_relations(spark, sf_dir), F.col("r"), "Relation", {"what": at(0), "prep": at(1), "place": at(2), "kind": "word"}, most)


_RELATION = rf"""relation AS (
  SELECT doc_id, sent_id, 'Relation' AS fact_type, pos AS f, pos + 3 AS t, low AS what, lower(w[pos + 2]) AS prep, lower(w[pos + 3]) AS place, 'word' AS kind
  FROM tokens WHERE regexp_matches(low, '^[\p{{L}}]{{3,}}$') AND lower(w[pos + 2]) IN ('of', 'in', 'de', 'von') AND regexp_matches(lower(w[pos + 3]), '^[\p{{L}}]{{3,}}$'))"""


@query(f"WITH {TOKS}, {_RELATION} SELECT * FROM relation")
def fact_interpretation(spark, sf_dir):
    return _relation(spark, sf_dir)


@query(f"WITH {TOKS}, {_RELATION} SELECT * EXCLUDE (place), CASE WHEN place = 'the' THEN 'somewhere' ELSE place END AS place FROM relation WHERE what <> 'that'")
def fact_required_default(spark, sf_dir):
    facts = _relation(spark, sf_dir).withColumn("place", F.when(F.col("place") != "the", F.col("place"))).withColumn("what", F.when(F.col("what") != "that", F.col("what")))
    return FA.complete(facts, ["what"], {"place": "somewhere"})


@query(f"WITH {TOKS}, {_RELATION} SELECT doc_id, sent_id, f, what FROM relation QUALIFY count(*) OVER (PARTITION BY doc_id, sent_id, fact_type) <= 2")
def fact_cap(spark, sf_dir):
    return _relation(spark, sf_dir, 2).select("doc_id", "sent_id", "f", "what")


@query(f"WITH {TOKS}, {_RELATION} SELECT doc_id, sent_id, f, replace(upper(what), 'ẞ', 'SS') AS upper_form, replace(upper(what[1]), 'ẞ', 'SS') || what[2:] AS title_form FROM relation")
def fact_capitalization(spark, sf_dir):
    return _relation(spark, sf_dir).select("doc_id", "sent_id", "f", T.capitalize(F.col("what"), "UPPER").alias("upper_form"), T.capitalize(F.col("what"), "TITLE").alias("title_form"))


@query(f"WITH {TOKS}, {_RELATION} SELECT doc_id, sent_id, f, what || ' ' || place AS value FROM relation")
def fact_concatenation(spark, sf_dir):
    return _relation(spark, sf_dir).select("doc_id", "sent_id", "f", F.concat_ws(" ", "what", "place").alias("value"))


_LISTS = f"""{TOKS}, lists AS (
  SELECT doc_id, sent_id, list(low ORDER BY pos) FILTER (low IN ('of', 'in')) AS a, list(low ORDER BY pos) FILTER (regexp_matches(low, '^(?:.*tion)$')) AS b FROM tokens GROUP BY doc_id, sent_id)"""


@query(
    f"""WITH {_LISTS} SELECT doc_id, sent_id, CAST(i AS BIGINT) AS fact_id, a[CASE WHEN len(a) = 1 THEN 1 ELSE i + 1 END] AS a, b[CASE WHEN len(b) = 1 THEN 1 ELSE i + 1 END] AS b
    FROM (SELECT *, unnest(range(greatest(len(a), len(b)))) AS i FROM lists WHERE len(a) > 0 AND len(b) > 0 AND (len(a) = len(b) OR least(len(a), len(b)) = 1))"""
)
def fact_merge(spark, sf_dir):
    low = lambda test: F.transform(F.filter("toks", test), lambda x: x["low"])
    df = TK.computed(charts(spark, sf_dir), {"a": low(_is("of", "in")), "b": low(TERMINALS["tion"][0])}).where("size(a) > 0 AND size(b) > 0")
    return df.select("doc_id", "sent_id", F.posexplode(FA.merge(F.col("a"), F.col("b"))).alias("fact_id", "x")).select("doc_id", "sent_id", F.col("fact_id").cast("long").alias("fact_id"), "x.a", "x.b")


@query(
    f"""WITH {TOKS}, {_RELATION}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, what ORDER BY sent_id, f, fact_type) AS r FROM relation),
    pairs AS (SELECT a.doc_id, a.what, a.sent_id AS sent_id_a, a.f AS f_a, b.sent_id AS sent_id_b, b.f AS f_b, row_number() OVER (PARTITION BY a.doc_id, a.what ORDER BY b.r, a.r) AS n
      FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.what = b.what AND a.r < b.r)
    SELECT * EXCLUDE (n), CASE WHEN sent_id_a = sent_id_b AND f_a = f_b THEN 'SameEntry' WHEN sent_id_a = sent_id_b THEN 'SameSent' ELSE 'SameDocument' END AS kind FROM pairs WHERE n <= 1000"""
)
def doc_equal_facts(spark, sf_dir):
    return FA.equal_pairs(_relation(spark, sf_dir), "what")


@query(
    f"""WITH RECURSIVE {TOKS}, {_RELATION}, node AS (SELECT doc_id, sent_id, f, what, place, sent_id * 4294967296 + f AS id FROM relation),
    edge AS (SELECT DISTINCT a.doc_id, a.id AS x, b.id AS y FROM node a JOIN node b ON a.doc_id = b.doc_id AND (a.what = b.what OR a.place = b.place)),
    reach AS (SELECT doc_id, x, y FROM edge UNION SELECT r.doc_id, r.x, e.y FROM reach r JOIN edge e ON r.doc_id = e.doc_id AND r.y = e.x)
    SELECT n.doc_id, n.sent_id, n.f, CAST(min(r.y) AS BIGINT) AS group_id FROM node n JOIN reach r ON n.doc_id = r.doc_id AND n.id = r.x GROUP BY n.doc_id, n.sent_id, n.f"""
)
def doc_groups(spark, sf_dir):
    """Facts of a document that share a value, through others too."""
    return FA.groups(_relation(spark, sf_dir), ["what", "place"])


@query(f"WITH {TOKS}, {_RELATION} SELECT chr(123) || '\"doc_id\":' || doc_id || ',\"sent_id\":' || sent_id || ',\"type\":\"Relation\",\"fields\":' || chr(123) || '\"what\":\"' || what || '\",\"place\":\"' || place || '\"' || chr(125) || chr(125) AS value FROM relation")
def sink_json(spark, sf_dir):
    from factloom.sources.sinks import json_lines

    return json_lines(_relation(spark, sf_dir), ["what", "place"])


@query(f"WITH {TOKS}, {_RELATION} SELECT doc_id, sent_id, substr(sentence, 1, 400) AS lead, CAST(length(substr(sentence, 1, 400)) AS BIGINT) AS n_chars, CAST(strlen(substr(sentence, 1, 400)) AS BIGINT) AS n_bytes FROM sents s WHERE EXISTS (SELECT 1 FROM relation r WHERE r.doc_id = s.doc_id AND r.sent_id = s.sent_id)")
def sink_leads(spark, sf_dir):
    return _relations(spark, sf_dir).where(F.size("r") > 0).select("doc_id", "sent_id", *FA.lead_of())


@query(f"WITH {TOKS}, {_RELATION} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM sents) AS sentences, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_id FROM relation)) AS touched")
def doc_counters(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    touched = _relations(spark, sf_dir).where(F.size("r") > 0).agg(F.count("*").alias("touched"))
    # three one-row frames, joined by a constant key
    parts = [docs.agg(F.count("*").alias("documents")), TK.sentences(docs).agg(F.count("*").alias("sentences")), touched]
    one, two, three = (p.withColumn("k", F.lit(1)) for p in parts)
    return one.join(two, "k").join(three, "k").drop("k")


@query(f"WITH {TOKS}, {_RELATION} SELECT doc_id, sent_id, string_agg(chr(9) || 'Relation' || chr(10) || chr(9) || chr(123) || chr(10) || chr(9) || chr(9) || 'place = ' || place || chr(10) || chr(9) || chr(9) || 'what = ' || what || chr(10) || chr(9) || chr(125) || chr(10), '' ORDER BY f) AS text FROM relation GROUP BY doc_id, sent_id")
def sink_text(spark, sf_dir):
    from factloom.sources.sinks import text_blocks

    return text_blocks(_relation(spark, sf_dir), ["place", "what"])


# --- algorithms --------------------------------------------------------------------------------------

_TEXTS = "SELECT doc_id, unnest({}) AS value FROM documents"


@query(
    rf"""SELECT doc_id, value FROM (
      SELECT doc_id, CAST(try_cast(lpad(CASE WHEN length(y) <= 2 THEN CASE WHEN CAST(y AS INT) < 30 THEN CAST(2000 + CAST(y AS INT) AS VARCHAR) ELSE CAST(1900 + CAST(y AS INT) AS VARCHAR) END WHEN CAST(y AS INT) BETWEEN 1000 AND 3000 THEN y END, 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0') AS DATE) AS VARCHAR) AS value
      FROM (SELECT doc_id, regexp_extract(x, '(\d+)\D+(\d+)\D+(\d+)', 1) AS d, regexp_extract(x, '(\d+)\D+(\d+)\D+(\d+)', 2) AS m, regexp_extract(x, '(\d+)\D+(\d+)\D+(\d+)', 3) AS y
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d{{1,2}})[./\\-](\d{{1,2}})[./\\-](\d{{4}}|\d{{2}})\b')) AS x FROM {_MORE}))) WHERE value IS NOT NULL"""
)
def alg_date(spark, sf_dir):
    return and_more(spark, sf_dir).select("doc_id", F.explode(T.dates(F.col("text"))).alias("value"))


@query(rf"SELECT doc_id, CAST(split_part(x, ':', 1) AS BIGINT) * 60 + CAST(split_part(x, ':', 2) AS BIGINT) AS minute FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b([01]?\d|2[0-3]):([0-5]\d)\b')) AS x FROM {_MORE})")
def alg_time(spark, sf_dir):
    return and_more(spark, sf_dir).select("doc_id", F.explode(T.times(F.col("text"))).alias("minute"))


@query(rf"SELECT doc_id, regexp_extract(x, '\x22(.*)\x22', 1) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\x22([^\x22.,;:!?\n]+)\x22')) AS x FROM {_MORE})")
def alg_quoted(spark, sf_dir):
    return and_more(spark, sf_dir).select("doc_id", F.explode(T.quoted(F.col("text"))).alias("value"))


@query(r"SELECT doc_id, CAST(replace(x, ',', '.') AS DOUBLE) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:[.,]\d+)?')) AS x FROM documents)")
def alg_number(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.numbers(F.col("text"))).alias("value"))


@query(f"WITH {TOKS}, {_RELATION}, v AS (SELECT DISTINCT doc_id, what FROM relation) SELECT t.doc_id, t.sent_id, t.pos, t.low AS value FROM tokens t JOIN v ON t.doc_id = v.doc_id AND t.low = v.what")
def alg_in_text(spark, sf_dir):
    """Values of a document's facts, found again in its other sentences."""
    values = _relation(spark, sf_dir).select("doc_id", F.col("what").alias("value")).distinct()
    return tokens(spark, sf_dir).withColumn("value", F.col("low")).join(values, ["doc_id", "value"]).select("doc_id", "sent_id", "pos", "value")


SUFFIXES = [("tion", "tio"), ("ion", "io"), ("ung", "ung"), ("ment", "men"), ("ent", "en"), ("ing", "")]
_SUFFIX_SQL = ", ".join(f"('{a}', '{b}')" for a, b in SUFFIXES)


@query(
    f"WITH {TOKS}, suffix(s, e) AS (VALUES {_SUFFIX_SQL}), words_ AS (SELECT DISTINCT low FROM tokens) SELECT low AS word, left(low, length(low) - length(s)) || e AS lemma FROM words_ JOIN suffix ON ends_with(low, s) AND length(low) > length(s) QUALIFY row_number() OVER (PARTITION BY low ORDER BY length(s) DESC) = 1"
)
def alg_suffix_prediction(spark, sf_dir):
    """Lemmas by the longest known suffix of each distinct word."""
    words = tokens(spark, sf_dir).select("low").distinct()
    lemma = F.lit(None).cast("string")
    for s, e in sorted(SUFFIXES, key=lambda x: len(x[0])):
        lemma = F.when(F.col("low").endswith(s) & (F.length("low") > len(s)), F.concat(F.expr(f"left(low, length(low) - {len(s)})"), F.lit(e))).otherwise(lemma)
    return words.select(F.col("low").alias("word"), lemma.alias("lemma")).where("lemma IS NOT NULL")


@query("SELECT page_id, regexp_replace(url, '^(http://)+', '') AS address FROM pages")
def source_url_lookup(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^(http://)+", "").alias("address"))


_HTML = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)^.*?<body[^>]*>', ''), '(?is)<(style|applet|script|select|textarea|banner|frameset|object)\b[^>]*>.*?</(style|applet|script|select|textarea|banner|frameset|object)>', ' ', 'g'), '(?is)<!--.*?-->', '', 'g'),
  '(?i)<br[^>]*>\s*<br[^>]*>|</?(p|table|h[1-6]|hr|dl)\b[^>]*>', chr(10) || chr(10), 'g'), '(?i)<(tr|th|td|li|dd|dt)\b[^>]*>', chr(10), 'g'), '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS text FROM pages"""


@query(_HTML)
def source_html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


_GRAMMAR = r"""
#define ENDS .*tion
#GRAMMAR_ROOT S
Prep -> 'of' | 'in' | 'de';
Noun -> Word<wff=/${ENDS}/>;
S -> Prep ('the') Noun | Noun<fw> 'and' Word<~l-reg>;
"""


@query(
    rf"""WITH {TOKS} SELECT doc_id, sent_id, pos AS f, pos + 2 AS t FROM tokens WHERE low IN ('of', 'in', 'de') AND regexp_matches(w[pos + 2], '^(?:.*tion)$') AND regexp_matches(w[pos + 2], '^[\p{{L}}]+$')
    UNION SELECT doc_id, sent_id, pos, pos + 3 FROM tokens WHERE low IN ('of', 'in', 'de') AND lower(w[pos + 2]) = 'the' AND regexp_matches(w[pos + 3], '^(?:.*tion)$') AND regexp_matches(w[pos + 3], '^[\p{{L}}]+$')
    UNION SELECT doc_id, sent_id, pos, pos + 3 FROM tokens WHERE pos = 0 AND regexp_matches(tok, '^(?:.*tion)$') AND regexp_matches(tok, '^[\p{{L}}]+$') AND lower(w[2]) = 'and' AND regexp_matches(w[3], '^[\p{{Lu}}]') AND regexp_matches(w[3], '^[\p{{L}}]+$')"""
)
def grammar_text(spark, sf_dir):
    """A grammar in its language, compiled to a plan."""
    from factloom.plans import grammar as PG

    return PG.apply(charts(spark, sf_dir), PG.parse(_GRAMMAR)).select("doc_id", "sent_id", F.inline("spans"))
