"""Words and their readings: a pluggable lexicon, a suffix guesser, grammemes as bit masks, agreement.

A lexicon is a DataFrame (form, lemma, pos, grams array<string>, predicted boolean), a row per form and
reading. Rows of one lemma and part of speech are one homonym with several forms. As columns: ``readings``
joins tokens to a lexicon by the lower-cased word, and a set of grammemes is one long, so constraints
and agreement are bit operations. As Python objects (``Lexicon``): what the chart parser uses.

Defined cases: a word that the lexicon lacks has no reading (``readings`` drops it or keeps it with nulls);
equal rows count once; unknown grammeme names are an error; an empty lexicon knows no word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: grammeme names, Latin and Cyrillic
GRAMS = "A ADV ADVPRO ANUM APRO COM CONJ INTJ NUM PART PR S SPRO V anim inan sg pl m f n mf nom gen dat acc ins loc abl voc brev plen poss supr comp 1p 2p 3p praes inpraes praet fut ipf pf act pass partcp ger inf indic imper tran intr reflex praed geo persn famn patrn abbr".split()
NATIVE = dict(zip("од неод ед мн муж жен сред мж им род дат вин твор местн пр зват кр полн притяж прев срав 1-л 2-л 3-л наст непрош прош буд несов сов действ страд прич деепр инф изъяв пов пе нп возвр прдк гео имя фам отч сокр".split(), "anim inan sg pl m f n mf nom gen dat acc ins loc abl voc brev plen poss supr comp 1p 2p 3p praes inpraes praet fut ipf pf act pass partcp ger inf indic imper tran intr reflex praed geo persn famn patrn abbr".split(), strict=True))
_ALIASES = NATIVE | {"instr": "ins", "prep": "abl", "mas": "m", "fem": "f", "neu": "n", "plur": "pl"}
BIT = {g: 1 << i for i, g in enumerate(GRAMS)}


def mask(grams: Iterable[str] | str) -> int:
    found = 0
    for g in grams.split(",") if isinstance(grams, str) else grams:
        g = g.strip().strip("\"'")
        if g:
            name = _ALIASES.get(g, g)
            if name not in BIT:
                raise ValueError(f"unknown grammeme {g}")
            found |= BIT[name]
    return found


CASE = mask("nom,gen,dat,acc,ins,loc,abl,voc")
NUMBER = mask("sg,pl")
GENDER = mask("m,f,n,mf")
PERSON = mask("1p,2p,3p")
POS = mask("A,ADV,ADVPRO,ANUM,APRO,COM,CONJ,INTJ,NUM,PART,PR,S,SPRO,V")
NAMES = mask("persn,famn,patrn")


# --- agreement: of two sets of grammemes, ints or columns alike ---------------------------------------------

def _case(a, b):
    return _meet(a, b, CASE)


def _number(a, b):
    return _meet(a, b, NUMBER)


def _gender(a, b):
    """Plural forms have no gender to agree in, common gender agrees with all but neuter."""
    both = _meet(a, b, GENDER)
    plural = (_bits(a, BIT["pl"]) != 0) & (_bits(b, BIT["pl"]) != 0)
    common = ((_bits(a, BIT["mf"]) != 0) & (_bits(b, BIT["m"] | BIT["f"]) != 0)) | ((_bits(b, BIT["mf"]) != 0) & (_bits(a, BIT["m"] | BIT["f"]) != 0))
    return both | plural | common


def _meet(a, b, m: int):
    return a.bitwiseAND(b).bitwiseAND(F.lit(m)) != 0 if isinstance(a, Column) else a & b & m != 0


def _bits(x, m: int):
    return x.bitwiseAND(F.lit(m)) if isinstance(x, Column) else x & m


def agree(kind: str, a, b):
    """Whether a form with grammemes ``a`` and one with ``b`` agree; for longs as columns too."""
    has = lambda x, g: _bits(x, mask(g)) != 0
    gnc = lambda: _gender(a, b) & _number(a, b) & _case(a, b)
    rules = {
        "gnc-agr": gnc,
        "nc-agr": lambda: _number(a, b) & _case(a, b),
        "c-agr": lambda: _case(a, b),
        "gn-agr": lambda: _gender(a, b) & _number(a, b),
        "gc-agr": lambda: _gender(a, b) & _case(a, b),
        "n-agr": lambda: _number(a, b),
        # subject and predicate: past and short forms by gender and number, imperatives by the second person, others by person and number
        "sp-agr": lambda: has(a, "nom")
        & (
            ((has(b, "praet") | has(b, "brev")) & _number(a, b) & (_gender(a, b) | has(a, "1p") | has(a, "2p")))
            | (has(b, "imper") & has(a, "2p"))
            | (~_b(has(b, "praet") | has(b, "brev") | has(b, "imper")) & _number(a, b) & (has(b, "3p") & ~_b(has(a, "1p") | has(a, "2p")) | (_meet(a, b, PERSON))))
        ),
        # a woman's name agrees with a masculine word
        "fem-c-agr": lambda: _case(a, b) & _number(a, b) & (_gender(a, b) | (has(a, "f") & (has(a, "famn") | has(a, "persn"))) | (has(b, "f") & (has(b, "famn") | has(b, "persn")))),
        # after a numeral: both in the genitive, the adjective in the plural; or as usual
        "after-num-agr": lambda: (has(a, "gen") & has(b, "gen") & has(a, "pl")) | gnc(),
        # izafet: a noun in the nominative or genitive, and one with a possessive ending
        "izf-agr": lambda: has(a, "S") & (has(a, "nom") | has(a, "gen")) & has(b, "S") & has(b, "poss"),
        "any-agr": lambda: _case(a, a) | ~_b(_case(a, a)),
    }
    out = rules[kind]()
    return out if isinstance(out, Column) else bool(out)


class _Truth(int):
    def __invert__(self):
        return _Truth(not self)


def _b(x):
    return x if isinstance(x, Column) else _Truth(bool(x))


# --- columns ------------------------------------------------------------------------------------------------

BROADCAST_FORMS = 300_000


def masks(lexicon: DataFrame) -> DataFrame:
    """form, lemma, pos, g (grammemes as a long) and predicted; part of speech is among the grammemes."""
    known = F.create_map(*[F.lit(x) for g, bit in ({g: BIT[g] for g in GRAMS} | {a: BIT[g] for a, g in _ALIASES.items()}).items() for x in (g, bit)])
    g = F.aggregate(F.array_union("grams", F.array("pos")), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.element_at(known, x).cast("long")))
    return lexicon.select("form", "lemma", "pos", g.alias("g"), F.coalesce("predicted", F.lit(False)).alias("predicted")).distinct()


def readings(tokens: DataFrame, lexicon: DataFrame, word: str = "low", how: str = "inner") -> DataFrame:
    """``tokens`` with lemma, pos, g and predicted, a row per reading: a hash join by the word, broadcast up to
    ``BROADCAST_FORMS`` forms of the lexicon."""
    forms = masks(lexicon)
    if forms.count() <= BROADCAST_FORMS:
        forms = F.broadcast(forms)
    return tokens.join(forms, tokens[word] == forms["form"], how).drop("form")


def with_readings(tokens: DataFrame, lexicon: DataFrame, word: Column, name: str) -> DataFrame:
    """``tokens`` with the column ``name``: all readings of a word as an array of (lemma, pos, g, predicted), empty for
    words that the lexicon lacks. One join, broadcast up to ``BROADCAST_FORMS`` forms: no row of tokens is repeated."""
    forms = masks(lexicon)
    total = forms.count()
    forms = forms.groupBy(F.col("form").alias("_form")).agg(F.array_sort(F.collect_list(F.struct("lemma", "pos", "g", "predicted"))).alias(name))
    joined = tokens.withColumn("_word", word).join(F.broadcast(forms) if total <= BROADCAST_FORMS else forms, F.col("_word") == F.col("_form"), "left").drop("_word", "_form")
    return joined.withColumn(name, F.coalesce(name, F.slice(F.array(F.struct(F.lit("").alias("lemma"), F.lit("").alias("pos"), F.lit(0).cast("long").alias("g"), F.lit(False).alias("predicted"))), 1, 0)))


def has(g: Column, grams: str, every: bool = True) -> Column:
    """Whether a set of grammemes has all (or any) of some."""
    m = mask(grams)
    return g.bitwiseAND(F.lit(m)) == m if every else g.bitwiseAND(F.lit(m)) != 0


def fits(readings: Column, grams: str) -> Column:
    """gram="a,~b": a form has all of a, and none has any of b."""
    want = [x.strip() for x in grams.split(",")]
    need, bad = [x for x in want if not x.startswith("~")], [x[1:] for x in want if x.startswith("~")]
    out = F.exists(readings, lambda r: has(r["g"], ",".join(need)))
    for b in bad:
        out = out & ~F.exists(readings, lambda r: has(r["g"], b))  # noqa: B023
    return out


def union_fits(readings: Column, text: str) -> Column:
    """GU: alternatives by |; [a,b] a form has all, &[a,b] the union of a homonym's forms, ~[a,b] no form any."""
    out = F.lit(False)
    for part in text.split("|"):
        grams = part.strip().lstrip("~&").strip("[] ")
        if part.strip().startswith("~"):
            out = out | ~F.exists(readings, lambda r: has(r["g"], grams, False))  # noqa: B023
        elif part.strip().startswith("&"):
            whole = lambda x: F.aggregate(F.filter(readings, lambda r: (r["lemma"] == x["lemma"]) & (r["pos"] == x["pos"])), F.lit(0).cast("long"), lambda acc, r: acc.bitwiseOR(r["g"]))
            out = out | F.exists(readings, lambda x: has(whole(x), grams))  # noqa: B023
        else:
            out = out | F.exists(readings, lambda r: has(r["g"], grams))  # noqa: B023
    return out


def agreeing(kind: str, left: Column, right: Column) -> Column:
    """Whether a form of the left readings agrees with one of the right ones."""
    return F.exists(left, lambda x: F.exists(right, lambda y: agree(kind, x["g"], y["g"])))


def is_terminal(name: str, g: Column) -> Column:
    """Terminals that speak of a reading, as in ``plans/chart``."""
    has = lambda x: g.bitwiseAND(F.lit(mask(x))) != 0
    return {
        "Noun": has("S") & ~has("persn,famn,patrn,abbr"),
        "Adj": has("A,partcp,ANUM,APRO") & ~has("brev"),
        "AdjPartOrdNum": has("A,partcp,ANUM,APRO"),
        "OrdinalNumeral": has("ANUM"),
        "Adv": has("ADV,ADVPRO"),
        "Participle": has("partcp"),
        "Verb": has("V") & ~has("partcp,ger,inf"),
        "Infinitive": has("inf"),
        "Prep": has("PR"),
    }[name]


def analyze_words(tokens: DataFrame, lexicon: DataFrame, word: str = "low") -> DataFrame:
    """Distinct words with ``homonyms``: an array of (lemma, pos, predicted, forms array<long>), sorted."""
    words = tokens.select(F.col(word).alias("form")).distinct()
    forms = masks(lexicon)
    joined = words.join(F.broadcast(forms) if forms.count() <= BROADCAST_FORMS else forms, "form")
    homs = joined.groupBy("form", "lemma", "pos", "predicted").agg(F.array_sort(F.collect_set("g")).alias("forms"))
    return homs.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("lemma", "pos", "predicted", "forms"))).alias("homonyms"))


def guess(words: DataFrame, suffixes: DataFrame, word: str = "word") -> DataFrame:
    """word, lemma, pos, grams and size by known endings (suffix, ending, pos, grams): of each part of speech and
    grammemes the longest suffix that fits; words of at most the suffix are not guessed."""
    sizes = [r[0] for r in suffixes.select(F.length("suffix")).distinct().collect()]  # a row a length
    tails = F.filter(F.array(*[F.when(F.length(word) > n, F.right(F.col(word), F.lit(n))) for n in sorted(sizes)]), lambda x: x.isNotNull()) if sizes else F.array().cast("array<string>")
    rows = words.select(word, F.explode(tails).alias("suffix")).join(F.broadcast(suffixes) if suffixes.count() <= BROADCAST_FORMS else suffixes, "suffix")
    stem = F.expr(f"left({word}, length({word}) - length(suffix))")
    found = rows.select(word, F.concat(stem, "ending").alias("lemma"), "pos", "grams", F.length("suffix").alias("size"))
    return found.groupBy(word, "pos", "grams").agg(F.max_by("lemma", F.struct("size", "lemma")).alias("lemma"), F.max("size").alias("size"))


def normalize_unicode(column: Column, form: str = "NFC") -> Column:
    """Unicode normal form (NFC, NFD, NFKC, NFKD), by Arrow batches."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run(column)


# --- objects ------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Homonym:
    lemma: str
    pos: str
    forms: tuple[int, ...]
    predicted: bool = False
    kwtypes: frozenset[str] = frozenset()
    labels: frozenset[str] = frozenset()
    article: str = ""

    @property
    def grams(self) -> int:
        out = 0
        for f in self.forms:
            out |= f
        return out


def plain(word: str) -> str:
    return word.lower().replace("ё", "е")


@dataclass
class Lexicon:
    """Forms and paradigms. ``bastards``: which predicted readings count: no, outOfDict (for words without others), always."""

    rows: list[tuple[str, str, str, str, bool]] = field(default_factory=list)  # form, lemma, pos, grammemes, predicted
    suffixes: list[tuple[str, str, str, str]] = field(default_factory=list)  # suffix, lemma's ending, pos, grammemes
    bastards: str = "no"

    def __post_init__(self) -> None:
        self.by_form: dict[str, dict[tuple, set[int]]] = {}
        self.paradigm: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for form, lemma, pos, grams, predicted in self.rows:
            m = mask(grams) | mask(pos)
            self.by_form.setdefault(plain(form), {}).setdefault((plain(lemma), pos, bool(predicted)), set()).add(m)
            self.paradigm.setdefault((plain(lemma), pos), []).append((plain(form), m))
        self.rules = sorted(((plain(s), plain(e), pos, mask(g) | mask(pos)) for s, e, pos, g in self.suffixes), key=lambda r: -len(r[0]))

    @classmethod
    def of(cls, lexicon: DataFrame | None, suffixes: DataFrame | None = None, bastards: str = "no") -> Lexicon:
        """Collected to the driver, from where it travels with the parser's function: a dictionary, not data."""
        rows = [(r.form, r.lemma, r.pos, ",".join(r.grams), bool(r.predicted)) for r in lexicon.collect()] if lexicon is not None else []
        more = [(r.suffix, r.ending, r.pos, ",".join(r.grams)) for r in suffixes.collect()] if suffixes is not None else []
        return cls(rows, more, bastards)

    def homonyms(self, word: str) -> tuple[Homonym, ...]:
        key = plain(word)
        found = [Homonym(lemma, pos, tuple(sorted(fs)), p) for (lemma, pos, p), fs in self.by_form.get(key, {}).items()]
        sure = [h for h in found if not h.predicted]
        if self.bastards == "no" or (self.bastards == "outOfDict" and sure):
            return tuple(sure)
        guessed: dict[tuple[str, str], set[int]] = {}
        seen = {f for h in found for f in h.forms}
        size = None
        for suffix, ending, pos, m in self.rules:
            if len(key) > len(suffix) and key.endswith(suffix):
                if size is not None and len(suffix) < size and m in seen:
                    continue  # a shorter suffix adds new grammemes only
                size = len(suffix) if size is None else size
                seen.add(m)
                guessed.setdefault((key[: len(key) - len(suffix)] + ending, pos), set()).add(m)
        return tuple(found) + tuple(Homonym(lemma, pos, tuple(sorted(fs)), True) for (lemma, pos), fs in guessed.items())

    def inflect(self, lemma: str, pos: str, want: int, have: int = 0) -> str:
        """The form of a lemma that has all wanted grammemes and most of those it had; the lemma if there is none."""
        forms = list(self.paradigm.get((plain(lemma), pos), ()))
        for suffix, ending, p, m in self.rules:
            if p == pos and plain(lemma).endswith(ending):
                forms.append((plain(lemma)[: len(lemma) - len(ending)] + suffix if ending else plain(lemma) + suffix, m))
        good = [(f, m) for f, m in forms if m & want == want]
        return max(good, key=lambda x: (bin(x[1] & have).count("1"), x[0] == plain(lemma)))[0] if good else lemma


@cache
def gender_of(grams: int) -> int:
    return grams & GENDER
