"""A whole project (dictionary, grammars, fact types, configuration) as one narrow map over sentences.

Everything is read and checked on the driver and travels with the function. A sentence is parsed on its own: words get their
readings, keys of the articles that a grammar names are looked up (of grammars among them, too: these run first,
once a sentence), a maximal cover of the longer ones takes the place of their words, the chart is parsed, the best parses are
chosen, and their facts become rows. Nothing is shuffled; a row of the output belongs to one sentence.

Only stretches of words that can hold a parse are parsed, and each kind of stretch once in a task (``plans/stretches``); what
that does not serve is parsed as a whole sentence, with the same rows.

Defined cases: null and empty texts have no sentence; repeated rows give their facts each; a null id stays
null; extra columns are dropped; sentences of any length are read, a chain of more than a rule's ``count`` words is no chain.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.operators import tokens as TK
from factloom.operators.morphology import BIT, Homonym, Lexicon, agree, mask, plain
from factloom.plans import algorithms, batches, chart, stretches
from factloom.plans import dictionary as D
from factloom.plans import language as L
from factloom.plans.chart import Fact, Unit, Value

WORD = re.compile(r"[^\W\d_]+(?:[-–][^\W\d_]+)*|\d+|[^\w\s]|_")
PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")  # words with a hyphen are three tokens
#: the same of ASCII texts, by plain ranges
_ASCII = r"|[0-9]+|[\x00-\x08\x0e-\x1b!-/:-@\[-`{-~\x7f]"
ASCII_WORD, ASCII_PARTS = re.compile("[A-Za-z]+(?:-[A-Za-z]+)*" + _ASCII), re.compile("[A-Za-z]+" + _ASCII)
SCHEMA = "doc_id long, sent_id long, fact_id long, article string, fact_type string, f long, t long, c_from long, c_to long, fields map<string,string>, weight long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "sent_id", "fact_id")] + [("article", pa.string()), ("fact_type", pa.string())] + [(n, pa.int64()) for n in ("f", "t", "c_from", "c_to")] + [("fields", pa.map_(pa.string(), pa.string())), ("weight", pa.int64())])
MAX_FACTS = 25


@dataclass(frozen=True)
class Key:
    words: tuple[str, ...]  # * any word, !word as it stands, $name another article's match
    article: str
    grams: int = 0
    forbidden: int = 0
    case: str = ""
    agree: str = ""
    lang: str = ""
    mainword: int = 1
    exact: bool = False


@dataclass(frozen=True)
class Hit:
    f: int
    t: int
    article: str
    kind: str
    head: int
    lemma: str = ""
    facts: tuple[Fact, ...] = ()
    homonyms: tuple[Homonym, ...] = ()
    matched: frozenset[str] = frozenset()


@dataclass
class Project:
    dictionary: D.Dictionary
    articles: list[str]  # to run
    facts: list[str]  # to give
    lexicon: Lexicon
    most: int = MAX_FACTS
    files: dict[str, str] = field(default_factory=dict)
    hyphens: bool = True

    @classmethod
    def read(cls, folder: str, config: str = "config.proto", lexicon: Lexicon | None = None) -> Project:
        files = {}
        for base, _, names in os.walk(folder):
            for n in names:
                if n.endswith((".gzt", ".proto", ".cxx", ".txt", ".gztproto")):
                    with open(os.path.join(base, n), encoding="utf-8") as f:
                        files[os.path.relpath(os.path.join(base, n), folder)] = f.read()
        return cls.of(files, config, lexicon)

    @classmethod
    def of(cls, files: dict[str, str], config: str = "config.proto", lexicon: Lexicon | None = None) -> Project:
        settings = next(a for a in D.parse(files[config]).articles if a.type == "TTextMinerConfig").fields
        name = lambda block: block["Name"][0] if isinstance(block, dict) else block
        lexicon = lexicon or Lexicon()
        if "BastardMode" in settings:
            lexicon = Lexicon(lexicon.rows, lexicon.suffixes, settings["BastardMode"][0])
        load = cls._loader(files)
        found = D.parse(load(settings["Dictionary"][0]), load)
        return cls(found, [name(a) for a in settings.get("Articles", [])], [name(f) for f in settings.get("Facts", [])], lexicon, int(settings.get("MaxFactsCountPerSentence", [MAX_FACTS])[0]), files)

    @staticmethod
    def _loader(files: dict[str, str]) -> Callable[[str], str]:
        def load(name: str) -> str:
            name = re.sub("/+", "/", name)
            if name not in files:
                raise D.DictionaryError(f"no file {name}")
            return files[name]

        return load

    def compile(self) -> Compiled:
        load = self._loader(self.files)
        out = Compiled(self)
        for a in self.dictionary.articles:
            out.kinds[a.name] = a.type
            lemma = a.one("lemma")
            if isinstance(lemma, dict):
                out.lemmas[a.name] = (str(lemma.get("text", lemma.get("", [""]))[0]), str(lemma.get("always", ["false"])[0]) == "true")
            elif lemma:
                out.lemmas[a.name] = (str(lemma), False)
            if str(a.one("light_kw", "false")) == "true":
                out.light.add(a.name)
            if a.one("geopart"):
                out.geo[a.name] = str(a.one("geopart"))
            out.numbers[a.name] = tuple((n, float(v[0])) for n, v in a.fields.items() if isinstance(v[0], int | float))
            for key in a.fields.get("key", []):
                self._key(a, key, out, load)
        for kinds in out.grammars.values():
            for g in kinds:
                for target in (t for r in g.rules for i in r.items for t in i.interp):
                    fields = {f.name for f in self.dictionary.fields(target.fact)}
                    if fields and target.name not in fields:
                        raise L.GrammarError(f"{target.fact} has no field {target.name}")
        return out

    def _key(self, a: D.Article, key, out: Compiled, load) -> None:
        block = key if isinstance(key, dict) else {"": [key]}
        kind = str(block.get("type", ["text"])[0])
        main = int(block.get("mainword", a.fields.get("mainword", [1]))[0]) or 1
        for text in block.get("text", block.get("", [])):
            if kind == "CUSTOM":
                prefix, _, name = str(text).partition(":")
                if prefix == "tomita":
                    out.grammars.setdefault(a.name, []).append(L.parse(load(name), load))
                elif prefix == "alg" and name in algorithms.REGISTRY:
                    out.algorithms.setdefault(a.name, []).append(name)
                else:
                    raise D.DictionaryError(f"unknown key {text}")
                continue
            grams = [g.strip() for g in str(block.get("gram", [""])[0]).split(",") if g.strip()]
            for line in load(str(text)).splitlines() if kind == "FILE" else [str(text)]:
                words = re.findall(r"\$[\w/*]+|!?(?:" + (WORD if self.hyphens else PARTS).pattern + r")|\*", line)
                if words:
                    out.keys.setdefault(a.name, []).append(
                        Key(
                            tuple(words), a.name, mask([g for g in grams if not g.startswith("~")]), mask([g[1:] for g in grams if g.startswith("~")]),
                            str(block.get("case", [""])[0]), str(block.get("agr", [""])[0]), str(block.get("lang", [""])[0]), main, str(block.get("morph", [""])[0]) == "EXACT_FORM",
                        )
                    )

    def facts_of(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """A row per fact of ``docs``: ``SCHEMA``."""
        return extract(TK.sentences(docs, id_col, text_col), self.compile())

    def text_of(self, sentence: str) -> str:
        """The text output of one sentence: its words, then a block for each fact."""
        done = self.compile().sentence(sentence)
        blocks = "".join(f"\t{kind}\n\t{{\n" + "".join(f"\t\t{n} = {v}\n" for n, v in fields) + "\t}\n" for _, kind, _, _, fields, _ in done.facts())
        return "".join(w + " " for w in done.texts) + "\n" + blocks


@dataclass
class Compiled:
    project: Project
    keys: dict[str, list[Key]] = field(default_factory=dict)
    grammars: dict[str, list[L.Grammar]] = field(default_factory=dict)
    algorithms: dict[str, list[str]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    lemmas: dict[str, tuple[str, bool]] = field(default_factory=dict)
    light: set[str] = field(default_factory=set)
    geo: dict[str, str] = field(default_factory=dict)
    numbers: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)

    def word(self, text: str) -> re.Pattern:
        """The words of a text."""
        if text.isascii():
            return ASCII_WORD if self.project.hyphens else ASCII_PARTS
        return WORD if self.project.hyphens else PARTS

    def named(self, name: str) -> list[str]:
        """Articles of a type (exactly this one), a title, a mask or a folder."""
        pattern = re.compile(".*".join(map(re.escape, name.split("*")))) if "*" in name else None
        return [a for a, kind in self.kinds.items() if a == name or kind == name or a.startswith(name + "/") or (pattern and pattern.fullmatch(a))]

    def sentence(self, text: str) -> Sentence:
        places = [(m.start(), m.end()) for m in self.word(text).finditer(text)]
        return Sentence(self, text, places, [text[a:b] for a, b in places])

    def piece(self, words: list[str], *place: bool) -> Sentence:
        """A stretch of a sentence; ``place``: whether it begins and ends it, and whether quotes stand before and after."""
        return Sentence(self, None, [], words, *place)


class Sentence:
    """One sentence under a compiled project, or a stretch of one (without text and places); what is found for an article is kept."""

    def __init__(self, compiled: Compiled, text: str | None, places: list[tuple[int, int]], texts: list[str], first: bool = True, last: bool = True, before: bool = False, after: bool = False):
        self.c, self.text, self.places, self.texts = compiled, text, places, texts
        lexicon = compiled.project.lexicon
        end = len(texts) - 1
        self.words = []
        for n, w in enumerate(texts):
            homs = (lexicon.homonyms(w) or (Homonym(plain(w), "", (0,)),)) if w[0].isalpha() else ()
            self.words.append(
                Unit(w, n, n + 1, homs, texts[n - 1] in stretches.QUOTES if n else before, texts[n + 1] in stretches.QUOTES if n < end else after, first=first and n == 0, last=last and n == end)
            )
        self.found: dict[str, list[Hit]] = {}

    def hits(self, article: str) -> list[Hit]:
        if article not in self.found:
            self.found[article] = []  # a cycle of grammars finds nothing more
            out = [h for k in self.c.keys.get(article, ()) for h in self._keys(k)]
            out += [h for name in self.c.algorithms.get(article, ()) for h in self._algorithm(article, name)]
            out += [h for g in self.c.grammars.get(article, ()) for h in self._grammar(article, g)[0]]
            self.found[article] = list(dict.fromkeys(out))
        return self.found[article]

    def _keys(self, key: Key) -> Iterator[Hit]:
        for start in range(len(self.words)):
            for end, matched in self._match(key.words, start, key.exact):
                words = self.words[start:end]
                if self._passes(key, words):
                    yield Hit(start, end, key.article, self.c.kinds[key.article], start + min(key.mainword, end - start) - 1, self.c.lemmas.get(key.article, ("", False))[0], matched=frozenset(matched))

    def _match(self, words: tuple[str, ...], at: int, exact: bool) -> Iterator[tuple[int, list[str]]]:
        """Ends of matches of key words from a place, and the lemmas by which they match."""
        if not words:
            yield at, []
            return
        head, rest = words[0], words[1:]
        if head.startswith("$") and len(head) > 1:
            for name in self.c.named(head[1:]):
                for h in self.hits(name):
                    if h.f == at:
                        yield from self._match(rest, h.t, exact)
            return
        if at >= len(self.words):
            return
        unit, word = self.words[at], plain(head.lstrip("!")) if head != "!" else head
        lemmas = [h.lemma for h in unit.homonyms if plain(h.lemma) == word] if not (exact or head.startswith("!")) else []
        if head == "*" or plain(unit.text) == word or lemmas:
            for end, more in self._match(rest, at + 1, exact):
                yield end, lemmas + more

    def _passes(self, key: Key, words: list[Unit]) -> bool:
        head = words[min(key.mainword, len(words)) - 1]
        if key.grams and not any(f & key.grams == key.grams for h in head.homonyms for f in h.forms):
            return False
        if key.forbidden and any(f & key.forbidden for h in head.homonyms for f in h.forms):
            return False
        texts = [w.text for w in words]
        cases = {"lower": str.islower, "upper": str.isupper, "title": lambda t: t[:1].isupper()}
        if key.case and not all(cases[key.case.lower()](t) for t in texts if t[0].isalpha()):
            return False
        if key.lang and any(bool(re.match("[A-Za-z]", t)) != (key.lang.lower() in ("lat", "en", "eng")) for t in texts if t[0].isalpha()):
            return False
        kinds = {"case": "c-agr", "number": "n-agr", "gender": "gn-agr", "gnc": "gnc-agr"}
        if key.agree:
            a, b = words[0], head if head is not words[0] else words[-1]
            return any(agree(kinds.get(key.agree, key.agree), x, y) for h in a.homonyms for x in h.forms for g in b.homonyms for y in g.forms)
        return True

    def _algorithm(self, article: str, name: str) -> Iterator[Hit]:
        for f, t, lemma, grams, fields in algorithms.REGISTRY[name](self.words):
            facts = (Fact(name, tuple(sorted((k, Value(text=v, place=(f, t))) for k, v in fields.items()))),) if fields else ()
            yield Hit(f, t, article, self.c.kinds[article], f, lemma, facts, (Homonym(lemma, "S", (grams or BIT["S"],)),))

    def chain(self, grammar: L.Grammar) -> list[Unit]:
        """Words with the articles that the grammar names, and spans in place of their words."""
        found = [h for name in sorted(grammar.keywords()) for a in self.c.named(name) for h in self.hits(a)]
        found = list(dict.fromkeys(found))
        words = list(self.words)
        for h in found:
            if h.t == h.f + 1 and not h.facts and not h.homonyms:
                words[h.f] = self._marked(words[h.f], h)
        spans = [h for h in found if (h.t > h.f + 1 or h.facts or h.homonyms) and h.article not in self.c.light]
        chosen = cover(spans)
        out, at = [], 0
        for h in sorted(chosen, key=lambda h: h.f):
            out += words[at : h.f]
            inner = words[h.f : h.t]
            head = inner[min(h.head - h.f, len(inner) - 1)]
            names = frozenset(x for s in spans if (s.f, s.t) == (h.f, h.t) for x in (s.kind, s.article))
            text = " ".join(w.text for w in inner)
            given = h.homonyms or tuple(replace(x, predicted=False) for x in head.homonyms) or (Homonym("", "", (0,)),)
            lemma = h.lemma or (" ".join(w.text for w in inner) if len(inner) > 1 else "")
            homs = tuple(replace(x, lemma=lemma or x.lemma, kwtypes=names, article=h.article) for x in given)
            facts = tuple(f for s in spans if (s.f, s.t) == (h.f, h.t) for f in s.facts)
            out.append(Unit(text, h.f, h.t, homs, inner[0].open_quote, inner[-1].close_quote, len(inner) > 1, facts, inner[0].first, inner[-1].last, self.c.numbers.get(h.article, ())))
            at = h.t
        return out + words[at:]

    def _marked(self, unit: Unit, h: Hit) -> Unit:
        """The readings by which the key matched (all, if it was the form) carry the article."""
        names = frozenset({h.kind, h.article})
        light = h.article in self.c.light
        mark = lambda x: replace(x, labels=x.labels | names) if light else replace(x, kwtypes=x.kwtypes | names, article=h.article)
        homs = unit.homonyms or (Homonym(plain(unit.text), "", (0,)),)
        own = [x for x in homs if x.lemma in h.matched] or list(homs)
        return replace(unit, homonyms=tuple(mark(x) if x in own else x for x in homs), fields=unit.fields + self.c.numbers.get(h.article, ()))

    def _filtered(self, grammar: L.Grammar, units: list[Unit]) -> bool:
        """Whether a #filter holds: its terminals in order, with at most so many words between."""
        parser = chart.Parser(grammar, units, self.c.geo)

        def holds(steps, at: int, last: int | None, gap: int | None) -> bool:
            if not steps:
                return True
            item, after = steps[0]
            for n in range(at, len(units)):
                if gap is not None and last is not None and n - last - 1 > gap:
                    return False
                some = chart.terminal(item.name, units[n])
                if some is None:
                    continue
                node = chart.Node(item.name, n, n + 1, units[n].f, units[n].t, tuple((k, units[n].homonyms[k].forms) for k in some), n)
                if parser._narrow(node, item) is not None and holds(steps[1:], n + 1, n, after):
                    return True
            return False

        return not grammar.filters or any(holds(f, 0, None, None) for f in grammar.filters)

    def _grammar(self, article: str, grammar: L.Grammar) -> tuple[list[Hit], list[tuple]]:
        """Spans of the chosen parses, and rows of their facts."""
        units = self.chain(grammar)
        if not self._filtered(grammar, units):
            return [], []
        nodes = chart.choose(chart.Parser(grammar, units, self.c.geo).run(), units)
        normal = chart.Normalizer(units, self.c.project.lexicon, self.c.lemmas)
        hits, rows = [], []
        for n in nodes:
            facts, own = self.facts_of(article, n, units, normal)
            rows += own
            head = units[n.head]
            homs = tuple(replace(head.homonyms[k], forms=fs) for k, fs in n.readings) or head.homonyms[:1]
            whole = normal.text(Value(n))
            hits.append(Hit(n.f, n.t, article, self.c.kinds[article], head.f, whole, tuple(facts), homs or (Homonym(whole, "", (0,)),)))
        return hits, stretches.capped(rows, self.c.project.most)

    def facts_of(self, article: str, n: chart.Node, units: list[Unit], normal: chart.Normalizer) -> tuple[list[Fact], list[tuple]]:
        """The facts of a parse, and their rows."""
        facts, rows = [], []
        for x in n.facts:
            done = self._complete(x, normal)
            if done is not None:
                facts.append(done)
                rows.append((article, x.type, n.f, n.t, tuple((k, v.text) for k, v in done.fields), chart.weight(n, units)))
        return facts, rows

    def _complete(self, fact: Fact, normal: chart.Normalizer) -> Fact | None:
        """The fact with texts, defaults and capitals; None if a required field is empty."""
        given, out = dict(fact.fields), []
        types = self.c.project.dictionary.fields(fact.type) or [D.FieldType(n) for n in given]
        for f in types:
            value = given.get(f.name)
            text = normal.text(value) if value is not None else ""
            if text == "$SENT":
                if self.text is None:
                    raise stretches.WholeSentence
                text = self.text.strip()
            text = text or f.default or ("false" if f.type == "bool" else "")
            if not text and f.required:
                return None
            if text == "empty" and f.required:
                return None
            text = {"UPPER": str.upper, "TITLE": lambda t: t[:1].upper() + t[1:], "CAMEL": lambda t: " ".join(w[:1].upper() + w[1:] for w in t.split(" "))}.get(f.case, lambda t: t)(text)
            if text:
                out.append((f.name, Value(text=text, place=value.span if value is not None else (0, 0))))
        return Fact(fact.type, tuple(out))

    def facts(self) -> list[tuple]:
        """(article, type, f, t, fields, weight) of all facts of the articles to run."""
        wanted = set(self.c.project.facts)
        out = [r for a in self.c.project.articles for g in self.c.grammars.get(a, ()) for r in self._grammar(a, g)[1]]
        return [r for r in dict.fromkeys(out) if not wanted or r[1] in wanted]


def cover(hits: list[Hit]) -> list[Hit]:
    """The spans without overlaps that cover most words, with the fewest spans (of equal ones the first)."""
    unique = sorted({(h.t, h.f): h for h in reversed(hits)}.values(), key=lambda h: (h.t, h.f))
    best: list[tuple[int, int, list[Hit]]] = []
    for n, x in enumerate(unique):
        base, rival = (0, 0, []), None
        for k in range(n - 1, -1, -1):
            if unique[k].t <= x.f:
                base = best[k]
                break
            if rival is None or best[k][:2] > rival[:2]:
                rival = best[k]
        mine = (base[0] + x.t - x.f, base[1] - 1, [*base[2], x])
        best.append(rival if rival is not None and rival[:2] > mine[:2] else mine)
    return best[-1][2] if best else []


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    fields = columns[9]
    pairs = [p for x in fields for p in x]
    offsets = pa.array(accumulate(map(len, fields), initial=0), pa.int32())
    maps = pa.MapArray.from_arrays(offsets, pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    return [maps if i == 9 else pa.array(c, f.type) for i, (c, f) in enumerate(zip(columns, _ARROW, strict=True))]


def extract(sentences: DataFrame, compiled: Compiled) -> DataFrame:
    """Facts of sentences (doc_id, sent_id, sentence): one narrow map by Arrow batches."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = stretches.Reader(compiled)
        sieve = batches.Sieve(reader)
        for batch in found:
            if sieve.able:
                for sentence, number, *places, rest, rests in sieve.blocks(batch.column("sentence")):
                    made = _arrays([(0, 0, 0, article, kind, 0, 0, 0, 0, fields, weight) for article, kind, fields, weight in rests])
                    article, kind, fields, weight = (made[i].take(pa.array(rest)) for i in (3, 4, 9, 10))
                    c_from, c_to, f, t = map(pa.array, places)
                    ids = [batch.column(c).take(pa.array(sentence)).cast(pa.int64()) for c in ("doc_id", "sent_id")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(number), article, kind, f, t, c_from, c_to, fields, weight], schema=_ARROW)
                continue
            rows = []
            for d, s, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sent_id", "sentence")), strict=True):
                found = reader.facts(text)
                if found:
                    places = [m.span() for m in islice(compiled.word(text).finditer(text), max([r[3] for r in found]))]
                    rows += [(d, s, n, article, kind, f, t, places[f][0], places[t - 1][1], fields, weight) for n, (article, kind, f, t, fields, weight) in enumerate(found)]
            yield pa.RecordBatch.from_arrays(_arrays(rows), schema=_ARROW)

    return sentences.select("doc_id", "sent_id", "sentence").mapInArrow(run, SCHEMA)
