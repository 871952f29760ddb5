"""The chart parser: all parses of a grammar over one sentence, with constraints, agreement, weights and facts.

Bottom-up, with an agenda: a finished node opens and extends edges, an edge meets the nodes that begin where
it ends, so left and right recursion need no care. Nodes of one symbol and place with the same readings and
facts are one (the heavier stays). Sentences are parsed on their own; nothing is collected or shuffled.

Input: units (words, or the spans that stand for several words), each with its readings. Constraints are
checked on the readings of a part's head and narrow them; agreement narrows the forms of both parts.

Defined cases: no units, no parse; a part without readings fulfils no constraint on grammemes, and agrees with
anything if it has no reading at all; ties of weight go to the parse found first, in the order of the rules.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cache, cached_property, lru_cache
from itertools import accumulate
from typing import NamedTuple

from factloom.operators.morphology import BIT, CASE, GENDER, NUMBER, POS, Homonym, Lexicon, agree, mask, plain
from factloom.plans.language import AGREEMENTS, Grammar, Item, Rule, Tag, values

SCALE = 10**8
AND_WORDS = {"and", "et", "und", "y", "и"}


@dataclass(frozen=True)
class Unit:
    """A word, or a span that stands for its words: places from f to t (not included)."""

    text: str
    f: int
    t: int
    homonyms: tuple[Homonym, ...]
    open_quote: bool = False
    close_quote: bool = False
    multi: bool = False
    facts: tuple[Fact, ...] = ()
    first: bool = False
    last: bool = False
    fields: tuple[tuple[str, float], ...] = ()  # numbers of its article, for gztweight


@dataclass(frozen=True)
class Value:
    """A field's value: the chain of a node, a constant, or parts put together in the text's order."""

    node: Node | None = None
    text: str | None = None
    parts: tuple[Value, ...] = ()
    options: tuple[tuple[str, str], ...] = ()
    place: tuple[int, int] = (0, 0)  # of a text that was made elsewhere

    @property
    def span(self) -> tuple[int, int]:
        spans = [self.place] + [p.span for p in self.parts] + ([(self.node.f, self.node.t)] if self.node else [])
        spans = [s for s in spans if s[1] > s[0]]
        return (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else (0, 0)


@dataclass(frozen=True)
class Fact:
    type: str
    fields: tuple[tuple[str, Value], ...]

    def with_(self, name: str, value: Value) -> Fact:
        return Fact(self.type, tuple(sorted((dict(self.fields) | {name: value}).items())))

    @cached_property
    def key(self) -> tuple:
        return (self.type, tuple((n, v.span, v.text) for n, v in self.fields))


@dataclass(eq=False)
class Node:
    symbol: str
    i: int  # units
    j: int
    f: int  # words
    t: int
    readings: tuple[tuple[int, tuple[int, ...]], ...]  # homonyms of the head unit, with their forms
    head: int
    weight: float = 1.0
    facts: tuple[Fact, ...] = ()
    parts: tuple[Node, ...] = ()
    rule: Rule | None = None
    bonds: tuple[tuple[int, int, int], ...] = ()  # agreeing parts, and what the agreement counts
    keywords: int = 0
    cut: bool = False
    checked: frozenset[str] = frozenset()
    sums: tuple[int, int, int] | None = None  # once the chart is done

    def key(self) -> tuple:
        return (self.symbol, self.i, self.j, self.head, self.readings, tuple([x.key for x in self.facts]))

    def leaves(self) -> list[Node]:
        return [x for p in self.parts for x in p.leaves()] if self.parts else [self]


_STRENGTH = {"gnc-agr": 3, "gn-agr": 2, "gc-agr": 2, "nc-agr": 2, "c-agr": 1, "fem-c-agr": 1}
_PATTERN = {"LBracket": r"\(", "RBracket": r"\)", "Bracket": r"[()\[\]{}]", "Hyphen": "[-–—]", "Punct": r"[.,:;!?]", "Comma": ",", "Colon": ":", "Percent": ".*%.*", "Dollar": r".*\$.*", "PlusSign": r"\+", "NumSign": "[#№]", "Ampersand": "&", "EOSent": "[.!?]", "QuoteDbl": "[\"«»“”„]", "QuoteSng": "['‘’]", "Digit": r"\d+", "YYDate": r"\d{4}"}


@cache
def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def pattern(text: str) -> re.Pattern:
    """For whole texts; leading ^ and final $ are allowed."""
    return _re(text.removeprefix("^").removesuffix("$"))


def match(text: str, word: str) -> bool:
    return pattern(text).fullmatch(word) is not None


def terminal(name: str, unit: Unit) -> list[int] | None:
    """The unit's homonyms under which it is this terminal; [] if readings do not matter; None if it is not."""
    everything = list(range(len(unit.homonyms)))
    if name.startswith("'"):
        word = plain(name[1:-1])
        some = [n for n, h in enumerate(unit.homonyms) if plain(h.lemma) == word]
        return some if some else ([] if plain(unit.text) == word and not unit.homonyms else None)
    if name == "AnyWord":
        return everything
    if name == "Word":
        return everything if unit.multi or match(r"[^\W\d_]+(?:[-–][^\W\d_]+)*", unit.text) else None
    if name == "UnknownPOS":
        return [] if not any(h.pos for h in unit.homonyms) and match(r"[^\W\d_]+(?:-[^\W\d_]+)*", unit.text) else None
    if name == "SimConjAnd":
        return [] if unit.text.lower() in AND_WORDS else None
    if name == "EOSent":
        return [] if unit.last and match(_PATTERN[name], unit.text) else None
    if name in _PATTERN:
        return [] if match(_PATTERN[name], unit.text) else None
    some = [n for n, h in enumerate(unit.homonyms) if _is(name, h.grams)]
    return some or None


def _is(name: str, g: int) -> bool:
    has = lambda x: bool(g & mask(x))
    return {
        "Noun": has("S") and not has("persn,famn,patrn,abbr"),
        "Adj": has("A,partcp,ANUM,APRO") and not has("brev"),
        "AdjPartOrdNum": has("A,partcp,ANUM,APRO"),
        "OrdinalNumeral": has("ANUM"),
        "Adv": has("ADV,ADVPRO"),
        "Participle": has("partcp"),
        "Verb": has("V") and not has("partcp,ger,inf"),
        "Infinitive": has("inf"),
        "Prep": has("PR"),
    }[name]


def named(h: Homonym, name: str) -> bool:
    """An article or type: equal, by a mask with *, or the folder before /."""
    for own in h.kwtypes | ({h.article} if h.article else set()):
        if own == name or own.startswith(name + "/") or ("*" in name and re.fullmatch(".*".join(map(re.escape, name.split("*"))), own)):
            return True
    return False


class Parser:
    """One sentence. ``useful``: symbols and units of the nodes to make, if not all are wanted; ``span``: the units to parse."""

    def __init__(self, grammar: Grammar, units: list[Unit], geo: dict[str, str] | None = None, useful: set[tuple[str, int, int]] | None = None, span: tuple[int, int] | None = None):
        self.grammar, self.units, self.geo, self.useful = grammar, units, geo or {}, useful
        self.span = span or (0, len(units))
        self.words = grammar.keywords()
        self.nodes: dict[tuple, Node] = {}
        self.starting: dict[tuple[str, int], list[Node]] = {}
        self.waiting: dict[tuple[str, int], list[tuple]] = {}
        self.agenda: list[Node] = []
        self.opening: dict[str, list[Rule]] = {}
        for r in grammar.rules:
            self.opening.setdefault(r.items[0].name, []).append(r)

    def run(self) -> list[Node]:
        """All nodes of the root."""
        names = {i.name for r in self.grammar.rules for i in r.items} - {r.left for r in self.grammar.rules}
        for n in range(*self.span):
            unit = self.units[n]
            for name in sorted(names):
                some = terminal(name, unit)
                if some is not None:
                    readings = tuple((k, unit.homonyms[k].forms) for k in some)
                    self._add(Node(name, n, n + 1, unit.f, unit.t, readings, n, facts=(), keywords=int(any(named(unit.homonyms[k], w) for k in some for w in self.words))))
        while self.agenda:
            node = self.agenda.pop()
            for rule in self.opening.get(node.symbol, ()):
                self._extend((rule, ()), node)
            for edge in list(self.waiting.get((node.symbol, node.i), ())):
                self._extend(edge, node)
        found = [n for n in self.nodes.values() if n.symbol == self.grammar.root]
        dominant = [(n.f, n.t) for n in self.nodes.values() if n.rule and n.rule.left_dominant]
        return [n for n in found if not (n.rule.right_recessive and any(f < n.f < t or (f == n.f and t > n.t) for f, t in dominant))]

    def _add(self, node: Node) -> None:
        key = node.key()
        old = self.nodes.get(key)
        if old is not None:
            if node.weight > old.weight and not old.parts == node.parts:
                old.weight, old.parts, old.rule, old.bonds = node.weight, node.parts, node.rule, node.bonds
            return
        self.nodes[key] = node
        self.starting.setdefault((node.symbol, node.i), []).append(node)
        self.agenda.append(node)

    def _extend(self, edge: tuple, node: Node) -> None:
        rule, parts = edge
        item = rule.items[len(parts)]
        start = parts[0].i if parts else node.i
        if node.j - start > rule.count:
            return
        node = self._narrow(node, item)
        if node is None:
            return
        parts = (*parts, node)
        if len(parts) == len(rule.items):
            if self.useful is not None and (rule.left, start, node.j) not in self.useful:
                return
            made = self._reduce(rule, parts)
            if made is not None:
                self._add(made)
            return
        name = rule.items[len(parts)].name
        edge = (rule, parts)
        self.waiting.setdefault((name, node.j), []).append(edge)
        for other in list(self.starting.get((name, node.j), ())):
            self._extend(edge, other)

    # --- constraints

    def _narrow(self, node: Node, item: Item) -> Node | None:
        readings, weight, checked = node.readings, node.weight, node.checked
        head, first, last = self.units[node.head], self.units[node.i], self.units[node.j - 1]
        for tag in item.tags:
            if tag.name in AGREEMENTS or tag.name in ("rt", "cut"):
                continue
            if tag.name == "gztweight":
                kw = dict(head.fields)
                weight *= kw.get(tag.value, 1.0)
                continue
            found = self._tag(tag, item, node, readings, head, first, last)
            if found is None:
                return None
            readings = found
            if tag.name in ("kwtype", "kwset") and not tag.negated and tag.value != "none":
                checked = checked | set(values(tag.value))
        cut = node.cut or item.has("cut")
        if (readings, weight, cut, checked) == (node.readings, node.weight, node.cut, node.checked):
            return node
        return Node(node.symbol, node.i, node.j, node.f, node.t, readings, node.head, weight, node.facts, node.parts, node.rule, node.bonds, node.keywords, cut, checked)

    def _tag(self, tag: Tag, item: Item, node: Node, readings, head: Unit, first: Unit, last: Unit):
        """The readings that stay, or None if the tag does not hold."""
        name, value, no = tag.name, tag.value, tag.negated
        homs = head.homonyms
        yes = lambda ok: readings if ok != no else None
        if name == "kwtype":
            if value == "none":
                free = [r for r in readings if not any(named(homs[r[0]], w) for w in self.words)]
                if item.name == "Word":
                    return readings if len(free) == len(readings) else None
                return tuple(free) if free or not readings else None
            some = tuple(r for r in readings if any(named(homs[r[0]], v) for v in values(value)) != no)
            return some or (readings if no and not readings else None)
        if name in ("kwset", "kwsetf"):
            where = homs if name == "kwset" else first.homonyms
            some = [h for h in where if any(named(h, v) for v in values(value))]
            if no:
                return readings if not some else None
            if not some:
                return None
            return tuple(r for r in readings if homs[r[0]] in some) or readings if name == "kwset" else readings
        if name == "label":
            some = tuple(r for r in readings if any(v in homs[r[0]].labels for v in values(value)) != no)
            return some or None
        if name == "gram":
            return self._gram(readings, value, no)
        if name == "GU":
            return self._union(readings, value, homs, no)
        if name in ("wff", "wfl", "wfm"):
            return yes(match(value, {"wff": first, "wfl": last, "wfm": head}[name].text))
        if name == "h-reg1":
            return yes(match(r"[^\W_].*", first.text) and (first.text[0].isupper() or first.text[0].isdigit()))
        if name == "h-reg2":
            return yes(first.text[:1].isupper() and any(c.isupper() and first.text[k] not in "-–—" for k, c in enumerate(first.text[1:])))
        if name == "l-reg":
            return yes(not first.text[:1].isupper())
        if name in ("quoted", "l-quoted", "r-quoted"):
            left, right = first.open_quote, last.close_quote
            return yes({"quoted": left and right, "l-quoted": left and not right, "r-quoted": right and not left}[name])
        if name == "fw":
            return yes(first.first)
        if name == "mw":
            return yes(head.multi)
        if name == "lat":
            return yes(match(r"[A-Za-z]+(?:-[A-Za-z]+)*", head.text))
        if name == "no_hom":
            return yes(len({h.pos for h in homs}) <= 1)
        if name == "prep":
            return yes(any(h.grams & BIT["PR"] for h in homs))
        if name == "dict":
            return yes(any(not h.predicted and h.pos for h in homs))
        if name in ("name", "geo"):
            some = tuple(r for r in readings if bool(homs[r[0]].grams & mask("persn,famn,patrn" if name == "name" else "geo")) != no)
            return some or None
        raise ValueError(f"tag {name}")

    @staticmethod
    def _gram(readings, text: str, no: bool):
        want = [g.strip() for g in values(text)]
        need, bad = mask([g for g in want if not g.startswith("~")]), [mask(g[1:]) for g in want if g.startswith("~")]
        if no:
            bad, need = [need], 0
        if any(f & b == b for _, fs in readings for f in fs for b in bad):
            return None
        some = tuple((k, tuple(f for f in fs if f & need == need)) for k, fs in readings)
        some = tuple(r for r in some if r[1])
        return some or (readings if not need and not readings else None)

    @staticmethod
    def _union(readings, text: str, homs, no: bool):
        """[a,b]: a form has all; &[a,b]: the union of a reading's forms has; ~[a,b]: no form has any; | or."""
        for part in text.split("|"):
            part = part.strip()
            want = mask(values(part.lstrip("~&").strip()))
            if part.startswith("~") or no:
                if not any(f & want for _, fs in readings for f in fs):
                    return readings
                continue
            if part.startswith("&"):
                some = tuple((k, fs) for k, fs in readings if _all(fs) & want == want)
            else:
                some = tuple((k, tuple(f for f in fs if f & want == want)) for k, fs in readings)
                some = tuple(r for r in some if r[1])
            if some:
                return some
        return None

    # --- reduction

    def _reduce(self, rule: Rule, parts: tuple[Node, ...]) -> Node | None:
        forms = [p.readings for p in parts]
        bonds = []
        groups: dict[tuple[str, str], list[int]] = {}
        for n, item in enumerate(rule.items):
            for t in item.tags:
                if t.name in AGREEMENTS:
                    groups.setdefault((t.name, t.value), []).append(n)
        for (kind, _), pair in groups.items():
            if len(pair) != 2:
                continue
            a, b = pair
            negated = any(t.negated for t in rule.items[a].tags if t.name == kind)
            if kind in ("fio-agr", "geo-agr"):
                if self._special(kind, parts[a], parts[b]) == negated:
                    return None
                continue
            agreed = _agreed(kind, forms[a], forms[b])
            unknown = any(not any(f for _, fs in x for f in fs) for x in (forms[a], forms[b]))  # words of which nothing is known
            if negated:
                if agreed[0] or unknown:
                    return None
                continue
            if unknown:
                continue
            if not agreed[0]:
                return None
            forms[a], forms[b] = agreed
            bonds.append((a, b, _STRENGTH.get(kind, 0)))
        head = parts[rule.head]
        readings = forms[rule.head]
        if rule.outgram is not None:
            readings = tuple((k, (mask(rule.outgram),)) for k, _ in readings)
        facts = self._facts(rule, parts) if self.grammar.interpret else ()
        if facts is None:
            return None
        if rule.not_hreg_fact and facts:
            texts = [" ".join(self.units[n].text for n in range(v.node.i, v.node.j)) for x in facts for _, v in x.fields if v.node is not None and v.node.i >= 0]
            if texts and all(t.upper() == t and t.lower() != t for t in texts):
                return None
        f, t = parts[0].f, parts[-1].t
        if rule.trim and facts:
            spans = [v.span for x in facts for _, v in x.fields if v.span[1] > v.span[0]]
            if spans:
                f, t = min(s[0] for s in spans), max(s[1] for s in spans)
        weight = rule.weight
        for p in parts:
            weight *= p.weight
        parts = tuple(p if p.readings == r else Node(p.symbol, p.i, p.j, p.f, p.t, r, p.head, p.weight, p.facts, p.parts, p.rule, p.bonds, p.keywords, p.cut, p.checked) for p, r in zip(parts, forms, strict=True))
        return Node(rule.left, parts[0].i, parts[-1].j, f, t, readings, head.head, weight, facts, parts, rule, tuple(bonds), sum(p.keywords for p in parts), False, head.checked)

    def _special(self, kind: str, a: Node, b: Node) -> bool:
        x, y = self.units[a.head], self.units[b.head]
        if kind == "fio-agr":
            return layout(x.text) == layout(y.text)
        tops = [[h.article for h in u.homonyms if h.article in self.geo or h.article in self.geo.values()] for u in (x, y)]
        return any(p in ancestors(q, self.geo) or q in ancestors(p, self.geo) for p in tops[0] for q in tops[1])

    def _facts(self, rule: Rule, parts: tuple[Node, ...]) -> tuple[Fact, ...] | None:
        """Facts of the parts, each with what its item interprets, put together from left to right."""
        total: list[Fact] = []
        for item, part in zip(rule.items, parts, strict=True):
            mine = list(part.facts)
            for target in item.interp:
                if target.plus:
                    at = [k for k, x in enumerate(total) if x.type == target.fact and target.name in dict(x.fields)]
                    if at:
                        for k in at:
                            old = dict(total[k].fields)[target.name]
                            total[k] = total[k].with_(target.name, Value(parts=(*(old.parts or (old,)), Value(part, options=target.options))))
                        continue
                found = self._values(target, part)
                own = [k for k, x in enumerate(mine) if x.type == target.fact]
                if not found:
                    continue
                if not own:
                    mine += [Fact(target.fact, ((target.name, v),)) for v in found]
                elif len(found) == 1 or len(found) == len(own):
                    for n, k in enumerate(own):
                        mine[k] = mine[k].with_(target.name, found[n % len(found)])
                elif len(own) == 1:
                    base = mine.pop(own[0])
                    mine += [base.with_(target.name, v) for v in found]
            merged = merge(total, mine)
            if merged is None:
                return None
            total = merged
        return tuple(total)

    def _values(self, target, part: Node) -> list[Value]:
        if target.value is not None:
            return [Value(text=target.value)]
        unit = self.units[part.head]
        wanted = target.source.rsplit(".", 1)[-1] if target.source else target.name
        kind = target.source.rsplit(".", 1)[0] if target.source and "." in target.source else None
        found: list[Value] = []
        for x in unit.facts:
            value = dict(x.fields).get(wanted)
            if value is not None and (kind is None or x.type == kind) and value not in found:
                found.append(value)
        if found:
            return found
        if any(o == "only_from_fact" for o, _ in target.options):
            return []
        return [Value(part, options=target.options)]


def layout(name: str) -> tuple[bool, int]:
    """Whether a name begins with initials, and its number of words."""
    words = name.split()
    return (bool(words) and len(words[0].rstrip(".")) == 1, len(words))


def ancestors(article: str, parent: dict[str, str]) -> list[str]:
    out = []
    while article in parent and parent[article] not in out:
        article = parent[article]
        out.append(article)
    return out


def _all(forms: Iterable[int]) -> int:
    out = 0
    for f in forms:
        out |= f
    return out


@cache
def _agreed(kind: str, a, b):
    """The readings of both that have a form which agrees with one of the other, narrowed to these forms."""
    left = tuple((k, tuple(f for f in fs if any(agree(kind, f, g) for _, gs in b for g in gs))) for k, fs in a)
    right = tuple((k, tuple(g for g in gs if any(agree(kind, f, g) for _, fs in a for f in fs))) for k, gs in b)
    return tuple(r for r in left if r[1]), tuple(r for r in right if r[1])


def merge(a: list[Fact], b: list[Fact]) -> list[Fact] | None:
    """Facts of two neighbours. Those of a type: equal counts by pairs, one with each of many, other counts do not
    go (None); facts that share a field stay apart."""
    out: list[Fact] = []
    for kind in dict.fromkeys(x.type for x in [*a, *b]):
        x, y = [f for f in a if f.type == kind], [f for f in b if f.type == kind]
        if not x or not y:
            out += x + y
            continue
        if any({n for n, _ in f.fields} & {n for n, _ in g.fields} for f in x for g in y):
            out += x + y
            continue
        if len(x) == len(y):
            pairs = list(zip(x, y, strict=True))
        elif len(x) == 1:
            pairs = [(x[0], g) for g in y]
        elif len(y) == 1:
            pairs = [(f, y[0]) for f in x]
        else:
            return None
        out += [Fact(kind, tuple(sorted(dict(f.fields, **dict(g.fields)).items()))) for f, g in pairs]
    return out


# --- choice among parses ------------------------------------------------------------------------------------

def covered(units: list[Unit]) -> list[int]:
    """Words without commas and "and" before each unit, and before the end."""
    return list(accumulate((0 if u.text == "," or u.text.lower() in AND_WORDS else u.t - u.f for u in units), initial=0))


def coverage(node: Node, before: list[int]) -> int:
    """Words without commas and "and"; a span's length if nothing else is left."""
    return before[node.j] - before[node.i] or node.t - node.f


def mean_weight(size: int, strength: int, keywords: int, own: int) -> int:
    """The mean of agreement, keyword share and own weight in fixed point, for a group of so many words."""
    norm = 3 * size * (size - 1) // 2
    agreement = SCALE if size == 1 else strength * SCALE // norm if strength else 9 * SCALE // (10 * norm)
    return (agreement + min(keywords, size) * SCALE // size + own) // 3


@lru_cache(10_000)
def _fixed(weight: float) -> int:
    return int(Fraction(weight).limit_denominator(10**9) * SCALE)


def _own(node: Node) -> int:
    return _fixed(node.weight)


def weight(node: Node, units: list[Unit]) -> int:
    size, strength, keywords = sums(node)
    return mean_weight(size, strength, keywords, _own(node))


def sums(node: Node) -> tuple[int, int, int]:
    """Leaves of a finished parse, strength of its agreements, leaves with keywords; each part is counted once, however deep."""
    todo = [node]
    while todo:
        x = todo[-1]
        missing = [p for p in x.parts if p.sums is None]
        if missing:
            todo += missing
            continue
        todo.pop()
        parts = [p.sums for p in x.parts] or [(1, 0, x.keywords)]
        x.sums = (sum(p[0] for p in parts), sum(s for _, _, s in x.bonds) + sum(p[1] for p in parts), sum(p[2] for p in parts))
    return node.sums


class Weighed(NamedTuple):
    """What the choice needs of a parse: its units, and what it adds."""

    i: int
    j: int
    coverage: int
    strength: int
    keywords: int
    own: int


class Solution(NamedTuple):
    """Parses without overlaps, weighed as one group that reaches from the sentence's first word to its own last; each
    names its last parse and the solution before that."""

    rank: tuple[int, int, int] = (0, 0, 0)  # coverage, weight, less the number of parses
    strength: int = 0
    keywords: int = 0
    own: int = SCALE
    last: int = -1
    before: Solution | None = None

    def add(self, n: int, x: Weighed, shift: int) -> Solution:
        strength, keywords, own = self.strength + x.strength, self.keywords + x.keywords, self.own * x.own // SCALE
        covered, _, less = self.rank
        return Solution((covered + x.coverage, mean_weight(x.j + shift, strength, keywords, own), less - 1), strength, keywords, own, n, self)


def weigh(nodes: list[Node], units: list[Unit]) -> list[Weighed]:
    before = covered(units)
    return [Weighed(x.i, x.j, coverage(x, before), *sums(x)[1:], _own(x)) for x in nodes]


def best(parses: list[Weighed], base: Solution = Solution(), shift: int = 0) -> Solution:  # noqa: B008
    """The solution of largest coverage, then weight, then fewest parses, over parses ordered by last and first word: each is
    put on the best solution before it; if it overlaps the parse before it, it takes that one's solution's place only if it is no worse.
    No solution is worse than one before it, as every parse covers something. ``base``: of parses that end before all of these;
    ``shift``: units before theirs."""
    ends = [x.j for x in parses]
    found: list[Solution] = []
    for n, x in enumerate(parses):
        k = bisect_right(ends, x.i, 0, n)
        mine = (found[k - 1] if k else base).add(n, x, shift)
        found.append(found[-1] if k < n and found[-1].rank > mine.rank else mine)
    return found[-1] if found else base


def members(solution: Solution, base: Solution) -> list[int]:
    """The numbers of a solution's parses that were put on ``base``."""
    out = []
    while solution is not base:
        out.append(solution.last)
        solution = solution.before
    return out[::-1]


def choose(nodes: list[Node], units: list[Unit]) -> list[Node]:
    """The best parses without overlaps."""
    nodes = sorted(nodes, key=lambda x: (x.j, x.i))
    base = Solution()
    return [nodes[n] for n in members(best(weigh(nodes, units), base), base)]


# --- normalization ------------------------------------------------------------------------------------------

@dataclass
class Normalizer:
    """Values as text: the head and what agrees with it in the wanted form, the rest as it stands."""

    units: list[Unit]
    lexicon: Lexicon
    lemmas: dict[str, tuple[str, bool]] = field(default_factory=dict)  # article: its lemma, and whether it always stands

    def text(self, value: Value) -> str:
        if value.parts:
            return " ".join(self.text(v) for v in sorted(value.parts, key=lambda v: v.span) if v.parts or v.node or v.text)
        if value.text is not None:
            return value.text
        options = dict(value.options)
        if "not_norm" in options:
            return " ".join(self._plain(n) for n in value.node.leaves() if not n.cut)
        want = mask(options["norm"]) if options.get("norm") else 0
        out: list[tuple[int, str]] = []
        self._walk(value.node, want, True, 0, out)
        return " ".join(w for _, w in sorted(out) if w)

    def _plain(self, node: Node) -> str:
        unit = self.units[node.head]
        for h in unit.homonyms:
            lemma, always = self.lemmas.get(h.article, ("", False))
            if lemma and always:
                return lemma
        return unit.text if not unit.first or unit.text.upper() == unit.text else unit.text.lower()

    def _walk(self, node: Node, want: int, inflect: bool, with_head: int, out: list[tuple[int, str]]) -> None:
        if node.cut:
            return
        if not node.parts:
            out.append((node.f, self._word(node, want, with_head) if inflect else self._plain(node)))
            return
        head = node.rule.head
        agreed = {head}
        while True:  # what agrees with the head, or with what agrees
            more = {x for a, b, _ in node.bonds for x in (a, b) if (a in agreed) != (b in agreed)}
            if not more - agreed:
                break
            agreed |= more
        grams = self._grams(node.parts[head])
        for k, p in enumerate(node.parts):
            self._walk(p, want, inflect and k in agreed, with_head if k == head else grams, out)

    def _grams(self, node: Node) -> int:
        while node.parts:
            node = node.parts[node.rule.head]
        return _all(f for _, fs in node.readings[:1] for f in fs)

    def _word(self, node: Node, want: int, with_head: int) -> str:
        unit = self.units[node.head]
        if not node.readings:
            return self._plain(node)
        k, forms = node.readings[0]
        h, have = unit.homonyms[k], _all(forms)
        lemma, always = self.lemmas.get(h.article, ("", False))
        if lemma and (always or node.checked or unit.multi):
            return lemma
        if unit.multi or not h.pos:
            return h.lemma or self._plain(node)
        if have & mask("V") and not have & mask("partcp,ger"):
            return self._cased(self.lexicon.inflect(h.lemma, h.pos, want) if want else h.lemma, unit)
        target = (want & CASE or BIT["nom"]) | (want & NUMBER or BIT["sg"]) | (want & ~(CASE | NUMBER))
        if have & mask("A,partcp,ANUM,APRO") and with_head:
            target |= with_head & GENDER if target & BIT["sg"] else 0
        elif not have & (CASE | NUMBER):
            return self._cased(h.lemma, unit)
        return self._cased(self.lexicon.inflect(h.lemma, h.pos, target, have & ~(CASE | NUMBER | POS)), unit)

    @staticmethod
    def _cased(lemma: str, unit: Unit) -> str:
        """Upper case if the word is; a capital if the word has one and is a name or stands inside a sentence."""
        if len(unit.text) > 1 and unit.text.upper() == unit.text and unit.text.lower() != unit.text:
            return lemma.upper()
        proper = not unit.first or any(h.grams & mask("persn,famn,patrn,geo") for h in unit.homonyms)
        return lemma[:1].upper() + lemma[1:] if unit.text[:1].isupper() and proper else lemma
