"""The native subset of the grammar language: text of rules to built-in expressions over sentences, without
Python code. ``plans.language`` reads the whole language; what stands outside the subset is refused here.

    // comment
    #define NAME pattern
    #GRAMMAR_ROOT S
    S -> Prep Word<wff=/.*tion/> | Kw (Word<h-reg1>) Word+;

Items: terminals (Word, AnyWord, Punct, Comma, Digit, 'lemma'), non-terminals, each with constraints in
<>; ``( )`` optional, ``+`` and ``*`` repetition. Constraints: wff=/re/, ~wff, h-reg1, h-reg2, l-reg,
lat, fw, ~fw, kwset=[a, b], rt; for a rule {count=n}. Rules must not be recursive but by + and *.
Checks: undefined symbols, two heads or a head on an optional item, empty rules, self-rules, cycles, several roots.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import grammar as G
from factloom.operators.tokens import computed


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Item:
    name: str
    tags: tuple[tuple[str, str, bool], ...] = ()  # (tag, value, negated)
    repeat: str = ""  # "", "+" or "*"
    optional: bool = False


@dataclass
class Rule:
    left: str
    items: list[Item]
    most: int | None = None


@dataclass
class Grammar:
    rules: list[Rule]
    root: str
    order: list[str] = field(default_factory=list)


_TEST = {
    "Word": lambda x: x["tok"].rlike(r"^\p{L}+$"),
    "AnyWord": lambda x: F.lit(True),
    "Punct": lambda x: x["tok"].rlike(r"^[.,:;!?]$"),
    "Comma": lambda x: x["tok"] == ",",
    "Digit": lambda x: x["tok"].rlike(r"^\p{N}+$"),
    "Hyphen": lambda x: x["tok"].rlike("^[-–—]$"),
    "Percent": lambda x: x["tok"] == "%",
    "SimConjAnd": lambda x: x["low"].isin("and", "et", "und", "y", "и"),
}
_TAG = {
    "wff": lambda x, v: x["tok"].rlike(f"^(?:{v})$"),
    "h-reg1": lambda x, v: x["tok"].rlike(r"^[\p{Lu}\p{N}]"),
    "h-reg2": lambda x, v: x["tok"].rlike(r"^\p{Lu}(.*[^-–—])?\p{Lu}"),
    "l-reg": lambda x, v: ~x["tok"].rlike(r"^\p{Lu}"),
    "lat": lambda x, v: x["tok"].rlike("^[A-Za-z]+$"),
    "fw": lambda x, v: x["pos"] == 0,
    "kwset": lambda x, v: x["low"].isin(*[w.strip().lower() for w in v.strip("[]").split(",")]),
}
_TOKEN = re.compile(r"""\s*(?:(->)|([;|()+*{}])|'([^']*)'|<((?:/(?:\\.|[^/])*/|[^>])*)>|([\w$-]+(?:=\d+)?))""")


def preprocess(text: str, defined: set[str] | None = None) -> tuple[str, dict[str, str]]:
    """Text without comments and directives, macros put in, branches of #ifdef chosen; the directives' values."""
    macros: dict[str, str] = {d: "" for d in defined or ()}
    out, found, take = [], {}, [True]
    for line in text.splitlines():
        line = re.sub(r"//.*$", "", line)
        if m := re.match(r"\s*#(\w+)\s*(\S*)\s*(.*)", line):
            name, a, b = m.groups()
            if name in ("ifdef", "ifndef"):
                take.append(take[-1] and (a in macros) == (name == "ifdef"))
            elif name == "else" and len(take) > 1:
                take[-1] = take[-2] and not take[-1]
            elif name == "endif" and len(take) > 1:
                take.pop()
            elif take[-1] and name == "define":
                macros[a] = b.strip()
            elif take[-1] and name == "undef":
                macros.pop(a, None)
            elif take[-1] and name in ("GRAMMAR_ROOT", "encoding"):
                found[name] = f"{a} {b}".strip()
            elif take[-1]:
                raise GrammarError(f"#{name} is no part of the native subset; plans.language has it")
        elif take[-1]:
            out.append(re.sub(r"\$\{(\w+)\}", lambda m: macros.get(m[1], m[0]), line))
    if len(take) > 1:
        raise GrammarError("#ifdef without #endif")
    return "\n".join(out), found


def _tags(text: str) -> tuple[tuple[str, str, bool], ...]:
    parts = re.findall(r"(~?)([\w-]+)(?:\s*=\s*(~?)(/(?:\\.|[^/])*/|\[[^\]]*\]|[^,]+))?", text)
    return tuple((t, v.strip().removeprefix("/").removesuffix("/"), bool(a or b)) for a, t, b, v in parts)


def parse(text: str, defined: set[str] | None = None) -> Grammar:
    body, directives = preprocess(text, defined)
    rules: list[Rule] = []
    for part in _cut(body, ";"):
        if not part.strip():
            continue
        left, arrow, right = part.partition("->")
        if not arrow:
            raise GrammarError(f"no -> in {part.strip()!r}")
        for choice in _cut(right, "|"):
            rules.append(_rule(left.strip(), choice))
    names = {r.left for r in rules}
    used = {i.name for r in rules for i in r.items if i.name != r.left}
    roots = [directives["GRAMMAR_ROOT"]] if "GRAMMAR_ROOT" in directives else sorted(names - used)
    if len(roots) != 1 or roots[0].rstrip(";") not in names:
        raise GrammarError(f"the root is not clear: {roots}")
    grammar = Grammar(rules, roots[0])
    _check(grammar, names)
    return grammar


def _cut(text: str, sep: str) -> list[str]:
    """Parts between separators that do not stand in < >."""
    parts, inside = [""], False
    for i, c in enumerate(text):
        inside = c == "<" or inside and not (c == ">" and text[i - 1] != "-")
        if c == sep and not inside:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _rule(left: str, text: str) -> Rule:
    rule, at, depth = Rule(left, []), 0, 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise GrammarError(f"cannot read {text[at:].strip()[:40]!r}")
        at = m.end()
        _, sign, lemma, tags, name = m.groups()
        if sign == "{":
            end = text.index("}", at)
            c = re.fullmatch(r"\s*count\s*=\s*(\d+)\s*", text[at:end])
            if not c:
                raise GrammarError(f"{{{text[at:end]}}} is no part of the native subset; plans.language has it")
            rule.most = int(c[1])
            at = end + 1
        elif sign in ("(", ")"):
            depth += 1 if sign == "(" else -1
        elif sign in ("+", "*") and rule.items:
            rule.items[-1] = Item(rule.items[-1].name, rule.items[-1].tags, sign, rule.items[-1].optional)
        elif tags is not None and rule.items:
            last = rule.items[-1]
            rule.items[-1] = Item(last.name, last.tags + _tags(tags), last.repeat, last.optional)
        elif lemma is not None:
            rule.items.append(Item(f"'{lemma}'", optional=depth > 0))
        elif name:
            rule.items.append(Item(name, optional=depth > 0))
    return rule


def _check(grammar: Grammar, names: set[str]) -> None:
    for r in grammar.rules:
        if not r.items or all(i.optional or i.repeat == "*" for i in r.items):
            raise GrammarError(f"{r.left} can be empty")
        if len(r.items) == 1 and r.items[0].name == r.left:
            raise GrammarError(f"{r.left} is its own rule")
        heads = [i for i in r.items if any(t == "rt" for t, _, _ in i.tags)]
        if len(heads) > 1 or any(h.optional for h in heads):
            raise GrammarError(f"{r.left}: one head, and not an optional item")
        if heads and heads[0] is not r.items[0]:
            raise GrammarError(f"{r.left}: a head other than the first item is no part of the native subset; plans.language has it")
        for i in r.items:
            if i.name not in names and i.name not in _TEST and not i.name.startswith("'"):
                raise GrammarError(f"{i.name} is not defined")
            for t, _, _ in i.tags:
                if t not in _TAG and t != "rt":
                    raise GrammarError(f"unknown constraint {t}")
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 1:
            raise GrammarError(f"{name} is recursive")
        if name in names and name not in state:
            state[name] = 1
            for r in grammar.rules:
                if r.left == name:
                    for i in r.items:
                        visit(i.name)
            state[name] = 2
            grammar.order.append(name)

    visit(grammar.root)


def apply(charts: DataFrame, grammar: Grammar) -> DataFrame:
    """``charts`` with a column ``spans``: the root's spans. Rules that the root does not reach are left out."""
    toks = F.col("toks")
    column = {n: f"_{i}" for i, n in enumerate(grammar.order)}
    for name in grammar.order:
        rules = [r for r in grammar.rules if r.left == name]
        steps = {}
        for a, r in enumerate(rules):
            for b, i in enumerate(r.items):
                base = F.col(column[i.name]) if i.name in column else G.terminal(toks, _terminal(i.name))
                steps[f"_r{a}_{b}"] = _narrow(base, i, toks)
        charts = computed(charts, steps)
        runs = {f"_r{a}_{b}p": G.plus(F.col(f"_r{a}_{b}")) for a, r in enumerate(rules) for b, i in enumerate(r.items) if i.repeat}
        charts = computed(charts, runs) if runs else charts
        whole = []
        for a, r in enumerate(rules):
            for keep in _choices(r.items):
                parts = [F.col(f"_r{a}_{b}" + ("p" if r.items[b].repeat else "")) for b in keep]
                spans = G.seq(*parts)
                whole.append(G.count(spans, r.most) if r.most else spans)
        charts = computed(charts, {column[name]: reduce(F.array_union, whole)}).drop(*steps, *runs)
    return charts.withColumn("spans", F.col(column[grammar.root])).drop(*column.values())


def _terminal(name: str):
    return (lambda x: x["low"] == name[1:-1].lower()) if name.startswith("'") else _TEST[name]


def _narrow(spans: Column, item: Item, toks: Column) -> Column:
    """Constraints hold for the first token of a span, which is its head in the native subset."""
    for tag, value, negated in item.tags:
        if tag != "rt":
            spans = F.filter(spans, _passes(toks, tag, value, negated))
    return spans


def _passes(toks: Column, tag: str, value: str, negated: bool):
    def test(s: Column) -> Column:
        found = F.coalesce(_TAG[tag](F.element_at(toks, (s["f"] + 1).cast("int")), value), F.lit(False))
        return ~found if negated else found

    return test


def _choices(items: list[Item]) -> list[list[int]]:
    """Which items stand: with and without each optional or starred one."""
    out: list[list[int]] = [[]]
    for i, item in enumerate(items):
        out = [c + [i] for c in out] + (out if item.optional or item.repeat == "*" else [])
    return [c for c in out if c]
