"""The whole grammar language: text of rules to desugared rules for the chart parser (``plans/chart``).

    #include <date.cxx>
    #define CASES [nom,acc]
    #GRAMMAR_ROOT S
    NP -> Adj<gnc-agr[1]>* Noun<gnc-agr[1], rt> {weight=0.7};
    S -> NP<GU=${CASES}> interp (F.Who::norm="nom,sg"; G.X="yes") "in" (Adj) Word<kwtype=city> interp (+F.Who from City.Name) {trim};

Anything that is not understood is an error: unknown directives, tags and limits, symbols without a rule,
agreements that are not of exactly two items, two heads, a head on an optional item, empty rules, rules that are their own part
alone. Equal rules are merged and rules that the root does not reach are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Tag:
    name: str
    value: str = ""
    negated: bool = False


@dataclass(frozen=True)
class Target:
    """Where ``interp`` puts a chain: fact.field, with a constant, a source in a fact of the chain, or the chain itself."""

    fact: str
    name: str
    value: str | None = None
    source: str | None = None
    plus: bool = False
    options: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Item:
    name: str
    tags: tuple[Tag, ...] = ()
    interp: tuple[Target, ...] = ()
    repeat: str = ""
    between: tuple[str, ...] = ()  # agreements between copies
    optional: bool = False

    def has(self, tag: str) -> bool:
        return any(t.name == tag for t in self.tags)


@dataclass(frozen=True)
class Rule:
    left: str
    items: tuple[Item, ...]
    head: int = 0
    count: int = 1000
    weight: float = 1.0
    outgram: str | None = None
    trim: bool = False
    not_hreg_fact: bool = False
    left_dominant: bool = False
    right_recessive: bool = False


@dataclass
class Grammar:
    rules: list[Rule]
    root: str
    filters: list[list[tuple[Item, int | None]]] = field(default_factory=list)
    kwset: tuple[str, ...] = ()
    interpret: bool = True

    def keywords(self) -> set[str]:
        """Articles and types that tags and #GRAMMAR_KWSET name."""
        found = set(self.kwset)
        for items in [r.items for r in self.rules] + [[i for i, _ in f] for f in self.filters]:
            for t in (t for i in items for t in i.tags if t.name in ("kwtype", "kwset", "kwsetf", "label") and t.value != "none"):
                found |= set(values(t.value))
        return found


#: fixed values: the language's terminals and tags
TERMINALS = {"AnyWord", "Word", "Noun", "Adj", "AdjPartOrdNum", "OrdinalNumeral", "Adv", "Participle", "Verb", "Infinitive", "Prep", "UnknownPOS", "SimConjAnd", "QuoteDbl", "QuoteSng", "LBracket", "RBracket", "Bracket", "Hyphen", "Punct", "Comma", "Colon", "Percent", "Dollar", "PlusSign", "NumSign", "Ampersand", "EOSent", "YYDate", "Digit"}
AGREEMENTS = {"gnc-agr", "nc-agr", "c-agr", "gn-agr", "gc-agr", "n-agr", "sp-agr", "fem-c-agr", "after-num-agr", "izf-agr", "fio-agr", "geo-agr", "any-agr"}
TAGS = {"kwtype", "kwset", "kwsetf", "label", "gztweight", "gram", "GU", "wff", "wfl", "wfm", "h-reg", "h-reg1", "h-reg2", "l-reg", "quoted", "l-quoted", "r-quoted", "fw", "mw", "lat", "no_hom", "hom", "prep", "dict", "name", "geo", "cut", "rt"}
LIMITS = {"count", "weight", "trim", "outgram", "not_hreg_fact", "left_dominant", "right_recessive"}
OPTIONS = {"norm", "not_norm", "only_from_fact", "un_status", "sh_name", "dl_pronoun", "quoted_org_norm"}


def values(text: str) -> list[str]:
    """The members of a list [a, "b"], or the one value."""
    return [v.strip().strip("\"'").strip() for v in text.strip().strip("[]").split(",") if v.strip()]


def preprocess(text: str, load: Callable[[str], str] | None = None, macros: dict[str, str] | None = None, inner: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """The rules' text without comments and directives, macros put in; the directives."""
    macros = {} if macros is None else macros
    out, found, take = [], [], [True]
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
    for line in text.splitlines():
        m = re.match(r"\s*#(\w+)\s*(.*)$", line)
        line = _without_comment(line)
        if not m:
            if take[-1]:
                out.append(re.sub(r"\$\{(\w+)\}", lambda m: macros.get(m[1], m[0]), line))
            continue
        name, rest = m[1], _without_comment(m[2]).strip()
        word = rest.split()[0] if rest else ""
        if name in ("ifdef", "ifndef"):
            take.append(take[-1] and (word in macros) == (name == "ifdef"))
        elif name == "else":
            if len(take) < 2:
                raise GrammarError("#else without #ifdef")
            take[-1] = take[-2] and not take[-1]
        elif name == "endif":
            if len(take) < 2:
                raise GrammarError("#endif without #ifdef")
            take.pop()
        elif not take[-1]:
            continue
        elif name == "define":
            macros[word] = re.sub(r"\$\{(\w+)\}", lambda m: macros.get(m[1], m[0]), rest[len(word) :].strip())
        elif name == "undef":
            macros.pop(word, None)
        elif name == "include":
            if load is None:
                raise GrammarError(f"no files to include {rest} from")
            body, more = preprocess(load(re.sub(r"[<>\"“”;\s]", "", rest)), load, macros, True)
            out.append(body)
            found += [d for d in more if d[0] != "GRAMMAR_ROOT"]
        elif name.lower() in ("grammar_root", "grammar_kwset", "filter", "encoding", "no_interpretation", "nointerpretation"):
            found.append((name.upper().replace("NOINTER", "NO_INTER"), re.sub(r"\$\{(\w+)\}", lambda m: macros.get(m[1], m[0]), rest.rstrip(";").strip())))
        else:
            raise GrammarError(f"unknown directive #{name}")
    if len(take) > 1:
        raise GrammarError("#ifdef without #endif")
    return "\n".join(out), found


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif line.startswith("//", i) and not re.search(r"=~?\s*/[^/]*$", line[:i]):
            return line[:i]
    return line


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self) -> str:
        self.space()
        return self.text[self.at : self.at + 1]

    def take(self, sign: str) -> bool:
        self.space()
        if self.text.startswith(sign, self.at):
            self.at += len(sign)
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise GrammarError(f"{sign!r} is missing before {self.text[self.at : self.at + 40]!r}")

    def name(self) -> str:
        self.space()
        m = re.compile(r"[\w$-]*[\w$]").match(self.text, self.at)
        if not m:
            raise GrammarError(f"no name at {self.text[self.at : self.at + 40]!r}")
        name = m[0]
        if "->" in self.text[self.at : m.end() + 1] and name.endswith("-"):
            name = name[:-1]
        self.at += len(name)
        return name

    def string(self) -> str:
        quote = self.text[self.at]
        end = self.at + 1
        while end < len(self.text) and self.text[end] != quote:
            end += 2 if self.text[end] == "\\" else 1
        if end >= len(self.text):
            raise GrammarError(f"no end of {self.text[self.at : self.at + 40]!r}")
        value, self.at = self.text[self.at + 1 : end], end + 1
        return value

    def until(self, close: str) -> str:
        """Text up to a closing sign outside strings, regular expressions and brackets."""
        start, quote, depth = self.at, "", 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if quote:
                if c == "\\":
                    self.at += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'" or (c == "/" and re.search(r"=\s*~?\s*$", self.text[start : self.at])):
                quote = c
            elif c == close and depth <= 0:
                self.at += 1
                return self.text[start : self.at - 1]
            elif c in "[]":
                depth += 1 if c == "[" else -1
            self.at += 1
        raise GrammarError(f"{close!r} is missing after {self.text[start : start + 40]!r}")


def cut(text: str, sep: str) -> list[str]:
    """Parts between separators outside strings, regular expressions and brackets."""
    reader, parts = _Reader(text + sep), []
    while reader.at < len(reader.text):
        parts.append(reader.until(sep))
    return parts


def tags(text: str, allowed: set[str]) -> tuple[Tag, ...]:
    found = []
    for part in cut(text, ","):
        m = re.fullmatch(r"\s*(~?)\s*([\w-]+)\s*(?:=\s*(.*)|(\[[^\]]*\]))?\s*", part, re.S)
        if not m:
            raise GrammarError(f"cannot read the tag {part.strip()!r}")
        no, name, value, group = m.groups()
        if name not in allowed and name not in AGREEMENTS:
            raise GrammarError(f"unknown tag {name}")
        value = (value or group or "").strip()
        if value.startswith("~") and name != "GU":
            no, value = "~", value[1:].strip()
        if name in ("wff", "wfl", "wfm") and value.startswith("/"):
            value = value[1:].rsplit("/", 1)[0]
        elif name != "GU" and not value.startswith("["):
            value = value.strip("\"'")
        if name in ("wff", "wfl", "wfm"):
            try:
                re.compile(value)
            except re.error as e:
                raise GrammarError(f"bad expression {value!r}: {e}") from e
        found.append(Tag({"h-reg": "h-reg2", "hom": "no_hom"}.get(name, name), value, bool(no) != (name == "hom")))
    return tuple(found)


def _target(text: str) -> Target:
    text, *rest = re.split(r"::", text, maxsplit=1)
    options = []
    for part in cut(rest[0], ",") if rest else []:
        name, _, value = (x.strip() for x in part.partition("="))
        if name not in OPTIONS:
            raise GrammarError(f"unknown option {name}")
        options.append((name, value.strip("\"'")))
    m = re.fullmatch(r"\s*(\+?)\s*(\w+)\.(\w+)\s*(?:=\s*(.+?)|from\s+([\w.]+))?\s*", text, re.S)
    if not m:
        raise GrammarError(f"cannot read interp ({text.strip()})")
    value = m[4]
    return Target(m[2], m[3], value.strip().strip("\"'") if value is not None else None, m[5], bool(m[1]), tuple(options))


def _item(reader: _Reader, optional: bool) -> Item:
    if reader.peek() in ("'", '"'):
        name = f"'{reader.string().strip()}'"
    else:
        name = reader.name()
    item = Item(name, optional=optional)
    while True:
        c = reader.peek()
        if c == "<":
            reader.at += 1
            item = replace(item, tags=item.tags + tags(reader.until(">"), TAGS))
        elif c and c in "+*!":
            if item.repeat:
                raise GrammarError(f"{name}: two repetitions")
            reader.at += 1
            between: tuple[str, ...] = ()
            if reader.peek() == "[":
                reader.at += 1
                between = tuple(v.strip() for v in reader.until("]").split(","))
                if not set(between) <= AGREEMENTS:
                    raise GrammarError(f"unknown agreement {between}")
            item = replace(item, repeat=c, between=between)
        elif re.compile(r"interp\s*\(").match(reader.text, reader.at):
            reader.at = reader.text.index("(", reader.at) + 1
            inside = ""
            while True:
                inside += reader.until(")")
                if inside.count("(") <= inside.count(")"):
                    break
                inside += ")"
            item = replace(item, interp=item.interp + tuple(_target(t) for t in cut(inside, ";") if t.strip()))
        else:
            return item


def _limits(text: str) -> dict:
    found: dict = {}
    for part in cut(text, ","):
        name, _, value = (x.strip().strip("\"'") for x in part.partition("="))
        if name not in LIMITS:
            raise GrammarError(f"unknown limit {name}")
        if name == "outgram":
            value = re.sub(r"^[\"']|[\"']$", "", part.partition("=")[2].strip())
        found[name] = {"count": int, "weight": float, "outgram": str}.get(name, lambda v: True)(value)
    return found


def parse(text: str, load: Callable[[str], str] | None = None, defined: set[str] | None = None) -> Grammar:
    """A grammar from its text; ``load`` gives the text of an included file."""
    body, directives = preprocess(text, load, {d: "" for d in defined or ()})
    reader, rules = _Reader(body), []
    while reader.peek():
        left = reader.name()
        reader.need("->")
        while True:
            items: list[Item] = []
            while reader.peek() not in ("", ";", "|", "{"):
                if reader.take("("):
                    while not reader.take(")"):
                        items.append(_item(reader, True))
                        if reader.take("|"):
                            raise GrammarError(f"{left}: | inside ( )")
                else:
                    items.append(_item(reader, False))
            limits = {}
            if reader.take("{"):
                limits = _limits(reader.until("}"))
            rules.append((left, items, limits))
            if not reader.take("|"):
                break
        reader.need(";")
    lefts = {left for left, _, _ in rules}
    if lefts & TERMINALS:
        raise GrammarError(f"terminals with rules: {sorted(lefts & TERMINALS)}")
    used = {i.name for left, items, _ in rules for i in items if i.name != left}
    named = [v.strip().split()[0] for n, v in directives if n == "GRAMMAR_ROOT" and v.strip()]
    roots = named[-1:] or sorted(lefts - used)
    if len(roots) != 1 or roots[0] not in lefts:
        raise GrammarError(f"the root is not clear: {roots}")
    for left, items, _ in rules:
        _check(left, items, lefts)
    grammar = Grammar(_desugar(rules, roots[0]), roots[0])
    for name, value in directives:
        if name == "GRAMMAR_KWSET":
            grammar.kwset += tuple(values(value))
        elif name == "FILTER":
            grammar.filters.append(_filter(value))
        elif name == "NO_INTERPRETATION":
            grammar.interpret = False
    return grammar


def _filter(text: str) -> list[tuple[Item, int | None]]:
    """Items of a #filter with the most tokens that may stand before the next."""
    reader, out = _Reader(text), []
    while reader.peek():
        reader.need("&")
        item = _item(reader, False)
        if item.name not in TERMINALS and not item.name.startswith("'"):
            raise GrammarError(f"#filter takes terminals only, not {item.name}")
        gap = None
        if reader.take("["):
            gap = int(reader.until("]"))
        out.append((item, gap))
    if not out:
        raise GrammarError("empty #filter")
    return out


def _check(left: str, items: list[Item], lefts: set[str]) -> None:
    if not items or all(i.optional or i.repeat == "*" for i in items):
        raise GrammarError(f"{left} can be empty")
    if len(items) == 1 and items[0].name == left and not items[0].repeat:
        raise GrammarError(f"{left} is its own rule")
    heads = [i for i in items if i.has("rt")]
    if len(heads) > 1 or any(h.optional or h.repeat == "*" for h in heads):
        raise GrammarError(f"{left}: one head, and not an optional item")
    pairs: dict[tuple[str, str], int] = {}
    for i in items:
        if i.name not in lefts and i.name not in TERMINALS and not i.name.startswith("'"):
            raise GrammarError(f"{i.name} is not defined")
        for t in i.tags:
            if t.name in AGREEMENTS:
                pairs[t.name, t.value] = pairs.get((t.name, t.value), 0) + 1
        if i.has("gztweight") and sum(t.name == "kwtype" and not t.negated for t in i.tags) != 1:
            raise GrammarError(f"{left}: gztweight needs one kwtype")
    odd = [k for k, n in pairs.items() if n != 2]
    if odd:
        raise GrammarError(f"{left}: agreements of other than two items {odd}")


def _desugar(rules: list[tuple[str, list[Item], dict]], root: str) -> list[Rule]:
    out: list[Rule] = []
    made: dict[Item, str] = {}

    def plain(item: Item) -> Item:
        """X+ and X! as a symbol of their own; the head of a run is its first part."""
        if not item.repeat:
            return item
        inner = tuple(t for t in item.tags if t.name not in AGREEMENTS and t.name != "rt")
        one = Item(item.name, inner, item.interp)
        key = replace(one, repeat="!" if item.repeat == "!" else "+", between=item.between)
        if key not in made:
            made[key] = name = f"{item.name}{key.repeat}{len(made)}"
            out.append(Rule(name, (one,)))
            agree = tuple(Tag(a, "[0]") for a in item.between)
            again, first = replace(one, tags=one.tags + agree), Item(name, agree)
            if key.repeat == "!":
                out.extend(Rule(name, (first, Item(sep), again)) for sep in ("Comma", "SimConjAnd"))
            else:
                out.append(Rule(name, (first, again)))
        return Item(made[key], tuple(t for t in item.tags if t.name in AGREEMENTS or t.name == "rt"))

    for left, items, limits in rules:
        choices: list[list[int]] = [[]]
        for n, item in enumerate(items):
            choices = [c + [n] for c in choices] + (choices if item.optional or item.repeat == "*" else [])
        for keep in choices:
            some = [plain(items[n]) for n in keep]
            if not some:
                continue
            count: dict[tuple[str, str], int] = {}
            for i in some:
                for t in i.tags:
                    count[t.name, t.value] = count.get((t.name, t.value), 0) + 1
            some = [replace(i, tags=tuple(t for t in i.tags if t.name not in AGREEMENTS or count[t.name, t.value] == 2), optional=False) for i in some]
            if len(some) == 1 and some[0].name == left:
                continue
            head = next((n for n, i in enumerate(some) if i.has("rt")), 0)
            out.append(Rule(left, tuple(some), head, **limits))
    out = list(dict.fromkeys(out))
    reached, todo = set(), [root]
    while todo:
        name = todo.pop()
        if name not in reached:
            reached.add(name)
            todo += [i.name for r in out if r.left == name for i in r.items]
    return [r for r in out if r.left in reached]
