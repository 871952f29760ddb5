"""Gazetteer, fact-type and configuration files: one language of typed, named blocks.

    import "base.proto";
    message city : TAuxDicArticle {}
    message Born : NFactType.TFact { required string Who = 1; optional string Where = 2 [default = "?"]; }
    city "Nizhny_Novgorod" { key = "Nizhny Novgorod" | { "nn.txt" type=FILE }; mainword = 2; lemma = "Nizhny Novgorod" }

Imports of files that the reader does not have (built-in ones) are passed over if they are named ``BUILT_IN``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

BUILT_IN = {"base.proto", "articles_base.proto", "facttypes_base.proto", "kwtypes_base.proto"}
_TOKEN = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(-?\d+(?:\.\d+)?)(?![\w.])|([\w.]+)|([{}\[\]()=;:|,+]))""")


class DictionaryError(ValueError):
    pass


@dataclass
class Article:
    type: str
    name: str
    fields: dict[str, list] = field(default_factory=dict)  # strings, numbers, blocks (dicts, with their own text under "")

    def one(self, name: str, default=None):
        return self.fields.get(name, [default])[0]


@dataclass
class FieldType:
    name: str
    type: str = "string"
    required: bool = False
    default: str | None = None
    case: str = ""
    info: bool = False


@dataclass
class Dictionary:
    articles: list[Article] = field(default_factory=list)
    parents: dict[str, str] = field(default_factory=dict)
    types: dict[str, list[FieldType]] = field(default_factory=dict)

    def is_a(self, kind: str, ancestor: str) -> bool:
        seen = set()
        while kind not in seen:
            if kind == ancestor:
                return True
            seen.add(kind)
            kind = self.parents.get(kind, kind)
        return False

    def fields(self, kind: str) -> list[FieldType]:
        """Own and inherited fields."""
        out, seen = [], set()
        while kind in self.types and kind not in seen:
            seen.add(kind)
            out = self.types[kind] + out
            kind = self.parents.get(kind, "")
        return out


def tokens(text: str) -> list[tuple[str, str]]:
    text = re.sub(r"""("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/""", lambda m: m[1] or " ", text, flags=re.S)
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise DictionaryError(f"cannot read {text[at : at + 40].strip()!r}")
        at = m.end()
        for kind, x in zip(("text", "number", "name", "sign"), m.groups(), strict=True):
            if x is not None:
                out.append((kind, re.sub(r"\\(.)", r"\1", x[1:-1]) if kind == "text" else x))
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def take(self, sign: str) -> bool:
        if self.peek() == ("sign", sign):
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise DictionaryError(f"{sign!r} is missing before {self.peek()[1]!r}")

    def value(self):
        kind, x = self.next()
        if (kind, x) == ("sign", "{"):
            return self.block()
        if (kind, x) == ("sign", "["):
            out = []
            while not self.take("]"):
                out.append(self.value())
                self.take(",")
            return out
        if kind == "number":
            return float(x) if "." in x else int(x)
        if kind in ("text", "name"):
            return x
        raise DictionaryError(f"no value at {x!r}")

    def block(self) -> dict[str, list]:
        found: dict[str, list] = {}
        while not self.take("}"):
            if self.peek()[0] == "end":
                raise DictionaryError("} is missing")
            if self.peek()[0] == "name" and self.peek(1) in (("sign", "="), ("sign", "{")):
                name = self.next()[1]
                self.take("=")
                for v in self.choices():
                    found.setdefault(name, []).extend(v if isinstance(v, list) else [v])
            else:
                found.setdefault("", []).extend(self.choices())
            while self.take(";") or self.take(","):
                pass
        return found

    def choices(self) -> list:
        out = [self.value()]
        while self.take("|") or self.take("+"):
            out.append(self.value())
        return out


def parse(text: str, load: Callable[[str], str] | None = None, into: Dictionary | None = None, seen: set[str] | None = None) -> Dictionary:
    out, seen, r = into or Dictionary(), seen if seen is not None else set(), _Reader(text)
    while r.peek()[0] != "end":
        kind, word = r.next()
        if (kind, word) == ("sign", ";"):
            continue
        if word == "import":
            name = r.next()[1]
            r.take(";")
            if name not in seen and name not in BUILT_IN:
                if load is None:
                    raise DictionaryError(f"no files to import {name} from")
                seen.add(name)
                parse(load(name), load, out, seen)
        elif word in ("encoding", "package"):
            r.next()
            r.take(";")
        elif word == "option":
            while not r.take(";"):
                r.next()
        elif word == "message":
            _message(r, out)
        elif kind == "name":
            name = r.next()[1] if r.peek()[0] in ("text", "name") else ""
            r.need("{")
            out.articles.append(Article(word, name, r.block()))
        else:
            raise DictionaryError(f"cannot read {word!r}")
    return out


def _message(r: _Reader, out: Dictionary) -> None:
    name = r.next()[1]
    out.parents[name] = r.next()[1] if r.take(":") else ""
    fields = out.types[name] = []
    r.need("{")
    while not r.take("}"):
        kind, word = r.next()
        if kind == "end":
            raise DictionaryError(f"message {name}: }} is missing")
        if word in ("required", "optional", "repeated"):
            f = FieldType(type=r.next()[1], name=r.next()[1], required=word == "required")
            r.need("=")
            r.next()
            if r.take("["):
                while not r.take("]"):
                    option = ""
                    while not r.take("="):
                        option += r.next()[1]
                    value = r.value()
                    if option == "default":
                        f.default = str(value)
                    elif "normcase" in option:
                        f.case = str(value).split("_")[0]
                    elif "info" in option:
                        f.info = str(value) == "true"
                    r.take(",")
            fields.append(f)
            r.take(";")
        elif word == "extensions":
            while not r.take(";"):
                r.next()
