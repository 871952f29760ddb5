"""Algorithms that a dictionary names as ``alg:name``: functions from a sentence's units to spans.

Each gives (f, t, lemma, grammemes, fields) of what it finds, spans of one algorithm without overlaps, from left to right and the
longest first. ``register`` adds one of the user's own under a new name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date as Day

from factloom.functions.text import SCALES, UNITS
from factloom.operators.morphology import BIT, mask, plain

Found = tuple[int, int, str, int, dict[str, str]]
REGISTRY: dict[str, Callable[[list], Iterator[Found]]] = {}

#: fixed values: months by name, and in Russian by the form that stands in dates
MONTHS = {w: n for words in ("january february march april may june july august september october november december", "января февраля марта апреля мая июня июля августа сентября октября ноября декабря", "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь") for n, w in enumerate(words.split(), 1)}
YEAR_WORDS = {"г", "год", "года", "году", "year"}
FROM, TO = {"from", "с", "от"}, {"to", "till", "until", "до", "по"}
COMMA_AND = {",", "and", "и", "or", "или"}
#: number words of Russian, beside the English ones of ``functions.text``
NATIVE_UNITS = dict(zip("ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать двадцать".split(), range(21), strict=True)) | dict(zip("тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split(), [*range(30, 100, 10), *range(100, 1000, 100)], strict=True))
NATIVE_SCALES = {w: n for n, words in ((1000, "тысяча тысячи тысяч"), (10**6, "миллион миллиона миллионов"), (10**9, "миллиард миллиарда миллиардов"), (10**12, "триллион триллиона триллионов")) for w in words.split()}


def register(name: str):
    def add(f: Callable[[list], Iterator[Found]]):
        REGISTRY[name] = f
        return f

    return add


def _year(text: str) -> int | None:
    """Two digits: below 30 in this century, else in the last one; 100 to 999 and over 3000 are no years."""
    n = int(text)
    if len(text) <= 2:
        return 2000 + n if n < 30 else 1900 + n
    return n if 1000 <= n <= 3000 else None


def _digits(words: list[str], k: int, low: int = 1, high: int = 31) -> int | None:
    return int(words[k]) if k < len(words) and words[k].isdigit() and len(words[k]) <= 2 and low <= int(words[k]) <= high else None


def _month_year(words: list[str], k: int) -> tuple[int, int | None, int] | None:
    """Month, year and end of "May", "May 2012", "May 2012 year" from a place."""
    month = MONTHS.get(words[k]) if k < len(words) else None
    if month is None:
        return None
    end, year = k + 1, None
    at = end + (end < len(words) and words[end] == ",")
    if at < len(words) and words[at].isdigit() and len(words[at]) == 4 and _year(words[at]):
        year, end = _year(words[at]), at + 1
        if end < len(words) and words[end] in YEAR_WORDS:
            end += 1
    return month, year, end


def _iso(year: int | None, month: int, day: int | None) -> str | None:
    try:
        Day(year or 2000, month, day or 1)
    except ValueError:
        return None
    return f"{year:04}-{month:02}" + (f"-{day:02}" if day else "") if year else f"--{month:02}" + (f"-{day:02}" if day else "")


def dates(words: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """f, t, begin and end of dates (days of one month with the same month and year, intervals) in lower-cased words."""
    k = 0
    while k < len(words):
        found = list(_date_at(words, k))
        yield from found
        k = max((t for _, t, _, _ in found), default=k + 1)


def _date_at(words: list[str], k: int) -> Iterator[tuple[int, int, str, str]]:
    if words[k] in FROM:  # from 1 [May [2012]] to 3 May [2012]
        first = _digits(words, k + 1)
        if first:
            mine = _month_year(words, k + 2)
            at = mine[2] if mine else k + 2
            last = _digits(words, at + 1) if at < len(words) and words[at] in TO else None
            rest = _month_year(words, at + 2) if last else None
            if rest:
                begin, end = _iso(mine[1] or rest[1] if mine else rest[1], mine[0] if mine else rest[0], first), _iso(rest[1], rest[0], last)
                if begin and end:
                    yield k, rest[2], begin, end
                    return
    first = _digits(words, k)
    if first is not None:
        seps = words[k + 1 : k + 4 : 2]
        if len(seps) == 2 and seps[0] == seps[1] and seps[0] in ("." , "/", "\\", "-") and k + 4 < len(words):
            month, year = _digits(words, k + 2, 1, 12), words[k + 4]
            if month and year.isdigit() and len(year) in (2, 4) and _year(year) and (iso := _iso(_year(year), month, first)):
                yield k, k + 5, iso, iso
                return
        days, at = [(k, first)], k + 1
        while at + 1 < len(words) and words[at] in COMMA_AND and _digits(words, at + 1):
            days.append((at + 1, _digits(words, at + 1)))
            at += 2
        rest = _month_year(words, at)
        if rest and all(_iso(rest[1], rest[0], d) for _, d in days):
            for n, (place, d) in enumerate(days):
                iso = _iso(rest[1], rest[0], d)
                yield place, (rest[2] if n == len(days) - 1 else place + 1), iso, iso
            return
    rest = _month_year(words, k)
    if rest and rest[1]:
        yield k, rest[2], _iso(rest[1], rest[0], None), _iso(rest[1], rest[0], None)
    elif words[k].isdigit() and len(words[k]) == 4 and _year(words[k]) and k + 1 < len(words) and words[k + 1] in YEAR_WORDS:
        yield k, k + 2, words[k], words[k]


@register("date")
def _dates(units: list) -> Iterator[Found]:
    words = [u.text.lower() for u in units]
    for f, t, begin, end in dates(words):
        yield f, t, begin if begin == end else f"{begin} - {end}", mask("S"), {"Begin": begin, "End": end}


@register("quasi_date")
def _quasi(units: list) -> Iterator[Found]:
    """Day and month without a year."""
    for f, t, lemma, grams, fields in _dates(units):
        if fields["Begin"].startswith("--"):
            yield f, t, lemma, grams, fields


@register("digital_time")
def _times(units: list) -> Iterator[Found]:
    words = [u.text for u in units]
    for k in range(len(words) - 2):
        if words[k + 1] == ":" and _digits(words, k, 0, 23) is not None and len(words[k + 2]) == 2 and _digits(words, k + 2, 0, 59) is not None:
            yield k, k + 3, f"{int(words[k]):02}:{words[k + 2]}", mask("S"), {"Time": f"{int(words[k]):02}:{words[k + 2]}"}


#: fixed values: days, months and years from today by phrase
RELATIVE = {"today": ("d", 0), "yesterday": ("d", -1), "tomorrow": ("d", 1), "сегодня": ("d", 0), "вчера": ("d", -1), "завтра": ("d", 1), "last month": ("m", -1), "next month": ("m", 1), "last year": ("y", -1), "next year": ("y", 1), "this year": ("y", 0)}


def relative(phrase: str, today: Day) -> tuple[str, str] | None:
    """First and last day of a relative date, as ISO strings."""
    kind, n = RELATIVE.get(phrase, (None, 0))
    if kind == "d":
        d = Day.fromordinal(today.toordinal() + n)
        return d.isoformat(), d.isoformat()
    if kind == "m":
        month = today.year * 12 + today.month - 1 + n
        begin = Day(month // 12, month % 12 + 1, 1)
        end = Day.fromordinal(Day((month + 1) // 12, (month + 1) % 12 + 1, 1).toordinal() - 1)
        return begin.isoformat(), end.isoformat()
    if kind == "y":
        return f"{today.year + n:04}-01-01", f"{today.year + n:04}-12-31"
    return None


@register("date_chain")
def _chain(units: list) -> Iterator[Found]:
    """Dates and phrases of relative ones, which stay phrases (``relative`` gives their days for a document's date)."""
    words, taken, out = [u.text.lower() for u in units], set(), list(_dates(units))
    for found in out:
        taken |= set(range(found[0], found[1]))
    for n in (2, 1):
        for k in range(len(words) - n + 1):
            phrase = " ".join(words[k : k + n])
            if phrase in RELATIVE and not taken & set(range(k, k + n)):
                taken |= set(range(k, k + n))
                out.append((k, k + n, phrase, mask("S"), {"Phrase": phrase}))
    yield from sorted(out, key=lambda x: x[:2])


def word_number(words: list[str]) -> float | None:
    """The value of number words and digits: hundreds, tens and units add up; greater scales close a group."""
    done, group, some = 0.0, 0.0, False
    for w in words:
        v = NATIVE_UNITS.get(w, UNITS.get(w))
        scale = NATIVE_SCALES.get(w, SCALES.get(w))
        if v is not None or re.fullmatch(r"\d+", w):
            group += v if v is not None else int(w)
        elif scale == 100:
            group = (group or 1) * 100
        elif scale:
            done, group = done + (group or 1) * scale, 0.0
        else:
            return None
        some = True
    return done + group if some else None


@register("number")
def _numbers(units: list) -> Iterator[Found]:
    """Digits with decimals, number words with scales, "and a half"; lists and ranges share the last scale."""
    words, k = [plain(u.text) for u in units], 0
    out: list[list] = []
    while k < len(words):
        end = k
        while end < len(words) and word_number(words[k : end + 1]) is not None:
            end += 1
        value = word_number(words[k:end]) if end > k else None
        if value is not None and end == k + 1 and words[k].isdigit() and end + 1 < len(words) and words[end] in (".", ",") and words[end + 1].isdigit() and units[end + 1].f == units[end].t:
            tail = words[end + 1]
            if words[end] == ".":
                value, end = float(f"{words[k]}.{tail}"), end + 2
        if value is not None:
            if words[end : end + 3] == ["and", "a", "half"]:
                value, end = value + 0.5, end + 3
            elif words[end : end + 2] == ["с", "половиной"]:
                value, end = value + 0.5, end + 2
            out.append([k, end, value])
        k = max(end, k + 1)
    scale = None
    for n in range(len(out) - 2, -1, -1):  # 5, 6 or 7 million; from 5 to 7 million
        (_, end, value), (start, stop, _) = out[n], out[n + 1]
        between, last = words[end:start], words[stop - 1]
        scale = NATIVE_SCALES.get(last, SCALES.get(last)) or scale
        if not (len(between) == 1 and between[0] in COMMA_AND | TO):
            scale = None
        elif scale and value < scale and words[end - 1] not in NATIVE_SCALES | SCALES:
            out[n][2] = value * scale
    for f, t, value in out:
        text = str(int(value)) if value == int(value) else str(value)
        yield f, t, text, mask("NUM"), {"Value": text}


@register("words_in_quotes")
def _quoted(units: list) -> Iterator[Found]:
    """Quoted words without inner punctuation; not a whole sentence."""
    opened = None
    for k, u in enumerate(units):
        if u.text in "\"«»“”„":
            if opened is not None and k > opened + 1 and not (opened == 0 and k >= len(units) - 2):
                inner = [x.text for x in units[opened + 1 : k]]
                if not any(w in ".,;:!?" for w in inner):
                    yield opened + 1, k, " ".join(inner), mask("S"), {}
                    opened = None
                    continue
            opened = k
    return


def _role(u) -> set[str]:
    found = {name for name in ("persn", "famn", "patrn") for h in u.homonyms if h.grams & BIT[name]}
    return found if u.text[:1].isupper() else set()


#: fixed values: orders of surname (F), first name (I), patronymic (O) and initials (i)
TEMPLATES = ["F I O", "I O F", "I F", "F I", "I O", "F i . i .", "F i .", "i . i . F", "i . F", "I i . F", "F", "I"]


@register("fio")
def _names(units: list, templates: list[str] = TEMPLATES[:-1]) -> Iterator[Found]:
    """Names of persons by templates, the longest first; surnames are predicted for capitalized words
    without a reading next to a first name or initials."""
    k = 0
    while k < len(units):
        best = None
        for template in templates:
            parts = template.split()
            some = units[k : k + len(parts)]
            if len(some) == len(parts) and all(_fits(p, u, len(parts)) for p, u in zip(parts, some, strict=True)) and (best is None or len(parts) > len(best[0])):
                best = (parts, some)
        if best is None:
            k += 1
            continue
        parts, some = best
        of = lambda sign: " ".join(_lemma(u, {"F": "famn", "I": "persn", "O": "patrn"}[sign]) for p, u in zip(parts, some, strict=True) if p == sign)  # noqa: E731, B023
        initials = [u.text for p, u in zip(parts, some, strict=True) if p == "i"]
        fields = {"Surname": of("F"), "FirstName": of("I") or (initials[0] if initials else ""), "Patronymic": of("O") or (initials[1] if len(initials) > 1 else "")}
        known = any(h.grams & BIT["famn"] and not h.predicted for p, u in zip(parts, some, strict=True) if p == "F" for h in u.homonyms)
        fields = {n: v for n, v in fields.items() if v} | ({"SurnameIsDictionary": str(known).lower()} if fields["Surname"] else {})
        yield k, k + len(parts), " ".join(fields[n] for n in ("Surname", "FirstName", "Patronymic") if n in fields), mask("S,persn"), fields
        k += len(parts)


@register("fio_without_surname")
def _first_names(units: list) -> Iterator[Found]:
    yield from _names(units, ["I O", "I"])


def _fits(part: str, u, size: int) -> bool:
    if part == ".":
        return u.text == "."
    if part == "i":
        return len(u.text) == 1 and u.text.isupper()
    role = _role(u)
    if part == "F":
        predicted = size > 1 and not u.first and u.text[:1].isupper() and len(u.text) > 2 and u.text.isalpha() and not any(h.pos and not h.predicted for h in u.homonyms)
        return "famn" in role or predicted
    return {"I": "persn", "O": "patrn"}[part] in role


def _lemma(u, role: str) -> str:
    lemma = next((h.lemma for h in u.homonyms if h.grams & BIT[role]), u.text)
    return lemma[:1].upper() + lemma[1:]
