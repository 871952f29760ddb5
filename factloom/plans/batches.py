"""Facts of many sentences at once: arrays tell which words can belong to a parse, only these become strings.

Characters are looked up in tables (kind, case, plain form), so words are runs of a kind, by whole arrays. A word whose plain
form no key, reading or terminal names (told by a hash of 64 bits; a false hit costs time alone) fulfils at most the terminals of its
shape, whatever the grammar's patterns say; all others are looked up as strings. What fits no neighbour drops out.
The rest is told exactly and parsed as in ``plans/stretches``, with the same rows.

Defined cases: several grammars to run, grammars that name articles with grammars, lexicons with suffix rules and more than 59 terminals are
read sentence by sentence, as are sentences that stretches do not serve; a null sentence has no facts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from factloom.operators.morphology import plain
from factloom.plans.stretches import KEPT, LONG, QUOTES, WholeSentence

BLOCK = 1 << 20  # bytes of sentences that are looked at together
SPACE, LETTER, DIGIT, SIGN, UNKNOWN = 0, 1, 2, 3, 255
#: what a character tells of its word: not ASCII; a capital inside; a capital at its begin; to be looked up as a string
FOREIGN, UPPER, FIRST, NAMED = 1, 2, 4, 8
_LETTER, _DIGIT, _SPACE = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"\s")
_FACTOR = 0x9E3779B97F4A7C15


class Characters:
    """Kind, marks and plain form of each character that was met."""

    def __init__(self):
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.marks = np.zeros(0x110000, np.uint8)
        self.plain = np.arange(0x110000, dtype=np.uint32)
        self._add(range(0x250))

    def _add(self, codes) -> None:
        for c in codes:
            x = chr(c)
            kind = self.kind[c] = LETTER if _LETTER.match(x) else DIGIT if _DIGIT.match(x) else SPACE if _SPACE.match(x) else SIGN
            low = plain(x)
            if len(low) == 1:
                self.plain[c] = ord(low)
            if kind == LETTER:  # the small form of a sigma depends on its place
                self.marks[c] = FOREIGN * (c > 127) | UPPER * x.isupper() | NAMED * (not x.isalpha() or len(low) != 1 or x == "Σ")

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        out = self.kind[codes]
        if (out == UNKNOWN).any():
            self._add(np.unique(codes[out == UNKNOWN]).tolist())
            out = self.kind[codes]
        return out

    def hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the plain forms of words."""
        up, down = _powers(1 << max(len(codes), 1 << 12).bit_length())
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((self.plain[codes].astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


@cache
def characters() -> Characters:
    return Characters()


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Block:
    """Sentences as arrays: where each begins (one more for the end), and the words of all of them."""

    def __init__(self, text: str, begins: np.ndarray, hyphens: bool):
        chars = characters()
        self.text, self.begins = text, begins
        self.codes = codes = codes_of(text)
        kind, self.marks = chars.kinds(codes), chars.marks[codes]
        first = np.zeros(len(codes) + 1, bool)
        first[begins] = True
        if hyphens:
            at = np.flatnonzero(((codes[1:-1] == ord("-")) | (codes[1:-1] == ord("–"))) & (kind[:-2] == LETTER) & (kind[2:] == LETTER) & ~first[1:-2] & ~first[2:-1]) + 1
            kind[at], self.marks[at] = LETTER, NAMED
        same = (kind[1:] == kind[:-1]) & (kind[1:] != SIGN) & ~first[1:-1]
        word = kind != SPACE
        start, end = word.copy(), word
        start[1:] &= ~same
        end[:-1] &= ~same
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.kind = kind[self.starts]
        self.firsts = np.searchsorted(self.starts, begins)  # of each sentence, and the end

    def words(self, at: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Sieve:
    """The facts of sentences of a column, by a reader."""

    def __init__(self, reader):
        self.reader = reader
        self.plan = plan = reader.plans[0] if len(reader.plans) == 1 else None
        self.able = reader.able and plan is not None and not plan.inner and not plan.endings and plan.covered < 1 << 60
        if not self.able:
            return
        self.hyphens = reader.c.project.hyphens
        named = sorted({plain(w) for w in plan.special | set(plan.known)} - {""})
        ends = np.cumsum([len(w) for w in named], dtype=np.int64)
        self.named = np.unique(characters().hashes(codes_of("".join(named)), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)) if named else np.zeros(0, np.uint64)
        self.likely = np.zeros(1 << 16, bool)
        self.likely[self.named >> np.uint64(48)] = True
        self.most = np.full(32, -1, np.int64)  # terminals by shape
        self.known: dict[tuple, Run] = {}
        self.quotes = np.array(sorted(map(ord, QUOTES)), np.uint32)

    def _masks(self, block: Block) -> np.ndarray:
        """For each word the terminals that it may fulfil, at least."""
        plan, starts = self.plan, block.starts
        out = np.zeros(len(starts), np.int64)
        sign = block.kind == SIGN
        codes, which = np.unique(block.codes[starts[sign]], return_inverse=True)
        out[sign] = np.array([plan.masks[chr(c)] for c in codes.tolist()], np.int64)[which]
        marks = block.marks
        marks[starts] = marks[starts] & ~np.uint8(UPPER) | (marks[starts] & np.uint8(UPPER)) << 1
        shape = np.bitwise_or.reduceat(marks, starts)
        hashes = characters().hashes(block.codes, starts, block.ends)
        named = self.likely[hashes >> np.uint64(48)]
        at = np.flatnonzero(named)
        if len(at):
            named[at] = self.named[np.minimum(np.searchsorted(self.named, hashes[at]), len(self.named) - 1)] == hashes[at]
        named |= shape & NAMED > 0
        named &= ~sign
        at = np.flatnonzero(named)
        out[at] = np.fromiter(map(plan.masks.__getitem__, block.words(at)), np.int64, len(at))
        digits = block.kind == DIGIT
        shape[digits] = 16 + (block.ends[digits] - starts[digits] == 4)
        rest = np.flatnonzero(~named & ~sign)
        shape = shape[rest]
        bound = self.most[shape]
        if (bound < 0).any():
            for k in np.unique(shape[bound < 0]).tolist():
                self.most[k] = plan.most(block.words(rest[np.flatnonzero(shape == k)[:1]])[0])
            bound = self.most[shape]
        out[rest] = bound
        return out

    def _table(self, x: np.ndarray, allowed) -> np.ndarray:
        """What is allowed beside each."""
        if self.plan.covered > 1 << 12:
            values, which = np.unique(x, return_inverse=True)
            return np.array([allowed[v] if v else 0 for v in values.tolist()], np.int64)[which]
        table = np.zeros(2 * self.plan.covered, np.int64)
        for v in np.flatnonzero(np.bincount(x, minlength=1)).tolist():
            table[v] = allowed[v] if v else 0
        return table[x]

    def _runs(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Words that may belong to a parse, and where a new run of them begins (and the end)."""
        plan = self.plan
        x = self._masks(block)
        full = block.firsts[1:] > block.firsts[:-1]
        first, last = block.firsts[:-1][full], block.firsts[1:][full] - 1
        beside = np.zeros(len(x), np.int64)
        beside[1:] = self._table(x, plan.allowed_after)[:-1]
        beside[first] = 0
        x &= plan.begin | beside
        beside[:-1], beside[-1] = self._table(x, plan.allowed_before)[1:], 0
        beside[last] = 0
        x &= plan.end | beside
        new = np.zeros(len(x) + 1, bool)
        new[first] = True
        at = np.flatnonzero(x)
        return at, np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | new[at[1:]], [True]])) if len(at) else np.zeros(1, np.int64)

    def blocks(self, column: pa.Array) -> Iterator[tuple]:
        """``block`` of a column's sentences, some at a time."""
        column = column.cast(pa.large_string()).fill_null("")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        a, most = 0, len(column)
        while a < most:
            b = min(most, max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1))
            part, begins = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            text = part.tobytes().decode()
            if len(text) < len(part):  # characters before each byte
                begins = np.concatenate([[0], np.cumsum(part & 0xC0 != 0x80)])[begins]
            sentence, *rest = self.block(text, begins)
            yield sentence + a, *rest
            a = b

    def block(self, text: str, begins: np.ndarray) -> tuple:
        """Of each fact its sentence, the number there, first and next character, first and next word, and the rest of its row by number;
        and these rests."""
        block, rows = Block(text, begins, self.hyphens), Rows(self.reader.wanted)
        at, cuts = self._runs(block) if len(block.starts) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        runs, sizes = at[cuts[:-1]], np.diff(cuts)
        where = np.searchsorted(block.firsts, runs, "right") - 1
        first, last = runs == block.firsts[where], runs + sizes == block.firsts[where + 1]
        quote = np.isin(block.codes[block.starts], self.quotes) & (block.kind == SIGN)
        places = np.stack([first, last, ~first & quote[runs - 1], ~last & quote[np.minimum(runs + sizes, len(quote) - 1)]]) if len(runs) else np.zeros((4, 0), bool)
        kinds = self._kinds(block.words(at), cuts, np.packbits(places, axis=0, bitorder="little")[0] if len(runs) else places[0])
        which = np.array([rows.of(x) for x in kinds], np.int64)
        # all parses are chosen where none overlap; the other sentences are put together one by one
        most = self.plan.c.project.most
        slow = np.bincount(where, np.array(rows.before, np.int64)[which], len(begins)) > most
        slow |= np.bincount(where, np.array(rows.several, bool)[which], len(begins)) > 0
        alone = ~slow[where]
        sentence, place, which = [where[alone]], [(runs - block.firsts[where])[alone]], [which[alone]]
        found: dict[int, list] = {}
        for s, a, n in zip(*(x[~alone].tolist() for x in (where, runs - block.firsts[where], np.arange(len(runs)))), strict=True):
            found.setdefault(s, []).append((a, kinds[n]))
        for s, mine in found.items():
            sentence.append(s)
            place.append(0)
            which.append(rows.made(self._facts(block, s, mine)))
        sentence, place, which = (np.concatenate([x[0], np.array(x[1:], np.int64)]) for x in (sentence, place, which))
        order = np.argsort(sentence, kind="stable")
        sentence, number, f, t, rest = rows.arrays(sentence[order], place[order], which[order])
        origin, first = block.begins[sentence], block.firsts[sentence]
        return sentence, number, block.starts[first + f] - origin, block.ends[first + t - 1] - origin, f, t, rest, list(rows.rests)

    def _kinds(self, words: list[str], cuts: np.ndarray, places: np.ndarray) -> list[Run]:
        """What is found in runs of words, each kind of run told once."""
        names = list(map(self.plan.names.__getitem__, words)) if self.plan.alike else words
        known, out = self.known, []
        for p, q, place in zip(cuts[:-1].tolist(), cuts[1:].tolist(), places.tolist(), strict=True):
            key = (place, names[p]) if q - p == 1 else (place, *names[p:q])
            found = known.get(key)
            if found is None:
                found = Run(self.plan, words[p:q], place)
                if q - p <= LONG:
                    if len(known) >= KEPT:
                        known.clear()
                    known[key] = found
            out.append(found)
        return out

    def _facts(self, block: Block, sentence: int, found: list[tuple[int, Run]]) -> list[tuple]:
        try:
            if all(x.found is not None for _, x in found):
                return self.plan.joined([(at + a, s) for at, x in found for a, s in x.found])
        except WholeSentence:
            pass
        return self.reader.c.sentence(block.text[block.begins[sentence] : block.begins[sentence + 1]]).facts()


class Run:
    """The stretches of a run of words, with their places in it; None if they cannot be told from the rest of the sentence."""

    def __init__(self, plan, words: list[str], place: int):
        first, last, before, after = (bool(place >> k & 1) for k in range(4))
        size = len(words)
        try:
            self.found = [
                (a, plan.stretch(words[a:b], (first and a == 0, last and b == size, words[a - 1] in QUOTES if a else before, words[b] in QUOTES if b < size else after)))
                for a, b in plan.spans([plan.masks[w] for w in words])
            ]
        except WholeSentence:
            self.found = None
        self.several = self.found is None or any(s.overlaps for _, s in self.found)
        self.rows = [] if self.several else [(a, k, f + at, t + at, fields, w) for at, s in self.found if s.weighed for n in range(len(s.weighed)) for a, k, f, t, fields, w in s.rows(n)]


class Rows:
    """Rows of facts, as lists of them that may stand in many places."""

    def __init__(self, wanted: set[str]):
        self.wanted = wanted
        self.known: dict[Run, int] = {}  # lists by run
        self.rests: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.before: list[int] = []  # rows before those that are not wanted were left out
        self.several: list[bool] = []
        self.rows: tuple[list, ...] = ([], [], [])  # first and next word, rest

    def of(self, run: Run) -> int:
        n = self.known.get(run)
        if n is None:
            n = self.known[run] = self.made(run.rows, run.several)
        return n

    def made(self, rows: list[tuple], several: bool = False) -> int:
        own = [r for r in dict.fromkeys(rows) if not self.wanted or r[1] in self.wanted]
        for article, kind, f, t, fields, weight in own:
            self.rows[0].append(f)
            self.rows[1].append(t)
            self.rows[2].append(self.rests.setdefault((article, kind, fields, weight), len(self.rests)))
        self.sizes.append(len(own))
        self.before.append(len(rows))
        self.several.append(several)
        return len(self.sizes) - 1

    def arrays(self, sentence: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of lists by sentence, word and number: of each fact its sentence, the number there, first and next word, and the number of the rest."""
        sizes = np.array(self.sizes, np.int64)
        times = sizes[n]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat((np.cumsum(sizes) - sizes)[n], times) + within
        f, t, rest = (np.array(x, np.int64)[row] for x in self.rows)
        at, sentence = np.repeat(at, times), np.repeat(sentence, times)
        number = np.arange(len(sentence)) - np.searchsorted(sentence, sentence)
        return sentence, number, f + at, t + at, rest
