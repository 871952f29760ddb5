"""Which stretches of a sentence can hold a parse: only these are parsed, each kind of stretch once in a task.

For a grammar, each word has the set of terminals (with their tags) that it fulfils on its own, found once for each word. The
rules tell which terminals can begin a parse, end it and follow each other, so words without fitting neighbours drop
out, and what is left falls into stretches that no parse reaches beyond. A stretch goes through the same chain, chart and constraints as a
sentence; its parses depend only on its words, on whether it begins or ends the sentence and on quotes around it, so
they are kept by these. Parses of different stretches never overlap; the choice among overlapping ones is made with the
solution of the stretches before, as weights count the words up to there.

Of words without readings and keys only the shape (letters or digits, capitals, the grammar's patterns) decides which terminals they fulfil; if
a grammar puts constants alone into its facts, stretches are kept by such shapes, too.

A chart has a node for every run of a long stretch. Where a parse's rank comes from its words alone (no weights, agreements, keywords, trims,
or tags on symbols of rules), bit sets tell which spans parse, the choice is made among these, and a chosen span's chart
gets only the nodes of which its parses consist; should it have none, the sentence is parsed whole.

Spans of several words and parses of grammars that stand for words are found before, and their words stay whatever stands beside them.

Defined cases, all parsed as whole sentences instead: grammars with filters or dominance, articles with algorithms, keys with *, grammars that
name themselves through articles, overlapping parses of a grammar that stands for words, facts with the whole sentence's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace
from itertools import pairwise, product

from factloom.operators.morphology import plain
from factloom.plans import chart
from factloom.plans.language import AGREEMENTS, Grammar

KEPT = 20_000  # stretches of a grammar that a task remembers
LONG = 8  # words of a stretch that is likely to come again
WORDS = 200_000  # words that a task remembers
QUOTES = frozenset("\"«»“”„")
#: terminals and tags that look at a word's place
PLACED = {"EOSent", "fw", "quoted", "l-quoted", "r-quoted"}


class WholeSentence(Exception):
    """A stretch cannot be told from the rest of its sentence."""


def capped(rows: list[tuple], most: int) -> list[tuple]:
    """The rows, each once, without types that have more than so many."""
    if len(rows) <= most:
        return list(dict.fromkeys(rows)) if len(rows) > 1 else rows
    counts: dict[str, int] = {}
    for r in rows:
        counts[r[1]] = counts.get(r[1], 0) + 1
    return [r for r in dict.fromkeys(rows) if counts[r[1]] <= most]


def _bits(x: int) -> Iterable[int]:
    n = 0
    while x:
        if x & 1:
            yield n
        x >>= 1
        n += 1


class Made(dict):
    """Values by key, made when they are first asked for; of at most so many keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Stretch:
    """The parses of a stretch by last and first word, with their rows; words and units count from its begin."""

    def __init__(self, sentence, article: str, grammar: Grammar):
        self.units = units = sentence.chain(grammar)
        self.fewer = len(sentence.words) - len(units)
        self.nodes = sorted(chart.Parser(grammar, units, sentence.c.geo).run(), key=lambda x: (x.j, x.i))
        self.weighed = chart.weigh(self.nodes, units)
        self.overlaps = any(b.i < a.j for a, b in pairwise(self.nodes))
        self.sentence, self.article = sentence, article
        self.normal = chart.Normalizer(units, sentence.c.project.lexicon, sentence.c.lemmas)
        self.made: dict[int, list[tuple]] = {}
        if not self.overlaps:  # all will be chosen
            for n in range(len(self.nodes)):
                self.rows(n)
            self.units = self.nodes = self.sentence = self.normal = None

    def rows(self, n: int) -> list[tuple]:
        if n not in self.made:
            self.made[n] = self.sentence.facts_of(self.article, self.nodes[n], self.units, self.normal)[1]
        return self.made[n]


class Spans:
    """A long stretch whose spans are told by bit sets: ``ends`` has for each symbol and first word the bits of where it may end."""

    def __init__(self, sentence, article: str, grammar: Grammar, number: dict, masks: list[int]):
        self.sentence, self.article, self.grammar, self.number = sentence, article, grammar, number
        self.units = sentence.words
        self.weighed = self.overlaps = True
        self.fewer = 0
        size = len(masks)
        self.at = [sum(1 << n for n, x in enumerate(masks) if x >> c & 1) for c in range(len(number))]
        self.lefts: dict[str, list] = {}
        for r in grammar.rules:
            self.lefts.setdefault(r.left, []).append(r)
        self.ends = {x: [0] * (size + 1) for x in self.lefts}
        opening: dict[str, list] = {}  # rules by their first symbol, "" for those that a terminal opens
        self.longer: dict[str, list] = {}  # for each symbol, how terminals at its end make it longer
        for r in grammar.rules:
            opening.setdefault(r.items[0].name if r.items[0].name in self.lefts else "", []).append(r)
            if len(r.items) > 1 and r.items[0].name == r.left and not any(x.name in self.lefts for x in r.items[1:]):
                self.longer.setdefault(r.left, []).append((r.count, self._doubled(r.items[1:], size)))
        for i in range(size - 1, -1, -1):  # what begins later is known; what begins here is put through its rules once
            todo = [(r, 1 << i, r.items) for r in opening.get("", ())]
            while todo:
                r, here, items = todo.pop()
                ends = self.ends[r.left]
                more = self._through(items, here)[-1] & ((1 << (i + r.count + 1)) - 1) & ~ends[i]
                if more:
                    more = self._repeated(r.left, more, i)
                    ends[i] |= more
                    todo += [(x, more, x.items[1:]) for x in opening.get(r.left, ())]
        self.normal = chart.Normalizer(self.units, sentence.c.project.lexicon, sentence.c.lemmas)

    def _doubled(self, items: tuple, size: int) -> list[tuple[int, int]]:
        """From where terminals go on once, twice, four times and so on, and how far that is."""
        step, far = (1 << (size + 1)) - 1, len(items)
        for n, item in enumerate(items):
            step &= self.at[self.number[item.name, item.tags]] >> n
        out = []
        while step:
            out.append((step, far))
            step, far = step & step >> far, 2 * far
        return out

    def _repeated(self, symbol: str, ends: int, i: int) -> int:
        """The ends of a symbol that begins at i, with those that its left recursion by terminals adds."""
        for count, doubled in self.longer.get(symbol, ()):
            more = ends
            for step, far in doubled:
                more |= (more & step) << far
            ends |= more & ((1 << (i + count + 1)) - 1)
        return ends

    def _through(self, items: tuple, here: int) -> list[int]:
        """Places that parts can reach from some places, after each of them."""
        out = [here]
        for item in items:
            if item.name in self.lefts:
                here = self._joined(self.ends[item.name], here)
            else:
                here = (here & self.at[self.number[item.name, item.tags]]) << 1
            out.append(here)
        return out

    @staticmethod
    def _joined(ends: list[int], here: int) -> int:
        out = 0
        while here:
            low = here & -here
            out |= ends[low.bit_length() - 1]
            here ^= low
        return out

    def choice(self, base: chart.Solution, shift: int) -> tuple[list[tuple[int, int]], chart.Solution]:
        """As ``chart.best`` over all spans of the root: the chosen ones, and their solution on ``base``. Spans with the same end have the same
        weight, so of these the most words count, then the fewest spans, then the last begin."""
        before, roots = chart.covered(self.units), self.ends[self.grammar.root]
        size = len(self.units)
        weight = [chart.mean_weight(j + shift, base.strength, base.keywords, base.own) if j else 0 for j in range(size + 1)]
        made: list[tuple | None] = [None] * (size + 1)  # by end: words, less the number of spans, first word
        last = [0] * (size + 1)  # the end of the best solution up to there; 0 for the base
        rank = base.rank
        levels: dict[tuple[int, int, int], int] = {}  # words before a begin that no span covers, the rest of its rank; and the ends that it has
        for i in range(size + 1):
            mine = max((x for x, ends in levels.items() if ends >> i & 1), default=None)
            mine = max(filter(None, (made[i], mine and (mine[0] + before[i], *mine[1:]))), default=None)
            if mine is not None:
                made[i] = mine
                new = (mine[0], weight[i], mine[1])
                last[i], rank = (i, new) if new >= rank else (last[i - 1], rank)
            elif i:
                last[i] = last[i - 1]
            if i == size:
                break
            todo = roots[i]
            j = i + 1
            while j <= size and before[j] == before[i]:  # commas and the like alone count as words
                if todo >> j & 1:
                    made[j] = max(made[j] or (-1, 0, 0), (rank[0] + j - i, rank[2] - 1, i))
                j += 1
            todo = todo >> j << j
            own = (rank[0] - before[i], rank[2] - 1, i)
            for x in [x for x, ends in levels.items() if todo & ends]:
                if x > own:
                    todo &= ~levels[x]
                elif not (rest := levels[x] & ~todo):
                    del levels[x]
                else:
                    levels[x] = rest
            if todo:
                levels[own] = todo
        out, j = [], last[size]
        while j:
            i = made[j][2]
            out.append((i, j))
            j = last[i]
        return out[::-1], base._replace(rank=rank, last=-1, before=None) if out else base

    def useful(self, i: int, j: int) -> set[tuple[str, int, int]]:
        """The symbols and spans in parses of the root from i to j."""
        todo = [(self.grammar.root, i, j)]
        found = set(todo)
        while todo:
            symbol, a, b = todo.pop()
            for r in self.lefts[symbol]:
                places = self._through(r.items, 1 << a) if b - a <= r.count else [0]
                good = places[-1] & 1 << b
                for item, here in zip(r.items[::-1], places[-2::-1], strict=True) if good else ():
                    if item.name not in self.lefts:
                        good = here & self.at[self.number[item.name, item.tags]] & good >> 1
                        continue
                    fits = 0
                    for p in _bits(here):
                        some = self.ends[item.name][p] & good
                        fits |= (some != 0) << p
                        for q in _bits(some):
                            if (item.name, p, q) not in found:
                                found.add((item.name, p, q))
                                todo.append((item.name, p, q))
                    good = fits
        return found

    def rows(self, span: tuple[int, int]) -> list[tuple]:
        i, j = span
        nodes = [x for x in chart.Parser(self.grammar, self.units, self.sentence.c.geo, self.useful(i, j), span).run() if (x.i, x.j) == span]
        if not nodes:
            raise WholeSentence
        return self.sentence.facts_of(self.article, nodes[-1], self.units, self.normal)[1]


class Plan:
    """How one grammar of an article is run by stretches; ``able`` tells whether it can be."""

    def __init__(self, compiled, article: str, grammar: Grammar, within: tuple[str, ...] = ()):
        self.c, self.article, self.grammar = compiled, article, grammar
        self.able = not grammar.filters and not any(r.left_dominant for r in grammar.rules)
        self.inner: list[Plan] = []
        self.single, self.parts = [], []  # keys of one word, and the words of others
        self._keys(article, within)
        self._follow()
        self.placed = any(i.name in PLACED or any(t.name in PLACED for t in i.tags) for i in self.items)
        self.special = {plain(w.lstrip("!")) for words in [k.words for k in self.single] + [w for w, _ in self.parts] for w in words} | {plain(i.name.strip("'")) for i in self.items} | chart.AND_WORDS
        lexicon = compiled.project.lexicon
        self.known, self.endings = lexicon.by_form, tuple(r[0] for r in lexicon.rules)
        self.patterns = [chart.pattern(t.value) for t in dict.fromkeys(t for r in grammar.rules for i in r.items for t in i.tags if t.name in ("wff", "wfl", "wfm"))]
        self.alike = not self.inner and not self.parts and all(t.value is not None for r in grammar.rules for i in r.items for t in i.interp) and not any(t.name == "fio-agr" for i in (i for r in grammar.rules for i in r.items) for t in i.tags)
        self.shapes: dict[tuple, int] = {}
        self.equal = not self.inner and not grammar.keywords() and all(self._equal(r) for r in grammar.rules)
        self.shaped = Made(self.shape, WORDS)
        self.names = Made(lambda w: self.shaped[w] or w, WORDS)
        self.masks = Made(self._mask, WORDS)
        self.allowed_after = Made(lambda x: self._union(x, self.follow), WORDS)
        self.allowed_before = Made(lambda x: self._union(x, self.precede), WORDS)
        self.kept: dict[tuple, Stretch] = {}

    def _keys(self, article: str, within: tuple[str, ...]) -> None:
        todo = [(a, False) for name in sorted(self.grammar.keywords()) for a in self.c.named(name)]
        done = set()
        while todo:
            a, part = todo.pop()
            if (a, part) in done:
                continue
            done.add((a, part))
            grammars = self.c.grammars.get(a, ())
            if self.c.algorithms.get(a) or (grammars and (part or a == article or a in within)):
                self.able = False
                continue
            for g in grammars:
                self.inner.append(Plan(self.c, a, g, (*within, article)))
                self.able &= self.inner[-1].able
            for key in self.c.keys.get(a, ()):
                if not part and len(key.words) == 1 and not re.match(r"\$.|\*", key.words[0]):
                    self.single.append(key)
                    continue
                for w in key.words:
                    if w == "*":
                        self.able = False
                    elif w.startswith("$") and len(w) > 1:
                        todo += [(b, True) for b in self.c.named(w[1:])]
                    else:
                        self.parts.append(((w,), key.exact))

    def _follow(self) -> None:
        """Terminal items by number, and what the rules let stand beside them; the last number is a word that a span may cover."""
        lefts = {r.left for r in self.grammar.rules}
        number = {}
        for r in self.grammar.rules:
            for i in r.items:
                if i.name not in lefts:
                    number.setdefault((i.name, i.tags), len(number))
        self.items = list(dict.fromkeys(i for r in self.grammar.rules for i in r.items if i.name not in lefts))
        self.number = number
        edges = []
        for end in (0, -1):
            known, before = dict.fromkeys(lefts, 0), None
            while known != before:
                before = dict(known)
                for r in self.grammar.rules:
                    i = r.items[end]
                    known[r.left] |= known[i.name] if i.name in lefts else 1 << number[i.name, i.tags]
            edges.append(known)
        of = lambda i, known: known[i.name] if i.name in lefts else 1 << number[i.name, i.tags]
        self.covered = 1 << len(number)
        every = 2 * self.covered - 1
        self.begin, self.end = edges[0].get(self.grammar.root, 0) | self.covered, edges[1].get(self.grammar.root, 0) | self.covered
        self.follow, self.precede = ([self.covered] * len(number) + [every] for _ in range(2))
        for r in self.grammar.rules:
            for a, b in pairwise(r.items):
                left, right = of(a, edges[1]), of(b, edges[0])
                for c in _bits(left):
                    self.follow[c] |= right
                for c in _bits(right):
                    self.precede[c] |= left

    @staticmethod
    def _union(x: int, table: list[int]) -> int:
        out = 0
        for c in _bits(x):
            out |= table[c]
        return out

    def _equal(self, r) -> bool:
        """Whether a rule's parses weigh the same, and its parts ask nothing of what rules made."""
        lefts = {x.left for x in self.grammar.rules}
        return r.weight == 1.0 and not (r.trim or r.not_hreg_fact or r.right_recessive) and all(
            not (i.tags if i.name in lefts else [t for t in i.tags if t.name in AGREEMENTS or t.name == "gztweight"]) for i in r.items
        )

    def shape(self, word: str) -> tuple | None:
        """All that a grammar's terminals and tags can see of a word without readings and keys; None for other words."""
        if word.isalpha():
            end = word[1:]
            kind = (word.isascii(), word[0].isupper(), bool(end) and not end.islower() and any(map(str.isupper, end)))
        elif word.isdecimal():
            kind = (len(word) == 4,)
        else:
            return None
        low = plain(word)
        if low in self.special or low in self.known or (self.endings and low.endswith(self.endings)):
            return None
        return (kind, *[p.fullmatch(word) is None for p in self.patterns])

    def _mask(self, word: str) -> int:
        """The terminal items that a word fulfils in some place of a sentence, or all if a key of several words has it."""
        shape = self.shaped[word]
        if shape is None:
            return self._fulfilled(word)
        if shape not in self.shapes:
            self.shapes[shape] = self._fulfilled(word)
        return self.shapes[shape]

    def most(self, word: str) -> int:
        """The terminal items that a word would fulfil if all patterns held."""
        return self._fulfilled(word, [(i, replace(i, tags=tuple(t for t in i.tags if t.name not in ("wff", "wfl", "wfm")))) for i in self.items])

    def _fulfilled(self, word: str, items: list | None = None) -> int:
        """``items``: the grammar's, each with what is asked of the word in its place."""
        out = 0
        for place in product((False, True), repeat=4) if self.placed else ((False,) * 4,):
            piece = self.c.piece([word], *place)
            if any(True for words, exact in self.parts for _ in piece._match(words, 0, exact)):
                return 2 * self.covered - 1
            for k in self.single:
                for h in piece._keys(k):
                    piece.words[0] = piece._marked(piece.words[0], h)
            unit = piece.words[0]
            parser = chart.Parser(self.grammar, [unit], self.c.geo)
            for i, asked in items or [(i, i) for i in self.items]:
                some = chart.terminal(i.name, unit)
                if some is not None and parser._narrow(chart.Node(i.name, 0, 1, 0, 1, tuple((k, unit.homonyms[k].forms) for k in some), 0), asked) is not None:
                    out |= 1 << self.number[i.name, i.tags]
        return out

    def stretches(self, words: list[str]) -> list[tuple[int, Stretch]]:
        """The stretches of a sentence that may have parses, in order, with their first words."""
        masks = list(map(self.masks.__getitem__, words))
        for plan in self.inner:
            for at, found in plan.stretches(words):
                if found.overlaps:
                    raise WholeSentence
                if found.weighed:
                    masks[at : at + found.size] = [2 * self.covered - 1] * found.size
        return [(a, self.stretch(words[a:b], (a == 0, b == len(words), a > 0 and words[a - 1] in QUOTES, b < len(words) and words[b] in QUOTES))) for a, b in self.spans(masks)]

    def spans(self, masks: list[int]) -> list[tuple[int, int]]:
        """First and next words of the stretches among words that fulfil these terminals."""
        if not any(masks):
            return []
        alive, mask, at = [], 0, -2  # words that can stand after the one before them
        for n, x in enumerate(masks):
            if x:
                x &= self.begin | self.allowed_after[mask] if at == n - 1 else self.begin
                if x:
                    alive.append((n, x))
                    mask, at = x, n
        spans, mask, at, stop = [], 0, -2, -1  # and before the one after them
        for n, x in reversed(alive):
            x &= self.end | self.allowed_before[mask] if at == n + 1 else self.end
            if x:
                if at != n + 1:
                    if stop >= 0:
                        spans.append((at, stop))
                    stop = n + 1
                mask, at = x, n
        if stop >= 0:
            spans.append((at, stop))
        return spans[::-1]

    def stretch(self, words: list[str], place: tuple[bool, bool, bool, bool]) -> Stretch:
        """``place``: whether it begins and ends its sentence, and whether quotes stand before and after."""
        key = (place, *map(self.names.__getitem__, words)) if self.alike else (place, *words)
        found = self.kept.get(key)
        if found is None:
            piece = self.c.piece(words, *place)
            if len(words) > LONG and self.equal:
                found = Spans(piece, self.article, self.grammar, self.number, [self.masks[w] for w in words])
            else:
                found = Stretch(piece, self.article, self.grammar)
            found.size = len(words)
            if len(words) <= LONG:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[key] = found
        return found

    def rows(self, words: list[str]) -> list[tuple]:
        """Rows of the facts of a sentence's chosen parses."""
        return self.joined(self.stretches(words))

    def joined(self, found: list[tuple[int, Stretch]]) -> list[tuple]:
        """The same of all its stretches."""
        out, fewer, state = [], 0, chart.Solution()
        weighs = any(s.overlaps for _, s in found)
        for at, s in found:
            if s.weighed:
                if isinstance(s, Spans):
                    chosen, state = s.choice(state, at - fewer)
                elif weighs:
                    done = chart.best(s.weighed, state, at - fewer)
                    chosen, state = chart.members(done, state), done
                else:
                    chosen = range(len(s.weighed))
                for n in chosen:
                    out += [(article, kind, f + at, t + at, fields, weight) for article, kind, f, t, fields, weight in s.rows(n)]
            fewer += s.fewer
        return capped(out, self.c.project.most)


class Reader:
    """Facts of sentences under a compiled project; what is found for words and stretches is kept."""

    def __init__(self, compiled):
        self.c = compiled
        self.plans = [Plan(compiled, a, g) for a in compiled.project.articles for g in compiled.grammars.get(a, ())]
        self.able = all(p.able for p in self.plans)
        self.wanted = set(compiled.project.facts)

    def facts(self, text: str) -> list[tuple]:
        """As ``Sentence.facts``."""
        if not self.able:
            return self.c.sentence(text).facts()
        words = self.c.word(text).findall(text)
        try:
            found = [p.rows(words) for p in self.plans]
        except WholeSentence:
            return self.c.sentence(text).facts()
        out = found[0] if len(found) == 1 else dict.fromkeys(r for rows in found for r in rows)
        return [r for r in out if not self.wanted or r[1] in self.wanted]
