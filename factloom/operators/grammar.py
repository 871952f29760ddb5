"""Grammar operators on sentences. A symbol is a column with an array of spans ``struct<f, t>`` (first
token, token after the last); rules are expressions over the arrays of their parts. A sentence is a row, so
sequences need neither joins nor shuffles. A rule's spans are as many as the sentence has, which for A+ and
A! is quadratic in the longest run; arrays are made distinct as longs, which Spark hashes, structs it does not.

Defined cases: empty arrays give empty arrays; equal spans are given once; sentences of any length are read whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Spans = Column


def span(f: Column, t: Column) -> Column:
    return F.struct(f.cast("long").alias("f"), t.cast("long").alias("t"))


def distinct(spans: Spans) -> Spans:
    """Each span once: coded as one long each while they are compared."""
    coded = F.array_distinct(F.transform(spans, lambda x: x["f"] * (1 << 32) + x["t"]))
    return F.transform(coded, lambda x: span(F.shiftright(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1))))


def terminal(toks: Column, test: Callable[[Column], Column]) -> Spans:
    """The tokens that pass."""
    return F.transform(F.filter(toks, lambda x: F.coalesce(test(x), F.lit(False))), lambda x: span(x["pos"], x["pos"] + 1))


def seq(first: Spans, *rest: Spans) -> Spans:
    """A B ...: spans next to each other."""
    for other in rest:
        first = _then(first, other)
    return first


def _then(a: Spans, b: Spans) -> Spans:
    return distinct(F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: y["f"] == x["t"]), lambda y: span(x["f"], y["t"])))))


def alt(first: Spans, *rest: Spans) -> Spans:
    """A | B."""
    return distinct(F.concat(first, *rest)) if rest else first


def opt_between(a: Spans, middle: Spans, b: Spans) -> Spans:
    """A (M) B."""
    return alt(seq(a, b), seq(a, middle, b))


_EMPTY = "array<struct<f:bigint,t:bigint>>"


def plus(a: Spans) -> Spans:
    """A+: all runs of adjacent spans."""
    grow = lambda acc, x: F.concat(acc, F.array(x), F.transform(F.filter(acc, lambda r: r["t"] == x["f"]), lambda r: span(r["f"], x["t"])))
    return distinct(F.aggregate(F.array_sort(a), F.array().cast(_EMPTY), grow))


def islands(a: Spans) -> Spans:
    """The longest runs of adjacent spans (spans without overlaps): one fold that keeps the open run."""
    start = F.struct(F.array().cast(_EMPTY).alias("done"), F.lit(None).cast("bigint").alias("f"), F.lit(None).cast("bigint").alias("t"))
    closed = lambda acc: F.when(acc["f"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(span(acc["f"], acc["t"]))))

    def step(acc: Column, x: Column) -> Column:
        goes_on = F.coalesce(acc["t"] == x["f"], F.lit(False))
        return F.struct(F.when(goes_on, acc["done"]).otherwise(closed(acc)).alias("done"), F.when(goes_on, acc["f"]).otherwise(x["f"]).alias("f"), x["t"].alias("t"))

    return F.aggregate(F.array_sort(a), start, step, closed)


def token_runs(longest: Spans, most: int | None = None) -> Spans:
    """A+ of single tokens from its longest runs: every run in them, of at most ``most`` tokens."""
    last = lambda i, r: F.least(r["t"], i + most) if most else r["t"]
    return F.flatten(F.transform(longest, lambda r: F.flatten(F.transform(F.sequence(r["f"], r["t"] - 1), lambda i: F.transform(F.sequence(i + 1, last(i, r)), lambda j: span(i, j))))))


def star_before(a: Spans, b: Spans) -> Spans:
    """A* B."""
    return alt(b, seq(plus(a), b))


def chains(a: Spans, separators: Spans) -> Column:
    """The longest runs of spans with a separator between neighbours, each as an array of its spans: one fold
    over items and separators in their order that keeps the open run. The spans must not overlap."""
    one = lambda x, kind: F.struct(x["f"].alias("f"), F.lit(kind).alias("kind"), x["t"].alias("t"))
    events = F.array_sort(F.concat(F.transform(a, lambda x: one(x, 0)), F.transform(separators, lambda x: one(x, 1))))
    none = F.array().cast(_EMPTY)
    start = F.struct(F.array().cast(f"array<{_EMPTY}>").alias("done"), none.alias("open"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("t"))
    closed = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        item, on = x["kind"] == 0, (acc["kind"] != x["kind"]) & (acc["t"] == x["f"])
        mine = F.array(span(x["f"], x["t"]))
        return F.struct(
            F.when(on, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(item & on, F.concat(acc["open"], mine)).when(item, mine).when(on, acc["open"]).otherwise(none).alias("open"),
            x["kind"].alias("kind"),
            x["t"].alias("t"),
        )

    return F.aggregate(events, start, step, closed)


def coordinated(a: Spans, separators: Spans) -> Spans:
    """A!: spans with a separator between neighbours; every run within the longest ones."""
    runs = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 1, F.size(c)), lambda y: span(x["f"], y["t"]))))
    return F.flatten(F.transform(chains(a, separators), runs))


def count(a: Spans, most: int) -> Spans:
    """{count=n}: spans of at most n tokens."""
    return F.filter(a, lambda x: x["t"] - x["f"] <= most)


def maximal(a: Spans) -> Spans:
    """Spans that stand in no longer one."""
    return F.filter(a, lambda x: ~F.exists(a, lambda y: (y["f"] <= x["f"]) & (y["t"] >= x["t"]) & (y["t"] - y["f"] > x["t"] - x["f"])))


def outside(recessive: Spans, dominant: Spans) -> Spans:
    """Recessive spans whose first token is in no dominant one."""
    return F.filter(recessive, lambda x: ~F.exists(dominant, lambda d: (d["f"] <= x["f"]) & (x["f"] < d["t"])))


def ordered(a: Spans, b: Spans, gap: int | None = None) -> Column:
    """#filter A B [gap]: a B after an A, with at most ``gap`` tokens between."""
    near = lambda x, y: (y["f"] > x["f"]) & ((y["f"] - x["f"] - 1 <= gap) if gap is not None else F.lit(True))
    return F.exists(a, lambda x: F.exists(b, lambda y: near(x, y)))


def trim(spans: Spans, fields: Spans) -> Spans:
    """{trim}: each span shrinks to the extent of the field spans inside it."""
    inside = lambda x: F.filter(fields, lambda y: (y["f"] >= x["f"]) & (y["t"] <= x["t"]))
    return distinct(F.transform(F.filter(spans, lambda x: F.size(inside(x)) > 0), lambda x: span(F.array_min(F.transform(inside(x), lambda y: y["f"])), F.array_max(F.transform(inside(x), lambda y: y["t"])))))


def text(toks: Column, x: Column, part: str = "tok") -> Column:
    """The span's tokens, joined by spaces."""
    return F.array_join(F.transform(F.slice(toks, (x["f"] + 1).cast("int"), (x["t"] - x["f"]).cast("int")), lambda w: w[part]), " ")


def cover(spans: Spans) -> Spans:
    """The set of spans (struct f, t, w and more) without overlaps that covers most tokens; then of largest weight sum; then of
    fewest spans. Weighted interval scheduling in the order of (t, f): the solution up to a span is the
    better of the span on top of the best solution before it, and the best of those it overlaps, which it must beat strictly
    to stay out; a later span wins ties."""
    spans = F.array_sort(spans, lambda x, y: F.when(x["t"] != y["t"], F.signum(x["t"] - y["t"])).when(x["f"] != y["f"], F.signum(x["f"] - y["f"])).otherwise(F.signum(x["w"] - y["w"])).cast("int"))
    better = lambda a, b: (a["c"] > b["c"]) | ((a["c"] == b["c"]) & ((a["w"] > b["w"]) | ((a["w"] == b["w"]) & (a["k"] < b["k"]))))

    # a solution: tokens, weight, spans, end, the last span's place and the place of the solution before it (both from 1)
    def solution(c: Column, w: Column, k: Column, t: Column, own: Column, back: Column) -> Column:
        return F.struct(*[x.cast("long").alias(n) for n, x in (("c", c), ("w", w), ("k", k), ("t", t), ("own", own), ("back", back))])

    start = solution(*[F.lit(0)] * 6)

    def step(acc: Column, x: Column) -> Column:
        place = F.size(acc) + 1
        before = F.size(F.filter(acc, lambda y: y["t"] <= x["f"]))  # ends do not fall, so these come first
        base = F.when(before > 0, F.try_element_at(acc, before)).otherwise(start)
        mine = solution(base["c"] + x["t"] - x["f"], base["w"] + x["w"], base["k"] + 1, x["t"], place, before)
        rival = F.aggregate(F.reverse(F.slice(acc, before + 1, F.size(acc))), mine, lambda best, y: F.when(better(y, best), solution(y["c"], y["w"], y["k"], x["t"], y["own"], y["back"])).otherwise(best))
        return F.concat(acc, F.array(rival))

    folded = F.aggregate(spans, F.slice(F.array(start), 1, 0), step)
    none = F.slice(spans, 1, 0)

    def chosen(table: Column, spans: Column) -> Column:
        state = F.struct(F.size(table).cast("long").alias("at"), none.alias("s"))
        back = lambda acc, i: F.when(acc["at"] == i, F.struct(F.element_at(table, i)["back"].alias("at"), F.concat(F.array(F.element_at(spans, F.element_at(table, i)["own"].cast("int"))), acc["s"]).alias("s"))).otherwise(acc)
        places = F.when(F.size(table) > 0, F.sequence(F.size(table), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, state, back, lambda acc: acc["s"])

    both = F.transform(F.array(F.struct(folded.alias("table"), spans.alias("spans"))), lambda x: chosen(x["table"], x["spans"]))
    return F.element_at(both, 1)
