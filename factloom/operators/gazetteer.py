"""Dictionary lookup: phrases of a gazetteer in tokens, as typed spans.

A gazetteer is a DataFrame (article, kwtype, words array<string>, exact boolean, mainword int, lemma,
label, weight long), ``*`` standing for any word. Its keys are counted. Up to ``IN_ROW`` keys travel as a literal
and are found in the row of the sentence, without a join. More are joined by hash of their fixed words, with the n-grams
of those places only whose first word begins a key while the first words are at most ``FIRST_WORDS``; the gazetteer is
broadcast up to ``BROADCAST_KEYS`` keys of at most ``KEY_WORDS`` words, else both sides are shuffled.

Defined cases: an empty gazetteer finds nothing; equal keys of several articles give a hit each; a key longer than
its sentence finds nothing; null lemma and label stay null; mainword null or below 1 is the first word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "article string, kwtype string, words array<string>, exact boolean, mainword int, lemma string, label string, weight long"
HIT = "f long, t long, article string, kwtype string, head long, lemma string, label string, weight long"
IN_ROW = 512
FIRST_WORDS = 10_000
BROADCAST_KEYS = 200_000
KEY_WORDS = 16


def _starts(toks: Column, n: int) -> Column:
    return F.when(F.size(toks) >= n, F.sequence(F.lit(0).cast("long"), (F.size(toks) - n).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _word(exact: bool):
    return (lambda w: w["tok"]) if exact else (lambda w: w["low"])


def _at(toks: Column, i: Column) -> Column:
    return F.element_at(toks, i.cast("int"))


def hits(toks: Column, entries: list) -> Column:
    """All hits of the entries (rows of ``SCHEMA``) in a sentence's tokens, as an array: places whose first fixed
    word begins a key of their shape are compared with these keys."""
    shapes: dict[tuple, list] = {}
    for e in entries:
        fixed = next((i for i, w in enumerate(e["words"]) if w != "*"), None)
        shapes.setdefault((len(e["words"]), fixed, bool(e["exact"])), []).append(e)
    found = []
    for (n, fixed, exact), own in shapes.items():
        word = _word(exact)
        first = sorted({e["words"][fixed] for e in own}) if fixed is not None else []
        places = F.filter(_starts(toks, n), lambda i: word(_at(toks, i + fixed + 1)).isin(first)) if first else _starts(toks, n)  # noqa: B023

        def one(e, i: Column) -> Column:
            same = F.lit(True)
            for k, w in enumerate(e["words"]):
                if w != "*":
                    same = same & (_word(bool(e["exact"]))(_at(toks, i + k + 1)) == w)
            values = [i, i + len(e["words"]), e["article"], e["kwtype"], i + max(e["mainword"] or 1, 1) - 1, e["lemma"], e["label"], e["weight"]]
            row = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(c.split()[1]).alias(c.split()[0]) for c, v in zip(HIT.split(", "), values, strict=True)])
            return F.when(same, row)

        found.append(F.flatten(F.transform(places, lambda i: F.array_compact(F.array(*[one(e, i) for e in own])))))  # noqa: B023
    return F.concat(*found) if found else F.array().cast(f"array<struct<{HIT.replace(' ', ':')}>>".replace(",:", ","))


def with_hits(charts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``charts`` with the column ``hits``; for gazetteers of at most ``IN_ROW`` keys."""
    from factloom.operators.tokens import computed

    return computed(charts, {"hits": hits(F.col("toks"), gazetteer.limit(IN_ROW).collect())})


def lookup(charts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """doc_id, sent_id, f, t (span), article, kwtype, head (token position), lemma, label and weight of
    every occurrence of a key. ``charts``: doc_id, sent_id, toks."""
    total = gazetteer.count()
    if total <= IN_ROW:
        return with_hits(charts, gazetteer).select("doc_id", "sent_id", F.inline("hits"))
    return joined(charts, gazetteer, total)


def joined(charts: DataFrame, gazetteer: DataFrame, total: int) -> DataFrame:
    """``lookup`` by a join, for a gazetteer of ``total`` keys."""
    shapes = gazetteer.select(F.size("words").alias("n"), F.transform("words", lambda w: w == "*").alias("holes"), "exact").distinct().collect()  # a row a shape
    keys = gazetteer.withColumn("n", F.size("words")).withColumn("key", F.array_join("words", " "))
    if total <= BROADCAST_KEYS and max((s["n"] for s in shapes), default=0) <= KEY_WORDS:
        keys = F.broadcast(keys)
    begin = gazetteer.select(F.element_at("words", 1).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    begin = [r[0] for r in begin] if len(begin) <= FIRST_WORDS else None
    grams = []
    for shape in shapes:
        n, holes, word = shape["n"], shape["holes"], _word(shape["exact"])
        one = lambda i: F.array_join(F.array(*[F.lit("*") if hole else word(_at(F.col("toks"), i + k + 1)) for k, hole in enumerate(holes)]), " ")  # noqa: E731, B023
        starts = _starts(F.col("toks"), n)
        if begin is not None and not holes[0]:
            starts = F.filter(starts, lambda i: word(_at(F.col("toks"), i + 1)).isin(begin))  # noqa: B023
        grams.append(F.transform(starts, lambda i: F.struct(i.alias("f"), (i + n).alias("t"), F.lit(n).alias("n"), F.lit(bool(shape["exact"])).alias("exact"), one(i).alias("key"))))  # noqa: B023
    if not grams:
        return charts.sparkSession.createDataFrame([], f"doc_id long, sent_id long, {HIT}")
    rows = charts.select("doc_id", "sent_id", F.inline(F.flatten(F.array(*grams))))
    head = F.col("f") + F.greatest(F.coalesce("mainword", F.lit(1)), F.lit(1)) - 1
    return rows.join(keys, ["n", "exact", "key"]).select("doc_id", "sent_id", "f", "t", "article", "kwtype", head.alias("head"), "lemma", "label", "weight")


def best(found: Column) -> Column:
    """Hits as spans for the cover, each place once, with the largest weight of its articles."""
    places = F.array_distinct(F.transform(found, lambda h: h["f"] * (1 << 32) + h["t"]))
    return F.transform(
        places,
        lambda p: F.struct(
            F.shiftright(p, 32).alias("f"), p.bitwiseAND(F.lit((1 << 32) - 1)).alias("t"), F.array_max(F.transform(F.filter(found, lambda h: h["f"] * (1 << 32) + h["t"] == p), lambda h: h["weight"])).alias("w")
        ),
    )


def substitute(toks: Column, cover: Column) -> Column:
    """The sentence's words in order, those of a chosen span as one (f, word)."""
    covered = F.flatten(F.transform(cover, lambda x: F.sequence(x["f"], x["t"] - 1)))
    spans = F.transform(cover, lambda x: F.struct(x["f"].alias("f"), F.array_join(F.transform(F.slice(toks, (x["f"] + 1).cast("int"), (x["t"] - x["f"]).cast("int")), lambda w: w["low"]), " ").alias("word")))
    rest = F.transform(F.filter(toks, lambda w: ~F.array_contains(covered, w["pos"])), lambda w: F.struct(w["pos"].alias("f"), w["low"].alias("word")))
    return F.array_sort(F.concat(spans, rest))


def matches(title: str, article: str = "article"):
    """An article by title: equal, by mask with *, or in the folder of that name."""
    col = F.col(article)
    if "*" in title:
        return col.rlike("^" + ".*".join(f"\\Q{p}\\E" for p in title.split("*")) + "$")
    return (col == title) | col.startswith(title + "/")
