"""Facts from spans: interpretation, merging, defaults, caps, equality and leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FACTS = 25  # of one type in a sentence
MAX_PAIRS = 1000  # equal pairs in a cluster
LEAD_CHARS = 400


def interpret(charts: DataFrame, spans: Column, fact_type: str, fields: dict[str, Column | object], most: int | None = None) -> DataFrame:
    """A row per span: doc_id, sent_id, fact_type, f, t and the fields, each a function of the span's
    struct column or a constant. ``most``: sentences with more facts of the type give none."""
    if most is not None:
        spans = F.when(F.size(spans) <= most, spans)
    rows = charts.select("doc_id", "sent_id", "sentence", "toks", F.inline(spans))
    whole = F.struct("f", "t")
    return rows.select("doc_id", "sent_id", F.lit(fact_type).alias("fact_type"), "f", "t", *[(v(whole) if callable(v) else F.lit(v)).alias(k) for k, v in fields.items()])


def complete(facts: DataFrame, required: list[str], defaults: dict[str, object]) -> DataFrame:
    """Defaults fill empty fields; facts without a required field go."""
    for name, value in defaults.items():
        facts = facts.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value)))
    for name in required:
        facts = facts.where(F.coalesce(F.col(name), F.lit("")) != "")
    return facts


def cap(facts: DataFrame, most: int = MAX_FACTS) -> DataFrame:
    """Drops all facts of a type from sentences with more than ``most`` of them: for facts that are rows
    already; groups by id. ``interpret`` with ``most`` does it in the row of the sentence, without a shuffle."""
    over = facts.groupBy("doc_id", "sent_id", "fact_type").count().where(F.col("count") > most).drop("count")
    return facts.join(over, ["doc_id", "sent_id", "fact_type"], "left_anti")


def merge(left: Column, right: Column) -> Column:
    """Facts of one type from two parts: equal counts are zipped, one goes with each of many, else
    the rule does not hold (null)."""
    a, b = F.size(left), F.size(right)
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    return (
        F.when(a == b, F.zip_with(left, right, pair))
        .when(a == 1, F.transform(right, lambda y: pair(F.element_at(left, 1), y)))
        .when(b == 1, F.transform(left, lambda x: pair(x, F.element_at(right, 1))))
    )


def equal_pairs(facts: DataFrame, value: str, most: int = MAX_PAIRS) -> DataFrame:
    """Pairs of facts of a document with an equal value: each fact with the next ones of its group in the order of (sent_id,
    f), at most ``most`` pairs a group, as the number of pairs before a fact is known from its rank."""
    order = Window.partitionBy("doc_id", value).orderBy("sent_id", "f", "fact_type")
    ranked = facts.withColumn("rank", F.row_number().over(order))
    # ranks that can stand in the first ``most`` pairs, counted by the later fact: (r - 1)(r - 2) / 2 before it
    ranked = ranked.where((F.col("rank") - 1) * (F.col("rank") - 2) / 2 < most)
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col(f"a.{value}") == F.col(f"b.{value}")) & (F.col("a.rank") < F.col("b.rank")))
    place = (F.col("b.rank") - 1) * (F.col("b.rank") - 2) / 2 + F.col("a.rank")
    kind = F.when((F.col("a.sent_id") == F.col("b.sent_id")) & (F.col("a.f") == F.col("b.f")), "SameEntry").when(F.col("a.sent_id") == F.col("b.sent_id"), "SameSent").otherwise("SameDocument")
    return pairs.where(place <= most).select(F.col("a.doc_id").alias("doc_id"), F.col(f"a.{value}").alias(value), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("sent_id", "f")], kind.alias("kind"))


def lead_of(sentence: str = "sentence") -> list[Column]:
    """lead, n_chars and n_bytes of a sentence's row."""
    lead = F.substring(sentence, 1, LEAD_CHARS)
    return [lead.alias("lead"), F.length(lead).cast("long").alias("n_chars"), F.octet_length(lead).cast("long").alias("n_bytes")]


def leads(facts: DataFrame, charts: DataFrame) -> DataFrame:
    """The sentence of each fact, cut to 400 characters, with its lengths in characters and bytes; groups by id."""
    lead = F.substring("sentence", 1, LEAD_CHARS)
    keys = facts.select("doc_id", "sent_id").distinct()
    return charts.select("doc_id", "sent_id", lead.alias("lead")).join(keys, ["doc_id", "sent_id"], "left_semi").withColumns({"n_chars": F.length("lead").cast("long"), "n_bytes": F.octet_length("lead").cast("long")})


def groups(facts: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, sent_id, f and group_id of every fact: facts of a document that share the value of any of ``keys`` are one
    group, through others too; its id is the smallest place (sent_id * 2**32 + f) in it. Groups by id: a document's facts meet in one task."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        place = (part["sent_id"] * (1 << 32) + part["f"]).to_list()
        parent = {p: p for p in place}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        first: dict[tuple, int] = {}
        for key in keys:
            for p, v in zip(place, part[key].to_list(), strict=True):
                if v is not None and v == v:
                    a, b = sorted((top(first.setdefault((key, v), p)), top(p)))
                    parent[b] = a
        return pd.DataFrame({"doc_id": part["doc_id"], "sent_id": part["sent_id"], "f": part["f"], "group_id": [top(p) for p in place]})

    return facts.select("doc_id", "sent_id", "f", *keys).groupBy("doc_id").applyInPandas(run, "doc_id long, sent_id long, f long, group_id long")
