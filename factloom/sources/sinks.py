"""Facts as text blocks, JSON lines, XML, and as a message per document (JSON or length-delimited protobuf).

Defined cases: no facts, no output; null ids count as 0 in messages; facts of rows that share an id are put together in one message."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block(fact_type: Column, fields: list[str]) -> Column:
    """The text form of a fact: its type, and a line for each field that has a value."""
    lines = [F.concat(F.lit(f"\t\t{name} = "), F.col(name), F.lit("\n")) for name in fields]
    return F.concat(F.lit("\t"), fact_type, F.lit("\n\t{\n"), F.concat_ws("", *lines), F.lit("\t}\n"))


def text_blocks(facts: DataFrame, fields: list[str], type_col: str = "fact_type") -> DataFrame:
    """doc_id, sent_id and the facts of the sentence as text, in their order."""
    rows = facts.select("doc_id", "sent_id", F.struct("f", block(F.col(type_col), fields).alias("x")).alias("b"))
    return rows.groupBy("doc_id", "sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["x"]), "").alias("text"))


def json_lines(facts: DataFrame, fields: list[str]) -> DataFrame:
    """value: a JSON object per fact."""
    return facts.select(F.to_json(F.struct("doc_id", "sent_id", F.col("fact_type").alias("type"), F.struct(*fields).alias("fields"))).alias("value"))


def write_text(facts: DataFrame, fields: list[str], path: str, mode: str = "errorifexists") -> None:
    text_blocks(facts, fields).select("text").write.mode(mode).text(path)


def write_json(facts: DataFrame, fields: list[str], path: str, mode: str = "errorifexists") -> None:
    json_lines(facts, fields).write.mode(mode).text(path)


def write_xml(facts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    facts.write.mode(mode).option("rootTag", "facts").option("rowTag", "fact").format("xml").save(path)


def documents(facts: DataFrame) -> DataFrame:
    """A row per document of project facts (``plans.project.SCHEMA``): Id, and FactGroup, an array of (Type, Fact array of
    (Index, Attr, Field)); groups by id, pre-sorted, so the same facts give the same message."""
    fields = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("Name"), e["value"].alias("Value"))))
    attr = F.struct(F.col("c_from").alias("TextPos"), (F.col("c_to") - F.col("c_from")).alias("TextLen"), F.col("sent_id").alias("SentenceNumber"), F.col("f").alias("FirstWord"), (F.col("t") - 1).alias("LastWord"))
    one = F.struct(F.col("sent_id").alias("s"), F.col("fact_id").alias("i"), attr.alias("Attr"), fields.alias("Field"))
    groups = facts.groupBy(F.coalesce("doc_id", F.lit(0)).alias("Id"), "fact_type").agg(F.array_sort(F.collect_list(one)).alias("x"))
    fact = lambda y, k: F.struct(y["Attr"].alias("Attr"), y["Field"].alias("Field"), k.cast("long").alias("Index"))
    groups = groups.select("Id", F.struct(F.col("fact_type").alias("Type"), F.transform("x", fact).alias("Fact")).alias("g"))
    return groups.groupBy("Id").agg(F.array_sort(F.collect_list("g")).alias("FactGroup"))


def json_documents(facts: DataFrame) -> DataFrame:
    """value: a JSON object per document."""
    return documents(facts).select(F.to_json(F.struct("Id", "FactGroup")).alias("value"))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int | None) -> bytes:
    return b"" if n is None else _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str | None) -> bytes:
    if data is None:
        return b""
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def message(document: dict) -> bytes:
    """A document in protobuf's wire format; the numbers are those of the message (fixed values)."""
    out = _number(1, document["Id"]) + _bytes(2, document.get("Url", ""))
    for g in document["FactGroup"]:
        group = _bytes(1, g["Type"])
        for x in g["Fact"]:
            a = x["Attr"]
            attr = b"".join(_number(n, a[k]) for n, k in ((5, "TextPos"), (6, "TextLen"), (7, "SentenceNumber"), (8, "FirstWord"), (9, "LastWord")))
            group += _bytes(2, _bytes(1, attr) + b"".join(_bytes(2, _bytes(1, f["Name"]) + _bytes(2, f["Value"])) for f in x["Field"]) + _number(3, x["Index"]))
        out += _bytes(5, group)
    return out


def protobuf_documents(facts: DataFrame) -> DataFrame:
    """Id, and value: the document's message after its length, as streams of messages have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [message(d) for d in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("Id"), pa.array([_varint(len(v)) + v for v in values], pa.binary())], ["Id", "value"])

    return documents(facts).mapInArrow(run, "Id long, value binary")
