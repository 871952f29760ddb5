import io
import json
import struct
import tarfile

import pytest

from factloom.operators.morphology import Lexicon
from factloom.plans import algorithms as A
from factloom.plans.project import Project
from factloom.sources import readers, sinks


def test_tar_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("x.txt", "één".encode()), ("d/y.txt", b""), ("bad", b"\xff\xfe")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert sorted((r.name, r.text) for r in readers.archives(spark, str(tmp_path)).collect() if r.name != "bad") == [("d/y.txt", ""), ("x.txt", "één")]
    assert [r.text for r in readers.archives(spark, str(tmp_path)).collect() if r.name == "bad"] == [None]


def test_length_value_records(spark, tmp_path):
    field = lambda x: struct.pack("<I", len(x.encode())) + x.encode()
    (tmp_path / "r").write_bytes(b"".join(field(x) for x in ("a.org/p", "k", "text one", "b.org", "l", "")))
    rows = sorted(tuple(r) for r in readers.records(spark, str(tmp_path)).collect())
    assert rows == [("a.org/p", "a.org", "k", "text one"), ("b.org", "b.org", "l", "")]
    assert readers.records(spark, str(tmp_path), "k").count() == 1


def test_numbered_lines_over_partitions(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"line {k} {i}\n" for i in range(50)) + "-7\town id\n\n")
    rows = readers.per_line(spark, str(tmp_path)).collect()
    assert len(rows) == 153 and sorted(r.doc_id for r in rows if r.doc_id > 0) == sorted(set(range(1, 157)) - {51, 52, 103, 104, 155, 156})
    with pytest.raises(ValueError):
        readers.one_document(spark, str(tmp_path))


FILES = {
    "c": 'TTextMinerConfig { Dictionary = "d"; Articles = [{ Name = "m" }] Facts = [{ Name = "R" }] }',
    "d": 'TAuxDicArticle "m" { key = { "tomita:g" type=CUSTOM } } message R : NFactType.TFact { required string A = 1; optional string B = 2; }',
    "g": 'S -> "see" Word interp(R.A::not_norm) interp(R.B="x");',
}


def test_messages_of_documents(spark):
    project = Project.of(FILES, "c", Lexicon())
    facts = project.facts_of(spark.createDataFrame([(3, "see one. Then see two"), (4, "none"), (5, "see é")], "doc_id long, text string"))
    done = {d["Id"]: d for d in (json.loads(r.value) for r in sinks.json_documents(facts).collect())}
    assert [f["Value"] for x in done[3]["FactGroup"][0]["Fact"] for f in x["Field"] if f["Name"] == "A"] == ["one", "two"] and set(done) == {3, 5}
    raw = {r.Id: bytes(r.value) for r in sinks.protobuf_documents(facts).collect()}[5]
    assert raw[0] == len(raw) - 1 and raw[1:3] == b"\x08\x05" and b"\x0a\x01A\x12\x02\xc3\xa9" in raw


def found(name, text):
    return [(f, t, lemma) for f, t, lemma, _, _ in A.REGISTRY[name](Project.of(FILES, "c", Lexicon([("Anna", "anna", "S", "persn,nom,sg,f", False), ("Petrova", "petrova", "S", "famn,nom,sg,f", False)])).compile().sentence(text).words)]


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("date", "on 3.10.2011 and 5 May 2012", [(1, 6, "2011-10-03"), (7, 10, "2012-05-05")]),
        ("date", "1, 2 and 3 May 2012", [(0, 1, "2012-05-01"), (2, 3, "2012-05-02"), (4, 7, "2012-05-03")]),
        ("date", "from 1 to 3 May 2012", [(0, 6, "2012-05-01 - 2012-05-03")]),
        ("date", "31.02.2020", []),
        ("quasi_date", "5 May", [(0, 2, "--05-05")]),
        ("digital_time", "at 9:05 or 25:10", [(1, 4, "09:05")]),
        ("number", "two hundred five thousand and a half", [(0, 7, "205000.5")]),
        ("number", "5, 6 or 7 million", [(0, 1, "5000000"), (2, 3, "6000000"), (4, 6, "7000000")]),
        ("words_in_quotes", 'She saw "Solaris two" there', [(3, 5, "Solaris two")]),
        ("fio", "Then Anna Petrova and A. B. Ivanov met", [(1, 3, "Petrova Anna"), (4, 9, "Ivanov A B")]),
        ("date_chain", "yesterday and last month", [(0, 1, "yesterday"), (2, 4, "last month")]),
    ],
)
def test_algorithms(name, text, want):
    assert found(name, text) == want
