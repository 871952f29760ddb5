"""The queries opN_<name>: each applies an operator of this subpackage, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.packing import pack

    pieces = pack(read(spark, sf_dir, "documents"), bpe_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_SAID = "</s>[INST] ok [/INST]"


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.chat import format_chats, read_back

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], turns.schema)
    return read_back(format_chats(turns.unionByName(own))).drop("valid")


def _chat_sql() -> str:
    from factloom.llm.chat import Template

    t = Template()
    escaped = lambda x: f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + " + " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in t.controls) + ")"
    around = " ".join(f"WHEN '{r}' THEN {len(k.prefix + k.suffix)}" for r, k in t.roles.items())
    trained = ", ".join(f"'{r}'" for r, k in t.roles.items() if k.loss)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({trained})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role IN ({trained})), '')) AS loss_sha256,
  CAST({len(t.begin)} + sum({escaped("text")} + CASE role {around} ELSE {len("".join(t.other))} + {escaped("role")} END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


ORACLES["op7_chat_format"] = _chat_sql()


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.urls import judge

    return judge(read(spark, sf_dir, "pages"), RULES)


@query
def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.media import media_features

    return media_features(read(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.decontam import find_items

    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLES["op8_decontamination"] = rf"""
WITH item_words AS (SELECT item_id, row_number() OVER () AS item_row, {_WORDS} AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_row, item_id, least(len(w), 5) AS n, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_row, count(*) AS size FROM item_shingles GROUP BY item_row),
doc_words AS (SELECT doc_id, row_number() OVER () AS doc_row, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM item_shingles),
doc_shingles AS (
  SELECT DISTINCT doc_row, doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)),
shared AS (
  SELECT doc_row, any_value(doc_id) AS doc_id, item_row, any_value(item_id) AS item_id, count(*) AS shared
  FROM doc_shingles JOIN item_shingles USING (n, s) GROUP BY doc_row, item_row)
SELECT doc_id, item_id, CAST(size AS BIGINT) AS item_shingles, CAST(shared AS BIGINT) AS shared, shared / size AS containment
FROM shared JOIN sizes USING (item_row) WHERE shared >= ceil(round(0.8 * size, 9))"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality import resample

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.langid import fit, predict

    docs = read(spark, sf_dir, "documents")
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)")
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "familiarity")


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.lmscore import fit, score

    docs = read(spark, sf_dir, "documents")
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 7 = 2, false)")
    return score(docs, fit(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model")), held_out)


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.licenses import scan

    return scan(read(spark, sf_dir, "documents"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.setjoin import components_of

    return components_of(read(spark, sf_dir, "documents"))
