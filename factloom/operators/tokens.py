"""Texts as sentences and tokens. Everything here is a narrow plan of built-in functions: sentences and
tokens come from ``explode`` over arrays made in the row, neighbours are read from the same array, so
no window and no shuffle is needed. Filters on columns of the documents reach the scan; those on
sentences and tokens are applied above the ``explode`` that makes them.

Defined cases: null and empty texts have no sentence; null ids stay null; repeated rows give their
sentences each; extra columns are dropped; texts of any length are read whole; a sentence without words has
an empty array. What follows in this package works on the row of a sentence, so rows that share an id
are never mixed, unless a function says that it groups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?]*"
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]"
QUOTES = '["«»“”„]'


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_id (from 0) and sentence. The splitter is our definition: a run up to . ! ? or a line's end."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("sent_id", "sentence")).withColumn("sent_id", F.col("sent_id").cast("long"))


def token_array(words: Column, neighbours: bool = False) -> Column:
    """The words of a sentence as tokens: pos, tok, low, and, if asked for, the tokens before and after."""
    around = lambda i: [F.when(i > 0, F.try_element_at(words, i)).alias("prev"), F.try_element_at(words, i + 2).alias("next")] if neighbours else []
    return F.transform(words, lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("tok"), F.lower(w).alias("low"), *around(i)))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later expressions may use many times, also inside lambdas: a generator of one
    row stands between, so the optimizer cannot copy their expressions into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def charts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", neighbours: bool = False) -> DataFrame:
    """A row per sentence with its tokens as an array: the input of the grammar operators."""
    words = F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))
    df = computed(sentences(docs, id_col, text_col), {"words": words})
    return computed(df, {"toks": token_array(F.col("words"), neighbours)}).drop("words")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", neighbours: bool = True) -> DataFrame:
    """A row per token: doc_id, sent_id, pos, tok, low and, unless not asked for, prev and next."""
    return charts(docs, id_col, text_col, neighbours).select("doc_id", "sent_id", F.inline("toks"))


KINDS = [
    ("Digit", r"^\p{N}+$"),
    ("AltWord", r"^[A-Za-z]+$"),
    ("Word", r"^\p{L}+$"),
    ("Hyphen", r"^[-–—]$"),
    ("Punct", r"^[.,:;!?'()\[\]{}\"]$"),
]


def kind(tok: Column) -> Column:
    """The class of a token."""
    out = F.lit("Symbol")
    for name, pattern in reversed(KINDS):
        out = F.when(tok.rlike(pattern), name).otherwise(out)
    return out


_CYRILLIC, _LATIN = "АВЕКМНОРСТХаеорсухё", "ABEKMHOPCTXaeopcyxë"


def repair_lookalikes(tok: Column) -> Column:
    """A word that mixes Latin and Cyrillic letters becomes Cyrillic if that is possible, else Latin."""
    mixed = tok.rlike("[A-Za-z]") & tok.rlike(r"\p{IsCyrillic}")
    native = F.translate(tok, _LATIN, _CYRILLIC)
    return F.when(~mixed, tok).when(native.rlike(r"^\P{IsLatin}*$"), native).otherwise(F.translate(tok, _CYRILLIC, _LATIN))


def normalize(tok: Column) -> Column:
    """Lower case, with e for yo."""
    return F.translate(F.lower(tok), "ё", "е")


def ordinal(text: Column) -> tuple[Column, Column]:
    """Number and flexion of a token like 3-ya or 21st."""
    pattern = r"^(\d+)-?(\p{L}{1,3})$"
    number = F.regexp_extract(text, pattern, 1)
    return F.when(number != "", number.try_cast("long")), F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
