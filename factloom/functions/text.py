"""Date, number and quotation algorithms on text columns, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_DATE = r"\b(\d{1,2})[./\\-](\d{1,2})[./\\-](\d{4}|\d{2})\b"
TIME = r"\b([01]?\d|2[0-3]):([0-5]\d)\b"
QUOTED = r'"([^".,;:!?\n]+)"'
NUMBER = r"\d+(?:[.,]\d+)?"

#: number words
UNITS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def full_year(year: Column) -> Column:
    """Two digits: below 30 in this century, else in the last one; 100 to 999 and over 3000 are no years."""
    y = year.cast("int")
    return F.when(F.length(year) <= 2, F.when(y < 30, 2000 + y).otherwise(1900 + y)).when((y >= 1000) & (y <= 3000), y)


def dates(text: Column) -> Column:
    """All day-first numeric dates, as ISO strings."""
    found = F.regexp_extract_all(text, F.lit(NUMERIC_DATE), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, NUMERIC_DATE, i)
    iso = lambda x: F.concat_ws("-", F.lpad(full_year(part(x, 3)).cast("string"), 4, "0"), F.lpad(part(x, 2), 2, "0"), F.lpad(part(x, 1), 2, "0"))
    return F.array_compact(F.transform(found, lambda x: F.try_to_date(iso(x)).cast("string")))


def times(text: Column) -> Column:
    """All times of day, in minutes."""
    return F.transform(F.regexp_extract_all(text, F.lit(TIME), F.lit(0)), lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("long") * 60 + F.split_part(x, F.lit(":"), F.lit(2)).cast("long"))


def quoted(text: Column) -> Column:
    """Quoted spans without inner punctuation."""
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))


def numbers(text: Column) -> Column:
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", ".").try_cast("double")))


def word_number(words: Column) -> Column:
    """The value of an array of number words; null if one is none. Hundreds multiply what stands before
    them; greater scales close a group."""
    known = F.create_map(*[F.lit(x) for kv in (UNITS | SCALES).items() for x in (kv[0], F.lit(kv[1]).cast("long"))])
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("open"), F.lit(True).alias("ok"))

    def step(acc: Column, w: Column) -> Column:
        v = known[w]
        done = F.when(v >= 1000, acc["done"] + F.greatest(acc["open"], F.lit(1)) * v).otherwise(acc["done"])
        rest = F.when(v >= 1000, F.lit(0).cast("long")).when(v == 100, F.greatest(acc["open"], F.lit(1)) * v).otherwise(acc["open"] + v)
        return F.struct(F.coalesce(done, acc["done"]).alias("done"), F.coalesce(rest, acc["open"]).alias("open"), (acc["ok"] & v.isNotNull()).alias("ok"))

    return F.aggregate(words, start, step, lambda a: F.when(a["ok"], a["done"] + a["open"]))


def capitalize(value: Column, mode: str) -> Column:
    """NONE, UPPER, TITLE (first letter) or CAMEL (first letter of each word)."""
    if mode == "UPPER":
        return F.upper(value)
    if mode == "TITLE":
        return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1 << 30))
    if mode == "CAMEL":
        return F.array_join(F.transform(F.split(value, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return value


def html_to_text(html: Column) -> Column:
    """Body text: dropped elements go with their content, block tags become line breaks, others a space or nothing."""
    out = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")
    out = F.regexp_replace(out, r"(?is)<(style|applet|script|select|textarea|banner|frameset|object)\b[^>]*>.*?</(style|applet|script|select|textarea|banner|frameset|object)>", " ")
    out = F.regexp_replace(out, r"(?is)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br[^>]*>\s*<br[^>]*>|</?(p|table|h[1-6]|hr|dl)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"(?i)<(tr|th|td|li|dd|dt)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?i)<br[^>]*>", " ")
    return F.regexp_replace(out, r"<[^>]*>", "")
