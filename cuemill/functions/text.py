"""Words, folding and cleaning of text as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]+(?:[’'-]+[\p{L}\p{N}_]+)*"


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it - within lambdas of its own as well.

    Under a Python UDF f may use its own variable alone: Spark 4.1.2 does not find a UDF whose argument has a lambda that
    uses the variable of another around it.
    """
    return F.transform(F.array(value), f)[0]


def casefold(c: Column) -> Column:
    """Case folding for Latin text: lower case, and ss for ß."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def casefold_any(s: pd.Series) -> pd.Series:
    """Full Unicode case folding, which no built-in gives."""
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _unmarked(x: str) -> str:
    if x.isascii():
        return x
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c)[0] != "M"))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Text without combining marks: decomposed, category M dropped, composed again."""
    return s.map(_unmarked, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def strip_marks_each(s: pd.Series) -> pd.Series:
    """strip_marks of each text of an array; null texts stay."""
    return s.map(lambda a: [None if x is None else _unmarked(x) for x in a], na_action="ignore")


def words(c: Column) -> Column:
    """The words of a text in order: letters, digits and _, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))


def collapse(c: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_distinct(values: Column) -> Column:
    """Provider names trimmed, lower-cased, - as _, blanks dropped, each at its first place."""
    clean = F.transform(values, lambda x: F.replace(F.lower(F.trim(x)), F.lit("-"), F.lit("_")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def unknown_options(given: Column, known: Column) -> Column:
    """The options that are not known, sorted."""
    return F.sort_array(F.array_except(given, known))


def apply_edits(text: Column, edits: Column) -> Column:
    """Replacements applied from the right: array of (offset, length, value).

    An edit without a value, out of range, or reaching into one applied before it (at its right) is passed over; of edits
    at one offset the first given comes first.
    """
    usable = F.filter(edits, lambda e: (F.coalesce(e["value"], F.lit("")) != "") & (e["offset"] >= 0) & (e["length"] >= 0) & (e["offset"] + e["length"] <= F.length(text)))
    placed = F.transform(usable, lambda e, i: F.struct((-e["offset"]).alias("at"), i.alias("i"), e["length"].alias("length"), e["value"].alias("value")))
    start = F.struct(text.alias("text"), (F.length(text) + 1).alias("last"))

    def step(acc, e):
        offset = -e["at"]
        fits = offset + e["length"] <= acc["last"]
        out = F.concat(F.substring(acc["text"], F.lit(1), offset), e["value"], F.substring(acc["text"], offset + e["length"] + 1, F.length(acc["text"])))
        return F.struct(F.when(fits, out).otherwise(acc["text"]).alias("text"), F.when(fits, offset).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.array_sort(placed), start, step)["text"]
