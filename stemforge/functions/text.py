"""Column expressions on text; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Spark's trim() takes blanks only.
_EDGES = r"(?U)^\s+|\s+$"
#: A run of letters, digits and underscores, or any other single character that is no white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: An unbroken run of letters or digits.
WORD = r"[\p{L}\p{N}]+"


def strip(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _EDGES, "")


def blank(c: Column) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def or_default(c: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def token_count(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.regexp_count(c, F.lit(TOKEN)))


def split_paragraphs(c: Column, separator: str = r"\n\s*\n") -> Column:
    """Stripped non-empty parts between ``separator``; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator, -1), strip)
    return F.filter(parts, lambda x: x != "")


def split_sentences(c: Column) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and white space; null gives an empty array."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, r"(?U)(?<=[.!?])\s+", -1))


def word_set(c: Column) -> Column:
    """Distinct lower-cased words, sorted; null gives an empty array."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))))
