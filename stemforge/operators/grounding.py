"""Lexical grounding: how much of an answer's content words its context holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.skew import salted

#: Words that say nothing about content.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall not and but or if then else "
    "when where how what which who that this these those with from for in on at to of by as it its they them their we our you your he she his her"
).split()


def content_words(text: Column) -> Column:
    """Distinct runs of three or more ASCII letters of the lower-cased text that stand alone, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS)))


def overlap_ratio(answer_words: Column, context_words: Column) -> Column:
    """Share of the answer's words that the context has; 1 for an answer without content words."""
    shared = F.size(F.array_intersect(answer_words, F.coalesce(context_words, F.array().cast("array<string>"))))
    return F.when(F.size(answer_words) == 0, F.lit(1.0)).otherwise(shared / F.size(answer_words))


def check_grounding(answers: DataFrame, contexts: DataFrame, key: str, reference: str, answer: str, context_key: str, context: str, least: float = 0.3) -> DataFrame:
    """``key``, ``overlap_ratio`` and ``is_grounded`` of every answer; advisory, no row is dropped.

    ``contexts`` has one text per ``context_key`` (of several, the smallest counts). An answer whose
    reference is null or unknown has an empty context. A hot context is split over many tasks.
    """
    words = contexts.where(F.col(context_key).isNotNull()).groupBy(F.col(context_key).alias("_ref")).agg(F.min(context).alias("_c")).select("_ref", content_words(F.col("_c")).alias("_context"))
    asked = answers.select(F.col(key), F.col(reference).alias("_ref"), content_words(F.col(answer)).alias("_answer"))
    left, right = salted(asked, words, ["_ref"], [key])
    ratio = overlap_ratio(F.col("_answer"), F.col("_context"))
    joined = left.join(right, ["_ref", "_salt"], "left")
    return joined.select(key, ratio.alias("overlap_ratio")).withColumn("is_grounded", F.col("overlap_ratio") >= least)
