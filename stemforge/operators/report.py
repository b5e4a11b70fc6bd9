"""Counts and previews of questions and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QTYPES = ("mcq", "true_false", "short_answer", "cloze")
BLOOM_LEVELS = ("remember", "understand", "apply", "analyze", "evaluate", "create")
DIFFICULTIES = ("easy", "medium", "hard")


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Observed values in ascending order with their counts."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def count_domain(rows: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Every value of a fixed domain in its order with its count, 0 where there is none; other values are left out."""
    known = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], f"ord int, {column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(counts, column, "left").select("ord", column, F.coalesce("n", F.lit(0)).alias("n")).orderBy("ord")


def summary(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass: ``dimension``, ``value``, ``n``."""
    names = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    return rows.select(F.explode(F.array(*names)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


def ingest_totals(chunks: DataFrame, chapter: str, section: str, tokens: str) -> DataFrame:
    """Per chapter: sections, chunks, tokens, and the smallest and largest chunk."""
    return chunks.groupBy(chapter).agg(F.countDistinct(section).alias("n_sections"), F.count(F.lit(1)).alias("n_chunks"), F.sum(tokens).alias("n_tokens"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"))


def first_of_each(rows: DataFrame, by: str, order: Sequence[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each value of ``by``."""
    keys = ", ".join(f"`{c}`" for c in order)
    return rows.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY `{by}` ORDER BY {keys})")).where(F.col("_r") <= n).drop("_r")


def preview(questions: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first questions, shortened: section (or a dash), stem to 60 and explanation to 80 characters."""
    dash = F.coalesce(F.nullif("section", F.lit("")), F.lit("–")).alias("section")
    return questions.orderBy(*order).limit(n).select("id", "chapter", dash, F.substring("stem", 1, 60).alias("stem"), "answer", F.substring("explanation", 1, 80).alias("explanation"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row, with their counts."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
