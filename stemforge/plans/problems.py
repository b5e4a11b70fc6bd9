"""Queries of the problems that the core solves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.operators.references import find_orphans, orphan_report, split_ids
from stemforge.sources.tables import table

_REFERENCE = ["table_name", "record_id", "chunk_id", "period", "at"]


def _references(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record of either table and id it refers to."""
    period = F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM").alias("period")
    asked = table(spark, d, "questions").select(F.lit("questions").alias("table_name"), F.col("id").alias("record_id"), F.explode(split_ids(F.col("source_ref"))).alias("chunk_id"), F.col("created_at").alias("at"))
    hits = table(spark, d, "retrievals").select(F.lit("retrievals").alias("table_name"), F.col("retrieval_id").cast("string").alias("record_id"), F.explode(split_ids(F.col("chunk_id"))).alias("chunk_id"), F.col("retrieved_at").alias("at"))
    return asked.unionByName(hits).select("table_name", "record_id", "chunk_id", period, "at")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lower("chunk_id").alias("known_id"), "ingested_at", "deleted_at")
    return find_orphans(_references(spark, d), chunks, {"chunk_id": "known_id"}, at="at", valid_from="ingested_at", valid_to="deleted_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "chunk_id", "period", "reason").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    references = _references(spark, d).distinct()
    return orphan_report(_orphans(spark, d), references, ["table_name", "period"])


def p3_composite(spark: SparkSession, d: str) -> DataFrame:
    """Hits whose (chunk, chapter, section) do not occur together; null columns are left out of the comparison."""
    label = lambda c: F.nullif(F.col(c), F.lit(""))
    hits = table(spark, d, "retrievals").select("retrieval_id", F.lower(F.trim("chunk_id")).alias("chunk_id"), "chapter_num", label("section_label").alias("section_label"))
    chunks = table(spark, d, "chunks").select(F.lower("chunk_id").alias("chunk_id"), "chapter_num", label("section_label").alias("section_label"))
    return find_orphans(hits, chunks, {c: c for c in ("chunk_id", "chapter_num", "section_label")}, match="partial")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_composite": p3_composite}

_FOUND_SQL = r"""
WITH refs AS (
  SELECT DISTINCT 'questions' AS table_name, id AS record_id, x AS chunk_id, created_at AS t
  FROM (SELECT id, created_at, unnest(regexp_split_to_array(lower(source_ref), '[\s,;|"''\[\]]+')) AS x FROM questions) WHERE x <> ''
  UNION ALL
  SELECT DISTINCT 'retrievals', CAST(retrieval_id AS VARCHAR), x, retrieved_at
  FROM (SELECT retrieval_id, retrieved_at, unnest(regexp_split_to_array(lower(chunk_id), '[\s,;|"''\[\]]+')) AS x FROM retrievals) WHERE x <> ''
), known AS (SELECT lower(chunk_id) AS chunk_id, ingested_at, deleted_at FROM chunks),
judged AS (
  SELECT r.table_name, r.record_id, r.chunk_id, r.t,
    count(k.chunk_id) AS n, count(*) FILTER (WHERE k.ingested_at <= r.t) AS begun,
    count(*) FILTER (WHERE k.ingested_at <= r.t AND (k.deleted_at IS NULL OR r.t < k.deleted_at)) AS live
  FROM refs r LEFT JOIN known k ON k.chunk_id = r.chunk_id GROUP BY ALL
), orphans AS (
  SELECT table_name, record_id, chunk_id, t, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN live > 0 THEN NULL WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM judged
)"""

ORACLE = {
    "p3_found": _FOUND_SQL + " SELECT DISTINCT table_name, record_id, chunk_id, period, reason FROM orphans WHERE reason IS NOT NULL",
    "p3_report": _FOUND_SQL
    + """ SELECT table_name, period, count(*) AS n_references,
    count(*) FILTER (WHERE reason = 'missing') AS n_missing, count(*) FILTER (WHERE reason = 'late') AS n_late,
    count(*) FILTER (WHERE reason = 'deleted') AS n_deleted, CAST(0 AS BIGINT) AS n_partly_null, count(reason) AS n_orphans
  FROM orphans GROUP BY table_name, period""",
    "p3_composite": """WITH h AS (SELECT DISTINCT retrieval_id, lower(trim(chunk_id, ' ')) AS chunk_id, chapter_num, nullif(section_label, '') AS section_label FROM retrievals),
 c AS (SELECT DISTINCT lower(chunk_id) AS chunk_id, chapter_num, nullif(section_label, '') AS section_label FROM chunks)
 SELECT h.*, 'missing' AS reason FROM h WHERE coalesce(h.chunk_id, CAST(h.chapter_num AS VARCHAR), h.section_label) IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM c WHERE (h.chunk_id IS NULL OR c.chunk_id = h.chunk_id) AND (h.chapter_num IS NULL OR c.chapter_num = h.chapter_num) AND (h.section_label IS NULL OR c.section_label = h.section_label))""",
}
