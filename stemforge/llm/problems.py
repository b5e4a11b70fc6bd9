"""The queries of the problems solved in this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.llm import bpe, near_duplicates, packing, pairs, proportions, splitting, truncation
from stemforge.session import written
from stemforge.sources.tables import spread_table, table

_DIMENSIONS = {"difficulty": "difficulty", "chapters": "chapter", "bloom_level": "bloom_level"}
SIMILARITY = 0.7


def _allocated(spark: SparkSession, d: str) -> DataFrame:
    """Quotas of every blueprint, written once for all that is made of them."""
    targets = written(proportions.blueprint_targets(table(spark, d, "quizzes")), "targets")
    counts = proportions.count_categories(table(spark, d, "questions"), "bank_id", "id", _DIMENSIONS)
    return written(proportions.quotas(targets, counts), "quotas")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    short = _allocated(spark, d).where("shortfall > 0")
    return short.select(F.col("sample").alias("quiz_id"), "dimension", "category").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """What every category of a blueprint needs, has and lacks; the quotas are in p1_joint."""
    return _allocated(spark, d).drop("quota").withColumnsRenamed({"sample": "quiz_id", "group": "bank_id"})


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    allocated = _allocated(spark, d)
    people = proportions.members(table(spark, d, "questions"), "bank_id", "id", _DIMENSIONS)
    return proportions.draw(allocated, people).withColumnsRenamed({"sample": "quiz_id", "key": "id"})


def p1_joint(spark: SparkSession, d: str) -> DataFrame:
    """How near one set of questions for each quiz comes to the quotas of all its dimensions together."""
    drawn, report = proportions.draw_jointly(_allocated(spark, d), table(spark, d, "questions"), "bank_id", "id", _DIMENSIONS)
    return report.withColumnsRenamed({"sample": "quiz_id", "group": "bank_id"})


def _options(spark: SparkSession, d: str, name: str = "default") -> tuple[int, int, int]:
    """Limit, overlap and least size of one option set; the table is fixed, three rows."""
    row = table(spark, d, "chunk_options").where(F.col("option_set") == name).first()
    return row["max_tokens"], row["overlap_tokens"], row["min_tokens"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    pieces = splitting.split_oversized(chunks, "chunk_id", "text", *_options(spark, d), with_text=False)
    return pieces.where("n_pieces > 1 and piece_no = 0").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").dropDuplicates(["chunk_id", "text"])
    return splitting.split_oversized(chunks, "chunk_id", "text", *_options(spark, d))


def _stem_and_options() -> F.Column:
    return F.concat_ws(" ", "stem", "options")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, d, "questions"), "id", _stem_and_options(), SIMILARITY).select("id_a", "id_b")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.membership(table(spark, d, "questions"), "id", _stem_and_options(), SIMILARITY)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(spread_table(spark, d, "questions"), "id", "stem", "options", "answer", "explanation", "qtype")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(spread_table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    containers = table(spark, d, "containers")
    out = None
    # one pass for each tokenizer that the fixed table of containers names
    for (name,) in containers.select("tokenizer").distinct().collect():
        sized = spread_table(spark, d, "documents").select("doc_id", bpe.token_lengths(F.col("text"), name).alias("n_tokens"))
        one = packing.pack_items(sized, "doc_id", "n_tokens", containers.where(F.col("tokenizer") == name), "container_kind", "capacity_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(spread_table(spark, d, "documents"), "doc_id", "text", "source").where("is_cut").select("doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.find_truncated(spread_table(spark, d, "documents"), "doc_id", "text", "source"), "source")


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_sample": p1_sample,
    "p1_joint": p1_joint,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p8_report": p8_report,
}

_TARGETS_SQL = r"""
WITH b AS (SELECT DISTINCT quiz_id, md5(blueprint) AS blueprint, TRY_CAST(blueprint AS JSON) AS j FROM quizzes),
d AS (SELECT quiz_id, blueprint, j->>'bank_id' AS bank_id, CAST(j->>'total_questions' AS DOUBLE) AS total, coalesce(CAST(j->>'min_per_category' AS DOUBLE), 0) AS floor, dim, json_extract(j, '$.' || dim) AS shares
  FROM b, (VALUES ('difficulty'), ('chapters'), ('bloom_level')) t(dim) WHERE json_type(j) = 'OBJECT' AND j->>'bank_id' IS NOT NULL AND j->>'total_questions' IS NOT NULL),
k AS (SELECT *, unnest(json_keys(shares)) AS raw FROM d WHERE json_type(shares) = 'OBJECT'),
w AS (SELECT quiz_id, blueprint, bank_id, total, floor, dim AS dimension, lower(trim(raw)) AS category, sum(CAST(json_extract_string(shares, '$."' || raw || '"') AS DOUBLE)) AS weight FROM k GROUP BY ALL),
n AS (SELECT *, greatest(floor, coalesce(round(weight * total / nullif(sum(weight) OVER (PARTITION BY quiz_id, blueprint, bank_id, total, floor, dimension), 0)), 0)) AS needed FROM w),
m AS (SELECT bank_id, 'difficulty' AS dimension, lower(trim(difficulty)) AS category, id FROM questions UNION SELECT bank_id, 'bloom_level', lower(trim(bloom_level)), id FROM questions UNION SELECT bank_id, 'chapters', CAST(chapter AS VARCHAR), id FROM questions),
c AS (SELECT bank_id, dimension, category, count(DISTINCT id) AS available FROM m GROUP BY ALL)
"""

ORACLE = {
    "p1_found": _TARGETS_SQL + "SELECT DISTINCT quiz_id, dimension, category FROM n LEFT JOIN c USING (bank_id, dimension, category) WHERE coalesce(available, 0) < needed",
    "p1_report": _TARGETS_SQL + "SELECT quiz_id, blueprint, bank_id, dimension, category, total, CAST(ceil(round(needed, 6)) AS INTEGER) AS needed, CAST(coalesce(available, 0) AS INTEGER) AS available, CAST(greatest(ceil(round(needed, 6)) - coalesce(available, 0), 0) AS INTEGER) AS shortfall FROM n LEFT JOIN c USING (bank_id, dimension, category)",
    "p2_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE length(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_]+', 'x', 'g'), '[\s\p{Z}]', '', 'g')) > (SELECT max_tokens FROM chunk_options WHERE option_set = 'default')",
    "p4_found": r"""WITH t AS (SELECT id, lower(concat_ws(' ', stem, array_to_string(options, ' '))) AS text FROM questions),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word FROM t), s AS (SELECT id, count(*) AS n FROM w GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE c >= 0.7 * (x.n + y.n - c)""",
    "p4_classes": r"""WITH t AS (SELECT id, lower(concat_ws(' ', stem, array_to_string(options, ' '))) AS text FROM questions),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word FROM t),
k AS (SELECT id, list_sort(list(word)) AS words FROM w GROUP BY id),
m AS (SELECT id, min(id) OVER (PARTITION BY words) AS class_id, count(*) OVER (PARTITION BY words) AS n_copies, len(words) AS n FROM k),
r AS (SELECT id, n FROM m WHERE id = class_id), v AS (SELECT w.id, word FROM w JOIN r USING (id)),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM v a JOIN v b ON a.word = b.word AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, count(*) AS n_links FROM p JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE c >= 0.7 * (x.n + y.n - c) GROUP BY a)
SELECT m.id, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l ON l.a = class_id""",
}
