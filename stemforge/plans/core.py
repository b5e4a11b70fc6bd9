"""Queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemforge import pipeline
from stemforge.config import IngestConfig
from stemforge.functions.text import split_paragraphs, split_sentences, strip, token_count
from stemforge.operators import assembly, chunking, generation, grounding, prompts, report, responses, retrieval, structure
from stemforge.session import run_folder, written
from stemforge.sources import readers
from stemforge.sources.tables import table

#: White space as the SQL side writes it.
_WS = r"[\t\n\x0b\f\r \x{85}\p{Z}]"
_TOKENS = r"[\p{L}\p{N}_]+|[^\t\n\x0b\f\r \x{85}\p{Z}\p{L}\p{N}_]"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{_TOKENS}'))"


_SENTENCES = f"string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1))"
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n{_WS}*\\n'), lambda x: {_strip('x')}), lambda x: x <> '')"


# --- splitting and counting


@query(f"WITH t AS (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS paragraph FROM t, unnest(range(1, len(p) + 1)) u(i)")
def c1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(split_paragraphs(F.col("text"), r"(?U)\n\s*\n")).alias("pos", "paragraph"))


@query(f"SELECT doc_id, CAST(coalesce({_count('text')}, 0) AS INTEGER) AS n_tokens FROM documents")
def c2_token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))


@query(f"WITH t AS (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM t, unnest(range(1, len(s) + 1)) u(i)")
def c3_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))


_RUNS = """WITH RECURSIVE t AS (SELECT doc_id, {sentences} AS s FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, s, list_transform(s, lambda x: {count}) AS c FROM t),
r AS (SELECT doc_id, 1 AS i, 0 AS pos, c[1] AS total FROM n
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN total + c[i + 1] > {target} THEN pos + 1 ELSE pos END, CASE WHEN total + c[i + 1] > {target} THEN c[i + 1] ELSE total + c[i + 1] END
  FROM r JOIN n ON n.doc_id = r.doc_id WHERE i < len(c))
SELECT r.doc_id, CAST(pos AS INTEGER) AS pos, string_agg(n.s[i], ' ' ORDER BY i) AS chunk_text, CAST(sum(n.c[i]) AS INTEGER) AS token_count FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id, pos"""


@query(_RUNS.format(sentences=_SENTENCES, count=_count("x"), target=120))
def c6_sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 120).drop("text")


_SMALL = chunking.ChunkOptions(target=120, maximum=160, minimum=20, overlap=40)
# the walk as recursion: held paragraphs, and what the step puts out (list of paragraphs, or one long paragraph)
_WALK = f"""WITH RECURSIVE t AS (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> ''),
n AS (SELECT doc_id, p, list_transform(p, lambda x: {_count('x')}) AS c FROM t),
r AS (SELECT doc_id, 0 AS i, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT[]) AS flushed, FALSE AS is_long FROM n
  UNION ALL SELECT doc_id, i + 1,
    CASE WHEN k > {_SMALL.maximum} THEN kept WHEN len(held) > 0 AND total + k > {_SMALL.target} THEN list_append(kept, i + 1) ELSE list_append(held, i + 1) END,
    CASE WHEN len(held) > 0 AND (k > {_SMALL.maximum} OR (total + k > {_SMALL.target} AND total >= {_SMALL.minimum})) THEN held END, k > {_SMALL.maximum}
  FROM (SELECT r.doc_id, i, held, c[i + 1] AS k, coalesce(list_sum(list_transform(held, lambda x: c[x])), 0) AS total,
      list_filter(held, lambda x: list_sum(list_transform(list_filter(held, lambda y: y >= x), lambda z: c[z])) <= {_SMALL.overlap}) AS kept
    FROM r JOIN n ON n.doc_id = r.doc_id WHERE i < len(c)) s),
e AS (SELECT doc_id, i, 0 AS kind, flushed AS parts FROM r WHERE flushed IS NOT NULL
  UNION ALL SELECT doc_id, i, 1, [i] FROM r WHERE is_long
  UNION ALL SELECT r.doc_id, i + 1, 0, held FROM r JOIN n ON n.doc_id = r.doc_id WHERE i = len(c) AND len(held) > 0 AND list_sum(list_transform(held, lambda x: c[x])) >= {_SMALL.minimum}),
l AS (SELECT e.doc_id, e.i, {_SENTENCES.replace('text', 'n.p[e.i]')} AS s FROM e JOIN n ON n.doc_id = e.doc_id WHERE kind = 1),
lc AS (SELECT *, list_transform(s, lambda x: {_count('x')}) AS c FROM l),
q AS (SELECT doc_id, i, 1 AS j, 0 AS piece, c[1] AS total FROM lc
  UNION ALL SELECT q.doc_id, q.i, j + 1, CASE WHEN total + c[j + 1] > {_SMALL.target} THEN piece + 1 ELSE piece END, CASE WHEN total + c[j + 1] > {_SMALL.target} THEN c[j + 1] ELSE total + c[j + 1] END
  FROM q JOIN lc ON lc.doc_id = q.doc_id AND lc.i = q.i WHERE j < len(c)),
a AS (SELECT q.doc_id, q.i, 1 AS kind, piece, string_agg(lc.s[j], ' ' ORDER BY j) AS chunk_text, sum(lc.c[j]) AS token_count FROM q JOIN lc ON lc.doc_id = q.doc_id AND lc.i = q.i GROUP BY ALL
  UNION ALL SELECT e.doc_id, e.i, 0, 0, array_to_string(list_transform(parts, lambda x: n.p[x]), chr(10) || chr(10)), list_sum(list_transform(parts, lambda x: n.c[x])) FROM e JOIN n ON n.doc_id = e.doc_id WHERE kind = 0)
"""
_CHUNKS = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, kind, piece) - 1 AS INTEGER) AS pos, chunk_text, CAST(token_count AS INTEGER) AS token_count FROM a"


def _document_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, d, "documents").select("doc_id", "chapter_num", "text"), "text", _SMALL).drop("text")


@query(_WALK + _CHUNKS)
def c4_overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _document_chunks(spark, d).drop("chapter_num")


@query(
    _WALK
    + f""", o AS ({_CHUNKS}), s AS (SELECT o.*, chapter_num, row_number() OVER (PARTITION BY chapter_num, o.doc_id // 1000 ORDER BY o.doc_id, pos) AS seq FROM o JOIN documents USING (doc_id) WHERE chapter_num IS NOT NULL)
SELECT doc_id, pos, CAST(seq AS INTEGER) AS seq, printf('ch%d_s%s_chunk_%03d', chapter_num, chapter_num || '.' || doc_id, seq) AS chunk_id FROM s"""
)
def c7_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are numbered within the chapters of each book of 1000 documents."""
    cut = _document_chunks(spark, d).where("chapter_num is not null").withColumns({"book": F.expr("doc_id div 1000"), "label": F.concat_ws(".", "chapter_num", "doc_id")})
    return chunking.number_chunks(cut, "chapter_num", ["doc_id"], "label", ["book"]).select("doc_id", "pos", "seq", "chunk_id")


# --- structure

_TOC = f"""WITH total AS (SELECT max(page) AS pages FROM toc), pg AS (SELECT doc_id // pages AS book, doc_id % pages + 1 AS page_no, coalesce(text, '') AS text FROM documents, total),
t AS (SELECT book, ord, {_strip('title')} AS title, page FROM toc JOIN pg ON page = page_no)"""
_CH = r", ch AS (SELECT book, ord, CAST(regexp_extract(title, '^(\d+)\s+(.+)$', 1) AS INTEGER) AS number, regexp_extract(title, '^(\d+)\s+(.+)$', 2) AS title, page AS page_start, coalesce(lead(page) OVER (PARTITION BY book ORDER BY ord) - 1, pages) AS page_end FROM t, total WHERE regexp_full_match(title, '(\d+)\s+(.+)'))"
_SEC = r""", st AS (SELECT book, ord, regexp_extract(title, '^(\d+\.\d+(?:\.\d+)?)\s+(.+)$', 1) AS label, regexp_extract(title, '^(\d+\.\d+(?:\.\d+)?)\s+(.+)$', 2) AS title, page FROM t WHERE regexp_full_match(title, '(\d+\.\d+(\.\d+)?)\s+(.+)')),
held AS (SELECT ch.book, ch.number, ch.ord AS chapter_ord, st.ord AS sec_ord, label, st.title, page AS page_start, coalesce(lead(page) OVER (PARTITION BY ch.book, ch.ord ORDER BY st.ord) - 1, ch.page_end) AS page_end FROM ch JOIN st ON st.book = ch.book AND CAST(split_part(label, '.', 1) AS INTEGER) = ch.number),
sec AS (SELECT * FROM held UNION ALL SELECT book, number, ord, ord, number || '.0', title, page_start, page_end FROM ch WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.book = ch.book AND held.number = ch.number))"""


def _books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """(toc, pages, pages of a book): the documents as pages of as many books as they fill.

    Each book has the entries of the (fixed) table of contents for the pages that it has.
    """
    contents = table(spark, d, "toc")
    n = contents.agg(F.max("page")).first()[0]
    pages = table(spark, d, "documents").select(F.expr(f"doc_id div {n}").alias("book"), F.expr(f"doc_id % {n} + 1").cast("int").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    toc = pages.select("book", "page_no").join(F.broadcast(contents), F.col("page") == F.col("page_no")).drop("page_no")
    return toc, pages, n


@query(_TOC + _CH + " SELECT book, ord, number, title, page_start FROM ch")
def toc_chapters(spark: SparkSession, d: str) -> DataFrame:
    toc, _, n = _books(spark, d)
    return structure.chapters(toc, n, ["book"]).drop("page_end")


@query(_TOC + _CH + " SELECT * FROM ch")
def toc_chapter_ranges(spark: SparkSession, d: str) -> DataFrame:
    toc, _, n = _books(spark, d)
    return structure.chapters(toc, n, ["book"])


@query(_TOC + _CH + _SEC + " SELECT book, number, chapter_ord, sec_ord, label, title FROM sec")
def toc_sections(spark: SparkSession, d: str) -> DataFrame:
    toc, _, n = _books(spark, d)
    return structure.sections(toc, n, ["book"]).drop("page_start", "page_end")


@query(_TOC + _CH + _SEC + " SELECT * FROM sec")
def toc_section_ranges(spark: SparkSession, d: str) -> DataFrame:
    toc, _, n = _books(spark, d)
    return structure.sections(toc, n, ["book"])


@query(
    _TOC
    + _CH
    + _SEC
    + f""", j AS (SELECT sec.book, number, chapter_ord, sec_ord, label, string_agg(pg.text, chr(10) ORDER BY page_no) AS text FROM sec JOIN total ON TRUE LEFT JOIN pg ON pg.book = sec.book AND page_no BETWEEN page_start AND least(page_end, pages) GROUP BY ALL),
o AS (SELECT book, number, label, sec_ord, coalesce({_strip('text')}, '') AS text FROM j)
SELECT book, number, label, sec_ord, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest, text = '' AS is_empty FROM o"""
)
def toc_section_text(spark: SparkSession, d: str) -> DataFrame:
    toc, pages, n = _books(spark, d)
    out = structure.section_texts(structure.sections(toc, n, ["book"]), pages, n)
    return out.select("book", "number", "label", "sec_ord", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "is_empty")


def _book_files(spark: SparkSession, d: str) -> str:
    """The books as text files, one for each; a folder of its own for each run."""
    _, pages, _ = _books(spark, d)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    path = f"{run_folder(spark)}/books-{uuid.uuid4().hex}"
    pages.groupBy("book").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("value")).repartition("book").write.partitionBy("book").text(path)
    return f"{path}/*/*.txt"


_BOOK_TEXT = "b AS (SELECT book, string_agg(text, chr(10) ORDER BY page_no) || chr(10) AS text FROM pg GROUP BY book)"
_NUMBERED = (r"^(\d+)\.\d+[ \t]+([A-Z].*)$", r"^Exercise (\d+\.\d+)[:\s]+(.+)")


@query(_TOC + f", {_BOOK_TEXT} SELECT CAST(book AS INTEGER) AS book, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM b")
def s3_read_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole text files, as many as the documents fill."""
    texts = readers.read_texts(spark, _book_files(spark, d))
    return texts.select(F.regexp_extract("book", r"book=(\d+)", 1).cast("int").alias("book"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query()
def s1_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the same files; its parts have SQL of their own (s3_read_texts, heading_slices, c4_overlap_chunks, c7_chunk_ids)."""
    config = IngestConfig(_SMALL, *_NUMBERED)
    return readers.ingest(spark, _book_files(spark, d), None, config).withColumn("book", F.regexp_extract("book", r"book=(\d+)", 1).cast("int"))


_SLICES = rf"""WITH m AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '(?m)^(\d+)\.\d+[ \t]+([A-Z].*)$', chr(1) || '\1' || chr(2) || '\2' || chr(2), 'g'), chr(1))) AS c, generate_subscripts(string_split(regexp_replace(text, '(?m)^(\d+)\.\d+[ \t]+([A-Z].*)$', chr(1) || '\1' || chr(2) || '\2' || chr(2), 'g'), chr(1)), 1) - 1 AS chapter_pos FROM documents WHERE text IS NOT NULL),
ch AS (SELECT doc_id, chapter_pos, CAST(string_split(c, chr(2))[1] AS INTEGER) AS number, {_strip('string_split(c, chr(2))[2]')} AS title, array_to_string(string_split(c, chr(2))[3:], chr(2)) AS body FROM m WHERE chapter_pos > 0),
s AS (SELECT *, string_split(regexp_replace(body, '(?m)^Exercise (\d+\.\d+)[:\s]+(.+)', chr(1) || '\1' || chr(2) || '\2' || chr(2), 'g'), chr(1)) AS p FROM ch),
o AS (SELECT doc_id, number, chapter_pos, 1 AS sec_pos, number || '.0' AS label, title, {_strip('body')} AS text FROM s WHERE len(p) = 1
UNION ALL SELECT doc_id, number, chapter_pos, i - 1, string_split(p[i], chr(2))[1], {_strip('string_split(p[i], chr(2))[2]')}, {_strip('array_to_string(string_split(p[i], chr(2))[3:], chr(2))')} FROM s, unnest(range(2, len(p) + 1)) u(i) WHERE len(p) > 1)"""


@query(_SLICES + " SELECT doc_id, number, CAST(chapter_pos AS INTEGER) AS chapter_pos, CAST(sec_pos AS INTEGER) AS sec_pos, label, title, text FROM o")
def heading_slices(spark: SparkSession, d: str) -> DataFrame:
    """Numbered headings open a chapter, exercises are its sections."""
    return structure.heading_slices(table(spark, d, "documents"), "doc_id", "text", *_NUMBERED)


@query(_SLICES + " SELECT 'some' AS asked, number, count(*) AS n FROM o WHERE number IN (1, 2, 3) GROUP BY number UNION ALL SELECT 'empty', number, count(*) FROM o GROUP BY number")
def f2_text_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Of texts, a list of chapters keeps these, and an empty list keeps all."""
    found = structure.heading_slices(table(spark, d, "documents"), "doc_id", "text", *_NUMBERED)
    kept = [structure.keep_chapters(found, "number", numbers, empty_is_all=True).groupBy("number").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "number", "n") for name, numbers in (("some", [1, 2, 3]), ("empty", []))]
    return kept[0].unionByName(kept[1])


@query("SELECT chunk_id, chapter_num, seq FROM chunks WHERE chapter_num IN (1, 2, 3)")
def f1_chapter_filter(spark: SparkSession, d: str) -> DataFrame:
    return structure.keep_chapters(table(spark, d, "chunks").select("chunk_id", "chapter_num", "seq"), "chapter_num", [1, 2, 3], empty_is_all=False)


@query(
    """WITH s AS (SELECT DISTINCT page_start AS a, page_end AS b, chapter_num AS c FROM chunks)
SELECT a || '-' || b || ',' || c AS spec, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN a <= b THEN range(a, b + 1) ELSE [] END, [c]))), ',') AS numbers FROM s"""
)
def f6_parse_chapters(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "chunks").select(F.format_string("%d-%d,%d", "page_start", "page_end", "chapter_num").alias("spec")).distinct()
    return specs.select("spec", F.array_join(structure.chapter_numbers(F.col("spec")), ",").alias("numbers"))


@query("SELECT retrieval_id, rank_no, distance FROM retrievals WHERE chapter_num = 2 AND section_label = '2.1'")
def f5_metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.matching(table(spark, d, "retrievals"), 2, "2.1").select("retrieval_id", "rank_no", "distance")


# --- index and retrieval


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return table(spark, d, "documents").select("doc_id", "chapter_num", "source", F.coalesce("text", F.lit("")).alias("text")).join(vectors, "doc_id")


@query("SELECT chapter_num, count(*) AS n_indexed, CAST(sum(len(embedding)) AS BIGINT) AS n_numbers FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY chapter_num")
def v2_index_build(spark: SparkSession, d: str) -> DataFrame:
    path = f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
    retrieval.build_index(_vectors(spark, d), path)
    return spark.read.parquet(path).groupBy("chapter_num").agg(F.count(F.lit(1)).alias("n_indexed"), F.sum(F.size("embedding")).alias("n_numbers"))


def _chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with one row per id, the first one taken in."""
    rows = table(spark, d, "chunks")
    return rows.groupBy("chunk_id").agg(F.min(F.struct("ingested_at", *(c for c in rows.columns if c not in ("chunk_id", "ingested_at")))).alias("c")).select("chunk_id", "c.*")


_CHUNK_ROWS = "k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at NULLS FIRST, chapter_num NULLS FIRST, section_label NULLS FIRST, text NULLS FIRST, token_count NULLS FIRST, page_start, page_end, seq, deleted_at NULLS FIRST) AS _r FROM chunks) WHERE _r = 1)"


@query("SELECT DISTINCT md5(text) AS digest, list_transform(range(8), lambda i: CAST(len(list_filter(string_split(text, ''), lambda c: unicode(c) % 8 = i)) AS FLOAT)) AS embedding FROM (SELECT coalesce(text, '') AS text FROM chunks)")
def v1_embed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of texts by an injected model, here a stand-in that counts code points."""
    texts = table(spark, d, "chunks").select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    return retrieval.embed(texts, "text", retrieval.hashed_vectors).select(F.md5("text").alias("digest"), "embedding")


@query(f"WITH {_CHUNK_ROWS}, f AS (SELECT count(*) AS n FROM k WHERE chapter_num <= 3) SELECT n AS n_first, n AS n_kept, (SELECT count(*) FROM k) AS n_rebuilt, n AS n_read FROM f")
def v2_index_kept(spark: SparkSession, d: str) -> DataFrame:
    """An index that holds rows is kept though other chunks are given, unless it is to be built anew."""
    rows = written(_chunk_rows(spark, d), "index-chunks")
    first = rows.where("chapter_num <= 3")
    path = f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
    counts = [retrieval.build_index(first, path), retrieval.build_index(rows, path)]
    read = spark.read.parquet(path).count()
    counts.append(retrieval.build_index(rows, path, rebuild=True))
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in zip(("n_first", "n_kept", "n_rebuilt", "n_read"), [*counts, read])])


@query(f"WITH {_CHUNK_ROWS} SELECT chapter_num, nullif(section_label, '') AS section_label, count(*) AS n FROM k GROUP BY ALL")
def f9_index_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that went into an index as empty come back as null."""
    path = f"{run_folder(spark)}/index-{uuid.uuid4().hex}"
    retrieval.build_index(_chunk_rows(spark, d), path)
    return retrieval.open_index(spark, path).groupBy("chapter_num", "section_label").agg(F.count(F.lit(1)).alias("n"))


_TOPK = """WITH q AS (SELECT vec_id AS query, label, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT query, vec_id, pow(list_distance(CAST(embedding AS DOUBLE[]), q), 2) AS distance FROM q JOIN embeddings e ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank_no FROM x)
SELECT query, vec_id, CAST(rank_no AS INTEGER) AS rank_no, round(distance, 5) AS distance, round(1 / (1 + distance), 5) AS similarity FROM r WHERE rank_no <= 5"""


def _nearest(spark: SparkSession, d: str, by: str | None) -> DataFrame:
    rows = table(spark, d, "embeddings")
    found = retrieval.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, by)
    return found.select("query", F.col("key").alias("vec_id"), "rank_no", F.round("distance", 5).alias("distance"), F.round(retrieval.similarity(F.col("distance")), 5).alias("similarity"))


@query(_TOPK.format(on="e.label = q.label"))
def v4_topk_chapter(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "label")


@query(_TOPK.format(on="TRUE"))
def v4_topk_global(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, None)


@query("SELECT DISTINCT chapter_num, section_label, 'Chapter ' || chapter_num || ' Section ' || coalesce(section_label, '') AS query_text FROM chunks")
def v6_query_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chapter_num", "section_label", retrieval.query_text(F.col("chapter_num"), F.col("section_label")).alias("query_text")).distinct()


# --- prompts


@query("SELECT chapter_num, section_label, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM chunks GROUP BY ALL")
def a7_targets(spark: SparkSession, d: str) -> DataFrame:
    return prompts.targets(table(spark, d, "chunks"))


def _filled(template: str, values: dict[str, str]) -> str:
    """The template as an SQL expression."""
    out = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || coalesce(CAST({value} AS VARCHAR), '') || '")
    return out


_CHUNK_SQL = _filled(prompts.CHUNK_TEMPLATE, {"n": "2", "chunk_id": "chunk_id", "chapter_num": "chapter_num", "section_label": "coalesce(nullif(section_label, ''), 'N/A')", "text": "substring(text, 1, 3000)"})
_PASSAGE_SQL = _filled(prompts.PASSAGES_TEMPLATE, {"n": "2", "chapter_num": "chapter_num", "section_label": "coalesce(nullif(section_label, ''), 'N/A')", "passages": "passages", "source_ref": "source_ref"})


@query(f"SELECT chunk_id, md5({_CHUNK_SQL}) AS digest, CAST(length({_CHUNK_SQL}) AS INTEGER) AS n_chars FROM chunks")
def g2_chunk_prompts(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("messages")[1]["content"]
    return prompts.chunk_prompts(table(spark, d, "chunks"), 2).select("chunk_id", F.md5(user).alias("digest"), F.length(user).alias("n_chars"))


@query(
    f"""WITH h AS (SELECT chapter_num, section_label, rank_no, lower({_strip('chunk_id')}) AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY chapter_num, section_label, rank_no ORDER BY retrieved_at DESC, retrieval_id DESC) AS r FROM retrievals) WHERE r = 1 AND rank_no <= 5),
c AS (SELECT lower(chunk_id) AS chunk_id, min(text) AS text FROM chunks GROUP BY 1),
k AS (SELECT h.*, c.text, row_number() OVER (PARTITION BY chapter_num, section_label ORDER BY rank_no) AS i FROM h JOIN c USING (chunk_id)),
p AS (SELECT chapter_num, section_label, arg_min(chunk_id, i) AS source_ref, count(*) AS n, string_agg('[Passage ' || i || ' — ' || chunk_id || ']' || chr(10) || substring(text, 1, 2000), chr(10) || chr(10) ORDER BY i) AS passages FROM k GROUP BY ALL)
SELECT chapter_num, section_label, source_ref, CAST(n AS INTEGER) AS n_passages, md5({_PASSAGE_SQL}) AS digest FROM p"""
)
def g3_rag_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each target's newest hit of each rank, with the text of its chunk."""
    hits = table(spark, d, "retrievals").withColumn("_r", F.expr("row_number() OVER (PARTITION BY chapter_num, section_label, rank_no ORDER BY retrieved_at DESC, retrieval_id DESC)"))
    hits = hits.where("_r = 1 and rank_no <= 5").select("chapter_num", "section_label", "rank_no", F.lower(strip(F.col("chunk_id"))).alias("chunk_id"))
    texts = table(spark, d, "chunks").groupBy(F.lower("chunk_id").alias("chunk_id")).agg(F.min("text").alias("text"))
    found = prompts.passage_prompts(hits.join(texts, "chunk_id"), 2, 5)
    return found.select("chapter_num", "section_label", "source_ref", "n_passages", F.md5(F.col("messages")[1]["content"]).alias("digest"))


def _stub(messages: list[dict], json_mode: bool) -> str:
    """A transport for tests: fails in JSON mode where the source's name ends in an even digit, answers badly where it ends in 5."""
    source = messages[1]["content"].split("Source: ", 1)[1].split("\n", 1)[0]
    if json_mode and source[-1] in "02468":
        raise ValueError("no JSON mode")
    if source[-1] == "5":
        return "I cannot say."
    item = {"qtype": "cloze", "bloom_level": "apply", "difficulty": "easy", "stem": "Which source is this ____?", "answer": source, "explanation": "It is named in the prompt."}
    return "```json\n" + json.dumps({"questions": [item]}) + "\n```"


@query("SELECT DISTINCT chunk_id, CASE WHEN chunk_id LIKE '%5' THEN 2 ELSE 1 END AS attempts, CASE WHEN chunk_id LIKE '%5' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN chunk_id LIKE '%5' THEN NULL ELSE chunk_id END AS answer FROM chunks")
def g4_generate_stub(spark: SparkSession, d: str) -> DataFrame:
    asked = prompts.chunk_prompts(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), 1)
    replies = generation.generate(asked, "chunk_id", _stub, pause=0.0)
    parsed = responses.parse_replies(replies, "reply", ["chunk_id", "attempts", "status"])
    answers = responses.validate_items(parsed, ["chunk_id"], {"source_ref": F.col("chunk_id"), "chapter": F.lit(1)}).where(F.size("reject_reasons") == 0).select("chunk_id", "answer")
    return replies.select("chunk_id", "attempts", "status").join(answers, "chunk_id", "left")


@query("SELECT count(DISTINCT chunk_id) AS n_prompts, count(DISTINCT chunk_id) FILTER (WHERE chunk_id NOT LIKE '%5') AS n_answered, count(DISTINCT chunk_id) FILTER (WHERE chunk_id LIKE '%5') AS n_failed, count(DISTINCT chunk_id) + count(DISTINCT chunk_id) FILTER (WHERE chunk_id LIKE '%5') AS n_attempts FROM chunks")
def a8_run_counters(spark: SparkSession, d: str) -> DataFrame:
    asked = prompts.chunk_prompts(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), 1)
    return generation.run_counters(generation.generate(asked, "chunk_id", _stub, pause=0.0))


@query(f"WITH {_CHUNK_ROWS} SELECT 'single-chunk' AS mode, chapter_num, count(*) FILTER (WHERE chunk_id NOT LIKE '%5') AS n FROM k GROUP BY chapter_num UNION ALL SELECT 'RAG', chapter_num, count(*) FROM (SELECT DISTINCT chapter_num, nullif(section_label, '') FROM k) GROUP BY chapter_num")
def g1_modes(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each chapter in either mode; passages come from an index by the stand-in's vectors."""
    rows = written(_chunk_rows(spark, d).withColumn("section_label", F.nullif("section_label", F.lit(""))), "mode-chunks")
    index = written(retrieval.embed(rows, "text", retrieval.hashed_vectors), "mode-index")
    single, _ = pipeline.generate_questions(rows, 1, _stub, pause=0.0)
    passages, _ = pipeline.generate_questions(rows, 1, _passage_stub, use_passages=True, index=index, model=retrieval.hashed_vectors, pause=0.0)
    counts = [q.groupBy(F.col("chapter").alias("chapter_num")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "chapter_num", "n") for mode, q in (("single-chunk", single), ("RAG", passages))]
    every = rows.select(F.lit("single-chunk").alias("mode"), "chapter_num").distinct()
    none = every.join(counts[0], ["mode", "chapter_num"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    return counts[0].unionByName(none).unionByName(counts[1])


def _passage_stub(messages: list[dict], json_mode: bool) -> str:
    """A transport for passages; one question about the first of them."""
    item = {"qtype": "cloze", "bloom_level": "apply", "difficulty": "easy", "stem": "What do the passages say of ____?", "answer": "nothing", "explanation": "It stands in the passages."}
    return json.dumps([item])


@query(f"WITH {_CHUNK_ROWS} SELECT chunk_id, chapter_num AS chapter, section_label AS section, chunk_id AS source_ref FROM k WHERE chunk_id NOT LIKE '%5'")
def g9_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Chapter, section and source of the chunk fill what a reply leaves out."""
    questions, _ = pipeline.questions_from_chunks(_chunk_rows(spark, d), 1, _stub, pause=0.0)
    return questions.select("chunk_id", "chapter", "section", "source_ref")


@query("SELECT DISTINCT chunk_id, chunk_id NOT LIKE '%5' AS is_sound FROM chunks")
def g11_structured(spark: SparkSession, d: str) -> DataFrame:
    """Replies that must have one structure as a whole, or are an error."""
    asked = prompts.chunk_prompts(table(spark, d, "chunks").dropDuplicates(["chunk_id"]), 1)

    @F.udf("boolean")
    def sound(messages):
        try:
            generation.ask_structured(_stub, [m.asDict() for m in messages], lambda x: isinstance(x, dict) and isinstance(x.get("questions"), list))
            return True
        except ValueError:
            return False

    return asked.select("chunk_id", sound("messages").alias("is_sound"))


# --- replies

_BARE = f"""b AS (SELECT doc_id, {_strip('text')} AS t FROM documents),
i AS (SELECT doc_id, t, CASE WHEN contains(t, chr(10)) THEN substring(t, strpos(t, chr(10)) + 1) ELSE substring(t, 4) END AS u FROM b),
f AS (SELECT doc_id, CASE WHEN starts_with(t, '```') THEN {_strip("CASE WHEN contains(u, '```') THEN array_to_string(string_split(u, '```')[:-2], '```') ELSE u END")} ELSE t END AS reply FROM i)"""
_ITEMS = f"""WITH {_BARE}, v AS (SELECT doc_id, TRY_CAST(reply AS JSON) AS j FROM f),
n AS (SELECT doc_id, coalesce(json_type(j) IN ('OBJECT', 'ARRAY'), FALSE) AS is_parsed, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN CASE WHEN NOT list_contains(json_keys(j), 'questions') THEN CAST('[]' AS JSON) WHEN json_type(j, '$.questions') = 'ARRAY' THEN j->'$.questions' END END AS items FROM v)"""


@query(f"WITH {_BARE} SELECT doc_id, md5(reply) AS digest FROM f")
def g6_strip_fences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(responses.strip_fences(F.col("text"))).alias("digest"))


@query(_ITEMS + " SELECT doc_id, is_parsed, CAST(coalesce(json_array_length(items), -1) AS INTEGER) AS n_items FROM n")
def g8_normalise(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse_replies(table(spark, d, "documents"), "text", ["doc_id"]).drop("items")


def _sound(f: str, extra: str = "") -> str:
    return f"(coalesce(json_type(q, '$.{f}') = 'VARCHAR', FALSE){extra})"


def _domain(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RULES = {
    "id": f"(json_type(q, '$.id') IS NULL OR {_sound('id')})",
    "chapter": "coalesce(chapter >= 1, FALSE)",
    "section": f"(coalesce(json_type(q, '$.section'), 'NULL') = 'NULL' OR {_sound('section')})",
    "qtype": _sound("qtype", f" AND q->>'$.qtype' IN {_domain(report.QTYPES)}"),
    "bloom_level": _sound("bloom_level", f" AND q->>'$.bloom_level' IN {_domain(report.BLOOM_LEVELS)}"),
    "difficulty": _sound("difficulty", f" AND q->>'$.difficulty' IN {_domain(report.DIFFICULTIES)}"),
    "stem": _sound("stem", " AND length(q->>'$.stem') >= 10"),
    "options": "(coalesce(json_type(q, '$.options'), 'NULL') = 'NULL' OR (json_type(q, '$.options') = 'ARRAY' AND len(list_filter(from_json(q->'$.options', '[\"JSON\"]'), lambda x: json_type(x) <> 'VARCHAR')) = 0))",
    "answer": _sound("answer", " AND length(q->>'$.answer') >= 1"),
    "explanation": _sound("explanation", " AND length(q->>'$.explanation') >= 10"),
    "source_ref": f"(json_type(q, '$.source_ref') IS NULL OR {_sound('source_ref')})",
}
_VALID = (
    _ITEMS
    + r""", e AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, json_extract(items, '$[' || i || ']') AS q FROM n, unnest(range(0, CAST(json_array_length(items) AS BIGINT))) u(i)),
c AS (SELECT *, CASE json_type(q, '$.chapter') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(q->>'$.chapter', '\s*[+-]?\d+(\.0*)?\s*') THEN CAST(TRY_CAST(trim(q->>'$.chapter') AS DOUBLE) AS INTEGER) END WHEN 'BOOLEAN' THEN CAST(q->>'$.chapter' = 'true' AS INTEGER) ELSE CASE WHEN TRY_CAST(q->>'$.chapter' AS DOUBLE) = floor(TRY_CAST(q->>'$.chapter' AS DOUBLE)) THEN CAST(TRY_CAST(q->>'$.chapter' AS DOUBLE) AS INTEGER) END END AS chapter FROM e),
z AS (SELECT doc_id, pos, chapter, q->>'$.qtype' AS qtype, q->>'$.answer' AS answer, coalesce(q->>'$.source_ref', CASE WHEN json_type(q, '$.source_ref') IS NULL THEN 'doc_' || doc_id END) AS source_ref,
CASE WHEN json_type(q) <> 'OBJECT' THEN 'item' ELSE array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN NOT {rule} THEN '{f}' END" for f, rule in _RULES.items())
    + "], lambda x: x IS NOT NULL), ',') END AS reasons FROM c)"
)


def _validated(spark: SparkSession, d: str) -> DataFrame:
    parsed = responses.parse_replies(table(spark, d, "documents"), "text", ["doc_id"])
    return responses.validate_items(parsed, ["doc_id"], {"source_ref": F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))})


@query(_VALID + " SELECT doc_id, pos, chapter, qtype, answer, source_ref, reasons FROM z WHERE reasons <> 'item'")
def g10_validate(spark: SparkSession, d: str) -> DataFrame:
    """Every item of the documents that are replies, with what is wrong with it; a missing source is the document (G9)."""
    rows = _validated(spark, d).withColumn("reasons", F.array_join("reject_reasons", ",")).where("reasons <> 'item'")
    return rows.select("doc_id", "pos", "chapter", "qtype", "answer", "source_ref", "reasons")


@query(_VALID + " SELECT unnest(string_split(CASE WHEN reasons = '' THEN 'valid' ELSE reasons END, ',')) AS reason, count(*) AS n FROM z GROUP BY 1")
def g10_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.size("reject_reasons") == 0, F.array(F.lit("valid"))).otherwise(F.col("reject_reasons"))
    return _validated(spark, d).select(F.explode(reason).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- grounding

_STOP = "[" + ", ".join(f"'{w}'" for w in grounding.STOP_WORDS) + "]"


def _content(x: str) -> str:
    return f"list_filter(list_distinct(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))), lambda w: NOT list_contains({_STOP}, w))"


@query(f"SELECT doc_id, CAST(coalesce(len({_content('text')}), 0) AS INTEGER) AS n_words FROM documents")
def r1_content_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(grounding.content_words(F.col("text"))).alias("n_words"))


@query(
    f"""WITH c AS (SELECT lower(chunk_id) AS ref, {_content('min(text)')} AS w FROM chunks GROUP BY 1),
q AS (SELECT DISTINCT id, lower({_strip('source_ref')}) AS ref, coalesce({_content('explanation')}, []) AS a FROM questions),
r AS (SELECT id, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, coalesce(w, []))) / len(a) END AS ratio FROM q LEFT JOIN c USING (ref))
SELECT id, round(ratio, 6) AS overlap_ratio, ratio >= 0.3 AS is_grounded FROM r"""
)
def r2_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Explanations of the questions against the chunk that they refer to."""
    asked = table(spark, d, "questions").select("id", F.lower(strip(F.col("source_ref"))).alias("ref"), "explanation").distinct()
    known = table(spark, d, "chunks").select(F.lower("chunk_id").alias("ref"), "text")
    return grounding.check_grounding(asked, known, "id", "ref", "explanation", "ref", "text").withColumn("overlap_ratio", F.round("overlap_ratio", 6))


# --- reports


@query("SELECT chapter, count(*) AS n FROM questions GROUP BY chapter")
def a1_by_chapter(spark: SparkSession, d: str) -> DataFrame:
    return report.count_by(table(spark, d, "questions"), "chapter")


@query("SELECT qtype, count(*) AS n FROM questions GROUP BY qtype")
def a2_by_qtype(spark: SparkSession, d: str) -> DataFrame:
    return report.count_by(table(spark, d, "questions"), "qtype")


def _zero_filled(column: str, domain: tuple[str, ...]) -> str:
    values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(domain))
    return f"SELECT ord, v AS {column}, count({column}) AS n FROM (VALUES {values}) t(ord, v) LEFT JOIN questions ON {column} = v GROUP BY ord, v"


@query(_zero_filled("difficulty", report.DIFFICULTIES))
def a3_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return report.count_domain(table(spark, d, "questions"), "difficulty", report.DIFFICULTIES)


@query(_zero_filled("bloom_level", report.BLOOM_LEVELS))
def a4_by_bloom(spark: SparkSession, d: str) -> DataFrame:
    return report.count_domain(table(spark, d, "questions"), "bloom_level", report.BLOOM_LEVELS)


_DIMENSIONS = ["chapter", "qtype", "difficulty", "bloom_level"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM questions GROUP BY 2" for c in _DIMENSIONS))
def a5_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(table(spark, d, "questions"), _DIMENSIONS)


@query("SELECT chapter_num, count(DISTINCT section_label) AS n_sections, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS n_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens FROM chunks GROUP BY 1")
def a6_ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.ingest_totals(table(spark, d, "chunks"), "chapter_num", "section_label", "token_count")


@query("SELECT id, count(*) AS n FROM questions GROUP BY id HAVING count(*) > 1")
def a11_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return report.duplicate_keys(table(spark, d, "questions"), "id")


@query("SELECT id, chapter, coalesce(nullif(section, ''), '–') AS section, substring(stem, 1, 60) AS stem, answer, substring(explanation, 1, 80) AS explanation FROM (SELECT DISTINCT ON (id) * FROM questions) ORDER BY created_at, id LIMIT 5")
def t3_preview(spark: SparkSession, d: str) -> DataFrame:
    return report.preview(table(spark, d, "questions").dropDuplicates(["id"]), ["created_at", "id"])


@query("SELECT chapter_num, chunk_id, substring(text, 1, 200) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY chapter_num ORDER BY seq, chunk_id, ingested_at) AS r FROM chunks) WHERE r = 1")
def t4_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    return report.first_of_each(table(spark, d, "chunks"), "chapter_num", ["seq", "chunk_id", "ingested_at"]).select("chapter_num", "chunk_id", F.substring("text", 1, 200).alias("sample"))


# --- assembly

#: Questions of one quiz, and of one part of a bank's whole quiz (the size of a row).
QUIZ_SIZE, PART_SIZE = 20, 1000


@query(f"SELECT bank_id, CAST((r - 1) // {PART_SIZE} + 1 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n_questions, string_agg(id, ',' ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY created_at NULLS FIRST, id NULLS FIRST) AS r FROM (SELECT bank_id, id, min(created_at) AS created_at FROM questions GROUP BY ALL)) GROUP BY ALL")
def q1_quizzes(spark: SparkSession, d: str) -> DataFrame:
    """Each bank as one quiz of all its questions, in parts of rows that stay bounded."""
    parts = assembly.assemble_all(_once(spark, d), "bank_id", ["created_at", "id"], PART_SIZE).withColumnRenamed("quiz_no", "part")
    return parts.select("bank_id", "part", "n_questions", F.array_join("questions.id", ",").alias("ids"))


def _once(spark: SparkSession, d: str) -> DataFrame:
    """Questions with one row per bank and id; of rows that repeat an id, the first one counts."""
    once = table(spark, d, "questions").groupBy("bank_id", "id").agg(F.min(F.struct("created_at", *(f for f in responses.FIELDS if f != "id"))).alias("q"))
    return once.select("bank_id", "id", "q.*")


@query(f"SELECT bank_id, CAST((r - 1) // {QUIZ_SIZE} + 1 AS INTEGER) AS quiz_no, CAST(count(*) AS INTEGER) AS n_questions, string_agg(id, ',' ORDER BY r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY created_at NULLS FIRST, id NULLS FIRST) AS r FROM (SELECT bank_id, id, min(created_at) AS created_at FROM questions GROUP BY ALL)) GROUP BY ALL")
def q1_all_quizzes(spark: SparkSession, d: str) -> DataFrame:
    """All questions of each bank as quizzes of QUIZ_SIZE."""
    quizzes = assembly.assemble_all(_once(spark, d), "bank_id", ["created_at", "id"], QUIZ_SIZE)
    return quizzes.select("bank_id", "quiz_no", "n_questions", F.array_join("questions.id", ",").alias("ids"))


@query(f"SELECT bank_id, CAST((r - 1) // {QUIZ_SIZE} + 1 AS INTEGER) AS quiz_no, CAST(count(*) AS INTEGER) AS n_questions, TRUE AS has_id, TRUE AS is_dated FROM (SELECT *, row_number() OVER (PARTITION BY bank_id ORDER BY created_at NULLS FIRST, id NULLS FIRST) AS r FROM (SELECT bank_id, id, min(created_at) AS created_at FROM questions GROUP BY ALL)) GROUP BY ALL")
def k1_quiz_files(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes written as files of JSON and read again; each has a random id of its own, and the time of writing."""
    quizzes = assembly.assemble_all(_once(spark, d), "bank_id", ["created_at", "id"], QUIZ_SIZE)
    body = assembly.quiz_json(assembly.new_id(), F.concat_ws(" ", "bank_id", "quiz_no"), F.current_timestamp(), F.to_json(F.struct("bank_id", "quiz_no")), F.col("questions"))
    path = f"{run_folder(spark)}/quizzes-{uuid.uuid4().hex}"
    quizzes.select(body.alias("value")).write.text(path)
    back = spark.read.text(path).select(F.get_json_object("value", "$.blueprint.bank_id").alias("bank_id"), F.get_json_object("value", "$.blueprint.quiz_no").cast("int").alias("quiz_no"), assembly.read_quiz(F.col("value")).alias("q"))
    own = F.count(F.lit(1)).over(Window.partitionBy("q.quiz_id")) == 1
    recent = F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds("q.created_at")) < 86_400
    return back.select("bank_id", "quiz_no", F.size("q.questions").alias("n_questions"), (own & F.col("q.quiz_id").rlike("^[0-9a-f]{12}$")).alias("has_id"), recent.alias("is_dated"))


@query("""SELECT chapter_num, '{"chapters":null,"per_chunk":2,"total_chunks":' || count(*) || ',"generation_mode":"single-chunk","rag_top_k":null,"grounding_check":null}' AS blueprint, left(md5(CAST(chapter_num AS VARCHAR)), 12) AS quiz_id FROM chunks GROUP BY chapter_num""")
def q4_blueprint(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "chunks").groupBy("chapter_num").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("chapter_num", assembly.blueprint(None, 2, F.col("n"), "single-chunk").alias("blueprint"), assembly.digest_id(F.col("chapter_num").cast("string")).alias("quiz_id"))


@query("SELECT DISTINCT quiz_id, loaded_at, CAST(len(questions) AS INTEGER) AS n_questions, TRUE AS is_same FROM quizzes")
def q5_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes to JSON and back: every field must come back as it was."""
    quizzes = table(spark, d, "quizzes")
    back = assembly.read_quiz(assembly.quiz_json(F.col("quiz_id"), F.col("title"), F.col("created_at"), F.lit(None).cast("string"), F.col("questions")))
    rows = quizzes.withColumn("back", back)
    same = F.col("back.quiz_id").eqNullSafe(F.col("quiz_id")) & F.col("back.title").eqNullSafe(F.col("title")) & F.col("back.created_at").eqNullSafe(F.col("created_at")) & (F.to_json("back.questions") == F.to_json("questions"))
    return rows.select("quiz_id", "loaded_at", F.size("questions").alias("n_questions"), same.alias("is_same")).distinct()
