"""Prompts for question writing, as message arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.text import or_default

#: Characters of a chunk, and of each retrieved passage, that enter a prompt.
CHUNK_CHARS, PASSAGE_CHARS = 3000, 2000

SYSTEM = (
    "You write exam questions for a university course. Use nothing but the source text you are given: every question must be answerable from it alone. "
    "Mix the types mcq, true_false, short_answer and cloze, the levels remember, understand, apply, analyze, evaluate and create, and the difficulties easy, medium and hard. "
    "An mcq has four options and its answer is the letter of the right one; a true_false answer is True or False; other types have null options. "
    'Reply with one JSON object whose key "questions" holds an array of objects with the keys '
    "chapter, section, qtype, bloom_level, difficulty, stem, options, answer, explanation and source_ref."
)
#: Placeholders are replaced by columns of the same name.
CHUNK_TEMPLATE = "Write exactly {n} questions from this passage.\nSource: {chunk_id}\nChapter: {chapter_num}\nSection: {section_label}\n\n{text}\n\nUse the source as source_ref."
PASSAGES_TEMPLATE = "Write exactly {n} questions for chapter {chapter_num}, section {section_label}, from the passages below.\n\n{passages}\n\nUse the id of the passage a question comes from as source_ref; the first is {source_ref}."


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced; what a value holds is not looked at again."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def messages(system: str, user: Column) -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def chunk_prompts(chunks: DataFrame, n: int) -> DataFrame:
    """One prompt per chunk: ``chunk_id``, ``chapter_num``, ``section_label``, ``messages``; a missing section is ``N/A``."""
    values = {"n": F.lit(n), "chunk_id": F.col("chunk_id"), "chapter_num": F.col("chapter_num"), "section_label": or_default(F.col("section_label"), "N/A"), "text": F.substring("text", 1, CHUNK_CHARS)}
    return chunks.select("chunk_id", "chapter_num", "section_label", messages(SYSTEM, fill(CHUNK_TEMPLATE, values)).alias("messages"))


def join_passages(hits: Column) -> Column:
    """Passages in rank order from an array of (rank_no, chunk_id, text): a head line, the first characters, a blank line between."""
    ordered = F.array_sort(hits)
    one = lambda x, i: F.concat(F.lit("[Passage "), (i + 1).cast("string"), F.lit(" — "), x["chunk_id"], F.lit("]\n"), F.substring(x["text"], 1, PASSAGE_CHARS))
    return F.array_join(F.transform(ordered, one), "\n\n")


def passage_prompts(hits: DataFrame, n: int, k: int) -> DataFrame:
    """One prompt per (chapter_num, section_label) from its ``k`` best hits.

    ``hits`` has ``chapter_num``, ``section_label``, ``rank_no``, ``chunk_id`` and ``text``, at most one
    per rank; the default source is the first of them.
    """
    best = hits.where(F.col("rank_no") <= k)
    group = best.groupBy("chapter_num", "section_label").agg(F.collect_list(F.struct("rank_no", "chunk_id", "text")).alias("h"))
    group = group.withColumns({"passages": join_passages(F.col("h")), "source_ref": F.array_sort("h")[0]["chunk_id"]})
    values = {"n": F.lit(n), "chapter_num": F.col("chapter_num"), "section_label": or_default(F.col("section_label"), "N/A"), "passages": F.col("passages"), "source_ref": F.col("source_ref")}
    return group.select("chapter_num", "section_label", "source_ref", F.size("h").cast("int").alias("n_passages"), messages(SYSTEM, fill(PASSAGES_TEMPLATE, values)).alias("messages"))


def targets(chunks: DataFrame) -> DataFrame:
    """(chapter_num, section_label) with the number of chunks and their tokens; labels sort as text, so 2.10 before 2.2."""
    return chunks.groupBy("chapter_num", "section_label").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk")).orderBy("chapter_num", "section_label")
