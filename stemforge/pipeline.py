"""From a book to a quiz: the two ways of writing questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.operators import assembly, generation, grounding, prompts, responses, retrieval
from stemforge.operators.generation import Transport
from stemforge.session import written


def questions_from_chunks(chunks: DataFrame, per_chunk: int, transport: Transport, max_attempts: int = 2, pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(questions, replies): one prompt per chunk; valid items only, in chunk order."""
    replies = generation.generate(prompts.chunk_prompts(chunks, per_chunk), "chunk_id", transport, max_attempts, pause=pause)
    asked = replies.join(chunks.select("chunk_id", "chapter_num", "section_label", "seq"), "chunk_id")
    parsed = responses.parse_replies(asked, "reply", ["chunk_id", "chapter_num", "section_label", "seq"])
    defaults = {"source_ref": F.col("chunk_id"), "chapter": F.col("chapter_num"), "section": F.col("section_label")}
    return _valid(parsed, ["chapter_num", "seq", "chunk_id", "section_label"], defaults), replies


def target_key() -> F.Column:
    """(chapter_num, section_label) as one value; a missing label is the empty one."""
    return F.concat_ws("\u0001", F.col("chapter_num").cast("string"), F.coalesce("section_label", F.lit("")))


def retrieve(index: DataFrame, targets: DataFrame, model: Callable[[list[str]], list[list[float]]], k: int) -> DataFrame:
    """The ``k`` best chunks of each target (chapter_num, section_label) among the chunks of that target.

    ``index`` has ``chunk_id``, ``chapter_num``, ``section_label``, ``text`` and ``embedding``; the target's
    query text is embedded by the same model. A target without chunks gives none.
    """
    asked = targets.select("chapter_num", "section_label", retrieval.query_text(F.col("chapter_num"), F.col("section_label")).alias("q")).distinct()
    asked = written(retrieval.embed(asked, "q", model).withColumn("target", target_key()), "queries")
    rows = index.withColumn("target", target_key())
    found = retrieval.nearest(rows.withColumnRenamed("chunk_id", "key_"), asked.withColumn("key_", F.col("target")), "key_", "embedding", k, "target")
    hits = found.select(F.col("key").alias("chunk_id"), "rank_no", "distance", retrieval.similarity(F.col("distance")).alias("similarity"))
    return hits.join(index.select("chunk_id", "chapter_num", "section_label", "text"), "chunk_id")


def generate_questions(
    chunks: DataFrame,
    per_unit: int,
    transport: Transport,
    max_attempts: int = 2,
    use_passages: bool = False,
    index: DataFrame | None = None,
    model: Callable[[list[str]], list[list[float]]] | None = None,
    k: int = 5,
    check: bool = True,
    pause: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """(questions, replies) of all chunks, or with ``use_passages`` of each (chapter, section) that they have.

    Passages are fetched from ``index`` by the vectors of ``model``; both must then be given. A target
    that finds no passage has a reply without text and the status ``no passages``.
    """
    if not use_passages:
        return questions_from_chunks(chunks, per_unit, transport, max_attempts, pause)
    if index is None or model is None:
        raise ValueError("questions from passages need an index and the model of its vectors")
    targets = chunks.select("chapter_num", F.nullif("section_label", F.lit("")).alias("section_label")).distinct()
    hits = written(retrieve(index, targets, model, k), "hits")
    questions, replies = questions_from_passages(hits, per_unit, k, transport, max_attempts, check, pause)
    missing = targets.select(target_key().alias("target")).join(hits.select(target_key().alias("target")).distinct(), "target", "left_anti")
    return questions, replies.unionByName(missing.select("target", F.lit(None).cast("string").alias("reply"), F.lit(0).alias("attempts"), F.lit("no passages").alias("status")))


def questions_from_passages(hits: DataFrame, per_target: int, k: int, transport: Transport, max_attempts: int = 2, check: bool = True, pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(questions, replies): one prompt per (chapter, section) from its best hits.

    With ``check``, ``overlap_ratio`` and ``is_grounded`` say how far the answer rests on the passages; no
    question is dropped for it.
    """
    asked = prompts.passage_prompts(hits, per_target, k).withColumn("target", target_key())
    replies = generation.generate(asked, "target", transport, max_attempts, pause=pause)
    joined = replies.join(asked.select("target", "chapter_num", "section_label", F.col("source_ref").alias("first_ref")), "target")
    parsed = responses.parse_replies(joined, "reply", ["target", "chapter_num", "section_label", "first_ref"])
    defaults = {"source_ref": F.col("first_ref"), "chapter": F.col("chapter_num"), "section": F.col("section_label")}
    questions = _valid(parsed, ["target", "chapter_num", "section_label", "first_ref"], defaults)
    if check:
        passages = hits.where(F.col("rank_no") <= k).withColumn("target", target_key())
        context = passages.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "text"))), lambda x: x["text"]), " ").alias("context"))
        scores = grounding.check_grounding(questions.select("question_no", "target", "answer"), context, "question_no", "target", "answer", "target", "context")
        questions = questions.join(scores, "question_no")
    return questions, replies


def _valid(parsed: DataFrame, keep: list[str], defaults: dict) -> DataFrame:
    """Valid items, with an id where the reply had none."""
    # the fields are written before the rules are applied, which every reader of the questions does anew
    items = responses.apply_rules(written(responses.item_fields(parsed, keep), "items"), keep, defaults).where(F.size("reject_reasons") == 0).drop("reject_reasons")
    number = F.xxhash64(*[F.col(c).cast("string") for c in keep], "pos").alias("question_no")
    fresh = assembly.digest_id(*[F.col(c).cast("string") for c in [*keep, "pos"]], F.col("stem"))
    return items.select("*", number).withColumn("id", F.coalesce("id", fresh))


def quiz_of(questions: DataFrame, title: str, settings: F.Column, most: int | None, order: list[str]) -> DataFrame:
    """One quiz as JSON (column ``quiz``) of the first ``most`` questions, or of all (None)."""
    held = assembly.assemble(questions.withColumn("_one", F.lit(1)), "_one", order, most)
    body = assembly.quiz_json(assembly.digest_id(F.lit(title), F.to_json("questions")), F.lit(title), F.current_timestamp(), settings, F.col("questions"))
    return held.select(body.alias("quiz"), "n_questions")
