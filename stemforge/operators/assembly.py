"""Quizzes from questions, and the files a run leaves."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.operators.report import BLOOM_LEVELS, DIFFICULTIES, QTYPES
from stemforge.operators.responses import FIELDS, LEAST_LENGTH, MAY_BE_ABSENT, MAY_BE_NULL
from stemforge.session import written

QUESTION = "id string, chapter int, section string, qtype string, bloom_level string, difficulty string, stem string, options array<string>, answer string, explanation string, source_ref string"


def new_id() -> Column:
    """Twelve random hexadecimal digits; write the result down before it is used twice."""
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def digest_id(*columns: Column) -> Column:
    """Twelve hexadecimal digits that follow from the columns, where a run must be repeatable."""
    return F.left(F.md5(F.concat_ws("\u0001", *columns)), F.lit(12))


def blueprint(chapters: Sequence[int] | None, per_chunk: int, total_chunks: Column, mode: str, top_k: int | None = None, grounded: bool | None = None) -> Column:
    """The run's settings as JSON; settings that do not apply are null."""
    numbers = F.array(*map(F.lit, chapters)) if chapters else F.lit(None).cast("array<int>")
    held = F.struct(numbers.alias("chapters"), F.lit(per_chunk).alias("per_chunk"), total_chunks.alias("total_chunks"), F.lit(mode).alias("generation_mode"), F.lit(top_k).cast("int").alias("rag_top_k"), F.lit(grounded).cast("boolean").alias("grounding_check"))
    return F.to_json(held, {"ignoreNullFields": "false"})


def assemble(questions: DataFrame, by: str, order: Sequence[str], most: int | None) -> DataFrame:
    """One quiz per value of ``by``: its first ``most`` questions in order (None: all of them), ``by``, ``n_questions``, ``questions``.

    ``most`` is the size of a quiz; it also bounds the row that holds one. Without it, or to keep what
    goes beyond it, see :func:`assemble_all`, whose rows are bounded and lose nothing.
    """
    keys = ", ".join(f"`{c}`" for c in order)
    first = questions.withColumn("_r", F.expr(f"row_number() OVER (PARTITION BY `{by}` ORDER BY {keys})"))
    return _held(first if most is None else first.where(F.col("_r") <= most), by)


def assemble_all(questions: DataFrame, by: str, order: Sequence[str], size: int) -> DataFrame:
    """All questions of each value of ``by`` in order, ``size`` to a quiz: ``by``, ``quiz_no`` from 1, ``n_questions``, ``questions``.

    Only the last quiz of a value may be smaller. ``order`` must tell the questions of a value apart. The
    rows are range-partitioned by ``by`` and ``order``, so a value with many questions lies in many parts;
    a rank is the place in the part plus the rows of the value in the parts before.
    """
    placed = questions.select(by, *dict.fromkeys([*order, *FIELDS])).repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    placed = written(placed.select(by, *FIELDS, F.monotonically_increasing_id().alias("_at")), "quiz-parts")
    part = F.shiftright("_at", 33).alias("_part")
    spans = placed.groupBy(F.col(by).alias("_by"), part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row per value and part that holds it
    spans = spans.withColumn("_before", F.expr("coalesce(sum(_n) OVER (PARTITION BY _by ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    ranked = placed.withColumn("_p", part).join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_part")))
    ranked = ranked.withColumn("_r", F.col("_at") - F.col("_first") + F.col("_before"))
    return _held(ranked.withColumn("quiz_no", F.expr(f"CAST(_r DIV {size} + 1 AS INTEGER)")), by, "quiz_no")


def _held(ranked: DataFrame, *by: str) -> DataFrame:
    """Questions of each ``by`` as an array in the order of ``_r``."""
    held = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", *FIELDS))).alias("_q"))
    fields = lambda x: F.struct(*[x[f].alias(f) for f in FIELDS])
    return held.select(*by, F.size("_q").alias("n_questions"), F.transform("_q", fields).alias("questions"))


def quiz_json(quiz_id: Column, title: Column, created_at: Column, settings: Column, questions: Column) -> Column:
    """A quiz as JSON with nulls kept; ``settings`` is JSON itself and goes in as a value."""
    body = F.to_json(F.struct(quiz_id.alias("quiz_id"), title.alias("title"), created_at.alias("created_at"), questions.alias("questions")), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"})
    return F.concat(F.left(body, F.length(body) - 1), F.lit(',"blueprint":'), F.coalesce(settings, F.lit("{}")), F.lit("}"))


def read_quiz(quiz: Column) -> Column:
    return F.from_json(quiz, f"quiz_id string, title string, created_at timestamp, questions array<struct<{QUESTION.replace(' ', ':').replace(',:', ',')}>>")


def write_quiz(quiz: DataFrame, column: str, path: str) -> None:
    """The one quiz of ``quiz`` as an indented file; a folder of many is ``quiz.write.text``."""
    rows = quiz.select(column).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one quiz goes into one file")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(json.loads(rows[0][0]), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


#: What the published schemas say of the enumerations, the fields and the examples.
_ENUMERATIONS = {"QuestionType": (QTYPES, "Supported question formats."), "BloomLevel": (BLOOM_LEVELS, "Bloom's taxonomy cognitive levels (revised, 2001)."), "Difficulty": (DIFFICULTIES, "Three-tier difficulty scale.")}
_QUESTION_ABOUT = "A single exam / quiz question with full metadata.\n\n``source_ref`` traces the question back to the text chunk(s) that\ngrounded its generation \u2014 essential for the RAG audit trail."
_QUIZ_ABOUT = "A complete quiz / exam consisting of selected questions.\n\n``blueprint`` stores the professor's constraints that drove the\nAutomated Test Assembly selection so the exam is fully reproducible."
_ABOUT = {
    "id": "Unique question identifier.", "chapter": "Chapter number the question belongs to.", "section": "Section label within the chapter (e.g. '2.3').", "qtype": "Question format.", "bloom_level": "Bloom's taxonomy cognitive level.", "difficulty": "Difficulty tier.",
    "stem": "The question text / prompt shown to the student.", "options": "Answer options (required for MCQ, optional otherwise).", "answer": "The correct answer (letter for MCQ, text otherwise).", "explanation": "Explanation of why the answer is correct, for review.",
    "source_ref": "Identifier(s) of the source chunk(s) this question is grounded in.", "quiz_id": "Unique quiz identifier.", "title": "Human-readable title for the quiz/exam.", "created_at": "UTC timestamp of creation.", "blueprint": "The blueprint / constraints used to assemble this quiz.", "questions": "Ordered list of questions in this quiz.",
}
_QUESTION_EXAMPLE = {
    "id": "a1b2c3d4e5f6", "chapter": 2, "section": "2.1", "qtype": "mcq", "bloom_level": "understand", "difficulty": "medium", "stem": "Which data structure provides O(1) average-case lookup?", "options": ["Linked list", "Hash table", "Binary tree", "Stack"],
    "answer": "B", "explanation": "Hash tables use a hash function to map keys to buckets, giving O(1) average-case lookup time.", "source_ref": "ch2_s1_chunk_003",
}
_QUIZ_EXAMPLE = {
    "quiz_id": "exam_2025_v1", "title": "AI-1 Midterm Exam \u2014 Version A", "created_at": "2025-07-01T10:00:00Z", "questions": [],
    "blueprint": {"total_questions": 20, "chapters": {"1": 10, "2": 6, "3": 4}, "difficulty_mix": {"easy": 0.4, "medium": 0.4, "hard": 0.2}},
}


def json_schemas() -> dict[str, dict]:
    """JSON Schemas of a question and a quiz, as published."""

    def field(name: str, **rules: object) -> dict:
        titled = {} if "$ref" in rules else {"title": name.replace("_", " ").title()}
        return rules | {"description": _ABOUT[name]} | titled

    def text(name: str, **rules: object) -> dict:
        return field(name, type="string", **({"minLength": LEAST_LENGTH[name]} if LEAST_LENGTH.get(name) else {}), **rules)

    def may_be_null(name: str, kind: dict) -> dict:
        return field(name, anyOf=[kind, {"type": "null"}], default=None)

    named = {"QuestionType": "qtype", "BloomLevel": "bloom_level", "Difficulty": "difficulty"}
    enumerations = {n: {"title": n, "type": "string", "enum": list(values), "description": about} for n, (values, about) in _ENUMERATIONS.items()}
    fields = {f: text(f) for f in FIELDS} | {f: field(f, **{"$ref": f"#/$defs/{n}"}) for n, f in named.items()}
    fields |= {"chapter": field("chapter", type="integer", minimum=1), "section": may_be_null("section", {"type": "string"}), "options": may_be_null("options", {"type": "array", "items": {"type": "string"}})}
    needed = [f for f in FIELDS if f not in (*MAY_BE_NULL, *MAY_BE_ABSENT)]
    question = {"title": "Question", "type": "object", "description": _QUESTION_ABOUT, "examples": [_QUESTION_EXAMPLE], "properties": fields, "required": needed}
    held = {
        "quiz_id": text("quiz_id"), "title": text("title"), "created_at": text("created_at", format="date-time"), "blueprint": field("blueprint", type="object", additionalProperties=True),
        "questions": field("questions", type="array", items={"$ref": "#/$defs/Question"}),
    }
    quiz = {"title": "Quiz", "type": "object", "description": _QUIZ_ABOUT, "examples": [_QUIZ_EXAMPLE], "properties": held, "required": ["title"]}
    return {"question.schema.json": {"$defs": enumerations} | question, "quiz.schema.json": {"$defs": enumerations | {"Question": question}} | quiz}


def export_schemas(folder: str = "schemas") -> list[str]:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, schema in json_schemas().items():
        (out / name).write_text(json.dumps(schema, indent=2) + "\n", encoding="utf-8")
    return [str(out / name) for name in json_schemas()]
