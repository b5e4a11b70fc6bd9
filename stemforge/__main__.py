"""``python -m stemforge BOOK``: chunks of a book, or a quiz through an OpenAI-compatible endpoint."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import functions as F

from stemforge import pipeline
from stemforge.config import Settings, load_config
from stemforge.operators import assembly, generation, report, retrieval, structure
from stemforge.session import local_session, release, written
from stemforge.sources import chat
from stemforge.sources.readers import ingest

#: Where settings of a course are looked for, and where its index is kept.
CONFIG, INDEX = "data/chapter_config.yaml", "data/index"
log = logging.getLogger("stemforge")


def parser(settings: Settings) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stemforge", description=__doc__)
    p.add_argument("book", help="a file, or a pattern for many")
    p.add_argument("--chapters", help="1-3, or 1,2,5, or both")
    p.add_argument("--config", default=CONFIG, help="YAML file")
    p.add_argument("--per-chunk", type=int, default=settings.per_chunk)
    p.add_argument("--output", default="quiz.json")
    p.add_argument("--title")
    p.add_argument("--show", type=int, default=5, help="questions to preview")
    p.add_argument("--ingest-only", action="store_true")
    p.add_argument("--rag", action="store_true", help="write questions from retrieved passages")
    p.add_argument("--no-rag", action="store_true", help="write questions from single chunks, whatever --rag says")
    p.add_argument("--rag-top-k", type=int, default=5, help="passages for each section")
    p.add_argument("--no-grounding-check", action="store_true")
    p.add_argument("--index-dir", default=INDEX, help="folder of the index; one that holds rows is used as it is")
    p.add_argument("--export-schemas", metavar="FOLDER")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(arguments: list[str] | None = None) -> int:
    settings = Settings.from_environment()
    p = parser(settings)
    args = p.parse_args(arguments)
    logging.basicConfig(format="%(levelname)s %(name)s %(message)s")
    log.setLevel(logging.DEBUG if args.verbose else logging.INFO)
    if args.export_schemas:
        print(*assembly.export_schemas(args.export_schemas), sep="\n")
    spark = local_session()
    try:
        return run(spark, args, settings, p)
    finally:
        release(spark)


def run(spark, args: argparse.Namespace, settings: Settings, p: argparse.ArgumentParser) -> int:
    numbers = None
    if args.chapters:
        numbers = spark.range(1).select(structure.chapter_numbers(F.lit(args.chapters))).first()[0]
        if numbers is None:
            p.error(f"not a list of chapters: {args.chapters}")
    chunks = written(ingest(spark, args.book, numbers, load_config(args.config)), "chunks")
    n_chunks = chunks.count()
    report.ingest_totals(chunks, "chapter_num", "section_label", "token_count").orderBy("chapter_num").show(1000, False)
    if args.ingest_only:
        report.first_of_each(chunks, "chapter_num", ["seq"]).select("chunk_id", "token_count", F.substring("text", 1, 200).alias("text")).show(1000, False)
        return 0
    use_rag = args.rag and not args.no_rag
    index = model = None
    if use_rag:
        model = chat.embedder(settings) if settings.embedding_model else retrieval.hashed_vectors
        if not settings.embedding_model:
            log.warning("no embedding model is set, a stand-in counts characters")
        size = retrieval.build_index(retrieval.embed(chunks, "text", model), args.index_dir)
        log.info("%d chunks are indexed", size)
        index = retrieval.open_index(spark, args.index_dir)
    log.debug("about %d questions are expected", n_chunks * args.per_chunk)
    questions, replies = pipeline.generate_questions(chunks, args.per_chunk, chat.transport(settings), use_passages=use_rag, index=index, model=model, k=args.rag_top_k, check=not args.no_grounding_check)
    questions = written(questions, "questions")
    if replies is not None:
        generation.run_counters(replies, questions).show(1, False)
    if questions.isEmpty():
        print("no questions were written", file=sys.stderr)
        return 1
    title = args.title or (f"Quiz — Chapters {args.chapters}" if args.chapters else "Generated Quiz")
    settled = {"top_k": args.rag_top_k, "grounded": not args.no_grounding_check} if use_rag else {}
    blueprint = assembly.blueprint(numbers, args.per_chunk, F.lit(n_chunks), "RAG" if use_rag else "single-chunk", **settled)
    order = ["chapter_num", "target", "pos"] if use_rag else ["chapter_num", "seq", "pos"]
    assembly.write_quiz(pipeline.quiz_of(questions, title, blueprint, None, order), "quiz", args.output)
    report.summary(questions, ["chapter", "qtype", "difficulty", "bloom_level"]).orderBy("dimension", "value").show(1000, False)
    report.preview(questions, order, args.show).show(args.show, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
