"""Books from files: text and Markdown by headings, PDF by its embedded table of contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.config import IngestConfig
from stemforge.functions.text import blank
from stemforge.operators import chunking, structure
from stemforge.session import written

TEXT_SUFFIXES = (".tex", ".md", ".txt")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``book`` (the file) and ``text``, one row per whole file; a folder or pattern reads many."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book"), F.col("value").alias("text"))


#: opener(content) -> (entries of the contents as (level, title, page), texts of the pages)
Opener = Callable[[bytes], tuple[list[tuple[int, str, int]], list[str]]]


def open_pdf(content: bytes) -> tuple[list[tuple[int, str, int]], list[str]]:
    """Contents and page texts of one PDF; needs the optional PyMuPDF where the tasks run."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [tuple(entry[:3]) for entry in doc.get_toc()], [page.get_text() for page in doc]


def read_pdf(spark: SparkSession, path: str, opener: Opener = open_pdf) -> tuple[DataFrame, DataFrame]:
    """(toc, pages) of PDF files, each with its ``book``; a file is read once, in one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                toc, texts = opener(content)
                contents = [(name, i, level, title, page, None) for i, (level, title, page) in enumerate(toc)]
                pages = [(name, None, None, None, i, text) for i, text in enumerate(texts, 1)]
                yield pd.DataFrame(contents + pages, columns=["book", "ord", "level", "title", "page", "text"])

    rows = written(files.mapInPandas(read, "book string, ord int, level int, title string, page int, text string"), "pdf")
    toc = rows.where("text is null").select("book", "ord", "level", "title", "page")
    return toc, rows.where("text is not null").select("book", F.col("page").alias("page_no"), "text")


def chunks_of_sections(section: DataFrame, order: Sequence[str], config: IngestConfig) -> DataFrame:
    """Numbered chunks of section texts (``book``, ``number``, ``label``, ``page_start``, ``page_end``, ``text``); blank sections give none."""
    cut = chunking.chunk_texts(section.where(~blank(F.col("text"))), "text", config.options).drop("text")
    numbered = chunking.number_chunks(cut, "number", order, "label", ["book"])
    return numbered.select("book", "chunk_id", F.col("number").alias("chapter_num"), F.col("label").alias("section_label"), F.col("chunk_text").alias("text"), "token_count", "page_start", "page_end", "seq")


def ingest(spark: SparkSession, path: str, chapters: Sequence[int] | None = None, config: IngestConfig = IngestConfig(), opener: Opener = open_pdf) -> DataFrame:
    """Chunks of the books at ``path``, by suffix; a pattern reads many books, each with its own contents and pages.

    In texts an empty list of chapters keeps all, in PDFs none (an error). No chapter heading, no table
    of contents, or no chapter left in any book is an error; so is any other suffix.
    """
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix in TEXT_SUFFIXES:
        sections = structure.heading_slices(read_texts(spark, path), "book", "text", config.chapter_heading, config.section_heading)
        if sections.isEmpty():
            raise ValueError("no chapter heading in the text")
        sections = structure.keep_chapters(sections, "number", chapters, empty_is_all=True)
        return chunks_of_sections(sections.withColumns({"page_start": F.lit(0), "page_end": F.lit(0)}), ["chapter_pos", "sec_pos"], config)
    if suffix == ".pdf":
        toc, pages = read_pdf(spark, path, opener)
        if toc.isEmpty():
            raise ValueError("the document has no table of contents")
        counts = pages.groupBy("book").agg(F.max("page_no").alias("n_pages"))
        toc = toc.join(counts, "book")
        sections = structure.keep_chapters(structure.sections(toc, F.col("n_pages"), ["book"]), "number", chapters, empty_is_all=False)
        if sections.isEmpty():
            raise ValueError("no chapter matches")
        texts = structure.section_texts(sections.join(counts, "book"), pages, F.col("n_pages"))
        return chunks_of_sections(texts, ["chapter_ord", "sec_ord"], config)
    raise ValueError(f"cannot read {suffix} files")
