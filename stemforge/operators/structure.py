"""Chapters and sections from a table of contents or from headings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemforge.functions.text import strip

#: Titles of chapters and sections. ``(?d)``: a line ends at the newline only, as in the titles' source.
CHAPTER_TITLE = r"(?d)^(\d+)\s+(.+)$"
SECTION_TITLE = r"(?d)^(\d+\.\d+(?:\.\d+)?)\s+(.+)$"
#: Default headings of plain text and Markdown.
CHAPTER_HEADING = r"^#+\s+Chapter\s+(\d+)[:\s]+(.+)"
SECTION_HEADING = r"^##+\s+(\d+\.\d+)\s+(.+)"
_MARK, _FIELD = "\u0001", "\u0002"


def match_titles(toc: DataFrame, pattern: str, book: Sequence[str] = ()) -> DataFrame:
    """Entries whose stripped title matches: ``book``, ``ord``, ``label``, ``title``, ``page``; null titles match nothing."""
    t = strip(F.col("title"))
    return toc.where(t.rlike(pattern)).select(*book, "ord", F.regexp_extract(t, pattern, 1).alias("label"), F.regexp_extract(t, pattern, 2).alias("title"), "page")


def _total(total_pages: int | Column) -> Column:
    return total_pages if isinstance(total_pages, Column) else F.lit(total_pages)


def chapters(toc: DataFrame, total_pages: int | Column, book: Sequence[str] = ()) -> DataFrame:
    """``book``, ``ord``, ``number``, ``title``, ``page_start``, ``page_end``; a chapter ends before the next matched one of its book.

    Entries of any level count. ``book`` names the columns that tell books apart, so no window holds more
    than the contents of one; without it, ``toc`` is one book. ``total_pages`` may be a column of ``toc``.
    """
    matched = match_titles(toc.withColumn("_total", _total(total_pages)), CHAPTER_TITLE, [*book, "_total"])
    matched = matched.select(*book, "ord", F.col("label").cast("int").alias("number"), "title", F.col("page").alias("page_start"), "_total")
    following = F.lead("page_start").over(Window.partitionBy(*book).orderBy("ord"))
    return matched.withColumn("page_end", F.coalesce(following - 1, F.col("_total"))).drop("_total")


def sections(toc: DataFrame, total_pages: int | Column, book: Sequence[str] = ()) -> DataFrame:
    """``book``, ``number``, ``chapter_ord``, ``sec_ord``, ``label``, ``title``, ``page_start``, ``page_end``.

    A section belongs to every chapter of its book whose number is its leading integer and ends before the
    next one of that chapter, the last with its chapter. A chapter without sections has one,
    ``{number}.0``, over its whole range.
    """
    book = list(book)
    chapter = chapters(toc, total_pages, book).select(*book, F.col("ord").alias("chapter_ord"), "number", F.col("title").alias("chapter_title"), F.col("page_start").alias("chapter_start"), F.col("page_end").alias("chapter_end"))
    titles = match_titles(toc, SECTION_TITLE, book).withColumn("number", F.split("label", r"\.")[0].cast("int")).withColumnRenamed("ord", "sec_ord")
    # a chapter without a section keeps its own row, which then is its section
    held = chapter.join(titles, [*book, "number"], "left")
    bare = F.col("sec_ord").isNull()
    following = F.lead("page").over(Window.partitionBy(*book, "chapter_ord").orderBy("sec_ord"))
    own = {
        "sec_ord": F.coalesce("sec_ord", "chapter_ord"), "label": F.when(bare, F.format_string("%d.0", "number")).otherwise(F.col("label")), "title": F.when(bare, F.col("chapter_title")).otherwise(F.col("title")),
        "page_start": F.when(bare, F.col("chapter_start")).otherwise(F.col("page")), "page_end": F.coalesce(following - 1, F.col("chapter_end")),
    }
    return held.select(*book, "number", "chapter_ord", *[c.alias(n) for n, c in own.items()])


def section_texts(section: DataFrame, pages: DataFrame, page_count: int | Column, book: Sequence[str] = ("book",)) -> DataFrame:
    """Each section of each book with the text of its pages; ``pages`` has ``book``, ``page_no`` and ``text``.

    Pages of the range are put together in order, a newline between them, and stripped. A section whose
    range is empty, or whose pages are missing, has an empty text (``is_empty``). The range becomes page
    numbers first, so that the join is one of equal books and pages; a page belongs to as many sections
    as hold it. ``page_count`` may be a column of ``section``.
    """
    book = list(book)
    last = F.least(F.col("page_end"), _total(page_count))
    # sequence() counts down where the end comes first; a section without a page keeps its row
    numbers = F.when(F.col("page_start") <= last, F.sequence("page_start", last))
    keys = [*book, "number", "chapter_ord", "sec_ord", "label", "title", "page_start", "page_end"]
    wanted = section.select(*keys, F.explode_outer(numbers).alias("page_no"))
    found = wanted.join(pages.select(*book, "page_no", F.col("text").alias("_t")), [*book, "page_no"], "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("page_no", "_t"))))
    text = strip(F.array_join(F.transform(parts, lambda x: x["_t"]), "\n")).alias("text")
    return found.groupBy(*keys).agg(text).withColumn("is_empty", F.col("text") == "")


def heading_slices(documents: DataFrame, key: str, text: str, chapter: str = CHAPTER_HEADING, section: str = SECTION_HEADING, numbers: Sequence[int] | None = None) -> DataFrame:
    """Sections of texts by their headings: ``key``, ``number``, ``chapter_pos``, ``sec_pos``, ``label``, ``title``, ``text``.

    A chapter runs from the end of its heading to the next chapter heading, a section likewise within
    it; what stands before the first heading is dropped, a chapter without section headings is one
    section ``{number}.0``. ``numbers`` keeps some chapters; None and an empty list keep all. A text
    without a chapter heading gives no row. Headings take two groups: number and title.
    """
    marked = lambda c, pattern: F.regexp_replace(c, f"(?md){pattern}", f"{_MARK}$1{_FIELD}$2{_FIELD}")
    parts = lambda c, pattern: F.split(marked(c, pattern), _MARK, -1)
    body = F.split(F.col("_c"), _FIELD, 3)
    rows = documents.select(F.col(key).alias("_key"), F.posexplode(parts(F.col(text), chapter)).alias("chapter_pos", "_c")).where("chapter_pos > 0")
    rows = rows.select("_key", "chapter_pos", body[0].cast("int").alias("number"), strip(body[1]).alias("_title"), body[2].alias("_body"))
    if numbers:
        rows = rows.where(F.col("number").isin(list(numbers)))
    split = rows.withColumn("_s", parts(F.col("_body"), section))
    whole = split.where(F.size("_s") == 1).select("_key", "number", "chapter_pos", F.lit(1).alias("sec_pos"), F.format_string("%d.0", "number").alias("label"), F.col("_title").alias("title"), strip("_body").alias("text"))
    piece = F.split(F.col("_p"), _FIELD, 3)
    cut = split.where(F.size("_s") > 1).select("_key", "number", "chapter_pos", F.posexplode("_s").alias("sec_pos", "_p")).where("sec_pos > 0")
    cut = cut.select("_key", "number", "chapter_pos", "sec_pos", piece[0].alias("label"), strip(piece[1]).alias("title"), strip(piece[2]).alias("text"))
    return whole.unionByName(cut).withColumnRenamed("_key", key)


def keep_chapters(rows: DataFrame, column: str, numbers: Sequence[int] | None, empty_is_all: bool) -> DataFrame:
    """Rows of the given chapters; None keeps all, an empty list keeps all or nothing."""
    if numbers is None or (empty_is_all and not numbers):
        return rows
    return rows.where(F.col(column).isin(list(numbers))) if numbers else rows.where(F.lit(False))


def chapter_numbers(spec: Column) -> Column:
    """Sorted distinct numbers of ``1-3``, ``1,2,5`` and mixtures; a range that descends is empty, a bad part null."""
    parts = F.transform(F.split(spec, ","), strip)
    bounds = lambda p: F.split(p, "-", 2)
    low = lambda p: strip(bounds(p)[0]).try_cast("int")
    high = lambda p: F.when(F.size(bounds(p)) == 2, strip(F.get(bounds(p), F.lit(1))).try_cast("int")).otherwise(low(p))
    numbers = lambda p: F.when(low(p) <= high(p), F.sequence(low(p), high(p))).when(low(p) > high(p), F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
