"""Overlapping, token-bounded chunks of section texts.

Splitting, counting and joining are built-in expressions. The greedy walk over a text's token counts
is a small helper on arrays of numbers; the text never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.text import blank, split_paragraphs, split_sentences, token_count


@dataclass(frozen=True)
class ChunkOptions:
    target: int = 600
    maximum: int = 800
    minimum: int = 100
    overlap: int = 100


def suffix_within(parts: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """The longest run of last parts whose tokens fit; it stops at the first that does not."""
    kept, total = 0, 0
    for _, n in reversed(parts):
        if total + n > limit:
            break
        total += n
        kept += 1
    return parts[len(parts) - kept :] if kept and limit > 0 else []


def merge_sentences(counts: Sequence[int], target: int) -> list[tuple[int, int, int]]:
    """(first, end, tokens) of greedy runs of sentences; a sentence over the target stands alone."""
    out: list[tuple[int, int, int]] = []
    start, total = 0, 0
    for i, n in enumerate(counts):
        if i > start and total + n > target:
            out.append((start, i, total))
            start, total = i, 0
        total += n
    if len(counts) > start:
        out.append((start, len(counts), total))
    return out


def walk(counts: Sequence[int], sentences: Sequence[Sequence[int]], o: ChunkOptions) -> list[dict]:
    """Chunks of one text as paragraph numbers, or a run of one paragraph's sentences.

    A paragraph over the maximum first flushes what is held, whatever its size, then comes out in runs
    of sentences; the overlap stays held. Another that would pass the target flushes what is held if it
    reaches the minimum (else only the overlap survives) and is then added without a second check. What
    is left at the end comes out if it reaches the minimum.
    """
    out: list[dict] = []
    held: list[tuple[int, int]] = []

    def emit(n: int, parts: list[int], first: int = -1, end: int = -1) -> None:
        out.append({"parts": parts, "first": first, "end": end, "n_tokens": n})

    for i, n in enumerate(counts):
        total = sum(k for _, k in held)
        if n > o.maximum:
            if held:
                emit(total, [p for p, _ in held])
                held = suffix_within(held, o.overlap)
            for first, end, k in merge_sentences(sentences[i], o.target):
                emit(k, [i], first, end)
            continue
        if held and total + n > o.target:
            if total >= o.minimum:
                emit(total, [p for p, _ in held])
            held = suffix_within(held, o.overlap)
        held.append((i, n))
    total = sum(k for _, k in held)
    if held and total >= o.minimum:
        emit(total, [p for p, _ in held])
    return out


_RUN = "array<struct<parts:array<int>,first:int,end:int,n_tokens:int>>"


def chunk_texts(texts: DataFrame, text: str, options: ChunkOptions = ChunkOptions(), separator: str = r"(?U)\n\s*\n") -> DataFrame:
    """Rows of ``texts`` once for each chunk, with ``pos``, ``chunk_text`` and ``token_count``.

    Rows with a null or blank text give none. Every row is chunked by itself.
    """
    o = options

    @F.pandas_udf(_RUN)
    def runs(counts: pd.Series, sentences: pd.Series) -> pd.Series:
        return pd.Series([walk(list(c), s, o) for c, s in zip(counts, sentences)])

    parts = texts.where(~blank(F.col(text))).withColumn("_p", split_paragraphs(F.col(text), separator))
    parts = parts.withColumn("_n", F.transform("_p", token_count))
    # sentences of the paragraphs over the maximum, none of the others
    parts = parts.withColumn("_s", F.zip_with("_p", "_n", lambda p, n: F.when(n > o.maximum, split_sentences(p)).otherwise(F.array().cast("array<string>"))))
    walked = parts.withColumn("_r", runs("_n", F.transform("_s", lambda s: F.transform(s, token_count))))
    run = lambda r: F.array_join(F.slice(F.get("_s", r["parts"][0]), r["first"] + 1, r["end"] - r["first"]), " ")
    whole = lambda r: F.array_join(F.transform(r["parts"], lambda i: F.get("_p", i)), "\n\n")
    return _exploded(walked, texts.columns, lambda r: F.when(r["first"] >= 0, run(r)).otherwise(whole(r)))


def _exploded(walked: DataFrame, columns: list[str], text: Callable[[Column], Column]) -> DataFrame:
    """One row per run in ``_r``; texts are put together before, so that no row carries the parts of all.

    The explode is an outer one, then filtered: else the optimizer would evaluate the walk a second time
    in a filter before it.
    """
    chunks = F.transform("_r", lambda r: F.struct(text(r).alias("t"), r["n_tokens"].alias("n")))
    rows = walked.select(*columns, chunks.alias("_c")).select(*columns, F.posexplode_outer("_c").alias("pos", "_c")).where("pos is not null")
    return rows.select(*columns, "pos", F.col("_c.t").alias("chunk_text"), F.col("_c.n").alias("token_count"))


def sentence_chunks(texts: DataFrame, text: str, target: int) -> DataFrame:
    """Greedy runs of sentences joined by a blank: the rows of ``texts`` with ``pos``, ``chunk_text``, ``token_count``."""

    @F.pandas_udf("array<struct<first:int,end:int,n_tokens:int>>")
    def runs(counts: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "end": b, "n_tokens": n} for a, b, n in merge_sentences(list(c), target)] for c in counts])

    walked = texts.where(F.col(text).isNotNull()).withColumn("_s", split_sentences(F.col(text))).withColumn("_r", runs(F.transform("_s", token_count)))
    return _exploded(walked, texts.columns, lambda r: F.array_join(F.slice("_s", r["first"] + 1, r["end"] - r["first"]), " "))


def number_chunks(chunks: DataFrame, chapter: str, section_order: Sequence[str], label: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``seq`` (from 1 per chapter, across sections) and ``chunk_id`` ``ch{n}_s{label}_chunk_{seq:03d}``.

    ``within`` names what chapters are counted in (a book), so that no window holds more than a chapter.
    """
    by = ", ".join(f"`{c}`" for c in [*within, chapter])
    order = ", ".join(f"`{c}`" for c in [*section_order, "pos"])
    out = chunks.withColumn("seq", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {order})"))
    return out.withColumn("chunk_id", F.format_string("ch%d_s%s_chunk_%03d", chapter, label, "seq"))


def chunk_sizes(count: Column) -> Column:
    """Class of a chunk's size, for reports."""
    return F.when(count < 100, "small").when(count <= 800, "regular").otherwise("large")
