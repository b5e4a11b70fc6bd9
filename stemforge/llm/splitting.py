"""Cutting oversized texts at natural boundaries, with overlap.

A text is seen as its tokens' begin and end offsets. Boundaries (the token counts after which the
text itself pauses) are a sorted array; the last one under the limit is found by binary search, the
next piece begins ``overlap`` tokens before the cut, and where no boundary leads on the cut is hard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE, _WORD, _OTHER = 0, 1, 2
#: Characters that end a sentence, and those that may close it after them.
_STOPS = ".!?。！？…"
_CLOSERS = "\"'”’»)]}」』）"
#: Fixed value: stops of scripts without blanks, after which a sentence ends without white space.
_WIDE_STOPS = "。！？"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: white space, letters digits and underscores, any other."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            kinds[i] = _SPACE
        elif c.isalnum() or c == "_":
            kinds[i] = _WORD
    return kinds


def token_offsets(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every token, and the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[points]
    before = np.concatenate((np.array([_SPACE], np.uint8), kinds[:-1]))
    begins = np.flatnonzero((kinds == _OTHER) | ((kinds == _WORD) & (before != _WORD)))
    after = np.concatenate((kinds[1:], np.array([_SPACE], np.uint8)))
    ends = np.flatnonzero((kinds == _OTHER) | ((kinds == _WORD) & (after != _WORD))) + 1
    return begins, ends, points


def boundaries(begins: np.ndarray, ends: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts after which a paragraph, and after which at least a line or sentence, is over."""
    n = len(begins)
    newline = np.concatenate(([0], np.cumsum(points == 10)))
    breaks = newline[begins[1:]] - newline[ends[:-1]]
    apart = begins[1:] > ends[:-1]
    last = points[ends[:-1] - 1]
    is_stop = np.isin(last, [ord(c) for c in _STOPS])
    closes = np.isin(last, [ord(c) for c in _CLOSERS])
    # a closer right behind a stop ends the sentence as well
    stop = is_stop.copy()
    stop[1:] |= closes[1:] & stop[:-1]
    wide = np.isin(last, [ord(c) for c in _WIDE_STOPS])
    paragraph = np.flatnonzero(breaks >= 2) + 1
    pause = np.flatnonzero((breaks >= 1) | (stop & apart) | wide) + 1
    return paragraph[paragraph < n], pause[pause < n]


def cut(text: str, limit: int, overlap: int, least: int = 1) -> list[tuple[int, int, int, bool]]:
    """Pieces of a text as (first token, tokens, begin offset, natural cut?) of at most ``limit`` tokens.

    A paragraph end is taken if it leaves at least half of the limit, else a line or sentence end that
    leaves at least ``least`` new tokens, else the cut is hard at the limit. Every piece after the first
    begins with the last ``overlap`` tokens (at most limit - 1) of the one before it.
    """
    begins, ends, points = token_offsets(text)
    n = len(begins)
    if n <= limit:
        return [(0, n, 0, True)]
    overlap = max(0, min(overlap, limit - 1))
    strong, weak = boundaries(begins, ends, points)
    out, start = [], 0
    while start + limit < n:
        most, fresh = start + limit, start + (overlap if out else 0)
        stop, natural = most, False
        for array, lowest in ((strong, max(start + limit // 2, fresh + 1)), (weak, fresh + max(1, min(least, limit - overlap)))):
            i = int(np.searchsorted(array, most, side="right")) - 1
            # the step back by the overlap must lead on
            if i >= 0 and array[i] >= lowest and array[i] - overlap > start:
                stop, natural = int(array[i]), True
                break
        out.append((start, stop - start, int(begins[start]), natural))
        start = stop - overlap
    out.append((start, n - start, int(begins[start]), True))
    return out


def split_oversized(items: DataFrame, key: str, text: str, limit: int, overlap: int, least: int = 1, with_text: bool = True) -> DataFrame:
    """Pieces of every item: ``key``, ``piece_no``, ``n_pieces``, ``first_token``, ``n_tokens``, ``is_natural``, ``piece``.

    A token is an unbroken run of letters, digits and underscores or any other single character that is
    no white space. No piece has more than ``limit`` tokens; an item within the limit is one piece, its
    text as stored. Null, empty and blank texts are one piece of 0 tokens. Pieces run from the first to
    the last of their tokens; the text between is as stored. Every row is split by itself, repeated
    rows too; other columns are not read. ``limit`` must be at least 1 and ``overlap`` below it.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 1, and overlap at least 0 and below the limit")
    kind = items.schema[key].dataType
    fields = [T.StructField(key, kind)] + [T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "first_token", "n_tokens")] + [T.StructField("is_natural", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("piece", T.StringType())] * with_text)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cols = [], [[], [], [], [], [], []]
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = cut(t or "", limit, overlap, least)
                ends = token_offsets(t)[1] if len(found) > 1 and with_text else None
                for no, (first, n, begin, natural) in enumerate(found):
                    row.append(i)
                    piece = t if ends is None else t[begin : ends[first + n - 1]]
                    for c, v in zip(cols, (no, len(found), first, n, natural, piece)):
                        c.append(v)
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[5], pa.string())] * with_text, names=schema.names)

    return items.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(pieces, schema)
