"""Byte-level BPE over a whole corpus, from the vocabulary file of a public tokenizer.

A text is split into pre-tokens by the tokenizer's pattern, and each pre-token's bytes are merged in
the order of the merge list. The distinct pre-tokens of an Arrow batch that the task has not met yet
are merged together, by one rank queue for all of them: a bucket per merge rank holds the positions of
a linked list of symbols where that pair stands, a bitmap of three levels says which buckets are
filled, find-first-set picks the next rank, and entries whose pair has since been merged away are
skipped. A position enters the queue at most twice per merge, so a very long pre-token costs no more
per byte than a short one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; every operator takes another folder as ``folder``.
FOLDER = os.environ.get("STEMFORGE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern of this family of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on ASCII text, for the faster matcher of the standard library; a letter never begins what another branch matches.
ASCII_PATTERN = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9]+| ?[0-9]+|\s+(?!\S)|\s+"
#: Pre-tokens a task remembers; when it is full the memory starts anew, results do not change.
MEMORY = 400_000
#: Longest pre-token, in bytes, that is remembered.
REMEMBERED_BYTES = 64
_NONE = -1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, by letter."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {chr(b): b for b in plain}
    hidden = [b for b in range(256) if b not in set(plain)]
    return shown | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankQueue:
    """Positions by merge rank; a bitmap of three levels of 64-bit words finds the lowest rank."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.words = [[0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), [0] * (ranks // 262144 + 1)]

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.words:
            level[rank >> 6] |= 1 << (rank & 63)
            rank >>= 6

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions in ascending order, each once."""
        low, middle, high = self.words
        top = next((i for i, w in enumerate(high) if w), None)
        if top is None:
            return None
        m = (top << 6) | ((high[top] & -high[top]).bit_length() - 1)
        n = (m << 6) | ((middle[m] & -middle[m]).bit_length() - 1)
        rank = (n << 6) | ((low[n] & -low[n]).bit_length() - 1)
        low[n] &= ~(1 << (rank & 63))
        if not low[n]:
            middle[m] &= ~(1 << (n & 63))
            if not middle[m]:
                high[top] &= ~(1 << (m & 63))
        held = self.buckets.pop(rank)
        return rank, np.unique(np.concatenate(held)) if len(held) > 1 else held[0]


class Merger:
    """The merge list of one vocabulary file, and the merging of many byte strings at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, letters = model["vocab"], byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of_key[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each byte string."""
        if not pieces:
            return []
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = len(raw)
        # symbols of all pieces as one linked list; -1 ends a piece, and one more slot takes writes beyond an end
        symbol = np.append(self.byte_id[raw], _NONE)
        after = np.arange(1, n + 2)
        after[ends[lengths > 0] - 1] = n
        after[n] = n
        before = np.arange(-1, n)
        before[(ends - lengths)[lengths > 0]] = n
        before = np.append(before, n)[: n + 1]
        queue = RankQueue(len(self.merged))

        def push(positions: np.ndarray) -> None:
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            keep = rank >= 0
            positions, rank = positions[keep], rank[keep]
            if len(rank) == 0:
                return
            if len(rank) > 1:
                order = np.argsort(rank, kind="stable")
                positions, rank = positions[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(rank)]
            firsts = rank[starts[:-1]].tolist()
            for r, a, b in zip(firsts, starts, starts[1:]):
                queue.push(r, positions[a:b])

        alive = np.ones(n + 1, bool)
        push(np.flatnonzero(after[:n] < n))
        while (entry := queue.pop()) is not None:
            rank, at = entry
            a, b = self.left[rank], self.right[rank]
            at = at[alive[at] & (symbol[at] == a) & (symbol[after[at]] == b)]  # stale entries are skipped
            if len(at) == 0:
                continue
            if a == b and len(at) > 1:
                at = _leftmost(at, after)
            gone = after[at]
            new_after = after[gone]
            symbol[at] = self.merged[rank]
            alive[gone] = False
            after[at] = new_after
            before[new_after] = at
            before[n] = n
            after[n] = n
            ahead = before[at]
            at = at[new_after < n]
            ahead = ahead[ahead < n]
            around = np.concatenate((at, ahead)) if len(ahead) else at
            if len(around):
                push(np.unique(around) if len(around) > 1 else around)
        alive = alive[:n]
        ids = symbol[:n][alive].tolist()
        counts = np.concatenate(([0], np.cumsum(alive)))
        stops = counts[ends].tolist()
        return [ids[s:e] for s, e in zip([0, *stops[:-1]], stops)]


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs of one symbol that overlap in runs, every second, from the left."""
    follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    return at[(np.arange(len(at)) - start) % 2 == 0]


class Encoder:
    """Texts to ids; remembers short pre-tokens of this task."""

    def __init__(self, path: str) -> None:
        self.merger = Merger(path)
        self.split_any = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.known: dict[str, list[int]] = {}

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.split_ascii(text) if text.isascii() else self.split_any(text)

    def __call__(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """For each text, the ids of its pre-tokens."""
        split = list(map(self.split, texts))
        known = self.known
        fresh = [p for p in set(chain.from_iterable(split)) if p not in known]
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            fresh = list(set(chain.from_iterable(split)))
        found = dict(zip(fresh, self.merger.encode([p.encode() for p in fresh])))
        known.update(found)
        get = known.__getitem__
        for pieces in split:
            yield list(map(get, pieces))
        for p in fresh:
            if len(p) > REMEMBERED_BYTES:
                del known[p]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(path)


def vocabulary_path(tokenizer: str, folder: str = FOLDER) -> str:
    return f"{folder}/{tokenizer}.json"


def shipped_vocabulary(tokenizer: str, folder: str = FOLDER) -> str:
    """The vocabulary file, which Spark also brings to every executor, so that only the driver needs the folder."""
    path, session = vocabulary_path(tokenizer, folder), SparkSession.getActiveSession()
    if session is not None and os.path.exists(path):
        session.sparkContext.addFile(path)
    return path


def _at_hand(path: str) -> str:
    """Within a task: the copy that Spark brought, else the file itself."""
    brought = SparkFiles.get(os.path.basename(path))
    return brought if os.path.exists(brought) else path


#: Characters of one block of texts that is split and merged together.
BLOCK_CHARS = 4_000_000


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_column(texts: list[str | None], path: str) -> pa.Array:
    enc, sizes, ids = encoder(path), [0], []
    for block in _blocks(texts):
        for pieces in enc(block):
            flat = list(chain.from_iterable(pieces))
            sizes.append(sizes[-1] + len(flat))
            ids.append(np.array(flat, np.int32))
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), pa.array(values))


def encode_corpus(documents: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row.

    Ids are those of ``tokenizer`` without special tokens, of the text exactly as stored; the strings
    of special tokens in a text are ordinary text. An empty text and a null text both give an empty
    list. Every row is kept, repeated rows and null keys too; other columns are not read. Work is one
    pass over the scan's partitions, without a shuffle.
    """
    path = shipped_vocabulary(tokenizer, folder)
    kind = documents.schema[key].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), encode_column(texts, _at_hand(path))], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text")).mapInArrow(encode, schema)


def token_lengths(text: Column, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> Column:
    """Number of tokens of each text as a column; null and empty texts have 0."""
    path = shipped_vocabulary(tokenizer, folder)

    @F.pandas_udf(T.IntegerType())
    def lengths(texts: pd.Series) -> pd.Series:
        enc, out = encoder(_at_hand(path)), []
        for block in _blocks(texts.where(texts.notna(), None).tolist()):
            out.extend(sum(map(len, pieces)) for pieces in enc(block))
        return pd.Series(out, dtype="int32")

    return lengths(text)
