"""Pairs of records whose word sets are similar, without comparing all pairs.

Equal word sets become one class. Two sets of Jaccard similarity t or more share a word among the
first few of each when all words are put in one order, so each class enters a tile for each of its
first words (for each two of its first words, where these are common). Tiles are banded by size: a
set stands in its own band, and as a visitor in the next one if it can match a set of it. Within a
tile only sets whose sizes differ by no more than the factor t are compared, by hashed bitmaps whose
bit counts bound the overlap from above, and only pairs that pass in some tile are intersected
exactly, by merging their sorted arrays.

The entries of a tile are counted where they meet. A tile of more than TILE entries is not compared but
refined: its sets meet again in tiles of one more shared word, and what is still too large is cut into
blocks, each pair of which is a tile of its own. So no task holds more than two blocks at a time.

Words and classes are compared by 64-bit hashes (of the word; of the sorted set).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.skew import salted
from stemforge.functions.text import word_set
from stemforge.session import written

#: A word is common if it is in one of COMMON_ONE_IN sets. With k words in a set on average, no more
#: than k * COMMON_ONE_IN words are common, whatever the data; that list goes to every task.
#: Words in fewer than LEAST_COMMON sets are rare in any case.
COMMON_ONE_IN, LEAST_COMMON = 1000, 200
#: Words of the mean set for each 64 bits of the bitmaps, and the most of these.
WORDS_PER_MAP, MOST_MAPS = 48, 8
#: Entries of the largest tile that is compared as it is, and of one block of a larger one.
TILE, BLOCK = 8000, 4000
#: Sets of this many words enter tiles of one word only, as those of several words would be too many.
LONG = 512
#: A band of sizes spans the factor threshold ** -BAND.
BAND = 4


def _sets(items: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, sorted word hashes ``h``, and the class; rows without key or word are left out.

    No class is null; that is said once more, so that every use shares one plan and its shuffle.
    """
    sets = items.select(F.col(f"`{key}`").alias("key"), word_set(text).alias("words")).where(F.col("key").isNotNull() & (F.size("words") > 0))
    return written(sets.select("key", F.xxhash64("words").alias("class"), F.array_sort(F.transform("words", lambda w: F.xxhash64(w))).alias("h")), "similar-sets").where("class is not null")


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, as far as a batch holds them more often than a word that is not common anywhere."""
    for batch in batches:
        words, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        keep = n >= max(2, batch.num_rows // (2 * COMMON_ONE_IN))
        yield pa.RecordBatch.from_arrays([pa.array(words[keep]), pa.array(n[keep].astype(np.int64))], names=["w", "n"])


class _Batch:
    """The words of a batch of sets in the order of all words (rare ones first), and what follows from their number."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, common: np.ndarray, counts: np.ndarray, threshold: float):
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        often = np.zeros(len(words), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, words), len(common) - 1)
            often = np.where(common[at] == words, counts[at], 0)
        order = np.lexsort((words, often, self.row))
        self.words, self.often, self.sizes = words[order], often[order] > 0, sizes
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # t * |y| words at least are shared with a smaller set, and 2t / (1 + t) * |x| with a larger one
        self.larger = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
        self.smaller = sizes - np.ceil(sizes * (2 * threshold / (1 + threshold)) - 1e-9).astype(np.int64) + 1
        # the fewest words that a set shares with any that it matches
        self.least = np.ceil((sizes + np.ceil(sizes * threshold - 1e-9)) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
        # sets that are long, and those that can match one
        self.long, self.longish = sizes >= LONG, sizes >= LONG * threshold - 1e-9
        edges = [1]
        while len(sizes) and edges[-1] <= sizes.max():
            edges.append(int(edges[-1] * threshold**-BAND) + 1)
        self.band = np.searchsorted(edges, sizes, side="right") - 1
        following = np.array([*edges, edges[-1] * 4])[self.band + 1]
        self.visits = sizes >= following * threshold - 1e-9


class _Entries:
    """Entries of tiles: the tile, the place of its last word, its words, and whether the set may be the smaller one there, or visits."""

    def __init__(self, tile: np.ndarray, at: np.ndarray, row: np.ndarray, n_words: np.ndarray, few: np.ndarray, visitor: np.ndarray):
        self.columns = (tile, at, row, n_words, few, visitor)
        self.tile, self.at, self.row, self.n_words, self.few, self.visitor = self.columns

    def take(self, where: np.ndarray) -> _Entries:
        return _Entries(*(c[where] for c in self.columns))

    @staticmethod
    def together(parts: list[_Entries]) -> _Entries:
        return _Entries(*(np.concatenate(c) for c in zip(*(p.columns for p in parts))))


def _mixed(tile: np.ndarray, with_: np.ndarray | int) -> np.ndarray:
    """A tile's number, changed by a word, a band or a block."""
    return (tile ^ (tile >> 29)) * np.int64(0x1E3779B97F4A7C15) ^ (with_ + np.int64(1)) * np.int64(0x2545F4914F6CDD1D)


def _first_tiles(b: _Batch) -> _Entries:
    """The tiles that each set enters at first.

    With one word more in each prefix, a pair shares two words at least, the first two in the order.
    If the first is rare, its own tile has the pair; else both are common, and the tile of the two
    common words has it. So no tile belongs to a common word alone, but for sets that may share one only.
    """
    row, place = b.row, b.place
    single = np.flatnonzero((place < b.larger[row]) & (~b.often | ((b.least <= 1) | b.longish)[row]))
    ones = np.ones(len(single), np.int64)
    parts = [(b.words[single], single, ones, (place < b.smaller[row])[single])]
    first, step = np.flatnonzero((place <= b.larger[row]) & b.often & ~b.long[row]), 0
    while len(first):
        step += 1
        first = first[first + step < len(row)]
        first = first[(row[first + step] == row[first]) & (place[first + step] <= b.larger[row[first]])]
        second = first + step
        parts.append(((b.words[first] * np.int64(0x5851F42D4C957F2D)) ^ b.words[second], second, np.full(len(first), 2), (place <= b.smaller[row])[second]))
    tile, at, n_words, few = (np.concatenate(c) for c in zip(*parts))
    home = _Entries(_mixed(tile, b.band[row[at]]), at, row[at], n_words, few, np.zeros(len(at), bool))
    guests = np.flatnonzero(few & b.visits[row[at]])
    away = _Entries(_mixed(tile[guests], b.band[row[at[guests]]] + 1), at[guests], row[at[guests]], n_words[guests], few[guests], np.ones(len(guests), bool))
    return _Entries.together([home, away])


def _refined(b: _Batch, e: _Entries) -> _Entries:
    """Entries of the same tiles by one more word; what may share no further word, or is long, stays together by itself."""
    kept = e.take((b.least[e.row] <= e.n_words) | b.longish[e.row])
    parts = [_Entries(_mixed(kept.tile, np.int64(-2)), *kept.columns[1:])]
    rest, step = e.take(~b.long[e.row]), 0
    while len(rest.tile):
        step += 1
        rest = rest.take(rest.at + step < len(b.row))
        following = rest.at + step
        # with each shared word more, a prefix is longer by one
        fit = (b.row[following] == rest.row) & (b.place[following] < b.larger[rest.row] + rest.n_words)
        rest, following = rest.take(fit), following[fit]
        few = b.place[following] < b.smaller[rest.row] + rest.n_words
        kept = few | ~rest.visitor
        parts.append(_Entries(_mixed(rest.tile, b.words[following]), following, rest.row, rest.n_words + 1, few, rest.visitor).take(kept))
    return _Entries.together(parts)


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _bitmaps(words: np.ndarray, sizes: np.ndarray, maps: int) -> list[np.ndarray]:
    """One bit of ``maps`` times 64 for each word of a set."""
    bits, which = np.left_shift(np.uint64(1), (words & 63).astype(np.uint64)), (words >> 6) % maps
    starts = np.cumsum(sizes) - sizes
    return [np.bitwise_or.reduceat(np.where(which == i, bits, np.uint64(0)), starts).view(np.int64) for i in range(maps)]


def _enter(common: np.ndarray, counts: np.ndarray, threshold: float, maps: int, crowded: list[tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tile entries of each class: its size with four flags in ``packed``, and its bitmaps.

    ``crowded`` holds the tiles (sorted) that were too large in each round so far, with their entries:
    those of the first round are refined, those of the second one cut into blocks.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words = batch.column(1).flatten().to_numpy()
            sizes = batch.column(1).value_lengths().to_numpy().astype(np.int64)
            b = _Batch(words, sizes, common, counts, threshold)
            e = _first_tiles(b)
            if crowded:
                e = _refined(b, e.take(_among(e.tile, crowded[0][0])[0]))
            n = np.ones(len(e.tile), np.int64)
            if len(crowded) > 1:
                hot, at = _among(e.tile, crowded[1][0])
                e, n = e.take(hot), -(-crowded[1][1][at[hot]] // BLOCK)
            classes = batch.column(0).to_numpy()
            own = (classes[e.row].view(np.uint64) % n.astype(np.uint64)).astype(np.int64)
            take = np.repeat(np.arange(len(e.tile)), n)
            other = np.arange(len(take)) - np.repeat(np.cumsum(n) - n, n)
            mine, e = own[take], e.take(take)
            tile = e.tile if len(crowded) < 2 else _mixed(_mixed(e.tile, np.minimum(mine, other)), np.maximum(mine, other))
            # in the tile of two blocks, the flags say which of them
            packed = sizes[e.row] << 4 | e.visitor << 3 | e.few << 2 | (mine > other) << 1 | (mine != other)
            bits = _bitmaps(words, sizes, maps)
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(packed.astype(np.int32)), pa.array(classes[e.row]), *(pa.array(m[e.row]) for m in bits)], names=["tile", "packed", "class", *(f"m{i}" for i in range(maps))])

    return enter


def _compare(threshold: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (``a``, ``b``) within each tile that the bitmaps let pass; entries come sorted by tile, size and class.

    The smaller set of a pair (of equal ones the smaller class) has a shared word among its fewer first
    words, so only such entries are held against what follows them in the tile. A tile of more than
    ``most`` entries is only counted: ``a`` is then the tile, and ``n`` its entries (0 for a pair).
    """
    share = threshold / (1 + threshold)

    def pairs(tile: np.ndarray, packed: np.ndarray, classes: np.ndarray, *bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size, visitor, few, second, crossed = packed.astype(np.int64) >> 4, (packed & 8) > 0, (packed & 4) > 0, (packed & 2) > 0, (packed & 1) > 0
        bits = [m.view(np.uint64) for m in bits]
        at, step = np.flatnonzero(few), 0
        while True:
            step += 1
            at = at[at + step < len(tile)]
            b = at + step
            # sorted by size: beyond the reach of a set, nothing in its tile can match it
            at = at[(tile[at] == tile[b]) & (size[at] >= size[b] * threshold - 1e-9)]
            if len(at) == 0:
                return
            b = at + step
            fit = (~crossed[at] | (second[at] != second[b])) & ~visitor[b] & (classes[at] != classes[b])
            a, b = at[fit], b[fit]
            need = np.ceil((size[a] + size[b]) * share - 1e-9)
            lost_a, lost_b = (sum(np.bitwise_count(m[x] & ~m[y]).astype(np.int64) for m in bits) for x, y in ((a, b), (b, a)))
            close = np.minimum(size[a] - lost_a, size[b] - lost_b) >= need
            if close.any():
                x, y = classes[a[close]], classes[b[close]]
                yield np.minimum(x, y), np.maximum(x, y)

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (a, b, n)], names=["a", "b", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            begins = np.concatenate(([0], np.flatnonzero(np.diff(columns[0])) + 1))
            n = np.diff(np.concatenate((begins, [len(columns[0])])))
            if (n > most).any():
                yield rows(columns[0][begins[n > most]], np.zeros((n > most).sum()), n[n > most])
                fits = np.repeat(n <= most, n)
                columns = [c[fits] for c in columns]
            found = list(pairs(*columns))
            if found:
                both = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (0, 1)]), axis=1)
                yield rows(both[0], both[1], np.zeros(both.shape[1]))

        held: list[np.ndarray] | None = None
        large, n_large = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            if large is not None:
                # what goes on from a tile that is too large already is only counted
                rest = int(np.searchsorted(columns[0], large, side="right"))
                n_large += rest
                columns = [c[rest:] for c in columns]
                if len(columns[0]) == 0:
                    continue
                yield rows(np.array([large]), np.zeros(1), np.array([n_large]))
                large = None
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            begin = int(np.searchsorted(columns[0], columns[0][-1]))  # the last tile may go on in the next batch
            held = [c[begin:] for c in columns]
            if begin:
                yield from done([c[:begin] for c in columns])
            if len(held[0]) > most:
                large, n_large, held = int(held[0][0]), len(held[0]), None
        if large is not None:
            yield rows(np.array([large]), np.zeros(1), np.array([n_large]))
        if held is not None:
            yield from done(held)

    return compare


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the number of words in both sets: their sorted arrays are merged, those of all pairs of a batch in step."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        one, two = (np.append(c.flatten().to_numpy(), np.int64(0)) for c in (x, y))
        n_one, n_two = (c.value_lengths().to_numpy().astype(np.int64) for c in (x, y))
        i, j = np.cumsum(n_one) - n_one, np.cumsum(n_two) - n_two
        end_one, end_two = i + n_one, j + n_two
        shared, live = np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows)
        while len(live):
            live = live[(i[live] < end_one[live]) & (j[live] < end_two[live])]
            p, q = one[i[live]], two[j[live]]
            shared[live] += p == q
            i[live] += p <= q
            j[live] += p >= q
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(n_one + n_two - shared)], names=["a", "b", "shared", "either"])


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes (``a`` < ``b``) with their ``similarity``; ``sets`` has ``class`` and sorted word hashes ``h``."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    # only the common words come to the driver, a number that does not grow with the rows
    frequent = sets.select("h").mapInArrow(_frequent, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    n, words = sets.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("h")), F.lit(1.0))).first()
    least, maps = max(LEAST_COMMON, -(-n // COMMON_ONE_IN)), min(MOST_MAPS, math.ceil(words / WORDS_PER_MAP))
    listed = frequent.where(F.col("n") >= least).select("w", "n").toArrow().sort_by("w")
    common, counts = listed["w"].to_numpy(), listed["n"].to_numpy()
    classes = sets.select("class", "h").groupBy("class").agg(F.first("h").alias("h"))
    crowded: list[tuple[np.ndarray, np.ndarray]] = []
    close = None
    for most in (TILE, TILE, 2**62):
        entries = classes.select("class", "h").mapInArrow(_enter(common, counts, threshold, maps, crowded), "tile long, packed int, class long" + "".join(f", m{i} long" for i in range(maps)))
        tiles = entries.repartition("tile").sortWithinPartitions("tile", F.shiftright("packed", 4), "class")
        met = written(tiles.mapInArrow(_compare(threshold, most), "a long, b long, n long"), "close-pairs")
        some = met.where("n = 0").select("a", "b")
        close = some if close is None else close.unionByName(some)
        # a list of tiles of more than TILE entries each, so shorter than the entries by four digits
        over = met.where("n > 0").select("a", "n").toArrow().sort_by("a")
        if over.num_rows == 0:
            break
        crowded.append((over["a"].to_numpy(), over["n"].to_numpy()))
    one, two = classes.select(F.col("class").alias("a"), F.col("h").alias("x")), classes.select(F.col("class").alias("b"), F.col("h").alias("y"))
    both = close.distinct().join(one, "a").join(two, "b").select("a", "b", "x", "y")
    exact = both.mapInArrow(_shared, "a long, b long, shared long, either long").withColumn("similarity", F.col("shared") / F.col("either"))
    return exact.where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def similar_pairs(items: DataFrame, key: str, text: Column, threshold: float) -> DataFrame:
    """``id_a`` < ``id_b`` and ``similarity`` of all pairs of different keys at or above the threshold.

    ``text`` holds the words (unbroken runs of letters or digits, lower-cased); similarity is the number
    of words in both sets divided by that in either. Keys with equal sets are pairs of similarity 1.
    A pair counts by itself, chains are not closed. Null texts, keys and texts without a word are in no
    pair; repeated rows count once; a key with several texts has the best similarity of them.
    """
    sets = _sets(items, key, text)
    pairs, of = similar_classes(sets, threshold), sets.select("class", "key").distinct()
    one, two = of.select(F.col("class").alias("a"), F.col("key").alias("x")), of.select(F.col("class").alias("b"), F.col("key").alias("y"))
    apart = pairs.join(one, "a").join(two, "b").select("x", "y", "similarity")
    # the copies of one text meet each other; of a text with many, in as many tasks as its class has parts
    left, right = salted(of.select("class", F.col("key").alias("x")), of.select("class", F.col("key").alias("y")), ["class"], ["x"])
    equal = left.join(right, ["class", "_salt"]).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    both = apart.unionByName(equal).where("x <> y")
    return both.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def membership(items: DataFrame, key: str, text: Column, threshold: float) -> DataFrame:
    """One row per key: ``class_id`` (the smallest key with the same words), ``n_copies`` and ``n_links`` to other classes.

    This form does not grow with the square of a group of copies. Keys without words have no class; a
    key with several texts has a row for each class.
    """
    sets = _sets(items, key, text)
    pairs, of = similar_classes(sets, threshold), sets.select("class", "key").distinct()
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    heads = of.groupBy("class").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_copies")).join(links, "class", "left")
    return of.join(heads, "class").select(F.col("key").alias("id"), "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
