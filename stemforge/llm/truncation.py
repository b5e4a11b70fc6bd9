"""Texts that were cut off, and how often each source cuts them.

The values of the self-join by prefix are the sentences and lines of all texts: sorted, a value that is
a strict prefix of a longer one stands right before it. The unfinished last value of a text that begins
a longer one elsewhere, and stands nowhere as a whole, was cut; where it breaks off within a word, or
is long enough to be no title, this decides by itself. What has no longer copy is judged by its end (see
:mod:`stemforge.llm.endings`): a mark in place of the lost end, something opened and never closed, or
last words that do not end a sentence elsewhere; a length at which the texts of a source pile up makes
a cut likely.

The texts are read three times: for the end and the measures of each text (a narrow table, which all else
is joined to), for the counts that the ends ask for, and for the values of the self-join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemforge.llm import endings
from stemforge.session import written

#: Lengths of the prefixes whose keys bring values together, and bits of their filter for each; a value of fewer characters than the first says nothing.
HEADS, HEAD_BITS = (4, 6, 8, 12, 16, 20, 28, 40), 64
#: Words of an unfinished value that a longer one proves cut if it breaks off within a word, or makes likely to be if between words.
WITHIN_WORDS, BETWEEN_WORDS = 2, 3
#: Texts that end with the same value: then it is an ending, as of a chat.
COMMON_LAST = endings.COMMON_LAST_LINE
#: Limits up to this number are broadcast, beyond it they are shuffled.
BROADCAST_ROWS = 100_000
#: Lengths up to this one are those of titles and words, no limits.
LEAST_LIMIT = 24
#: Lengths below the largest of a source that count as its limit: cuts at a blank, or before a mark.
NEAR_LIMIT = 12
#: Different ends of texts at a length that make it a limit, and how many times more they are than its neighbours give.
LIMIT_ROWS, LIMIT_EXCESS = 5, 3.0
#: Lengths on either side, beyond those near, that say how many texts a length has by chance; natural logarithm of how rare such a count must be.
NEIGHBOURS, RARE = 100, 14.0
#: Sizes of blocks in bytes that texts may be lost by, and how rare the count of whole blocks must be (few sizes are tried, so less).
BLOCKS, RARE_BLOCKS = (256, 512, 1024, 2048, 4096), 10.0
#: Share of cut texts among those without the end of a sentence: in general, before a longer value, and at a limit. They tell the kinds of
#: texts apart; how low a chance must be for a cut is taken from the counts of all texts where enough of them are at limits.
PRIOR, LONGER, LIKELY = 0.3, 0.9, 0.995
#: Texts at limits that it takes to know how chances of cut texts lie; first and last step of the chances, in half powers of two of the usual one.
LEAST_CUTS, STEPS = 200, range(-12, 8)
#: Verdicts of texts that are whole, whatever a longer value says.
WHOLE = ("nothing", "sentence", "picture", "json", "fence closed", "aside", "closed")
#: Where a sentence or line is over. Plain strings, which cost far less than a pattern over whole texts.
_OVER = (". ", "! ", "? ", "。", "！", "？", "\r")
#: A mark at the end of a text, and what is no part of a value at its begin and end.
_MARK, _MARK_ENDS = re.compile(r"\s*(?:[\[(<{]\s*(?:\.{3,}|…)\s*[\])>}]|…+|\.{3,}|\ufffd+)\s*$", re.ASCII), "…\ufffd.])>}"
_BEFORE, _BEHIND = " \t\u00a0\u3000-*+•‣>#|\"'“”„«(", " \t\r\n\f\v\u00a0\u3000.,;:!?…\"'“”„’«»()[]{}<>「」『』（）【】、。，；：！？｡*_`~|/\\&+=#-–—•\ufffd"
_BLANKS = " \t\n\r\f\v\u00a0\u3000"
_WIDE = r"[぀-ヿ㐀-鿿豈-﫿]"


def _pieces(text: str) -> list[str]:
    """Sentences and lines of a text in order; some may be empty."""
    for over in _OVER:
        text = text.replace(over, "\n")
    return text.split("\n")


def _value(piece: str) -> str:
    """A sentence or line without a list mark before it, and without what stands at its end."""
    bare = piece.lstrip(_BEFORE)
    if bare[1:3] == ") ":
        bare = bare[3:]
    elif bare[2:4] == ") ":
        bare = bare[4:]
    return bare.rstrip(_BEHIND)


def _last_value(text: str) -> str:
    bare = text.rstrip(_BLANKS)
    line = bare[bare.rfind("\n") + 1 :]
    if line[-1:] in _MARK_ENDS:
        line = _MARK.sub("", line).rstrip(_BLANKS)
    return _value(_pieces(line)[-1])


def _last_values(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None else _last_value(t) for t in texts.to_pylist()], pa.string())


def last_value(text: Column) -> Column:
    """The last value of a text, without a mark in place of the lost end; empty where its last line holds none."""
    return F.arrow_udf(_last_values, T.StringType())(text)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows of a few numbers each; else left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _next_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted distinct values, the unfinished ones that begin the next one, with the character behind them.

    The first and the last value of the partition come out as well.
    """
    part, first, last = TaskContext.get().partitionId(), None, None
    names = ["part", "value", "behind", "first"]
    for batch in batches:
        found: list[tuple[str, str]] = []
        for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last is None:
                first = text
            elif last[1] and text.startswith(last[0]):
                found.append((last[0], text[len(last[0])]))
            last = text, asked
        rows = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), *rows, pa.nulls(len(found), pa.string())], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last[0] if last[1] else ""], pa.string()), pa.nulls(1, pa.string()), pa.array([first], pa.string())], names=names)


def strict_prefixes(values: DataFrame) -> DataFrame:
    """Unfinished values that begin a longer one (``value``), and the character that follows there (``behind``).

    ``values`` has ``value`` (distinct) and ``asked`` (whether it is unfinished). They are range-partitioned
    and sorted by their bytes, so a value stands right before those it begins, and a common beginning is
    spread over many tasks. Only the first and last value of each partition are compared across partitions.
    """
    ordered = values.select("value", "asked").repartitionByRange("value").sortWithinPartitions("value")
    scanned = ordered.mapInArrow(_next_values, "part int, value string, behind string, first string")
    # two values of each partition; the next partition that holds any begins with the value after the last
    edges = scanned.where("first is not null").selectExpr("value", "lead(first) OVER (ORDER BY part) AS after")
    across = edges.where(F.startswith(F.col("after"), F.col("value")) & (F.col("value") != "")).select("value", F.substr("after", F.length("value") + 1, F.lit(1)).alias("behind"))
    return scanned.where("first is null").select("value", "behind").unionByName(across)


def _heads(values: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of HEADS, the numbers of the values that have it, and the keys of their prefixes."""
    cut = [v[: HEADS[-1]] for v in values]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    first = np.cumsum(sizes) - sizes
    runs = endings.Runs("".join(cut))
    for n in HEADS:
        has = np.flatnonzero(sizes >= n)
        yield has, runs.keys(first[has], first[has] + n)


def _longest_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each value (first column) the key of the longest prefix that it has."""
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.uint64)
        for has, own in _heads(batch.column(0).to_pylist()):
            keys[has] = own
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64))], names=[*batch.schema.names, "key"])


def _met_values(texts: DataFrame, text: Column, asked: Broadcast) -> DataFrame:
    """``value`` and ``places`` of the sentences and lines of all texts that share a prefix with a key of the filter ``asked``.

    The filter decides nothing: a value between two sorted ones of which one begins the other begins with it as well.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in endings.slices(batches):
            counts = Counter(map(_value, _pieces("\n".join(some))))
            values = [v for v in counts if len(v) >= HEADS[0]]
            met = np.zeros(len(values), bool)
            for has, keys in _heads(values):
                met[has] |= endings.passes(keys, asked.value)
            values = [values[i] for i in np.flatnonzero(met).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([counts[v] for v in values], pa.int64())], names=["value", "places"])

    return texts.select(text.alias("t")).where(F.length("t") > 0).mapInArrow(read, "value string, places long")


def broken_values(documents: DataFrame, text: str, tails: DataFrame) -> DataFrame:
    """Of ``tails`` (``tail``: last values of unfinished texts), those that a longer value proves cut, or makes likely to be.

    One row per distinct value (hash ``tail``): ``proof`` (it breaks off within a word) and ``longer`` (it is no title).
    Values that stand somewhere as a whole, or end several texts, are left out, as are those of fewer
    characters than the shortest head. Only values that begin like the longest head of some tail are sorted.
    """
    counted = tails.groupBy(F.col("tail").alias("value")).agg(F.count(F.lit(1)).alias("n")).where(F.length("value") >= HEADS[0])
    counted = written(counted.mapInArrow(_longest_heads, "value string, n long, key long"), "tails")
    met = _met_values(documents, F.col(text), endings.key_filter(counted.select("key"), counted.count(), HEAD_BITS))
    both = met.select("value", "places", F.lit(0).alias("n")).unionByName(counted.select("value", F.lit(0).alias("places"), "n"))
    sums = both.groupBy("value").agg(F.sum("places").alias("places"), F.sum("n").alias("n"))
    asked = (F.col("n") > 0) & (F.col("n") < COMMON_LAST) & (F.col("places") <= F.col("n"))
    found = strict_prefixes(written(sums.select("value", asked.alias("asked")), "values"))
    letter = F.col("behind").rlike(r"\p{L}") & ~F.concat(F.right("value", F.lit(1)), "behind").rlike(_WIDE)
    words = F.size(F.split("value", r"\s+")) + F.regexp_count("value", F.lit(_WIDE)) / endings.WIDE_WORD
    found = found.select(F.xxhash64("value").alias("tail"), letter.alias("within"), words.alias("words"))
    return found.select("tail", (F.col("within") & (F.col("words") >= WITHIN_WORDS)).alias("proof"), (F.col("words") >= BETWEEN_WORDS).alias("longer"))


def _rarity(n: Column, usual: Column) -> Column:
    """Minus the logarithm of how likely ``n`` or more are where ``usual`` are expected (bound of Chernoff)."""
    return F.when(n > usual, n * F.log(n / usual) - n + usual).otherwise(0.0)


def field_limits(measures: DataFrame) -> DataFrame:
    """Lengths (``unit`` chars or bytes, ``size``) at which the texts of a ``source`` pile up.

    ``measures`` has ``source``, ``chars``, ``bytes`` and ``end`` (hash of the end) of every text.

    A length is a limit if it has far more texts than its neighbours, however small their share of the
    source is; texts that end alike count once, so copies and forms are no pile. Lengths just below the
    largest are tested together, and so are the whole multiples of a block in bytes, without those that
    are limits by themselves.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("c").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("b").alias("size")))).alias("u")
    ends = measures.where("chars > 0").select(F.coalesce("source", F.lit("")).alias("source"), F.col("chars").alias("c"), F.col("bytes").alias("b"), "end").distinct()
    counts = ends.select("source", units).groupBy("source", "u.unit", "u.size").agg(F.count(F.lit(1)).alias("n"))
    # a row per length, so a partition is bounded by the longest text of a source
    each = Window.partitionBy("source", "unit")
    between = lambda a, b: F.coalesce(F.sum("n").over(each.orderBy("size").rangeBetween(a, b)), F.lit(0))
    far = NEAR_LIMIT + NEIGHBOURS
    usual = (F.greatest(between(-far, -NEAR_LIMIT - 1), between(NEAR_LIMIT + 1, far)) + 1) / NEIGHBOURS
    near = (between(-NEAR_LIMIT, NEAR_LIMIT) - F.col("n")) / (2 * NEAR_LIMIT)
    known = counts.select("*", usual.alias("usual"), near.alias("near"), F.max("size").over(each).alias("top"))
    sharp = (F.col("n") >= LIMIT_ROWS) & (F.col("size") > LEAST_LIMIT) & (F.col("n") >= LIMIT_EXCESS * F.greatest("usual", "near")) & (_rarity(F.col("n"), F.col("usual")) >= RARE)
    known = known.select("*", sharp.alias("sharp"))
    # lengths just below the largest one, but for those that are limits by themselves
    below = F.col("top") - F.col("size")
    total = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0)).over(each)
    known = known.select("*", total((below < NEAR_LIMIT) & ~F.col("sharp")).alias("at_top"), (NEAR_LIMIT * F.greatest((total((below >= NEAR_LIMIT) & (below < far)) + 1) / NEIGHBOURS, total((below >= NEAR_LIMIT) & (below < 2 * NEAR_LIMIT)) / NEAR_LIMIT)).alias("usual_top"))
    capped = (below < NEAR_LIMIT) & (F.col("source") != "") & (F.col("size") > LEAST_LIMIT) & (F.col("at_top") >= LIMIT_ROWS) & (F.col("at_top") >= LIMIT_EXCESS * F.col("usual_top")) & (_rarity(F.col("at_top"), F.col("usual_top")) >= RARE)
    # the block whose multiples are least likely by chance; sizes within NEAR_LIMIT of a multiple are no measure of it
    rests = []
    for block in BLOCKS:
        rest = F.pmod(F.col("size"), F.lit(block))
        held = (F.col("unit") == "bytes") & (F.col("size") >= block) & ~F.col("sharp")
        n, other = total(held & (rest == 0)), (total(held & (rest > NEAR_LIMIT) & (rest < block - NEAR_LIMIT)) + 1) / (block - 2 * NEAR_LIMIT - 1)
        rests.append(F.struct(F.when((n >= LIMIT_ROWS) & (n >= LIMIT_EXCESS * other), _rarity(n, other)).otherwise(0.0).alias("rarity"), F.lit(block).alias("block")))
    known = known.select("*", F.array_max(F.array(*rests)).alias("blocks"))
    blocked = (F.col("unit") == "bytes") & (F.col("blocks.rarity") >= RARE_BLOCKS) & (F.pmod(F.col("size"), F.col("blocks.block")) == 0)
    return known.where(F.col("sharp") | capped | blocked).select("source", "unit", "size")


def thresholds(counts: dict[float, dict[int, int]], cut: float) -> dict[float, float]:
    """For each kind of text, under which multiple of the usual chance it is cut with the fewest errors.

    ``counts`` has the texts of each kind by steps of the chance. Those of the kind ``cut`` (at a limit) are
    cut: they say how chances of cut texts lie. Of another kind, as many are cut as its share of low chances
    allows; its threshold is where the cut texts below outnumber the whole ones most. No kind is given
    one where LEAST_CUTS of ``cut`` are not there.
    """
    size = sum(counts.get(cut, {}).values())
    if size < LEAST_CUTS:
        return {}
    found = {}
    for kind, own in counts.items():
        if kind == cut:
            continue
        held = [(own.get(step, 0), counts[cut].get(step, 0) / size) for step in STEPS]
        below = [(sum(n for n, _ in held[: i + 1]), sum(share for _, share in held[: i + 1])) for i in range(len(held))]
        cuts = min(n / share for n, share in below if share >= 0.5)
        won, most, end = 0.0, 0.0, 0
        for i, (n, share) in enumerate(held):
            won += 2 * cuts * share - n
            if won > most:
                most, end = won, i + 1
        found[kind] = float("inf") if end == len(held) else 2.0 ** (STEPS[end] / 2)
    return found


_VERDICTS = "tail string, is_whole boolean, verdicts array<struct<cut: boolean, why: string, limit: double, of_usual: boolean>>"
_VERDICTS_ARROW = (pa.string(), pa.bool_(), pa.list_(pa.struct([("cut", pa.bool_()), ("why", pa.string()), ("limit", pa.float64()), ("of_usual", pa.bool_())])))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last value of each text that is not whole, its verdicts under each prior, and what its end asks of the counts, as a narrow table."""
    names = ["tail", "is_whole", "verdicts", "question", "keys", "line", "word"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for text in batch.column(batch.num_columns - 1).to_pylist():
            seen = endings.Reading(text) if text else None
            verdicts = [seen.verdict(p) if seen else endings.Verdict(False, "nothing") for p in (PRIOR, LONGER, LIKELY)]
            asked = seen.question if any(v.cut is None for v in verdicts) else None
            whole = verdicts[0].why in WHOLE
            for column, value in zip(out, (None if whole else _last_value(text), whole, [vars(v) for v in verdicts], *endings.asked_fields(asked))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out, (*_VERDICTS_ARROW, *endings.ASKED_ARROW))], names=[*batch.schema.names[:-1], *names])


def find_truncated(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key``, ``source``, ``is_cut`` and ``evidence`` of every row of ``documents``.

    Null, empty and blank texts are no case. A text that ends as a sentence, or whose brackets and
    fences are closed at its end, is whole, wherever it ends. ``evidence`` is ``prefix`` where a longer
    value elsewhere proves or supports the cut, else what the end shows. Repeated rows are judged alike; a null
    source is a source of its own without limits of the kind "largest length". Other columns are not read.
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"))
    measured = rows.select("key", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64(F.right("text", F.lit(32))).alias("end"), "text")
    schema = T.StructType([*measured.schema.fields[:-1], *T._parse_datatype_string(f"{_VERDICTS}, {endings.ASKED}").fields])
    narrow = written(measured.mapInArrow(_read, schema), "ends")
    chances, usual = endings.chances(narrow, rows, F.col("text"))
    limits = written(field_limits(narrow), "field-limits")
    at = {u: limits.where(F.col("unit") == u).select(F.col("source").alias("_s"), F.col("size").alias(u), F.lit(True).alias(f"at_{u}")) for u in ("chars", "bytes")}
    broken = broken_values(rows, "text", narrow.where("not is_whole").select("tail"))
    # a text that asks nothing gets a number by which the shuffle spreads it; it uses no answer
    known = narrow.drop("keys", "line", "word").withColumns({"question": F.coalesce("question", F.xxhash64("key", "end", "chars")), "_s": F.coalesce("source", F.lit("")), "tail": F.when(~F.col("is_whole"), F.xxhash64("tail"))})
    known = known.join(if_small(at["chars"]), ["_s", "chars"], "left").join(if_small(at["bytes"]), ["_s", "bytes"], "left")
    # narrow rows of both sides meet by a shuffle, whatever their number; those without a tail or question by none
    known = known.join(broken.hint("shuffle_hash"), "tail", "left").join(chances.hint("shuffle_hash"), "question", "left")
    proof, likely = F.coalesce("proof", F.lit(False)), F.coalesce("at_chars", "at_bytes", F.lit(False))
    longer = F.coalesce("longer", F.lit(False))
    verdict = F.get("verdicts", F.when(likely, 2).when(longer, 1).otherwise(0))
    known = written(known.select("key", "source", proof.alias("proof"), longer.alias("longer"), "chance", verdict.alias("verdict")), "verdicts")
    proof, longer, verdict = F.col("proof"), F.col("longer"), F.col("verdict")
    # texts without other evidence than the chance; their limit tells their kind, and all of them are counted
    by_chance = verdict["cut"].isNull() & verdict["why"].isNull() & F.coalesce(verdict["of_usual"], F.lit(False))
    step = F.greatest(F.lit(STEPS[0]), F.least(F.lit(STEPS[-1]), F.floor(2 * F.log2(F.col("chance") / usual))))
    counts: dict[float, dict[int, int]] = {}
    for kind, at_step, n in known.where(by_chance).groupBy(verdict["limit"].alias("kind"), step.alias("step")).count().collect():
        counts.setdefault(kind, {})[at_step] = n
    limit = verdict["limit"]
    for kind, least in thresholds(counts, LIKELY / (1 - LIKELY)).items():
        limit = F.when(by_chance & (verdict["limit"] == kind), least).otherwise(limit)
    under = F.col("chance") < limit * F.when(verdict["of_usual"], usual).otherwise(1.0)
    cut = proof | F.coalesce(verdict["cut"], under)
    why = F.coalesce(verdict["why"], F.format_string("%.3f", "chance"))
    return known.select(F.col("key").alias(key), F.col("source").alias(source), cut.alias("is_cut"), F.when(cut, F.when(proof | longer, "prefix").otherwise(why)).alias("evidence"))


def truncation_report(judged: DataFrame, source: str) -> DataFrame:
    """Per source: texts, cut texts, and their share."""
    counts = judged.groupBy(source).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("is_cut").alias("n_cut"))
    return counts.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
