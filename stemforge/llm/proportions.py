"""Samples whose share of each category matches given targets.

Categories are counted, integer quotas are allocated by largest remainder between a floor and what is
available, the rows with the smallest random keys of each category are drawn, and every category that
cannot be met is reported.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.skew import salted
from stemforge.functions.text import strip
from stemforge.session import written

#: How many more keys than a quota asks for a threshold lets pass on average, as a factor and as keys beside it.
SLACK, SPARE = 1.5, 30
_KEYS, _SAMPLE = ["group", "dimension", "category"], ["sample", "blueprint"]


def normal(category: Column) -> Column:
    return F.lower(strip(category.cast("string")))


def allocate(weights: Sequence[float], available: Sequence[int], total: int, floor: int) -> list[int]:
    """Integer quotas that sum to ``total`` as far as the bounds allow.

    Each quota lies between min(floor, available) and available. Ideals outside the bounds are set to
    the bound and the rest is shared again; what then is left of whole units goes by largest
    remainder, ties to the larger weight, then to the earlier category. Floors hold even where their
    sum exceeds ``total``.
    """
    w = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0.0)
    top = np.maximum(np.asarray(available, np.int64), 0)
    low = np.minimum(max(floor, 0), top)
    fixed, quota = np.zeros(len(w), bool), np.zeros(len(w), float)
    while not fixed.all():
        free = ~fixed
        rest, weight = total - quota[fixed].sum(), w[free].sum()
        ideal = np.where(free, w * (max(rest, 0) / weight if weight > 0 else 0.0), quota)
        under, over = free & (ideal < low - 1e-9), free & (ideal > top + 1e-9)
        if not under.any() and not over.any():
            quota = ideal
            break
        # the side with the larger misfit is settled first, as in bounded apportionment
        first = under if (low - ideal)[under].sum() >= (ideal - top)[over].sum() else over
        quota[first] = np.where(first, np.clip(ideal, low, top), 0)[first]
        fixed |= first
    whole = np.floor(quota + 1e-9).astype(np.int64)
    whole = np.clip(whole, low, top)
    order = sorted(range(len(w)), key=lambda i: (-round(quota[i] - whole[i], 9), -w[i], i))
    left = total - int(whole.sum())
    while left > 0:
        given = 0
        for i in order:
            if left > given and whole[i] < top[i] and (w[i] > 0 or w.sum() == 0):
                whole[i] += 1
                given += 1
        if not given:
            break
        left -= given
    return whole.tolist()


def count_categories(items: DataFrame, group: str, key: str, dimensions: dict[str, str]) -> DataFrame:
    """Distinct ``key`` per (group, dimension, category) as ``available``.

    ``dimensions`` maps names to columns. Categories are trimmed and lower-cased; a null group, key or
    category is not counted. Counts are of distinct keys: first of (category, key), then of keys, so that
    a hot category is spread over all tasks, and a count for each of their categories is all they send on.
    """
    return members(items, group, key, dimensions).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("available"))


def members(items: DataFrame, group: str, key: str, dimensions: dict[str, str]) -> DataFrame:
    """Distinct (group, dimension, category, key) of ``items``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), normal(F.col(f"`{c}`")).alias("category")) for d, c in dimensions.items()])).alias("_p")
    return items.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), pairs).select("group", "_p.dimension", "_p.category", "key").dropna().distinct()


def quotas(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``needed``, ``available``, ``quota`` and ``shortfall`` to each target category.

    ``targets`` has ``sample``, ``blueprint`` (a sample may have several), ``group``, ``dimension``, ``category``, ``weight``, ``total`` and
    ``floor``; weights are counts, fractions or percentages, only their ratio matters. ``needed`` is
    the larger of the floor and weight * total / sum of weights, rounded to the whole number it is up
    to noise; where all weights are 0 it is the floor. Each dimension is allocated by itself. The
    categories of one allocation meet in one row, as many as its target names.
    """
    have = targets.join(counts, _KEYS, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    one = F.struct("category", "weight", "available")
    grouped = have.groupBy("sample", "blueprint", "group", "dimension", "total", "floor").agg(F.array_sort(F.collect_list(one)).alias("c"))

    @F.pandas_udf("array<int>")
    def shared(weights: pd.Series, available: pd.Series, total: pd.Series, floor: pd.Series) -> pd.Series:
        return pd.Series([allocate(w, a, int(round(t)), f) for w, a, t, f in zip(weights, available, total, floor)])

    # the least whole number of items that keeps a fractional floor or share; noise of the division is no part of it
    whole = lambda c: F.ceil(F.round(c, 6)).cast("int")
    grouped = grouped.withColumn("floor", whole(F.col("floor")))
    grouped = grouped.withColumns({"quota": shared("c.weight", "c.available", "total", "floor"), "sum": F.aggregate("c.weight", F.lit(0.0), lambda s, x: s + x)})
    flat = grouped.select("sample", "blueprint", "group", "dimension", "total", "floor", "sum", F.explode(F.arrays_zip("c", "quota")).alias("z"))
    ideal = F.when(F.col("sum") > 0, F.round(F.col("z.c.weight") * F.col("total") / F.col("sum")).cast("int")).otherwise(F.lit(0))
    needed = F.greatest(F.col("floor"), ideal).alias("needed")
    out = flat.select("sample", "blueprint", "group", "dimension", "z.c.category", "total", needed, F.col("z.c.available").cast("int").alias("available"), "z.quota")
    return out.withColumn("shortfall", F.greatest(F.col("needed") - F.col("available"), F.lit(0)))


def _random(seed: int) -> Column:
    """A number from 0 to 1 that follows from the seed and the key alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(16**13)


def draw(allocated: DataFrame, population: DataFrame, seed: int = 1) -> DataFrame:
    """The drawn keys: ``sample``, ``blueprint``, ``dimension``, ``category``, ``key``, ``draw_rank``.

    ``population`` is the result of :func:`members`. The random number is a hash of seed and key, so a run
    draws the same rows again; ties of it are broken by the key. Of a category only the keys under a
    threshold are ranked, which the available number makes to let pass a little more than the largest
    quota; where fewer pass than the quota needs, all keys of that category are ranked. So a task ranks
    about as many keys as are drawn, however many a category has.
    """
    most = allocated.groupBy(*_KEYS).agg(F.max("quota").alias("most"), F.max("available").alias("available")).where("most > 0")
    below = F.least(F.lit(1.0), (F.col("most") * SLACK + SPARE) / F.col("available"))
    # the keys of a hot category are held against its threshold in many tasks
    left, right = salted(written(population, "members"), most.withColumn("below", below), _KEYS, ["key"])
    keyed = written(left.join(right, [*_KEYS, "_salt"]).drop("_salt").withColumn("random", _random(seed)), "drawn-from")
    near = keyed.where("random <= below")
    # every key under the threshold is counted before any is ranked; short categories take all of theirs
    short = near.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).join(most, _KEYS, "right").where("coalesce(n, 0) < least(most, available)").select(*_KEYS)
    ranked = near.unionByName(keyed.where("random > below").join(short, _KEYS, "left_semi"))
    by = "PARTITION BY `group`, dimension, category"
    ranked = ranked.withColumn("draw_rank", F.expr(f"row_number() OVER ({by} ORDER BY random, key)")).where("draw_rank <= most")
    asked = allocated.select(*_SAMPLE, *_KEYS, "quota")
    return asked.join(ranked.select(*_KEYS, "key", "draw_rank"), _KEYS).where("draw_rank <= quota").select(*_SAMPLE, "dimension", "category", "key", "draw_rank")


def draw_jointly(allocated: DataFrame, items: DataFrame, group: str, key: str, dimensions: dict[str, str], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """One set of keys for each sample that serves all its dimensions: (``sample``, ``blueprint``, ``group``, ``key``), and a report.

    An item lies in one cell, its category in each dimension. A cell gets as many of a sample's items as
    the shares of its categories and its size call for (iterative proportional fitting of the cells to the
    quotas, within what each cell has), rounded by largest remainder to the sample's total; its smallest
    random keys are taken. The report has ``sample``, ``blueprint``, ``dimension``, ``category``, ``quota``, ``drawn`` and
    ``missed`` of every target category. Cells of a sample are as many as its categories combine to; an
    item without a category of some dimension is in the cell of "other" there.
    """
    names = list(dimensions)
    cells = [F.coalesce(normal(F.col(f"`{c}`")), F.lit("")).alias(d) for d, c in dimensions.items()]
    rows = items.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), *cells).dropna(subset=["group", "key"])
    # of the rows of one key, the first by its categories counts
    rows = rows.groupBy("group", "key").agg(F.min(F.struct(*names)).alias("cell"))
    # a hot group, and later a hot cell, is held against its targets in many tasks
    left, right = salted(written(rows, "items"), allocated.select("group").distinct(), ["group"], ["key"])
    rows = written(left.join(right, ["group", "_salt"], "left_semi").drop("_salt"), "cells")
    sizes = rows.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("size"))
    wanted = allocated.groupBy(*_SAMPLE, "group").agg(F.first("total").alias("total"), F.collect_list(F.struct("dimension", "category", "quota")).alias("targets"))
    lists = wanted.join(sizes.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("cell", "size"))).alias("cells")), "group")

    @F.pandas_udf("array<int>")
    def fitted(targets: pd.Series, held: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([_fit(t, c, int(round(n)), names) for t, c, n in zip(targets, held, total)])

    each = lists.select(*_SAMPLE, "group", F.explode(F.arrays_zip("cells", fitted("targets", "cells", "total").alias("n"))).alias("z"))
    each = each.select(*_SAMPLE, "group", F.col("z.cells.cell").alias("cell"), F.col("z.cells.size").alias("size"), F.col("z.n").alias("n")).where("n > 0")
    most = each.groupBy("group", "cell").agg(F.max("n").alias("most"), F.max("size").alias("size"))
    left, right = salted(rows, most, ["group", "cell"], ["key"])
    near = left.join(right, ["group", "cell", "_salt"]).drop("_salt").withColumn("random", _random(seed))
    # as in draw(): a threshold first, and all keys of a cell where it lets too few pass
    near = near.withColumn("below", F.least(F.lit(1.0), (F.col("most") * SLACK + SPARE) / F.col("size")))
    passed = near.where("random <= below")
    short = passed.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("p")).join(most, ["group", "cell"], "right").where("coalesce(p, 0) < most").select("group", "cell")
    ranked = passed.unionByName(near.where("random > below").join(short, ["group", "cell"], "left_semi"))
    ranked = ranked.withColumn("r", F.expr("row_number() OVER (PARTITION BY `group`, cell ORDER BY random, key)"))
    drawn = written(each.join(ranked.select("group", "cell", "key", "r"), ["group", "cell"]).where("r <= n").select(*_SAMPLE, "group", "cell", "key"), "drawn")
    taken = drawn.select(*_SAMPLE, "group", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"cell.{d}").alias("category")) for d in names])).alias("p"))
    taken = taken.groupBy(*_SAMPLE, "group", "p.dimension", "p.category").agg(F.count(F.lit(1)).cast("int").alias("drawn"))
    report = allocated.select(*_SAMPLE, *_KEYS, "quota").join(taken, [*_SAMPLE, *_KEYS], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return drawn.select(*_SAMPLE, "group", "key"), report.withColumn("missed", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))


#: Rounds of the fit, after which its cells change by less than an item.
ROUNDS = 50


def _fit(targets: Sequence, cells: Sequence, total: int, names: Sequence[str]) -> list[int]:
    """Items to draw from each cell, so that the sums by category come near the quotas."""
    size = np.array([c["size"] for c in cells], float)
    asked: dict[str, dict[str, int]] = {}
    for t in targets:
        asked.setdefault(t["dimension"], {})[t["category"]] = t["quota"]
    n = size * min(1.0, total / max(size.sum(), 1.0))
    where = {d: np.array([c["cell"][d] for c in cells]) for d in asked}
    # categories that a dimension does not name are not drawn from, unless it cannot be helped
    for d, quota in asked.items():
        n[~np.isin(where[d], list(quota))] = 0.0
    if not n.any():
        return [0] * len(cells)
    for _ in range(ROUNDS):
        for d, quota in asked.items():
            for category, q in quota.items():
                at = where[d] == category
                held = n[at].sum()
                if held > 0:
                    n[at] = np.minimum(n[at] * (q / held), size[at])
    room = int(min(round(total), round(n.sum() + 1e-6)))
    whole = np.floor(n + 1e-9).astype(int)
    rest = sorted(range(len(n)), key=lambda i: (-round(n[i] - whole[i], 9), -size[i], i))
    for i in rest:
        if whole.sum() >= room:
            break
        if whole[i] < size[i] and n[i] > whole[i]:
            whole[i] += 1
    return whole.tolist()


def blueprint_targets(quizzes: DataFrame, quiz: str = "quiz_id", blueprint: str = "blueprint") -> DataFrame:
    """Targets of the JSON blueprints: one row per quiz, dimension and category.

    Blueprints that are null, no JSON object, or lack ``bank_id`` or ``total_questions`` give none;
    repeated rows count once. Categories that are equal after trimming and lower-casing are added up,
    a share that is no number counts as 0 (a percent sign is dropped); nothing else is mapped.
    """
    shape = "bank_id string, total_questions string, min_per_category string, difficulty map<string,string>, chapters map<string,string>, bloom_level map<string,string>"
    rows = quizzes.select(F.col(quiz).alias("sample"), F.col(blueprint).alias("text")).where(F.try_parse_json("text").isNotNull() & F.ltrim("text").startswith("{")).distinct()
    number = lambda c: F.coalesce(F.regexp_replace(c, r"[%\s]", "").try_cast("double"), F.lit(0.0))
    rows = rows.select("sample", F.md5("text").alias("blueprint"), F.from_json("text", shape).alias("b")).where("b.bank_id is not null and b.total_questions is not null")
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"b.{d}").alias("shares")) for d in ("difficulty", "chapters", "bloom_level")])
    rows = rows.select("sample", "blueprint", F.col("b.bank_id").alias("group"), number(F.col("b.total_questions")).alias("total"), number(F.col("b.min_per_category")).alias("floor"), F.explode(dims).alias("d"))
    rows = rows.select("sample", "blueprint", "group", "total", "floor", "d.dimension", F.explode("d.shares").alias("category", "weight"))
    rows = rows.withColumns({"category": normal(F.col("category")), "weight": number(F.col("weight"))})
    # the categories of one blueprint only are added up: a quiz that came with two has both
    return rows.groupBy("sample", "blueprint", "group", "total", "floor", "dimension", "category").agg(F.sum("weight").alias("weight"))
