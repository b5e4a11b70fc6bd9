"""References to records that do not exist, for keys of any number of columns.

A reference key may be null in part. References are grouped by which of their key columns are null
(the null mask); the references of one mask are compared on their non-null columns only. The mask is a
part of the join key, so one anti-join serves every mask that the declared match semantics call for:

``simple``   a reference with any null column is never an orphan;
``partial``  the non-null columns must occur together in one target row; all null is no orphan;
``full``     all null is no orphan, but a reference with some null columns is one.

References may carry a time. A target row then exists from ``valid_from`` (inclusive) until
``valid_to`` (exclusive, null: without end), and the reason of an orphan is ``missing`` (no target
row with this key at all), ``late`` (all begin after the reference) or ``deleted``. Without times,
every orphan is ``missing``; ``partly_null`` is the reason of a mixed key under ``full``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemforge.functions.skew import salted
from stemforge.session import written

#: What separates ids in a field: white space and , ; | " ' [ ]
SEPARATORS = r"""(?U)[\s,;|"'\[\]]+"""


def split_ids(field: Column) -> Column:
    """Distinct lower-cased ids held by a field; null and blank fields hold none."""
    ids = F.split(F.lower(F.coalesce(field, F.lit(""))), SEPARATORS, -1)
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def _spans(targets: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint spans of each key in which a target row exists.

    Rows of one key that touch or overlap become one span, and each span is carried on to the begin of
    the next (the first one back without end), so that a reference meets exactly one row of its key.
    """
    far = F.lit("9999-12-31 23:59:59").cast("timestamp")
    spans = targets.where("_from is not null").withColumn("_to", F.greatest(F.col("_from"), F.coalesce("_to", far)))
    keys = ", ".join(by)
    spans = spans.withColumn("_before", F.expr(f"max(_to) OVER (PARTITION BY {keys} ORDER BY _from, _to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    spans = spans.withColumn("_group", F.expr(f"sum(CASE WHEN _before >= _from THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY _from, _to ROWS UNBOUNDED PRECEDING)"))
    spans = spans.groupBy(*by, "_group").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    spans = spans.withColumns({"_next": F.expr(f"lead(_from) OVER (PARTITION BY {keys} ORDER BY _from)"), "_begin": F.when(F.col("_group") > 1, F.col("_from"))})
    return spans.drop("_group")


def find_orphans(
    references: DataFrame,
    targets: DataFrame,
    keys: Mapping[str, str],
    match: str = "simple",
    at: str | None = None,
    valid_from: str | None = None,
    valid_to: str | None = None,
) -> DataFrame:
    """Rows of ``references`` whose key is in no row of ``targets``, with a column ``reason``.

    ``keys`` maps columns of ``references`` to columns of ``targets``. Equal reference rows come out
    once. A reference without a time (``at`` null) is compared as if it had none: it is ``missing`` or
    no orphan. Target rows with a null in a compared key column, or without ``valid_from``, hold no
    key. Empty references give no rows, empty targets make every reference ``missing``. Other columns
    of either side may have any names; a column ``reason`` of ``references`` is replaced. Columns of
    ``references`` must be comparable (no maps).
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match must be simple, partial or full, not {match!r}")
    names = [f"_k{i}" for i in range(len(keys))]
    timed = at is not None
    # the whole reference row travels as one value, so that its columns may have any names
    refs = references.select(F.struct(*[F.col(f"`{c}`") for c in references.columns if c != "reason"]).alias("_row")).distinct()
    null = F.concat(*[F.col(f"_row.`{c}`").isNull().cast("int").cast("string") for c in keys])
    refs = refs.select("_row", null.alias("_mask"), *[F.col(f"_row.`{c}`").alias(k) for k, c in zip(names, keys)], *([F.col(f"_row.`{at}`").alias("_at")] if timed else []))
    refs = refs.where(F.contains("_mask", F.lit("0")))
    complete = F.col("_mask") == "0" * len(names)
    if match == "simple":
        refs = refs.where(complete)
    # read twice, for the hot keys and for the join
    refs = written(refs, "references")
    parts = []
    if match == "full":
        parts.append(refs.where(~complete).select("_row", F.lit("partly_null").alias("reason")))
        refs = refs.where(complete)
    times = [F.col(f"`{valid_from}`").alias("_from"), (F.col(f"`{valid_to}`") if valid_to else F.lit(None).cast("timestamp")).alias("_to")] if timed else []
    target = targets.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(names, keys.values())], *times)
    # a target row answers to each mask under which it is compared on columns that it has; the number of masks follows from the keys
    masks = ["".join(m) for m in product("01", repeat=len(names)) if "0" in m] if match == "partial" else ["0" * len(names)]
    seen = lambda m: [F.when(F.lit(m[i] == "0"), F.col(k)).alias(k) for i, k in enumerate(names)]
    fits = lambda m: F.forall(F.array(*[F.col(k).isNotNull() for i, k in enumerate(names) if m[i] == "0"]), lambda x: x)
    answers = F.filter(F.array(*[F.when(fits(m), F.struct(F.lit(m).alias("_mask"), *seen(m))) for m in masks]), lambda x: x.isNotNull())
    target = target.withColumn("_a", F.explode(answers)).select("_a.*", *(["_from", "_to"] if timed else [])).distinct()
    by = ["_mask", *names]
    # null columns of a mask are equal on both sides, so they meet under a value of their own
    meets = lambda df: df.withColumn("_key", F.xxhash64(*by))
    known = meets(_spans(target, by) if timed else target.withColumn("_from", F.lit(True)))
    left, right = salted(meets(refs), known, ["_key"], ["_row"])
    on = [left[k].eqNullSafe(right[k]) if k in names else left[k] == right[k] for k in ["_key", "_salt", *by]]
    if timed:
        # a reference without a time meets the first span
        on += [right["_begin"].isNull() | (left["_at"] >= right["_begin"]), right["_next"].isNull() | (F.coalesce(left["_at"], F.lit("0001-01-01").cast("timestamp")) < right["_next"])]
    reason = F.when(right["_from"].isNull(), "missing")
    if timed:
        reason = reason.when(left["_at"] < right["_from"], "late").when(left["_at"] >= right["_to"], "deleted")
    out = left.join(right, on, "left").select(left["_row"], reason.alias("reason"))
    for part in parts:
        out = out.unionByName(part)
    return out.where("reason is not null").select("_row.*", "reason")


def orphan_report(orphans: DataFrame, references: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per ``by`` (table, period, ...): references, orphans, and orphans of each reason."""
    reasons = ("missing", "late", "deleted", "partly_null")
    found = orphans.groupBy(*by).agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in reasons])
    every = references.groupBy(*by).agg(F.count(F.lit(1)).alias("n_references"))
    filled = every.join(found, list(by), "left").fillna(0, subset=[f"n_{r}" for r in reasons])
    return filled.withColumn("n_orphans", sum((F.col(f"n_{r}") for r in reasons), F.lit(0)))
