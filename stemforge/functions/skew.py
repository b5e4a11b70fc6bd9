"""Splitting hot keys over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemforge.session import written

#: A key is hot from this share of the rows on, or from HOT_ROWS, which are rows enough for a task, whichever is less.
HOT_SHARE, HOT_ROWS = 0.005, 1_000_000
#: Rows under which no key is hot, and the parts a hot key is split into, at least.
COLD_ROWS, HOT_PARTS = 1000, 64


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Key columns of the hot keys of ``df`` and the ``_parts`` to split each into.

    There are no more than ``1 / share`` of them, or one for each HOT_ROWS rows: a list that is smaller
    than the rows by six digits. Counts are summed on the map side first, so a hot key costs one row per
    task. Null keys count as keys here (joins do not match them).
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    least = F.greatest(F.least(F.col("_all") * share, F.lit(HOT_ROWS)), F.lit(COLD_ROWS))
    parts = F.greatest(F.lit(HOT_PARTS), F.ceil(F.col("_n") / HOT_ROWS)).cast("int").alias("_parts")
    # one row against the counts; only keys over the share pass
    return counts.join(F.broadcast(total), F.col("_n") >= least).select(*keys, parts)


def salted(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt`` to add to the join keys.

    Rows of ``left`` with a hot key are spread by a hash of ``spread`` over the parts of the key, and the
    rows of ``right`` with that key are repeated for each; all other rows keep salt 0. The list of hot
    keys is found once and written, as both sides are held against it.
    """
    hot = F.broadcast(written(hot_keys(left, keys), "hot-keys"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))
    left = left.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_parts")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    right = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(salts)).drop("_parts")
    return left, right
