"""Vector index and exact nearest neighbours under metadata filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemforge.session import written

#: Rows of the searched side in one group of a search, queries of one block, and those of them that are compared at once.
GROUP_ROWS, BLOCK_QUERIES, AT_ONCE = 50_000, 20_000, 256
#: Values of the filter column up to this number are broadcast with their sizes, beyond it they are shuffled.
BROADCAST_VALUES = 100_000


def embed(texts: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], column: str = "embedding", batch: int = 64) -> DataFrame:
    """``texts`` with the vectors that an injected model gives for batches of texts; null texts get the vector of ``""``."""

    @F.pandas_udf("array<float>")
    def vectors(values: pd.Series) -> pd.Series:
        given = values.fillna("").tolist()
        return pd.Series([v for i in range(0, len(given), batch) for v in model(given[i : i + batch])])

    return texts.withColumn(column, vectors(F.col(text)))


def hashed_vectors(texts: list[str], size: int = 8) -> list[list[float]]:
    """A stand-in for an embedding model, for tests and runs without one: how often each rest of a code point occurs."""
    return [np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % size, minlength=size).astype(float).tolist() for t in texts]


def build_index(chunks: DataFrame, path: str, chapter: str = "chapter_num", rebuild: bool = False) -> int:
    """Writes chunks with vectors, one folder per chapter, and returns the number indexed.

    An index that holds rows is left as it is, and its count returned, unless ``rebuild`` is set. A null
    label is written as an empty one; :func:`open_index` gives it back as null.
    """
    if "section_label" in chunks.columns:
        chunks = chunks.withColumn("section_label", F.coalesce("section_label", F.lit("")))
    if not rebuild and (n := index_size(chunks.sparkSession, path)):
        return n
    # rows of a chapter meet in few files; a hot chapter is spread by its rows
    spread = F.pmod(F.xxhash64(*[c for c in chunks.columns if c != chapter][:1]), F.lit(16))
    chunks.repartition(F.col(chapter), spread).write.mode("overwrite").partitionBy(chapter).parquet(path)
    return index_size(chunks.sparkSession, path)


def index_size(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return 0
    return spark.read.parquet(path).count()


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``; an empty section label is null again."""
    index = spark.read.parquet(path)
    return index.withColumn("section_label", F.nullif("section_label", F.lit(""))) if "section_label" in index.columns else index


def matching(index: DataFrame, chapter: int | None = None, section: str | None = None) -> DataFrame:
    """Rows of a chapter, a section, or both; without either, all. Reaches the scan as partition and pushed filters."""
    if chapter is not None:
        index = index.where(F.col("chapter_num") == chapter)
    if section is not None:
        index = index.where(F.col("section_label") == section)
    return index


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def query_text(chapter: Column, section: Column) -> Column:
    """The text that a target is searched with."""
    return F.concat(F.lit("Chapter "), chapter.cast("string"), F.lit(" Section "), F.coalesce(section, F.lit("")))


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` nearest ``rows`` of each query by squared Euclidean distance: ``query``, ``key``, ``distance``, ``rank_no``.

    With ``by``, a query is held against the rows with its value of that column only; null values match
    nothing. Exact: rows are dealt into groups of about GROUP_ROWS per value, blocks of about BLOCK_QUERIES
    queries visit the groups of their value, each visit keeps its k best, and these are merged. A row is
    shuffled once for each block, so once for every BLOCK_QUERIES queries. Ties go to the smaller
    key. Rows or queries without a vector are left out, all vectors have one length.
    """
    value = F.col(by) if by else F.lit(0)
    base = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"), value.alias("g")).where("g is not null")
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("q"), value.alias("g")).where("g is not null")

    # per value of the filter column: groups of rows and blocks of queries; a list of the values, which both sides are held against
    sizes = base.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    grid = written(sizes.join(asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")), "g"), "search-grid")
    grid = F.broadcast(grid) if by is None or grid.count() <= BROADCAST_VALUES else grid
    base = base.join(grid, "g").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("g", "key", "v", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = asked.join(grid, "g").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).select("g", "query", "q", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = ["g", "part", "block"]

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": right["query"][:0], "key": left["key"][:0], "distance": np.zeros(0)})]
        if left.empty or right.empty:
            return out[0]
        v, names = np.stack(left["v"].to_numpy()).astype(float), left["key"].to_numpy()
        squares, n = (v * v).sum(1)[None, :], min(k, len(left))
        for begin in range(0, len(right), AT_ONCE):
            some = right.iloc[begin : begin + AT_ONCE]
            q = np.stack(some["q"].to_numpy()).astype(float)
            d = np.maximum(squares + (q * q).sum(1)[:, None] - 2 * q @ v.T, 0)
            for i, name in enumerate(some["query"]):
                at = np.flatnonzero(d[i] <= np.partition(d[i], n - 1)[n - 1] + 1e-9)
                exact = ((v[at] - q[i]) ** 2).sum(1)
                best = np.lexsort((names[at], exact))[:n]
                out.append(pd.DataFrame({"query": name, "key": names[at][best], "distance": exact[best]}))
        return pd.concat(out[1:], ignore_index=True)

    types = dict(base.dtypes) | dict(asked.dtypes)
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(visit, f"query {types['query']}, key {types['key']}, distance double")
    ranked = found.withColumn("rank_no", F.expr("row_number() OVER (PARTITION BY query ORDER BY distance, key)"))
    return ranked.where(F.col("rank_no") <= k)
