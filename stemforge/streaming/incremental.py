"""Chunks of documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stemforge.operators.chunking import ChunkOptions, chunk_texts


def arriving(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunk_stream(documents: DataFrame, key: str, text: str, received: str, late: str = "30 days", options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of a stream of documents; one delivered again within ``late`` is chunked once.

    The state holds the keys of that time only. Chunking a document needs nothing but the document.
    """
    fresh = documents.select(key, text, received).withWatermark(received, late).dropDuplicatesWithinWatermark([key])
    return chunk_texts(fresh, text, options).drop(text)


def write_chunks(chunks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived so far to Parquet files and ends; a later call goes on from there."""
    return chunks.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
