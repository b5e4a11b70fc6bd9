"""The tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table for costly work on each row: where its files give fewer tasks than there are cores, the rows are dealt out first.

    A Parquet row group is read by one task, so a small table of one row group would keep one core busy;
    a large one has row groups enough and is left as it is.
    """
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
