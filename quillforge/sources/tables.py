"""Scans of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a folder of part files) under ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan for work that takes far longer than reading: rows of a table whose files give fewer than half as many tasks as there are
    cores are dealt out evenly. Larger tables stay as they are, without a shuffle. Only for scans: what is planned behind a shuffle would
    be run to count its tasks."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() <= cores else scan
