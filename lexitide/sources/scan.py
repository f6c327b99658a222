"""Parquet scans that use all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table at ``path``, only ``columns`` of it if given.

    A table of fewer splits than there are cores is spread over them, as text
    work after the scan costs more than moving such a table. Larger ones stay
    where they are read.
    """
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
