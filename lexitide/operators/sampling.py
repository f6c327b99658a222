"""Seeded random order and pages of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def random_order(ids: DataFrame, seed: int = 42, key: str = "article_id") -> DataFrame:
    """(key, random_rank): a permutation from 1 that depends on the seed and the id set alone.

    Ids are spread over ranges of their hash; ranks count within a range and
    add the totals of the ranges before it, so no task sorts all ids.
    """
    hashed = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    ranged = hashed.withColumn("r", F.substring("h", 1, 3))
    sizes = ranged.groupBy("r").agg(F.count("*").alias("n"))  # 4096 rows at most
    before = sizes.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy("h", key))
    return ranged.withColumn("k", inside).join(F.broadcast(before), "r").select(key, (F.col("k") + F.col("before")).cast("int").alias("random_rank"))


def batch_number(rank: str, size: int):
    """0-based batch of a rank from 1."""
    return F.floor((F.col(rank) - 1) / size).cast("long")


def page(ordered: DataFrame, size: int, offset: int, rank: str = "random_rank") -> DataFrame:
    """Rows offset+1 to offset+size by rank: a range of ranks, so earlier rows are pruned and nothing is sorted."""
    return ordered.where((F.col(rank) > offset) & (F.col(rank) <= offset + size))


def store_order(ids: DataFrame, root: str, seed: int = 42) -> None:
    """Replaces the stored order of articles (article_id) by a new one; without articles it is an empty table."""
    from ..sources.sinks import replace_table

    replace_table(root, "articles_order", random_order(ids, seed).sortWithinPartitions("article_id"))
