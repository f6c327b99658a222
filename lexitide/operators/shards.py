"""Enumeration and adaptive split of harvest shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enumerate_shards(subfields: DataFrame, statuses: list[str], first_year: int = 2019, last_year: int = 2025) -> DataFrame:
    """(year, subfield, oa_status): every combination, latest years first; exploded from constants, not joined."""
    years = F.sequence(F.lit(last_year), F.lit(first_year), F.lit(-1))
    return subfields.select("subfield", F.explode(years).alias("year")).select("year", "subfield", F.explode(F.array(*map(F.lit, statuses))).alias("oa_status"))


def split_shards(counts: DataFrame, topics: DataFrame, limit: int = 10_000) -> DataFrame:
    """Shards (shard, subfield, n) as they are read: none if empty, one, or one for each topic beyond ``limit`` rows.

    ``topics`` is (subfield, topic).  The result has topic null for whole shards.
    """
    whole = counts.where((F.col("n") > 0) & (F.col("n") <= limit)).select("shard", "subfield", F.lit(None).cast("string").alias("topic"))
    parts = counts.where(F.col("n") > limit).join(topics.select("subfield", F.col("topic").cast("string").alias("topic")).distinct(), "subfield").select("shard", "subfield", "topic")
    return whole.unionByName(parts)
