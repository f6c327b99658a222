"""First-wins dedupe, insert-ignore and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row of each key: the first by ``order``, which must be total for a defined result.

    An aggregate instead of a ranking: rows combine before the shuffle, so a
    key that holds most rows costs no more than any other.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.c{rest.index(c)}").alias(c) for c in df.columns])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new; a bag without keys keeps all."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti") if keys else incoming


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the new rows of ``incoming`` appended."""
    return existing.unionByName(insert_ignore(existing, incoming, keys))


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
