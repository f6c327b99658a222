"""Joins with small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join for a narrow, probably small right side.

    No hint is given: with adaptive execution the right side's exchange is
    measured at run time and becomes a broadcast only below
    spark.sql.autoBroadcastJoinThreshold; beyond it the join stays shuffled and
    hot keys are split.
    """
    return left.join(right, on, how)


def with_scalars(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """``left`` with the columns of a table that is one row by construction (a global aggregate), as scalar subqueries."""
    return left.withColumns({c: one_row.select(c).scalar() for c in one_row.columns})
