"""Rates, ratios and page arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_frequency(count: Column, total: Column, per: int = 1000) -> Column:
    """Occurrences in each ``per`` words; 0 where there are no words."""
    return F.when(total == 0, F.lit(0.0)).otherwise(count.cast("double") / total * F.lit(per))


def ratio_or(numerator: Column, denominator: Column, otherwise: float) -> Column:
    """numerator / denominator where the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(otherwise))


def page_count(rows: Column, page: int = 200) -> Column:
    return F.floor((rows + (page - 1)) / page).cast("long")


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Remaining seconds at the pace so far; null before any progress."""
    return F.when(done > 0, (total - done) / done * elapsed)
