"""Pruning and final statistics of n-grams over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.beta import with_quantiles
from ..functions.numbers import ratio_or
from .joining import join_small, with_scalars

REASONS = ("insufficient_years", "no_statistical_power", "no_fold_change")


def year_bounds(freqs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``freqs`` (count, year_word_count) with freq_lower and freq_upper, the bounds of the posterior rate; 0 without words."""
    a, b = F.col("count") + 1, F.col("year_word_count") - F.col("count") + 1
    out = with_quantiles(freqs, F.when(F.col("count") == 0, 1).otherwise(a), F.when(F.col("count") == 0, 1).otherwise(b), {"_low": config.year_alpha / 2, "_high": 1 - config.year_alpha / 2})

    def bound(name: str) -> Column:
        return F.when(F.col("year_word_count") > 0, F.col(name) * config.per_k_words).otherwise(F.lit(0.0))

    return out.withColumn("freq_lower", bound("_low")).withColumn("freq_upper", bound("_high")).drop("_low", "_high")


def power(totals: DataFrame, sizes: DataFrame, config: AnalysisConfig) -> DataFrame:
    """``totals`` (ngram, total_frequency) with estimated_total_count_upper and has_power.

    ``sizes`` is one row (processed, total).  More occurrences than documents
    plus one have no estimate and no power.
    """
    alpha = 1 - config.confidence_level
    joined = with_scalars(totals, sizes)
    out = with_quantiles(joined, F.col("total_frequency") + 1, F.col("processed") - F.col("total_frequency") + 1, {"_q": 1 - alpha / 2})
    upper = F.when(~F.isnan("_q"), F.col("_q") * F.col("total"))
    enough = F.coalesce(upper > config.min_estimated_total, F.lit(False)) | (F.col("processed") == 0)
    return out.withColumn("estimated_total_count_upper", upper).withColumn("has_power", enough).drop("_q", "processed", "total")


def fold_range(bounds: DataFrame, year_words: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(ngram, max_possible_fold): largest upper over smallest positive lower bound, null where too little is observed.

    A year with words but without the n-gram has the bounds of Beta(1, 1); they
    are folded in once instead of listing every absent year.
    """
    scale, half = config.per_k_words, config.year_alpha / 2
    years = year_words.agg(F.count("*").alias("observed"), F.sum((F.col("year_word_count") > 0).cast("int")).alias("with_words"))
    seen = bounds.where("year_word_count > 0").groupBy("ngram").agg(F.count("*").alias("present"), F.max("freq_upper").alias("u"), F.min(F.when(F.col("freq_lower") > 0, F.col("freq_lower"))).alias("l"))
    joined = with_scalars(seen, years)
    absent = F.col("present") < F.col("with_words")
    upper = F.when(absent, F.greatest("u", F.lit((1 - half) * scale))).otherwise(F.col("u"))
    lower = F.when(absent, F.least("l", F.lit(half * scale))).otherwise(F.col("l"))
    return joined.select("ngram", F.when((F.col("observed") >= 2) & (F.col("with_words") >= 2) & (lower > 0), upper / lower).alias("max_possible_fold"))


def prune(totals: DataFrame, bounds: DataFrame, year_words: DataFrame, sizes: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(ngram, total_frequency, years_present, reason): why an n-gram is dropped, null where it stays.

    With fewer than ``min_observed_years`` years everything stays.
    """
    years = year_words.agg((F.count("*") >= config.min_observed_years).alias("enough_years"))
    judged = join_small(power(totals, sizes, config), fold_range(bounds, year_words, config), "ngram", "left")
    reason = (
        F.when(F.col("years_present") < config.min_years_present, REASONS[0])
        .when(~F.col("has_power"), REASONS[1])
        .when(F.col("max_possible_fold") < config.min_fold_change, REASONS[2])
    )
    return with_scalars(judged, years).select("ngram", "total_frequency", "years_present", F.when(F.col("enough_years"), reason).alias("reason"))


def reason_counts(pruned: DataFrame) -> DataFrame:
    return pruned.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def final_statistics(bounds: DataFrame, kept: DataFrame, sizes: DataFrame, config: AnalysisConfig) -> DataFrame:
    """One row for each kept n-gram of at least two years: fold change, its interval, extremes, yearly frequencies and flags."""
    alpha = 1 - config.confidence_level
    f, y = F.col("normalized_frequency"), F.col("publication_year")
    own = F.struct(y.alias("year"), F.col("freq_lower").alias("lower"), F.col("freq_upper").alias("upper"))
    years = bounds.where("normalized_frequency > 0").groupBy("ngram").agg(
        F.max(f).alias("max_frequency"), F.min(f).alias("min_frequency"),
        F.max_by(own, F.struct(f, -y)).alias("peak"), F.min_by(own, F.struct(f, y)).alias("trough"),
        F.count("*").cast("int").alias("years_present"), F.sum("count").alias("total_frequency"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(y, f)))).alias("yearly_frequencies"),
    ).where("years_present >= 2")
    joined = with_scalars(years.join(kept.select("ngram"), "ngram", "left_semi"), sizes)
    joined = with_quantiles(joined, F.col("total_frequency") + 1, F.greatest(F.lit(1), F.col("processed") - F.col("total_frequency") + 1), {"_q": alpha / 2})
    low = F.when((F.col("processed") > 0) & (F.col("total") > 0), F.col("_q") * F.col("total")).otherwise(F.col("total_frequency").cast("double"))
    peak, trough, infinite = F.col("peak"), F.col("trough"), float("inf")
    out = joined.select(
        "ngram",
        ratio_or(F.col("max_frequency"), F.col("min_frequency"), infinite).alias("fold_change"),
        ratio_or(peak["lower"], trough["upper"], 0.0).alias("fold_change_ci_lower"),
        ratio_or(peak["upper"], trough["lower"], infinite).alias("fold_change_ci_upper"),
        "max_frequency", "min_frequency", peak["year"].alias("max_year"), trough["year"].alias("min_year"), "years_present", "total_frequency",
        F.col("years_present").alias("document_frequency"), low.alias("estimated_total_count_lower"), "yearly_frequencies",
    )
    enough = F.col("estimated_total_count_lower") > config.min_estimated_total
    return out.withColumn("statistically_significant", (F.col("fold_change_ci_lower") >= config.min_fold_change) & enough).withColumn("sufficient_power", enough)


def fold_changes(freqs: DataFrame) -> DataFrame:
    """Unpruned fold changes out of frequencies: (ngram, total_frequency, max/min frequency and year, years_present, fold_change)."""
    f, y = F.col("normalized_frequency"), F.col("publication_year")
    return (
        freqs.where("normalized_frequency > 0").groupBy("ngram")
        .agg(F.sum("count").alias("total_frequency"), F.max(f).alias("max_frequency"), F.min(f).alias("min_frequency"), F.max_by(y, F.struct(f, -y)).alias("max_year"), F.min_by(y, F.struct(f, y)).alias("min_year"), F.count("*").alias("years_present"))
        .where("years_present >= 2").withColumn("fold_change", F.col("max_frequency") / F.col("min_frequency"))
    )


def top(results: DataFrame, n: int = 20) -> DataFrame:
    """The n largest fold changes, ties by n-gram."""
    return results.orderBy(F.desc("fold_change"), "ngram").limit(n)
