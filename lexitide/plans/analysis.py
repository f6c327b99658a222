"""Temporal variation of n-grams: counts, pruning, statistics and exports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..operators import counting, variation
from ..operators.joining import join_small, with_scalars
from ..operators.staging import staged
from ..sources import sinks


@dataclass
class TemporalAnalysis:
    """The steps of an analysis as DataFrames; each is planned when first used.

    ``articles`` is (article_id, publication_year, abstract).  ``order``
    (article_id, random_rank), if given, restricts the counts to its articles,
    but not the total that estimates refer to.
    """

    articles: DataFrame
    config: AnalysisConfig = AnalysisConfig()
    order: DataFrame | None = None
    lemmas: DataFrame | None = None

    @cached_property
    def chosen(self) -> DataFrame:
        own = self.articles.select("article_id", "publication_year", "abstract")
        return own if self.order is None else own.join(self.order.select("article_id"), "article_id", "left_semi")

    @cached_property
    def clean(self) -> DataFrame:
        return counting.cleaned(self.chosen)

    @property
    def tally(self) -> DataFrame:
        """Counts and totals of one pass; the texts are read once for both."""
        return counting.tally(self.chosen, self.config, self.lemmas)

    @cached_property
    def tallied(self) -> DataFrame:
        return staged(self.tally, "ngram-years")

    @cached_property
    def totals(self) -> DataFrame:
        """One row a year, small whatever the corpus."""
        return self.tallied.where("ngram is null and publication_year is not null").select("publication_year", F.col("count").alias("year_doc_count"), F.col("words").alias("year_word_count"))

    @cached_property
    def sizes(self) -> DataFrame:
        """One row: documents processed and documents eligible."""
        processed = self.totals.agg(F.coalesce(F.sum("year_doc_count"), F.lit(0)).alias("processed"))
        if self.order is None:
            eligible = self.tallied.where("ngram is null").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
        else:
            eligible = counting.eligible(self.articles)
        return staged(with_scalars(processed, eligible), "sizes")

    @cached_property
    def tokens(self) -> DataFrame:
        return counting.tokens(self.clean, self.config, self.lemmas)

    @cached_property
    def occurrences(self) -> DataFrame:
        return counting.occurrences(self.tokens, self.config)

    @cached_property
    def mapping(self) -> DataFrame:
        """(ngram, article_id) of all n-grams."""
        return counting.article_mapping(self.tokens, self.config)

    @cached_property
    def counts(self) -> DataFrame:
        return counting.tallied_counts(self.tallied)

    @cached_property
    def frequencies(self) -> DataFrame:
        return counting.frequencies(self.counts, self.totals, self.config.per_k_words)

    @cached_property
    def bounds(self) -> DataFrame:
        return staged(variation.year_bounds(self.frequencies, self.config), "year-bounds")

    @cached_property
    def pruned(self) -> DataFrame:
        return staged(variation.prune(counting.global_counts(self.counts), self.bounds, self.totals, self.sizes, self.config), "pruned")

    @cached_property
    def kept(self) -> DataFrame:
        return self.pruned.where("reason is null").select("ngram")

    @cached_property
    def results(self) -> DataFrame:
        return variation.final_statistics(self.bounds, self.kept, self.sizes, self.config)

    @property
    def significant(self) -> DataFrame:
        return self.results.where("statistically_significant").select(*sinks.CSV_COLUMNS)

    @property
    def article_mapping(self) -> DataFrame:
        return join_small(self.mapping, self.kept, "ngram", "left_semi")

    def run(self, export_to: str | None = None) -> DataFrame:
        """The final statistics; with ``export_to`` also both CSV files and the article mapping below it."""
        results = staged(self.results, "results")
        if export_to:
            sinks.export_significant(results, f"{export_to}/temporal_ngrams_significant")
            sinks.export_time_series(results, f"{export_to}/temporal_ngrams_timeseries")
            sinks.export_articles(self.article_mapping, f"{export_to}/ngram_articles")
        return results


def run_analysis(articles: DataFrame, config: AnalysisConfig = AnalysisConfig(), export_to: str | None = None, **options) -> DataFrame:
    return TemporalAnalysis(articles, config, **options).run(export_to)
