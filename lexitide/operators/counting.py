"""Counts of n-grams by year and overall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions import text
from ..functions.numbers import normalized_frequency
from . import grams
from .staging import staged


#: Words of a lemma table; a dictionary of a language has fewer.
LEMMAS = 2_000_000
#: Bytes of input tables whose n-grams of one length make a partition.
SPREAD = 16_000_000


def cleaned(articles: DataFrame) -> DataFrame:
    """(article_id, publication_year, clean) of articles with words left; a null year drops out.

    Whether words are left is told by a first letter: a filter on the cleaned
    text would be pushed below the projection and clean every text twice.
    """
    lettered = F.lower(F.col("abstract")).rlike("[a-z]")
    return articles.where(F.col("publication_year").isNotNull() & lettered).select("article_id", "publication_year", text.clean_text(F.col("abstract")).alias("clean"))


def eligible(articles: DataFrame) -> DataFrame:
    """One row: how many articles have a non-empty abstract."""
    return articles.where(F.col("abstract").isNotNull() & (F.col("abstract") != "")).agg(F.count("*").alias("total"))


def year_totals(clean: DataFrame) -> DataFrame:
    """(publication_year, year_doc_count, year_word_count); words of the cleaned text, stop words included."""
    return clean.groupBy("publication_year").agg(F.count("*").alias("year_doc_count"), F.sum(text.word_count(F.col("clean"))).alias("year_word_count"))


def tokens(clean: DataFrame, config: AnalysisConfig, lemmas: DataFrame | None = None) -> DataFrame:
    """(article_id, publication_year, tokens): words after contractions, lemmas (word, lemma) and stop words.

    Without ``lemmas`` words are their own lemmas, as are words that the table
    lacks.  Tokens are looked up where they are, without a shuffle.
    """
    body = text.split_contractions(F.col("clean")) if config.contractions else F.col("clean")
    out = clean.select("article_id", "publication_year", text.words(body).alias("tokens"))
    if lemmas is not None:
        out = lemmatised(out, lemmas)
    if config.stop_words:
        out = out.withColumn("tokens", text.without_stop_words(F.col("tokens")))
    return out


def lemma_table(lemmas: DataFrame) -> Broadcast[dict[str, str]]:
    """Word -> lemma, the smallest where the table has several; at most LEMMAS words, an error beyond."""
    table = lemmas.where("word is not null and lemma is not null").groupBy("word").agg(F.min("lemma").alias("lemma")).limit(LEMMAS + 1).toArrow()
    if len(table) > LEMMAS:
        raise ValueError(f"a lemma table has at most {LEMMAS} words")
    return lemmas.sparkSession.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist())))


def lemmatised(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(article_id, publication_year, tokens) with each token replaced by its lemma.

    The table is broadcast (:func:`lemma_table`).  Each batch looks up its
    distinct tokens only.
    """
    shared = lemma_table(lemmas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            lists = batch.column(2)
            words = lists.flatten().dictionary_encode()
            named = pa.array([get(w, w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named)], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def occurrences(tokens_: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(article_id, publication_year, ngram), one row for each occurrence."""
    return tokens_.select("article_id", "publication_year", F.explode(text.ngrams(F.col("tokens"), *config.ngram_range)).alias("ngram"))


def year_counts(occurrences_: DataFrame) -> DataFrame:
    """(ngram, publication_year, count); counted before the shuffle."""
    return occurrences_.groupBy("ngram", "publication_year").agg(F.count("*").alias("count"))


def tally(articles: DataFrame, config: AnalysisConfig, lemmas: DataFrame | None = None) -> DataFrame:
    """(ngram, publication_year, count, words): :func:`year_counts` and the totals in one pass over the texts.

    Each eligible article also counts once under a null n-gram, with its words;
    under a null year too if it has no year or no words.

    Arrow batches are counted by integer codes, in pieces of bounded size, and
    only their counts become rows.  These are shuffled as they are: Spark's
    partial aggregation before the shuffle would hold most n-grams of a split.
    """
    body = F.when(F.col("publication_year").isNotNull(), text.clean_text(F.col("abstract"))).otherwise(F.lit(""))
    base = articles.where(F.col("abstract").isNotNull() & (F.col("abstract") != "")).select("publication_year", body.alias("clean"))
    split = text.split_contractions(F.col("clean")) if config.contractions else F.col("clean")
    made = base.select(F.when(F.col("clean") != "", F.col("publication_year")).alias("publication_year"), text.word_count(F.col("clean")).alias("n"), split.alias("clean"))
    run = grams.counter(*config.ngram_range, text.STOP_WORDS if config.stop_words else (), lemma_table(lemmas) if lemmas is not None else None)
    rows = made.mapInArrow(run, f"ngram string, publication_year {made.schema['publication_year'].dataType.simpleString()}, count long, words long")
    return spread(rows, config.ngram_range[1] - config.ngram_range[0] + 1, "ngram", "publication_year").groupBy("ngram", "publication_year").agg(F.sum("count").alias("count"), F.sum("words").alias("words"))


def spread(rows: DataFrame, lengths: int, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys``; to more than spark.sql.shuffle.partitions where the tables read are so large that a task would hold too many."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    wanted = sum(s for s in sizes if s < 1 << 60) * lengths // SPREAD  # an unknown size is given as 2^63 - 1
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(wanted, *keys) if wanted > most else rows.repartition(*keys)


def tallied_counts(tallied: DataFrame) -> DataFrame:
    """(ngram, publication_year, count) out of :func:`tally`."""
    return tallied.where("ngram is not null").select("ngram", "publication_year", "count")


def global_counts(counts: DataFrame) -> DataFrame:
    """(ngram, total_frequency, years_present)."""
    return counts.groupBy("ngram").agg(F.sum("count").alias("total_frequency"), F.count("*").cast("int").alias("years_present"))


def article_mapping(tokens_: DataFrame, config: AnalysisConfig) -> DataFrame:
    """(ngram, article_id), each pair once.

    A row's n-grams are made distinct where it is, so pairs of an id of one row
    are neither aggregated nor shuffled. Only the pairs of ids that several rows
    share, or that are null, are made distinct across rows, after a shuffle.
    """
    mine = F.explode(F.array_distinct(text.ngrams(F.col("tokens"), *config.ngram_range))).alias("ngram")
    shared = staged(tokens_.groupBy("article_id").agg(F.count("*").alias("n")).where("n > 1 or article_id is null").select(F.col("article_id").alias("shared_id")), "shared-ids")
    if shared.isEmpty():
        return tokens_.select(mine, "article_id")
    same = F.col("article_id").eqNullSafe(F.col("shared_id"))
    several = tokens_.join(shared, same, "left_semi").select(mine, "article_id").repartition("ngram", "article_id").distinct()
    return tokens_.join(shared, same, "left_anti").select(mine, "article_id").union(several)


def article_sets(mapping: DataFrame, span: int = 65_536) -> DataFrame:
    """(ngram, part, article_ids): sorted arrays; part p holds the ids from p * span on, so none has more than ``span`` of them."""
    return mapping.groupBy("ngram", F.floor(F.col("article_id") / span).alias("part")).agg(F.array_sort(F.collect_set("article_id")).alias("article_ids"))


def frequencies(counts: DataFrame, totals: DataFrame, per: int = 1000) -> DataFrame:
    """``counts`` with year_word_count and normalized_frequency; totals are one row a year."""
    return counts.join(F.broadcast(totals.select("publication_year", "year_word_count")), "publication_year").withColumn("normalized_frequency", normalized_frequency(F.col("count"), F.col("year_word_count"), per))
