import csv
import glob
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexitide.config import EXAMPLE, AnalysisConfig
from lexitide.operators import counting, dedupe, grams, sampling, variation
from lexitide.plans import catalogue
from lexitide.plans.analysis import TemporalAnalysis, run_analysis
from lexitide.sources import sinks

ARTICLES = "article_id long, publication_year int, abstract string"


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 0), (None, "n", 5), (1, "a", 1)], "k int, v string, o int")
    assert sorted(map(tuple, dedupe.first_wins(df, ["k"], ["o", "v"]).collect()), key=str) == sorted([(1, "a", 1), (2, None, 0), (None, "n", 5)], key=str)
    again = dedupe.upsert(df.limit(0), df.distinct(), ["k", "v"])
    assert again.count() == 4 and dedupe.insert_ignore(again, df, []).count() == 5
    assert dedupe.union_distinct(df, df).count() == 4


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_random_order(spark, n):
    ids = spark.range(n).select(F.col("id").alias("article_id"))
    got = [r.article_id for r in sampling.random_order(ids, 7).orderBy("random_rank").collect()]
    assert sorted(got) == list(range(n))
    assert got == [r.article_id for r in sampling.random_order(ids.repartition(3), 7).orderBy("random_rank").collect()]
    if n > 10:
        assert got != [r.article_id for r in sampling.random_order(ids, 8).orderBy("random_rank").collect()]
        assert [r.random_rank for r in sampling.page(sampling.random_order(ids, 7), 5, 10).orderBy("random_rank").collect()] == [11, 12, 13, 14, 15]


def corpus(spark):
    rows = [(y * 100 + i, y, "alpha beta " + ("gamma " * (30 if y == 2001 else 1)) + ("rare" if (y, i) == (2000, 0) else "")) for y in (2000, 2001, 2002) for i in range(20)]
    return spark.createDataFrame(rows + [(1, 2000, None), (2, 2000, "123"), (3, None, "alpha")], ARTICLES)


CONFIG = AnalysisConfig(ngram_range=(1, 1), stop_words=False, min_estimated_total=5.0)


def test_prune_reasons(spark):
    own = TemporalAnalysis(corpus(spark), CONFIG)
    got = {r.ngram: r.reason for r in own.pruned.collect()}
    # alpha occurs once in each of 60 documents; gamma more often than there are documents
    assert got == {"alpha": None, "beta": None, "gamma": "no_statistical_power", "rare": "insufficient_years"}
    assert own.sizes.first().asDict() == {"processed": 60, "total": 62}
    strict = TemporalAnalysis(corpus(spark), CONFIG.with_(min_fold_change=1e6))
    assert {r.reason for r in strict.pruned.where("ngram = 'alpha'").collect()} == {"no_fold_change"}


def test_an_absent_year_never_fails_the_fold_test(spark):
    rows = [(y * 100 + i, y, "alpha" if y == 2003 else "alpha beta") for y in (2000, 2001, 2002, 2003) for i in range(20)]
    own = TemporalAnalysis(spark.createDataFrame(rows, ARTICLES), CONFIG.with_(min_fold_change=39.0))
    assert {r.ngram: r.reason for r in own.pruned.collect()} == {"alpha": "no_fold_change", "beta": None}


def test_two_observed_years_prune_nothing(spark):
    own = TemporalAnalysis(corpus(spark).where("publication_year < 2002"), CONFIG.with_(min_years_present=9))
    assert own.pruned.where("reason is not null").count() == 0


def test_results_and_exports(spark, tmp_path):
    rows = [(y * 1000 + i, y, "alpha " + "beta " * (9 if y == 2001 and i % 2 else 0) + "beta") for y in (2000, 2001, 2002) for i in range(40)]
    articles = spark.createDataFrame(rows, ARTICLES)
    config = CONFIG.with_(min_estimated_total=50.0, min_fold_change=1.01)
    results = {r.ngram: r for r in run_analysis(articles, config, str(tmp_path)).collect()}
    assert set(results) == {"alpha"}  # beta occurs more often than there are documents
    alpha = results["alpha"]
    assert alpha.max_year == 2000 and alpha.min_year == 2001 and alpha.total_frequency == 120 and alpha.document_frequency == 3
    assert alpha.yearly_frequencies[2000] == alpha.yearly_frequencies[2002] == 500.0 and alpha.fold_change == 500 / alpha.yearly_frequencies[2001]
    assert alpha.fold_change_ci_lower < alpha.fold_change < alpha.fold_change_ci_upper
    series = [r for f in glob.glob(f"{tmp_path}/temporal_ngrams_timeseries/*.csv") for r in csv.DictReader(open(f))]
    assert len(series) == 3
    assert spark.read.parquet(f"{tmp_path}/ngram_articles").count() == 120
    sinks.export_significant(spark.createDataFrame([], spark.read.parquet(f"{tmp_path}/ngram_articles").schema).select(*[F.lit(None).cast("double").alias(c) for c in sinks.CSV_COLUMNS], F.lit(False).alias("statistically_significant")), f"{tmp_path}/none")
    assert [open(f).read().strip() for f in glob.glob(f"{tmp_path}/none/*.csv")] == [",".join(sinks.CSV_COLUMNS)]


def test_lemmas_and_stop_words(spark):
    clean = counting.cleaned(spark.createDataFrame([(1, 2000, "The cats cannot sit; cats!")], ARTICLES))
    lemmas = spark.createDataFrame([("cats", "cat"), ("sit", "sit")], "word string, lemma string")
    got = counting.tokens(clean, AnalysisConfig(), lemmas).first().tokens
    assert got == ["cat", "sit", "cat"]
    twice = counting.cleaned(spark.createDataFrame([(1, 2000, "Alpha beta")] * 2 + [(None, 2000, "alpha")], ARTICLES))
    config = AnalysisConfig(ngram_range=(1, 2), stop_words=False)
    found = counting.occurrences(counting.tokens(twice, config, lemmas), config).groupBy("ngram").count().collect()
    assert dict(map(tuple, found)) == {"alpha": 3, "beta": 2, "alpha beta": 2}
    counting.LEMMAS, before = 1, counting.LEMMAS
    try:
        with pytest.raises(ValueError, match="at most 1"):
            counting.lemmatised(twice, lemmas)
    finally:
        counting.LEMMAS = before
    assert EXAMPLE.min_fold_change == 4.0


def test_order_restricts_counts(spark):
    articles = corpus(spark)
    order = sampling.random_order(articles.select("article_id").limit(10))
    own = TemporalAnalysis(articles, CONFIG, order=order)
    assert own.clean.count() <= 10 and own.sizes.first().total == 62


def test_top_breaks_ties(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 3.0)], "ngram string, fold_change double")
    assert [r.ngram for r in variation.top(df, 2).collect()] == ["c", "a"]


def test_article_sets_come_in_parts(spark):
    pairs = spark.createDataFrame([("a", i) for i in (5, 1, 7, 1)] + [("b", 9)], "ngram string, article_id long")
    got = {(r.ngram, r.part): r.article_ids for r in counting.article_sets(pairs, 5).collect()}
    assert got == {("a", 0): [1], ("a", 1): [5, 7], ("b", 1): [9]}


def test_stored_order_is_replaced(spark, tmp_path):
    root = str(tmp_path)
    for n in (6, 3, 0):
        sampling.store_order(spark.range(n).select(F.col("id").alias("article_id")), root)
        assert sorted(r.random_rank for r in sinks.read_table(spark, root, "articles_order").collect()) == list(range(1, n + 1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inverted_indexes_are_made_in_place(spark, tmp_path):
    said = ["B a b", "", None, "one one", "12", "a b c a", "x y"]
    docs = spark.createDataFrame([(7 if i in (0, 5) else i, t) for i, t in enumerate(said)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.inverted_index_roundtrip(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(6, "x y", 1), (7, "a b c a", 3), (7, "b a b", 2)]  # a shared id is two texts
    assert "Aggregate" not in plan_of(found) and "Generate" not in plan_of(found)
    clean = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "a")], "id long, clean string")
    for letters in (1, 6, 100):  # texts alone, some together, all at once
        assert sorted((i, dict(m)) for i, m in grams.inverted_index(clean, "clean", "idx", letters).collect()) == [(1, {"a": [1], "b": [0, 2]}), (2, {}), (3, {"a": [0]})]


def test_pairs_of_an_article_are_distinct_in_place(spark):
    config = AnalysisConfig(ngram_range=(1, 2), stop_words=False)
    own = TemporalAnalysis(spark.createDataFrame([(1, 2000, "a b a b"), (2, 2000, "a")], ARTICLES), config)
    assert sorted(map(tuple, own.mapping.collect())) == [("a", 1), ("a", 2), ("a b", 1), ("b", 1), ("b a", 1)]
    assert "Aggregate" not in plan_of(own.mapping) and "Exchange" not in plan_of(own.mapping)
    rows = [(1, 2000, "a b"), (1, 2001, "b a"), (2, 2000, "a a"), (None, 2000, "c"), (None, 2000, "c c"), (3, 2000, None)]
    several = TemporalAnalysis(spark.createDataFrame(rows, ARTICLES), config)
    assert sorted(map(tuple, several.mapping.collect()), key=str) == sorted([("a", 1), ("a b", 1), ("b", 1), ("b a", 1), ("a", 2), ("a a", 2), ("c", None), ("c c", None)], key=str)


def test_ngrams_are_counted_in_place(spark):
    rows = [(1, 2000, "a b a b a"), (2, 2000, "b a"), (3, 2001, "A b!"), (4, None, "a b"), (5, 2001, "12"), (6, 2001, None), (7, 2001, "a")]
    articles = spark.createDataFrame(rows, ARTICLES).coalesce(1)
    config = AnalysisConfig(ngram_range=(1, 3), stop_words=False)
    expected = {("a", 2000): 4, ("b", 2000): 3, ("a", 2001): 2, ("b", 2001): 1, ("a b", 2000): 2, ("b a", 2000): 3, ("a b", 2001): 1, ("a b a", 2000): 2, ("b a b", 2000): 1}
    own = TemporalAnalysis(articles, config)
    assert {(g, y): n for g, y, n in own.counts.collect()} == expected
    assert sorted(map(tuple, own.totals.collect())) == [(2000, 2, 7), (2001, 2, 3)] and own.sizes.first().total == 6
    plan = plan_of(own.tally)
    assert "Generate" not in plan and "Aggregate" not in plan[plan.index("Exchange") :]  # nothing is aggregated before the shuffle
    batch = pa.RecordBatch.from_pydict({"y": [2000, 2000, 2001, None, 2001], "n": [5, 2, 2, 0, 1], "clean": ["a b a b a", "b a", "a b", "", "a"]})
    for letters in (1, 8, 1000):  # texts alone, some together, all at once
        found = Counter()
        for part in grams.counter(1, 3, letters=letters)(iter([batch])):
            for g, y, n in zip(*(part.column(i).to_pylist() for i in range(3))):
                found[g, y] += n
        assert found == expected | {(None, 2000): 2, (None, 2001): 2, (None, None): 1}


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, 2000, f"w{i} a b") for i in range(3000)], ARTICLES).coalesce(1).write.parquet(f"{tmp_path}/a")
    own = TemporalAnalysis(spark.read.parquet(f"{tmp_path}/a"), AnalysisConfig(ngram_range=(1, 2), stop_words=False))
    few = own.tally.rdd.getNumPartitions()
    monkeypatch.setattr(counting, "SPREAD", 500)
    assert few <= 4 < 20 < own.tally.rdd.getNumPartitions()
    assert own.tally.where("ngram = 'a b' and count = 3000").count() == 1


def test_lemmas_are_counted_in_place(spark):
    articles = spark.createDataFrame([(1, 2000, "Cats sat, cat sat"), (1, 2000, "cats"), (2, None, "cats"), (3, 2001, "9")], ARTICLES)
    lemmas = spark.createDataFrame([("cats", "cat"), ("cats", "kitten"), ("sat", None)], "word string, lemma string")
    own = TemporalAnalysis(articles, AnalysisConfig(ngram_range=(1, 2), stop_words=False), lemmas=lemmas)
    assert {(g, y): n for g, y, n in own.counts.collect()} == {("cat", 2000): 3, ("sat", 2000): 2, ("cat sat", 2000): 2, ("sat cat", 2000): 1}
    assert own.sizes.first().asDict() == {"processed": 2, "total": 4}
    plan = plan_of(own.tally)
    assert "Generate" not in plan and "Aggregate" not in plan[plan.index("Exchange") :]


def test_stop_words_and_contractions_are_counted_in_place(spark):
    articles = spark.createDataFrame([(1, 2000, "The cat cannot sing, gonna sing the cat"), (2, 2000, "the of"), (3, 2001, "scannot")], ARTICLES)
    own = TemporalAnalysis(articles, AnalysisConfig(ngram_range=(1, 2), stop_words=True, contractions=True))
    got = {(g, y): n for g, y, n in own.counts.collect()}
    assert got == {("cat", 2000): 2, ("sing", 2000): 2, ("gon", 2000): 1, ("na", 2000): 1, ("cat sing", 2000): 1, ("sing gon", 2000): 1, ("gon na", 2000): 1, ("na sing", 2000): 1, ("sing cat", 2000): 1, ("scannot", 2001): 1}
    assert sorted(map(tuple, own.totals.collect())) == [(2000, 2, 10), (2001, 1, 1)]  # words before contractions and stop words
    plan = plan_of(own.tally)
    assert "Generate" not in plan and "Aggregate" not in plan[plan.index("Exchange") :]
