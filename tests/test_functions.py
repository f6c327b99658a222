import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitide.functions import beta, ids, numbers, text

few = settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


@few
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
def test_clean_text(spark, texts):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.clean_text(F.col("t"))).collect()
    for i, clean in got:
        assert clean == re.sub("[^a-z]+", " ", texts[i].lower()).strip(" ")


def test_null_text(spark):
    assert spark.sql("select cast(null as string) t").select(text.clean_text(F.col("t"))).first()[0] == ""


def test_ngrams(spark):
    tokens = F.array(*map(F.lit, "abc"))
    assert one(spark, text.ngrams(tokens, 1, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, text.ngrams(tokens, 4, 4)) == []
    assert one(spark, text.without_stop_words(F.array(F.lit("the"), F.lit("cat")))) == ["cat"]
    assert one(spark, text.split_contractions(F.lit("we cannot wanna scannot"))) == "we can not wan na scannot"
    assert len(set(text.STOP_WORDS)) == 318


@pytest.mark.parametrize(
    "index, expected",
    [({"The": [0, 3], "cat": [1], "x": [5]}, "The cat  The  x"), ({"one": [0]}, None), (None, None), ({"a": [0], "b": [0, 1]}, "b b"), ({"a": [2], "b": [3]}, "  a b")],
)
def test_inverted_index(spark, index, expected):
    df = spark.createDataFrame([(index,)], "m map<string,array<int>>")
    assert df.select(text.inverted_index_to_text("m")).first()[0] == expected


@few
@given(st.lists(st.sampled_from("abcdefg"), min_size=2, max_size=60))
def test_inverted_index_round_trip(spark, said):
    index = {w: [i for i, x in enumerate(said) if x == w] for w in said}
    df = spark.createDataFrame([(index,)], "m map<string,array<int>>")
    row = df.select(text.inverted_index_to_text("m"), text.last_position(F.col("m"))).first()
    assert row[0] == (" ".join(said) if len(index) > 1 else None) and row[1] == len(said) - 1


def test_ids(spark):
    assert one(spark, ids.url_to_id(F.lit(ids.BASE + "W123"))) == 123
    assert one(spark, ids.clean_domain(F.lit(ids.BASE + "domains/2"))) == 2
    assert one(spark, ids.clean_field(F.lit(ids.BASE + "fields/31"))) == 31
    assert one(spark, ids.clean_subfield(F.lit(ids.BASE + "subfields/3312"))) == 3312
    assert one(spark, ids.clean_source(F.lit(ids.BASE + "S9"))) == "9"
    assert one(spark, ids.source_id(F.lit(None).cast("string"))) == 0
    assert one(spark, ids.arxiv_id(F.lit("x http://arxiv.org/abs/2101.00001v2/y"))) == "2101.00001v2"
    assert one(spark, ids.arxiv_id(F.lit("https://arxiv.org/abs/cs/0101001"))) == "cs"
    assert one(spark, ids.arxiv_id(F.lit("none"))) is None
    words = F.array(*map(F.lit, ["https://github.com/a/b.git", "(github.com/c/d)", "x", "www.github.com/e/f/g"]))
    assert one(spark, ids.repositories(words)) == ["a/b", "c/d", "e/f"]
    assert [one(spark, ids.gender_code(F.lit(x))) for x in ("female", "male", "mostly_male")] == ["f", "m", "mostly_male"]
    assert one(spark, ids.seconds_since_2000()) > 8e8


def test_numbers(spark):
    assert one(spark, numbers.normalized_frequency(F.lit(3), F.lit(0))) == 0
    assert one(spark, numbers.normalized_frequency(F.lit(3), F.lit(2000))) == 1.5
    assert [one(spark, numbers.page_count(F.lit(n))) for n in (0, 1, 200, 201)] == [0, 1, 1, 2]
    assert one(spark, numbers.ratio_or(F.lit(1.0), F.lit(0.0), float("inf"))) == float("inf")
    assert one(spark, numbers.eta_seconds(F.lit(2), F.lit(6), F.lit(3.0))) == 6


def test_beta_closed_forms():
    p = np.array([0.001, 0.025, 0.5, 0.975])
    for n in (1.0, 3.0, 50.0, 1e6):
        assert np.allclose(beta.beta_ppf(p, n, 1.0), p ** (1 / n), rtol=1e-10)
        assert np.allclose(beta.beta_ppf(p, 1.0, n), -np.expm1(np.log1p(-p) / n), rtol=1e-10)
    assert np.isnan(beta.beta_ppf(0.5, 1.0, 0.0))[0] and np.isnan(beta.beta_ppf(0.5, 1.0, -3.0))[0]
    assert np.allclose(beta.beta_ppf(0.5, [2, 7, 1000], [2, 7, 1000]), 0.5)


def test_beta_inverts(spark):
    rng = np.random.default_rng(1)
    a, b, p = np.exp(rng.uniform(0, 12, 300)), np.exp(rng.uniform(0, 16, 300)), rng.uniform(0.01, 0.99, 300)
    assert np.allclose(beta.beta_cdf(beta.beta_ppf(p, a, b), a, b), p, rtol=1e-6)
    jvm = spark.sparkContext._jvm.org.apache.commons.math3.distribution.BetaDistribution
    for x, y in ((2.0, 9.0), (40.0, 3000.0), (700.0, 2e5)):
        for q in (0.025, 0.975):
            assert np.isclose(beta.beta_ppf(q, x, y)[0], jvm(x, y).inverseCumulativeProbability(q), rtol=1e-5)
