import pytest
from conftest import DATA
from oracle import assert_same

from lexitide.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    sf_dir = f"{DATA}/sf0.001"
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert_same(df, catalogue.ORACLES[name], sf_dir)
    else:
        df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("partitions", [1, 16])
def test_repartitioning_changes_nothing(spark, partitions):
    sf_dir = f"{DATA}/sf0.001"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("fold_change_stats", "first_wins_topics", "random_order"):
            assert_same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name], sf_dir)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scans_are_pruned(spark):
    plan = catalogue.word_count_by_year(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "o_totalprice" not in plan and "EqualTo(lang,en)" in plan
