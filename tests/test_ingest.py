import gzip
import json
import os

import pytest

from lexitide.config import IngestConfig
from lexitide.functions.ids import BASE
from lexitide.plans import ingest
from lexitide.sources import pages, sinks
from lexitide.streaming.ingest import ingest_available


def work(n, **changes):
    topic = {"id": f"{BASE}T7", "display_name": "seven", "score": 0.5, **{k: {"id": f"{BASE}{k}s/{i}"} for k, i in (("domain", 2), ("field", 33), ("subfield", 3312))}}
    inst = {"id": f"{BASE}I5", "display_name": "five", "country_code": "SE", "type": "education", "lineage": [f"{BASE}I5", f"{BASE}I6"]}
    return {
        "id": f"{BASE}W{n}", "title": f"title {n}", "publication_year": 2020, "publication_date": "2020-02-03", "language": "en",
        "primary_location": {"source": {"id": f"{BASE}S11"}}, "primary_topic": {k: topic[k] for k in ("domain", "field", "subfield")},
        "locations": [{"is_oa": False, "landing_page_url": "closed"}, {"is_oa": True, "landing_page_url": None}, {"is_oa": True, "landing_page_url": f"open{n}"}],
        "abstract_inverted_index": {"two": [0], "words": [1]}, "topics": [topic, {**topic, "id": f"{BASE}T8", "display_name": "eight"}],
        "referenced_works": [f"{BASE}W99"],
        "authorships": [{"author_position": "first", "author": {"id": f"{BASE}A1", "display_name": "Ann", "orcid": None}, "institutions": [inst]},
                        {"author_position": "last", "author": {"id": f"{BASE}A1", "display_name": "Ann again", "orcid": "o"}, "institutions": []}],
    } | changes


def put(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with gzip.open(f"{folder}/{name}", "wt") as file:
        json.dump(content, file)


def table(spark, root, name):
    return [tuple(r) for r in sinks.read_table(spark, root, name).collect()]


def test_compile_works(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    put(f"{source}/gold/0", "page_1.gz", [
        work(1, language="fr"), work(1), work(1, title="second"), work(2, publication_year=2011), work(3, language=None), work(4, primary_topic=None),
        work(5, primary_location=None, abstract_inverted_index={"single": [0]}), work(6, primary_location={"source": None}, abstract_inverted_index=None, publication_year=2012),
    ])
    assert ingest.compile_works(spark, source, target, IngestConfig(enable_references=True)) == {"articles": 3, "open_locations": 6}
    articles = {r[0]: r for r in table(spark, target, "articles")}
    assert set(articles) == {1, 5, 6} and articles[1][1] == "title 1" and articles[1][10] == "open1" and articles[1][12] == 11
    assert articles[5][12] == 0 and articles[6][12] == 0 and articles[1][7] == [2, 2] and articles[1][4:7] == (2, 33, 3312)
    assert table(spark, target, "abstracts") == [(1, "two words")]
    assert table(spark, target, "authors") == [(1, "Ann", None, None)]
    assert table(spark, target, "institutions") == [(5, "five", "SE", [6])]
    assert sorted(table(spark, target, "articles_authors")) == [(n, 1, "first") for n in (1, 5, 6)]
    assert sorted(table(spark, target, "articles_topics"))[:2] == [(1, 7, 0.5), (1, 8, 0.5)]
    assert sorted(table(spark, target, "references")) == [(n, 99) for n in (1, 5, 6)]
    assert [r.problem for r in spark.read.parquet(f"{target}/quarantine").collect()] == ["primary_topic"]
    put(f"{source}/gold/0", "page_2.gz", [work(1, title="late"), work(7)])
    ingest.compile_works(spark, source, target)
    ingest.compile_works(spark, source, target)
    articles = {r[0]: r[1] for r in table(spark, target, "articles")}
    assert articles[1] == "title 1" and set(articles) == {1, 5, 6, 7}
    assert pages.read_manifest(spark, f"{target}/manifest").count() == 2
    assert {r.table: r.n for r in ingest.stats(spark, target).collect()} == {"articles": 4, "authors": 1, "institutions": 1, "topics": 2, "concepts": 0, "references": 3}


def test_pattern_and_failure(spark, tmp_path):
    source = str(tmp_path / "in")
    put(f"{source}/gold", "a.gz", [work(1)])
    put(f"{source}/bronze", "b.gz", [work(2, publication_date="soon")])
    ingest.compile_works(spark, source, str(tmp_path / "x"), pattern=f"{source}/gold")
    assert [r[0] for r in table(spark, str(tmp_path / "x"), "articles")] == [1]
    with pytest.raises(Exception, match="bad record"):
        ingest.compile_works(spark, source, str(tmp_path / "y"), IngestConfig(on_bad_record="fail"))


def test_genders_and_concepts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    put(f"{source}/w", "a.gz", [work(1)])
    put(f"{source}/c", "c.gz", {"results": [{"id": f"{BASE}C2", "display_name": "b", "level": 1}, {"id": f"{BASE}C2", "display_name": "late", "level": 2}]})
    ingest.compile_works(spark, f"{source}/w", target, genders=spark.createDataFrame([("Ann", "female")], "name string, gender string"))
    ingest.compile_concepts(spark, f"{source}/c", target)
    ingest.compile_concepts(spark, f"{source}/c", target)
    assert table(spark, target, "authors")[0][3] == "f" and table(spark, target, "concepts") == [(2, "b", 1)]


def test_stream(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(source, "a.gz", [work(1), work(2)])
    ingest_available(spark, source, target, checkpoint).awaitTermination()
    put(source, "b.gz", [work(2), work(3)])
    ingest_available(spark, source, target, checkpoint).awaitTermination()
    assert sorted(r[0] for r in table(spark, target, "articles")) == [1, 2, 3]


def test_sinks(spark, tmp_path):
    assert sinks.database_kind("postgresql+psycopg2://x") == "postgresql" and sinks.database_kind("jdbc:mysql://x") == "mysql"
    assert sinks.database_kind("sqlite:///f") == "sqlite" and sinks.database_kind("oracle://x") == "unknown"
    assert sinks.insert_ignore_sql("postgresql", "t", ["a", "b"], ["a"]) == 'INSERT INTO "t" ("a", "b") VALUES (?, ?) ON CONFLICT ("a") DO NOTHING'
    assert sinks.insert_ignore_sql("mysql", "t", ["a"]) == "INSERT IGNORE INTO `t` (`a`) VALUES (?)"
    assert sinks.insert_ignore_sql("unknown", "t", ["a"]) == 'INSERT OR IGNORE INTO "t" ("a") VALUES (?)'
    assert pages.pages_done(spark, str(tmp_path / "p")) is None
    made = pages.write_pages(spark.range(5), str(tmp_path / "p"), 2)
    assert made == pages.pages_done(spark, str(tmp_path / "p")) >= 3
    files = os.listdir(tmp_path / "p")
    assert "_SUCCESS" in files and sum(f.endswith(".json.gz") for f in files) >= 3
    assert spark.read.json(str(tmp_path / "p")).count() == 5


def test_rest_source(spark):
    import api_stub

    from lexitide.sources.rest import WorksReader, WorksSource

    options = {"endpoint": "https://api.example", "first_year": "2024", "last_year": "2025", "split_at": "10", "page": "2", "opener": "api_stub:answer"}
    shards = WorksReader(options).partitions()
    assert [(s.year, s.subfield, s.topic) for s in shards] == [(y, f, t) for y in (2025, 2024) for f, t in (("1", None), ("2", "1"), ("2", "2"))]
    assert [len(list(WorksReader(options).read(s))) for s in shards[:2]] == [3, 6]
    spark.sparkContext.addPyFile(api_stub.__file__)
    spark.dataSource.register(WorksSource)
    works = spark.read.format("works_api").options(**options).load()
    assert works.count() == 30
    recent = works.where("year = 2025 and subfield = '2' and oa_status in ('gold', 'green')")
    assert recent.rdd.getNumPartitions() == 2 and recent.count() == 12


def test_contradictory_filters(spark):
    import api_stub
    from pyspark.sql.datasource import EqualTo, In

    from lexitide.sources.rest import WorksReader, WorksSource

    options = {"endpoint": "https://api.example", "first_year": "2024", "last_year": "2025", "split_at": "10", "page": "2", "opener": "api_stub:answer"}
    for column, values in (("subfield", ("1", "2")), ("year", (2024, 2025)), ("year", (1990, 1990)), ("year", (1990, 2024))):
        reader = WorksReader(options)
        filters = [EqualTo((column,), v) for v in values]
        assert list(reader.pushFilters(filters)) == filters and reader.partitions() == []
    reader = WorksReader(options)
    list(reader.pushFilters([In(("subfield",), ("1", "2")), EqualTo(("subfield",), "1"), EqualTo(("year",), 2024)]))
    assert [(s.year, s.subfield) for s in reader.partitions()] == [(2024, "1")]
    spark.sparkContext.addPyFile(api_stub.__file__)
    spark.dataSource.register(WorksSource)
    works = spark.read.format("works_api").options(**options).load()
    assert works.where("subfield = '1' and subfield = '2'").count() == 0 and works.where("year = 1990").count() == 0


def test_failures_are_tried_again(monkeypatch):
    from urllib.error import HTTPError

    from lexitide.sources.rest import WorksReader

    waits, left = [], [HTTPError("u", 429, "slow down", {"Retry-After": "7"}, None), OSError("broken"), HTTPError("u", 503, "busy", {}, None)]

    def answer(address):
        if left:
            raise left.pop(0)
        return {"meta": {"count": 4}}

    monkeypatch.setattr("lexitide.sources.rest.time.sleep", waits.append)
    monkeypatch.setattr("lexitide.sources.rest.fetch", answer)
    reader = WorksReader({"wait": "1"})
    assert reader._count("x") == 4 and waits == [7, 2, 4]
    left += [HTTPError("u", 404, "none", {}, None)]
    with pytest.raises(HTTPError):
        reader._count("x")
    left += [OSError("broken")] * 2
    with pytest.raises(OSError):
        WorksReader({"retries": "1"})._count("x")


def test_external_database(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "own.db")
    with sqlite3.connect(path) as db:
        db.execute('create table "topics" ("topic_id" integer primary key, "name" text)')

    def connect():
        import sqlite3

        return sqlite3.connect(path, timeout=60)

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "late")], "topic_id long, name string").coalesce(1)
    for more in (rows, rows.unionByName(spark.createDataFrame([(3, 'q"uote?')], rows.schema))):
        sinks.insert_ignore_rows(more, connect, "sqlite", "topics", ["topic_id"], batch=2)
    with sqlite3.connect(path) as db:
        assert sorted(db.execute("select * from topics")) == [(1, "a"), (2, "b"), (3, 'q"uote?')]


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/derby;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    sinks.write_jdbc(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), url, "own", driver)
    sinks.write_jdbc(spark.createDataFrame([(3, "c")], "id long, name string"), url, "own", driver)
    got = sinks.read_jdbc(spark, url, 'select "id", "name" from own where "id" > 1', driver).collect()
    assert sorted(tuple(r) for r in got) == [(2, "b"), (3, "c")]


def test_stored_tables_are_sorted(spark, tmp_path):
    rows = spark.range(50).selectExpr("id as author_id", "cast(1000 - id as string) as name", "'' as orcid", "'f' as gender").repartition(2)
    sinks.append_new(str(tmp_path), "authors", rows)
    for file in {r.f for r in spark.read.parquet(f"{tmp_path}/authors").selectExpr("input_file_name() as f").collect()}:
        names = [r.name for r in spark.read.parquet(file).coalesce(1).collect()]
        assert names == sorted(names)
