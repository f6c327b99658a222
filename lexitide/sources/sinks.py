"""Writers: tables, exports and external databases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedupe import insert_ignore
from ..schema import INDEXES, KEYS, TABLES, struct

CSV_COLUMNS = "ngram fold_change fold_change_ci_lower fold_change_ci_upper max_frequency min_frequency max_year min_year years_present total_frequency document_frequency estimated_total_count_lower".split()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A star-schema table, empty where it was never written."""
    from pyspark.errors import AnalysisException

    schema: T.StructType = struct(TABLES[name])
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(root: str, name: str, incoming: DataFrame) -> None:
    """Appends rows whose key the stored table lacks.

    Files are sorted by the table's indexed columns, so that a filter on the
    first of them reads only the row groups whose range it meets.
    """
    existing = read_table(incoming.sparkSession, root, name)
    new = insert_ignore(existing, incoming, list(KEYS[name]))
    order = INDEXES.get(name)
    (new.sortWithinPartitions(*order) if order else new).write.mode("append").parquet(f"{root}/{name}")


def replace_table(root: str, name: str, rows: DataFrame) -> None:
    """Overwrites a table; an empty one is written too."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}")


def export_significant(results: DataFrame, path: str) -> None:
    """CSV of the significant n-grams, largest fold change first; a header alone if there are none."""
    chosen = results.where("statistically_significant").orderBy(F.desc("fold_change"), "ngram").select(*CSV_COLUMNS)
    chosen.write.mode("overwrite").option("header", "true").csv(path)


def time_series(results: DataFrame) -> DataFrame:
    """One row for each n-gram and year."""
    exploded = results.select("ngram", F.explode("yearly_frequencies").alias("year", "normalized_frequency"), "fold_change", "estimated_total_count_lower", "statistically_significant")
    return exploded.withColumnRenamed("statistically_significant", "significant")


def export_time_series(results: DataFrame, path: str) -> None:
    time_series(results).write.mode("overwrite").option("header", "true").csv(path)


def export_articles(mapping: DataFrame, path: str) -> None:
    """n-gram -> article ids as Parquet; one row an article, so a frequent n-gram is no huge array."""
    mapping.write.mode("overwrite").parquet(path)


def database_kind(url: str) -> str:
    """The dialect that a database address names."""
    scheme = url.split("://", 1)[0].removeprefix("jdbc:").split("+")[0].split(":")[0].lower()
    return {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mysql", "sqlite": "sqlite"}.get(scheme, "unknown")


def quoted(name: str, kind: str) -> str:
    mark = "`" if kind == "mysql" else '"'
    return f"{mark}{name.replace(mark, mark * 2)}{mark}"


def insert_ignore_sql(kind: str, table: str, columns: list[str], conflict: list[str] | None = None) -> str:
    """A prepared insert that skips rows whose key exists; unknown dialects get SQLite's form."""
    names = ", ".join(quoted(c, kind) for c in columns)
    into = f"INTO {quoted(table, kind)} ({names}) VALUES ({', '.join('?' * len(columns))})"
    if kind == "postgresql":
        target = f" ({', '.join(quoted(c, kind) for c in conflict)})" if conflict else ""
        return f"INSERT {into} ON CONFLICT{target} DO NOTHING"
    return f"INSERT {'IGNORE' if kind == 'mysql' else 'OR IGNORE'} {into}"


def insert_ignore_rows(rows: DataFrame, connect: Callable[[], object], kind: str, table: str, conflict: list[str] | None = None, batch: int = 10_000, mark: str = "?") -> None:
    """Adds the rows whose key an external database lacks, through its own insert-ignore.

    ``connect`` opens a DB-API connection on the executor; each partition
    commits once, and a repeated task adds nothing twice.  ``mark`` is the
    driver's placeholder.  Rows with arrays must be encoded before.
    """
    statement = insert_ignore_sql(kind, table, rows.columns, conflict).replace("?", mark)

    def run(part: Iterator) -> None:
        held = connect()
        try:
            cursor = held.cursor()
            while chunk := [tuple(r) for r in islice(part, batch)]:
                cursor.executemany(statement, chunk)
            held.commit()
        finally:
            held.close()

    rows.foreachPartition(run)


def write_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch: int = 10_000) -> None:
    """Appends to an external database through Spark's JDBC writer."""
    rows.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties or {})


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None) -> DataFrame:
    """The result of a query in an external database."""
    return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()
