"""Gzipped JSON pages of works and concepts, and the manifest of processed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONCEPT_DDL, WORK_DDL

MANIFEST_DDL = "path string"


def page_files(spark: SparkSession, root: str, pattern: str | None = None, glob: str = "*gz") -> DataFrame:
    """(path) of the files below ``root``; ``pattern`` is a regular expression for the start of the path.

    Only listed, never opened: the text column is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    return files.where(F.regexp_replace("path", "^file:/*", "/").rlike(f"^(?:{pattern})")) if pattern else files


def _pages(spark: SparkSession, root: str, pattern: str | None, glob: str) -> DataFrame:
    """(_file, value): one row a file, so that a record's place in its page is known; files spread over tasks."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true")
    rows = reader.text(root).select(F.col("_metadata.file_path").alias("_file"), "value")
    return rows.where(F.regexp_replace("_file", "^file:/*", "/").rlike(f"^(?:{pattern})")) if pattern else rows


def read_works(spark: SparkSession, root: str, pattern: str | None = None, processed: DataFrame | None = None, glob: str = "*gz") -> DataFrame:
    """Records of all works pages with _file and _ordinal (place in the page).

    ``processed`` (path) names files to skip.  A page is one JSON array; a page
    that is no such array gives no records, as does an empty one.
    """
    rows = _pages(spark, root, pattern, glob)
    if processed is not None:
        rows = rows.join(processed.select(F.col("path").alias("_file")).distinct(), "_file", "left_anti")
    records = rows.select("_file", F.posexplode(F.from_json("value", f"array<struct<{_typed(WORK_DDL)}>>")).alias("_ordinal", "work"))
    return records.select("_file", "_ordinal", "work.*")


def read_concepts(spark: SparkSession, root: str, pattern: str | None = None, glob: str = "*gz") -> DataFrame:
    """Concept records of pages that hold an object with the key results; all files, every time."""
    rows = _pages(spark, root, pattern, glob)
    parsed = rows.select("_file", F.from_json("value", f"results array<struct<{_typed(CONCEPT_DDL)}>>").alias("page"))
    return parsed.select("_file", F.posexplode("page.results").alias("_ordinal", "concept")).select("_file", "_ordinal", "concept.*")


def _typed(ddl: str) -> str:
    """A column list with colons, as struct<...> wants it."""
    out, depth = [], 0
    part = ""
    for ch in " ".join(ddl.split()) + ",":
        depth += (ch in "<") - (ch in ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Paths of processed files; none where the manifest does not exist yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST_DDL).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST_DDL)


def write_pages(records: DataFrame, path: str, records_per_page: int = 200) -> int:
    """Gzipped JSON lines of at most ``records_per_page`` records a file; returns and marks how many pages there are, last of all."""
    spark = records.sparkSession
    records.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", records_per_page).json(path)
    n = page_files(spark, path).count()
    spark.createDataFrame([(n,)], "pages long").coalesce(1).write.mode("overwrite").json(f"{path}/DONE")
    return n


def pages_done(spark: SparkSession, path: str) -> int | None:
    """The page count that a finished :func:`write_pages` left, None where it didn't finish."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema("pages long").json(f"{path}/DONE").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found and found.pages


def missing_pages(shards: DataFrame, pages: DataFrame, page: int = 200) -> DataFrame:
    """(shard, page): pages that shards (shard, n) should have and ``pages`` (shard, page) lacks; shards of 0 rows lack none."""
    due = shards.where("n > 0").select("shard", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("n") + (page - 1)) / page).cast("long"))).alias("page"))
    return due.join(pages.select("shard", "page"), ["shard", "page"], "left_anti")
