"""Pages of works and concepts -> star schema tables, incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import IngestConfig
from ..operators import normalize
from ..operators.staging import staged
from ..schema import COUNTED
from ..sources import pages, sinks

_ENTITIES = ("authors", "institutions", "topics")


def compile_works(spark: SparkSession, source: str, target: str, config: IngestConfig = IngestConfig(), pattern: str | None = None, genders: DataFrame | None = None) -> dict:
    """Adds the works of all unprocessed pages below ``source`` to the tables below ``target``.

    Articles that are stored already stay as they are, their children too.  The
    manifest of processed files is written last, so a run that is cut off is
    repeated and adds nothing twice.  Records that can't be normalised go to
    ``target``/quarantine.  Returns :func:`add_works`' observations, or nothing
    where no file is new.
    """
    manifest = f"{target}/manifest"
    listed = pages.page_files(spark, source, pattern)
    # the file listing and the records' own paths name files alike
    due = staged(listed.join(pages.read_manifest(spark, manifest), "path", "left_anti"), "due-files")
    if due.isEmpty():
        return {}
    works = pages.read_works(spark, source, pattern, processed=pages.read_manifest(spark, manifest))
    seen = add_works(works, target, config, genders)
    due.write.mode("append").parquet(manifest)
    return seen


def add_works(works: DataFrame, target: str, config: IngestConfig = IngestConfig(), genders: DataFrame | None = None) -> dict:
    """Adds work records (with _file and _ordinal) to the tables below ``target``.

    Returns what was observed on the way: articles added and open locations looked at.
    """
    spark = works.sparkSession
    good, bad = normalize.winners(works, config)
    stored = sinks.read_table(spark, target, "articles").select("article_id")
    seen = Observation("ingest")
    counted = good.join(stored, "article_id", "left_anti").observe(seen, F.count("*").alias("articles"), F.sum(normalize.open_locations_seen(F.col("locations"))).alias("open_locations"))
    good = staged(counted, "works")
    if config.on_bad_record == "quarantine":
        bad.select(F.col("_file").alias("file"), F.col("_ordinal").alias("ordinal"), "id", "problem").write.mode("append").parquet(f"{target}/quarantine")
    made = normalize.tables(good, config, genders)
    # articles last: until they are stored, a repeated run adds whatever of their children is missing
    for name in sorted(made, key=lambda n: (n == "articles", n not in _ENTITIES, n)):
        sinks.append_new(target, name, made[name])
    return seen.get


def compile_concepts(spark: SparkSession, source: str, target: str, config: IngestConfig = IngestConfig(), pattern: str | None = None) -> None:
    """Adds all concepts below ``source``; files are read every time and known concepts ignored."""
    sinks.append_new(target, "concepts", normalize.concepts(pages.read_concepts(spark, source, pattern), config))


def table_counts(counted: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each named table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in counted.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stats(spark: SparkSession, target: str) -> DataFrame:
    return table_counts({name: sinks.read_table(spark, target, name) for name in COUNTED})
