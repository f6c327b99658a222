"""New pages of works into the tables, by the file source's own checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import IngestConfig
from ..plans.ingest import add_works
from ..schema import WORK_DDL
from ..sources.pages import _typed


def works_stream(spark: SparkSession, source: str, max_files: int = 1000) -> DataFrame:
    """Records of pages as they appear, with _file and _ordinal."""
    pages = (
        spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*gz").option("maxFilesPerTrigger", max_files).format("text").load(source)
    )
    records = pages.select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.from_json("value", f"array<struct<{_typed(WORK_DDL)}>>")).alias("_ordinal", "work"))
    return records.select("_file", "_ordinal", "work.*")


def ingest_available(spark: SparkSession, source: str, target: str, checkpoint: str, config: IngestConfig = IngestConfig(), genders: DataFrame | None = None) -> StreamingQuery:
    """Starts a query that adds all pages not seen under ``checkpoint``, in batches, and ends.

    A batch that is repeated after a failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        add_works(batch, target, config, genders)

    return works_stream(spark, source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
