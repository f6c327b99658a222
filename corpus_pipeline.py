"""The corpus pipeline: toxicity, exact and near duplicates, decontamination, pieces.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm import decontaminate, exact_dedup, pieces, simhash, toxicity
from lexitide.llm.common import fits, held, materialize, table, text_of


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores 0.5 or more.

    Null text counts as empty.  Null ids are scored like others but never learnt
    from; repeated rows share their fate.  Without labels of both classes all
    stay.  Columns stay, whatever their names; no rows give no rows.
    """
    weights, intercept = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, weights, intercept)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id stays.

    Null text counts as empty; rows without an id go where another has the text.
    Of rows that repeat id and text one stays.  Columns stay, whatever their
    names; no rows give no rows.
    """
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row of the smallest doc_id stays.

    Null ids come last; of one doc_id's texts that of the smallest hash stays,
    and rows that repeat both stay or go together.  Null text counts as empty;
    texts without words are near each other.  Columns stay, whatever their
    names; no rows give no rows.
    """
    classes = simhash.verified_duplicates(docs)
    gone = materialize(classes.where("not kept").select(F.col("doc_id").alias("lost_id"), F.col("node").alias("lost")).distinct(), "near-copies")
    near = F.broadcast(gone) if fits(gone, 500_000) else gone
    rows = held(docs, doc_id=F.col("doc_id").cast("long"), node=F.xxhash64(text_of()))
    return rows.join(near, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("node") == F.col("lost")), "left_anti").select("held.*")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover at least half of a test item.

    Null text counts as empty and stays, as do rows of null ids; repeated rows
    share their fate.  Columns stay, whatever their names; no rows give no rows.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, the text's SentencePiece ids, in place of a column of that name.

    Null and empty text has no ids; null ids and repeated rows stay.  No rows
    give no rows.
    """
    return pieces.encode(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("sentencepiece", as_pieces),
]

#: SQL can't express the classifier, the fingerprint search or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
