"""Token counts as an exact histogram of encoded lengths.

One scan encodes every document and adds its length to a histogram inside the
worker; only histogram rows are shuffled.  Suffix sums over the histogram then
answer, for every context limit, how many documents and tokens reach it, which
quantile it is and how many tokens truncation to it leaves.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, text_of

_SPAN = 1024


@lru_cache(maxsize=2)
def encoding(vocabulary: str | None = None):
    """A tiktoken encoding of a ranks file, without special tokens; by default the public 50k byte-level BPE."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(n_tokens, docs): how many rows encode to each length.

    Null text counts as empty and has 0 tokens; repeated rows count each.  Other
    columns are ignored.  ``vocabulary`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoding(vocabulary), Counter()
        for batch in (part for whole in batches for part in slices(whole, 0)):
            seen.update(len(own.encode_ordinary(t)) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "docs"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """:func:`context_limits` for given limits, whether or not a document has such a length.

    Limits repeat once; null and negative ones are ignored.  An empty histogram
    gives no rows.
    """
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(n), 0) for n in sorted({n for n in limits if n is not None and n >= 0})], "n_tokens long, docs long")
    own = histogram.select("n_tokens", "docs").unionByName(wanted).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))
    return context_limits(own).where("quantile is not null").join(F.broadcast(wanted.select("n_tokens")), "n_tokens", "left_semi")


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, as a context limit.

    docs and tokens of that length; docs_ge and tokens_ge of at least it;
    truncated_tokens left when longer documents are cut to it; quantile, the
    share of documents of at most it.  Sums run within spans of lengths and
    over the spans' totals, so no task sorts the whole histogram.  An empty
    histogram gives no rows.
    """
    h = materialize(histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / _SPAN).alias("span")), "histogram")
    spans = h.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # one row a span: the longest document's length over 1024
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    totals = spans.select("span", F.coalesce(F.sum("d").over(later), zero).alias("d"), F.coalesce(F.sum("t").over(later), zero).alias("t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    own = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    ge = h.join(totals, "span").withColumn("docs_ge", F.sum("docs").over(own) + F.col("d")).withColumn("tokens_ge", F.sum("tokens").over(own) + F.col("t"))
    return ge.select(
        "n_tokens", "docs", "tokens", "docs_ge", "tokens_ge",
        (F.col("all_t") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        F.try_divide(F.col("all_d") - F.col("docs_ge") + F.col("docs"), F.col("all_d")).alias("quantile"),
    )
