"""Shared plumbing of the training-data operators.

Intermediate tables go to the folder every executor shares
(``spark.checkpoint.dir``), so a lost executor costs a re-read and never a
recomputation of the whole lineage.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import discard, new_path, staged
from ..sources.scan import scan

materialize = staged
__all__ = ["discard", "fits", "held", "join_checked", "materialize", "new_path", "release", "slices", "table", "text_of", "tokens_in"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet") if name in ("documents", "pages") else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held(docs: DataFrame, **keys: Column) -> DataFrame:
    """(held, keys): all columns in one struct, so that no name of theirs meets a key's; ``select("held.*")`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), *[k.alias(name) for name, k in keys.items()])


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more of it than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int = 500_000) -> DataFrame:
    """Join narrow rows to ``left``: broadcast after counting them, else shuffle both sides."""
    return left.join(F.broadcast(right) if fits(right, rows) else right, on, how)


def slices(batch: pa.RecordBatch, *columns: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of some text or binary columns: a worker turns no more than that into Python objects at once."""
    if not batch.num_rows:
        yield batch
        return
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield batch.slice(i, j - i)


def tokens_in(text: bytes, token: re.Pattern, gap: re.Pattern, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The tokens of a text, some ``size`` bytes of it at a time; ``gap`` finds a place between tokens."""
    at = 0
    while at < len(text):
        cut = gap.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield token.findall(text, at, end)
        at = end


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc
