"""Exact deduplication by progressive refinement.

Documents are grouped by length, the groups that survive by a hash of a prefix,
and the groups that survive that by a hash of the full content.  Only narrow
rows (ids, lengths, hashes) are ever shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, held, materialize, text_of

PREFIX = 64
BROADCAST_KEYS = 500_000
_RUN = 65_536


def _keys(prefix: int) -> dict[str, Column]:
    return {"doc_id": F.col("doc_id").cast("long"), "len": F.length(text_of()), "head": F.xxhash64(F.substring(text_of(), 1, prefix)), "text": text_of()}


def _heads(docs: DataFrame, prefix: int, broadcast_keys: int) -> DataFrame | None:
    """(len, head, again) of the lengths and prefix hashes that occur twice; None if they are too many to broadcast."""
    narrow = materialize(docs.select(*[_keys(prefix)[k].alias(k) for k in ("len", "head")]), "lengths")
    lengths = narrow.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len")
    shared = lengths if not fits(lengths, broadcast_keys) else F.broadcast(lengths)
    heads = materialize(narrow.join(shared, "len", "left_semi").groupBy("len", "head").agg(F.count("*").alias("n")).where("n > 1").select("len", "head", F.lit(True).alias("again")), "heads")
    return heads if fits(heads, broadcast_keys) else None


def _refined(docs: DataFrame, prefix: int, heads: DataFrame | None, digests: bool = False, whole: bool = False) -> DataFrame:
    """(held, doc_id, len, head, again, full) of every row; held, the row itself, only if ``whole``."""
    keys = _keys(prefix)
    rows = held(docs, **keys) if whole else docs.select(*[c.alias(k) for k, c in keys.items()])
    if heads is not None:
        rows = rows.join(F.broadcast(heads), ["len", "head"], "left").withColumn("again", F.coalesce("again", F.lit(False)))
    else:
        rows = rows.withColumn("again", F.lit(True))
    full = F.sha2("text", 256) if digests else F.when(F.col("again"), F.sha2("text", 256))
    return rows.withColumn("full", full).select(*["held"] * whole, "doc_id", "len", "head", "again", "full")


def _groups(keyed: DataFrame) -> DataFrame:
    """(len, head, full, doc_id, copies, keep_id, group_size) of the rows that share a length and a prefix hash."""
    # repeated ids are counted, not listed: a group's rows meet only in counts
    each = keyed.where("again").groupBy("len", "head", "full", "doc_id").agg(F.count("*").alias("copies"))
    groups = each.groupBy("len", "head", "full").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return each.join(groups, ["len", "head", "full"])


def duplicate_groups(docs: DataFrame, prefix: int = PREFIX, broadcast_keys: int = BROADCAST_KEYS, digests: bool = False) -> DataFrame:
    """(doc_id, head, full, keep_id, group_size, kept) of every row; equal texts form a group.

    head is the prefix hash; full the hex SHA-256 of the text, null where the
    refinement never had to read it, unless ``digests`` asks for those too.

    Null text counts as empty.  The largest doc_id of a group is its keep_id,
    null if no row has one; exactly one row of a group is kept, also where a
    doc_id repeats or is null.  Other columns are ignored, whatever their names;
    no rows give no rows.

    Full hashes are taken only of rows whose (length, prefix hash) occurs
    twice.  Those keys are broadcast if they are at most ``broadcast_keys``;
    beyond it every row is hashed in the scan, which is cheaper than to shuffle
    texts to the keys and gives the same groups.
    """
    keyed = materialize(_refined(docs, prefix, _heads(docs, prefix, broadcast_keys), digests), "keys")
    alone = keyed.where("not again").select("doc_id", "head", "full", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # in two steps, as no array can count the rows of a null id that holds very many
    runs = _groups(keyed).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_RUN}"))))
    copies = runs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_RUN), F.col("copies") - F.col("run") * _RUN)))).withColumn("copy", F.col("copy") + F.col("run") * _RUN)
    return alone.unionByName(copies.select("doc_id", "head", "full", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept")))


def drop_duplicates(docs: DataFrame, prefix: int = PREFIX, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged, whatever their names.

    Null text counts as empty.  The row of the largest doc_id stays, of rows
    without an id only one where no other has the text.  Rows that repeat both
    the doc_id and the text that stay (null and empty text alike) are told apart
    by nothing, so any one of them does.  No rows give no rows.
    """
    heads = _heads(docs, prefix, broadcast_keys)
    keyed = materialize(_refined(docs, prefix, heads), "keys")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = _groups(keyed).where(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("lost_id"), F.col("full").alias("lost_full"), stays.alias("repeats"))
    lost = materialize(lost, "dropped")
    small = F.broadcast(lost) if fits(lost, broadcast_keys) else lost
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("full") == F.col("lost_full"))

    def matched(which: DataFrame, how: str) -> DataFrame:
        return _refined(docs, prefix, heads, whole=True).join(which, same, how)

    kept = matched(small, "left_anti").select("held.*")
    if lost.where("repeats").isEmpty():
        return kept
    again = matched(small.where("repeats"), "left_semi").dropDuplicates(["doc_id", "full"]).select("held.*")
    return kept.unionByName(again)
