"""SimHash near-duplicates through sharded BK-trees.

Fingerprints within ``radius`` bits of each other agree on all bits of at least
``blocks - radius`` of ``blocks`` bit blocks.  Each choice of agreeing blocks
and each value of their bits is one *shard*; every shard holds a BK-tree whose
children are keyed by their integer Hamming distance to the parent, and a
search follows only edges within the radius of the distance at hand.  The
shard's tree travels with the shard's queries through one shuffle, so nothing
that grows with the corpus is broadcast to all executors.  A shard of more than
``tree_limit`` fingerprints is cut into slices, and each pair of slices becomes
a task of its own: no shard is gathered whole, none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_checked, materialize, release, slices, text_of
from .components import connected_components

TREE_LIMIT = 4096
#: Pairs a search holds at once, and items a forest does.
_PAIRS, _ITEMS = 1_000_000, 100_000
#: Shingles that OFTEN texts of one in SAMPLE hold, FREQUENT of them at most, come last in the order; it speeds the search and changes no result.
SAMPLE, OFTEN, FREQUENT = 16, 3, 1 << 18
#: Texts with one shingle in common beyond which they are linked one to the next first.
RUN = 8
#: Keeps rounding from excluding a pair at the threshold.
SLACK = 1e-6


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z only; splits at ASCII white space only."""
    return text.lower().split()


def shingles(text: bytes, width: int) -> list[bytes]:
    """All runs of ``width`` words, repeats included; of fewer words, their whole sequence."""
    words = words_of(text)
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [joined[i : j - 1] for i, j in zip(starts, starts[width:])]


def hashes(parts: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64, len(parts))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer; 0 of none."""
    n = len(h)
    if not n:
        return 0
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    counts = bits[whole:].sum(0, dtype=np.int64)
    if whole:  # sums of 255 rows fit in a byte, which numpy adds several at a time
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seeds: tuple[int, ...] = (42,), id_column: str = "doc_id") -> DataFrame:
    """(id_column, fp array of signed longs, one for each seed).

    Each is taken over all runs of ``width`` words, repeats included.  Null
    text counts as empty; texts without words have 0.  Null ids stay, repeated
    rows repeat, other columns are ignored.  No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                parts = shingles(text, width)
                out.append([majority(hashes(parts, s)) for s in seeds])
            flat = np.array(out, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(seeds)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_column, "fp"])

    schema = T.StructType([T.StructField(id_column, T.LongType()), T.StructField("fp", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_column).cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks (signed) of every choice of blocks that near fingerprints may agree on."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(items: int, radius: int = 4, shard: int = 16) -> int:
    """The least number of blocks, ``radius`` + 2 at least, by which that many evenly spread fingerprints make shards of about ``shard`` or fewer."""
    blocks = radius + 2
    while blocks < 16 and items >> (64 * (blocks - radius) // blocks) > shard:
        blocks += 1
    return blocks


class BKForest:
    """The BK-trees of many shards in one array, built and searched level by level."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps, n = fps, len(fps)
        first = np.unique(shard, return_index=True)[1]
        self.root = first[np.searchsorted(shard[first], shard)]
        self.child = np.full((n, 65), -1, np.int32)
        item = np.setdiff1d(np.arange(n), first)
        at = self.root[item]
        while len(item):
            d = np.bitwise_count(fps[item] ^ fps[at])
            found = self.child[at, d]
            free = found < 0
            key = at[free].astype(np.int64) * 65 + d[free]
            slots, lowest = np.unique(key, return_index=True)
            self.child.reshape(-1)[slots] = item[free][lowest]
            down = self.child[at, d]
            stay = down != item
            item, at = item[stay], down[stay]

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, earlier neighbour, distance) of all neighbours within the radius."""
        got, q, at = [], queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[at]).astype(np.int64)
            hit = (d <= radius) & (at < q)
            got.append((q[hit], at[hit], d[hit]))
            nq, nat = [], []
            for edge in range(-radius, radius + 1):
                e = d + edge
                down = np.where((e >= 0) & (e <= 64), self.child[at, np.clip(e, 0, 64)], -1)
                go = (down >= 0) & (down < q)  # children come after their parents: a later one has no earlier below it
                nq.append(q[go])
                nat.append(down[go])
            q, at = np.concatenate(nq), np.concatenate(nat)
        return tuple(np.concatenate(x) for x in zip(*got))


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _shard_links(node: np.ndarray, fps: np.ndarray, shard: np.ndarray, radius: int, direct: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of many shards that connect what chains of neighbours connect.

    With ``direct`` both ends of a link are neighbours: each item and its
    nearest earlier one, and one pair for each two groups still apart.
    """
    forest, sizes = BKForest(fps, shard), np.bincount(shard)[shard]
    cuts = np.cumsum(sizes) // _PAIRS
    parent, pairs = np.arange(len(fps)), []
    for chunk in np.split(np.arange(len(fps)), np.flatnonzero(np.diff(cuts)) + 1):
        q, at, d = forest.search(chunk, radius)
        if not direct:
            _hook(parent, q, at)
            continue
        order = np.lexsort((at, d, q))
        q, at = q[order], at[order]
        lead = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
        while lead.any():
            pairs.append((q[lead], at[lead]))
            _hook(parent, q[lead], at[lead])
            apart = parent[q] != parent[at]
            q, at = q[apart], at[apart]
            lead = np.zeros(len(q), bool)
            lead[np.unique(np.maximum(parent[q], parent[at]), return_index=True)[1]] = True
    if direct:
        q, at = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
        return node[q], node[at]
    tied = np.flatnonzero(parent != np.arange(len(fps)))
    return node[tied], node[parent[tied]]


def links(items: DataFrame, radius: int = 4, blocks: int | None = None, tree_limit: int = TREE_LIMIT, direct: bool = False) -> DataFrame:
    """(node, fp array) of distinct items -> (a, b) links between items within the radius.

    The links connect exactly the items that chains of near fingerprints
    connect.  With ``direct`` every link joins two items that are themselves
    near, each item's nearest earlier one in every shard among them.  Items
    need not be few: unless given, ``blocks`` follows from their number.  A
    repeated link may occur; no items give no rows; other columns are ignored.
    """
    masks = block_masks(radius, blocks or blocks_for(items.count(), radius))
    keyed = items.select("node", F.posexplode("fp").alias("which", "f")).select(
        "node", "f", F.explode(F.array(*[F.struct((F.col("which") * len(masks) + i).alias("c"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("s")
    ).select("node", "f", "s.c", "s.k")
    hot = materialize(
        keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > tree_limit).select("c", "k", F.ceil(F.col("n") / tree_limit).cast("int").alias("cuts")),
        "hot-shards",
    )
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    if hot.isEmpty():
        keyed = keyed.withColumn("pair", one[0])
    else:
        own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j")))
        keyed = join_checked(keyed, hot, ["c", "k"], "left").withColumn("pair", F.explode(F.when(F.col("cuts").isNull(), one).otherwise(pairs)))
    shards = keyed.groupBy("c", "k", "pair").agg(F.collect_list(F.struct("f", "node")).alias("of")).where(F.size("of") > 1).select(F.col("of.f").alias("f"), F.col("of.node").alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column(0)).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(ends // _ITEMS)) + 1).tolist(), len(ends)]
            for batch in (whole.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i):
                shard = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False))
                node = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                fps = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                order = np.lexsort((node, shard))
                a, b = _shard_links(node[order], fps[order], shard[order], radius, direct)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return shards.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int | None = None, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprints at most ``radius`` bits apart link.

    component_id is the smallest doc_id reachable over links, a document's own
    included.  Null text counts as empty; texts without words have fingerprint
    0 and link like any other.  Rows may repeat.  A row of null doc_id links
    nothing: it takes the component of its fingerprint if a row with an id has
    it, else null.  Other columns are ignored.  No rows give no rows.
    """
    prints = materialize(fingerprints(docs, width).select("doc_id", F.col("fp")[0].alias("fp")), "fingerprints")
    items = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "items")
    roots = connected_components(links(items.select("node", F.array("fp").alias("fp")), radius, blocks, tree_limit))
    classes = items.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the shingles; texts without words share one of their own."""
    return np.unique(hashes(shingles(text, width) or [b""], 42))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in (part for whole in batches for part in slices(whole, 1)):
        yield batch, [shingle_set(t, width) for t in batch.column(1).cast(pa.binary()).to_pylist()]


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "marks"])
        release()

    return texts.select("node", "text").mapInArrow(run, "node long, marks binary")


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the shingles that a sample of the texts repeats, by hash; the rarest has rank 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    seen = texts.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("node", "text").mapInArrow(run, "token long")
    often = seen.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    tokens = often.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int64)


def _marked(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, fp, size, firsts) in one pass over the texts: SimHash fingerprint, size of the shingle set and its first shingles, rarest first.

    In any one order of all shingles, two sets of at least the similarity meet
    in their first n - ceil(similarity * n) + 1.
    """
    often, ranks = _frequent(texts, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            prints, sizes, firsts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                h = hashes(shingles(text, width), 42)
                prints.append(majority(h))
                s = np.unique(h) if len(h) else shingle_set(b"", width)
                rank = np.zeros(len(s), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, ranks[at], 0)
                firsts.append(s[np.argsort(rank, kind="stable")[: len(s) - ceil(similarity * len(s) - SLACK) + 1]])
                sizes.append(len(s))
            ends = np.concatenate(([0], np.cumsum([len(f) for f in firsts])))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *firsts]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), lists], ["node", "fp", "size", "firsts"])
        release()

    return texts.select("node", "text").mapInArrow(run, "node long, fp long, size int, firsts array<long>")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2, 3)):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _verified(near: DataFrame, items: DataFrame, width: int, similarity: float) -> DataFrame:
    """The (a, b) whose texts' shingle sets are similar enough."""
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    texts = join_checked(items.select("node", "text"), wanted, "node", "left_semi")
    # both joins take the sets as the grouping has spread them: they are shuffled once
    sets = _shingle_sets(texts, width).groupBy("node").agg(F.max("marks").alias("marks"))
    pairs = near.join(sets.select(F.col("node").alias("a"), F.col("marks").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("marks").alias("y")), "b")
    return materialize(_similar(pairs.select("a", "b", "x", "y"), similarity), "similar-pairs")


def similar_components(items: DataFrame, width: int, similarity: float, radius: int = 4) -> DataFrame:
    """(node, text) -> (node, root) of the texts that chains of similar pairs connect; all such pairs count.

    First texts whose fingerprints are within ``radius`` bits are verified, as
    the BK-trees find them.  Fingerprints that near miss most pairs at the
    threshold, so every pair still apart that can be similar by its sizes and by
    the number of shingles shared in the prefixes is verified too; long runs of
    texts with a shingle in common are linked one to the next for that, by size.
    """
    ratio = similarity / (1 + similarity)
    need = F.ceil(ratio * (F.col("size") + F.col("size2")) - SLACK)  # shared shingles of a similar pair
    sizes = F.least("size", "size2") >= similarity * F.greatest("size", "size2") - SLACK
    alike = Window.partitionBy("token")
    marked = materialize(_marked(items, width, similarity), "marked-texts")
    close = links(materialize(marked.select("node", F.array("fp").alias("fp")).distinct(), "prints"), radius, direct=True)
    close = materialize(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "close-pairs")
    verified = _verified(close, items, width, similarity)
    grouped = materialize(connected_components(verified), "near-prints")
    tokens = marked.select("node", "size", F.posexplode("firsts").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)
    shared = tokens.withColumns({"lo": F.min("node").over(alike), "hi": F.max("node").over(alike)})
    shared = join_checked(shared.where("lo <> hi").select("token", "node", "size", "pos").distinct(), grouped, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    shared = materialize(shared, "shared-shingles")
    ordered = alike.orderBy("size", "node")
    runs = shared.withColumns({"run": F.count("*").over(alike), **{f"{c}2": F.lag(c).over(ordered) for c in ("node", "size", "pos", "part")}}).where((F.col("run") > RUN) & (F.col("part") != F.col("part2")))
    reach = 1 + F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2")) >= need
    chain = materialize(runs.where(sizes & reach).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct().join(close, ["a", "b"], "left_anti"), "chained-pairs")
    verified = verified.unionByName(_verified(chain, items, width, similarity))
    linked = materialize(connected_components(verified), "linked")
    parts = join_checked(shared.drop("pos", "part"), linked, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    parts = parts.withColumns({"lo": F.min("part").over(alike), "hi": F.max("part").over(alike)}).where("lo <> hi")
    parts = materialize(parts.select("token", "node", "size", "part"), "parts-apart")
    other = parts.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "part")])
    # of the first p shingles of one of two similar sets, all but (its size - need) are in the other; the set whose prefix ends first has them in both prefixes
    least = F.least(*[F.col(c) - F.ceil(similarity * F.col(c) - SLACK) + 1 - (F.col(c) - need) for c in ("size", "size2")])
    met = parts.join(other, "token").where((F.col("node") < F.col("node2")) & (F.col("part") != F.col("part2")) & sizes)
    met = met.groupBy("node", "node2", "size", "size2").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    near = met.select(F.col("node").alias("a"), F.col("node2").alias("b")).join(chain.unionByName(close), ["a", "b"], "left_anti")
    return connected_components(linked.toDF("a", "b").unionByName(_verified(materialize(near, "near-pairs"), items, width, similarity)))


def verified_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id, kept): texts whose shingle sets have a Jaccard similarity of at least ``similarity``.

    Candidates come from SimHash fingerprints in BK-trees and, for what those
    can't reach, from a prefix filter on the rarest ``width``-word shingles
    (hashed to 64 bits), which loses no such pair; they link only if their whole
    sets are similar enough.  Equal texts are one item, told apart by a 64-bit
    hash.  Null text counts as empty; texts without words are alike.
    component_id is the smallest doc_id of the class, null if none has one; node
    is the text's hash, and kept marks the rows of one doc_id and text that
    stands for the class: a row of component_id, of the smallest hash.  Rows of
    null or repeated ids link like others, repeated rows repeat, other columns
    are ignored.  No rows give no rows.
    """
    items = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("node"), text_of().alias("text"))
    owners = materialize(items.select("doc_id", "node"), "owners")
    roots = similar_components(items, width, similarity)
    rooted = materialize(owners.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return rooted.join(first, "root").select("doc_id", "node", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))
