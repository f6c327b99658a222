"""Benchmark decontamination by greedy string tiling.

Seeds, runs of ``min_match`` tokens, join documents to test items through a
running Karp-Rabin hash; a hit counts only if its tokens are equal.  For every
document and item that share enough seeds, the longest match whose tokens are
still unmarked on both sides is marked, again and again; the share of the
item's tokens that end up marked is its coverage.  Tiles may lie in any order,
so a reordered passage is covered like an intact one.

Test sets are small next to a corpus: they are held in blocks filled to a byte
bound, and each block is compared with all documents in one scan without a
shuffle.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, text_of, tokens_in

MIN_MATCH, COVERAGE, BLOCK_BYTES = 5, 0.5, 16_000_000
#: Place pairs and maximal matches that a comparison holds at once; more are taken in turns.
PAIRS, MATCHES = 1_000_000, 100_000
_TOKEN, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
_BASE = 0x9E3779B97F4A7C15


def tokens(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z lower-cased."""
    return _TOKEN.findall(text.lower())


def rolling(ids: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` ids, modulo 2**64: differences of one running sum."""
    n = len(ids)
    powers = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64))]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * powers[1][:n])))
    return (sums[width:] - sums[: n - width + 1]) * powers[0][width - 1 : n]


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of n entries each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Tiling:
    """Greedy tiling of one document and one item in bounded memory.

    Matches are taken in the order of falling length, then of their place in the
    item and in the document.  A pass gathers the first ``matches`` of them over
    bands of diagonals of at most ``pairs`` place pairs; what it leaves out is
    found again by the next pass, between the tokens marked by then.
    """

    def __init__(self, doc: np.ndarray, item: np.ndarray, width: int, pairs: int = 0, matches: int = 0):
        self.doc, self.item = (np.concatenate(([end], x, [end])) for x, end in ((doc, -1), (item, -2)))  # marked tokens become -1 and -2
        self.width, self.pairs, self.matches = width, pairs or PAIRS, matches or MATCHES
        self.marked = self.tiles = 0

    def run(self, p: np.ndarray, s: np.ndarray, q: np.ndarray, t: np.ndarray, enough: float = np.inf) -> tuple[int, int]:
        """(tokens marked, tiles) from places p and q of equal seeds s and t, each seed one number; stops at ``enough`` marked tokens, the most there can be or that are asked for."""
        order = np.lexsort((q, t))
        q, t = q[order], t[order]
        more = True
        while more and self.marked < min(enough, len(self.item) - 2):
            found, more = self._gather(p, s, q, t)
            more = self._mark(found, more, enough)
        return self.marked, self.tiles

    def _gather(self, p, s, q, t) -> tuple[list[tuple[int, int, int]], bool]:
        w = self.width
        free = [np.concatenate(([0], np.cumsum(x < 0))) for x in (self.doc, self.item)]
        ok = free[0][p + 1 + w] == free[0][p + 1]
        p, s = p[ok], s[ok]
        ok = free[1][q + 1 + w] == free[1][q + 1]
        q, t = q[ok], t[ok]
        if not len(p) or not len(q):
            return [], False
        total = int((np.searchsorted(t, s, "right") - np.searchsorted(t, s)).sum())
        first, last, wide = int(p.min() - q.max()), int(p.max() - q.min()), int(q.max()) + 2
        step = last - first + 1 if total <= self.pairs else max(1, self.pairs // min(len(p), len(q)))
        key = t * wide + q
        held, more = np.zeros((0, 3), np.int64), False
        for d in range(first, last + 1, step):  # diagonals d .. d + step - 1
            low = np.searchsorted(key, s * wide + np.clip(p - (d + step - 1), 0, wide - 1))
            n = np.maximum(np.where(p >= d, np.searchsorted(key, s * wide + np.clip(p - d, 0, wide - 1), "right"), low) - low, 0)
            if not n.any():
                continue
            pp, qq = np.repeat(p, n), q[_ranges(low, n)]
            start = self.doc[pp] != self.item[qq]  # the tokens before
            end = self.doc[pp + 1 + w] != self.item[qq + 1 + w]
            ends = []
            for edge in (start, end):
                x, y = pp[edge], qq[edge]
                o = np.lexsort((x, x - y))
                ends.append((x[o], y[o]))
            (x, y), (stop, _) = ends  # along a diagonal starts and ends take turns
            held = np.concatenate((held, np.stack((x - stop - w, y, x), 1)))
            if len(held) > 2 * self.matches:
                held, more = self._first(held), True
        if len(held) > self.matches:
            held, more = self._first(held), True
        return [tuple(m) for m in held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))].tolist()], more

    def _first(self, held: np.ndarray) -> np.ndarray:
        return held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))[: self.matches]]

    def _mark(self, heap: list[tuple[int, int, int]], more: bool, enough: float) -> bool:
        """Marks matches (-length, item place, document place); whether any may be left for a further pass."""
        limit = heap[-1] if more else None
        while heap:
            m = heapq.heappop(heap)
            if limit and m > limit:
                break  # others of its rank aren't known yet
            n, q, p = -m[0], m[1] + 1, m[2] + 1
            used = (self.doc[p : p + n] < 0) | (self.item[q : q + n] < 0)
            if not used.any():
                self.doc[p : p + n], self.item[q : q + n] = -1, -2
                self.marked, self.tiles = self.marked + n, self.tiles + 1
                if self.marked >= min(enough, len(self.item) - 2):
                    return False
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([1], used, [1]))))
            for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if j - i >= self.width:
                    heapq.heappush(heap, (i - j, m[1] + i, m[2] + i))
        return more


class Items:
    """A block of test items, indexed by their seeds."""

    def __init__(self, rows: list[tuple[int, bytes]], min_match: int):
        texts = [tokens(t) for _, t in rows]
        self.names, self.sizes = [i for i, _ in rows], np.array([len(t) for t in texts], np.int64)
        self.vocabulary: dict[bytes, int] = {}
        learn = self.vocabulary.setdefault
        self.ids = np.array([learn(w, len(self.vocabulary) + 1) for t in texts for w in t], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        widths = np.minimum(min_match, self.sizes)  # an item shorter than min_match is one seed of its own width
        self.seeds = {int(w): self._index(np.flatnonzero(widths == w), int(w)) for w in np.unique(widths) if w}

    def _index(self, own: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(base, hash of each seed, where its places start, items, places in the block's tokens); no two seeds have one hash."""
        counts = self.sizes[own] - width + 1
        item, at = np.repeat(own, counts), _ranges(self.starts[own], counts)
        base = _BASE
        while True:
            h = rolling(self.ids, width, base)[at]
            order = np.lexsort((at, h))
            h, item_, at_ = h[order], item[order], at[order]
            same = h[1:] == h[:-1]
            span = np.arange(width)
            if (self.ids[at_[1:][same][:, None] + span] == self.ids[at_[:-1][same][:, None] + span]).all():
                break
            base += 2  # stays odd
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        return base, h[first], np.append(first, len(h)), item_, at_

    def cover(self, text: bytes, coverage: float = 0.0, whole: bool = True) -> Iterator[tuple[int, int, int]]:
        """(index of item, tokens marked, tiles) of every item that shares a seed and can reach ``coverage``.

        Unless ``whole``, marking stops at that coverage.
        """
        get = self.vocabulary.get
        parts = [np.fromiter((get(w, 0) for w in run), np.int64, len(run)) for run in tokens_in(text.lower(), _TOKEN, _GAP)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        for width, (base, hashes, offsets, item, at) in self.seeds.items():
            if len(ids) < width:
                continue
            p = np.flatnonzero(strange[width:] == strange[: len(ids) - width + 1])
            if not len(p):
                continue
            h = rolling(ids, width, base)[p]
            s = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            p, s = p[hashes[s] == h], s[hashes[s] == h]
            if not len(p):
                continue
            span = np.arange(width)
            same = (self.ids[at[offsets[s]][:, None] + span] == ids[p[:, None] + span]).all(1)
            p, s = p[same], s[same]
            seen = np.unique(s)
            if not len(seen):
                continue
            counts = offsets[seen + 1] - offsets[seen]
            places = _ranges(offsets[seen], counts)
            places, seed = places[np.argsort(at[places])], np.repeat(seen, counts)[np.argsort(at[places])]  # by item and place: items lie one behind the other
            first = np.flatnonzero(np.diff(item[places], prepend=-1))
            # item tokens under any seed of the document: no tiling marks more
            most = np.add.reduceat(np.minimum(np.diff(at[places], append=at[places[-1]] + width), width), first)
            by_seed = np.argsort(s, kind="stable")
            p, s = p[by_seed], s[by_seed]
            for a, b, k, bound in zip(first, np.append(first[1:], len(places)), item[places[first]], most):
                if bound < coverage * self.sizes[k]:
                    continue
                own = np.unique(seed[a:b])
                low, high = np.searchsorted(s, own), np.searchsorted(s, own, "right")
                mine = _ranges(low, high - low)
                start, n = int(self.starts[k]), int(self.sizes[k])
                tiling = Tiling(ids, self.ids[start : start + n], width)
                yield int(k), *tiling.run(p[mine], s[mine], at[places[a:b]] - start, seed[a:b], int(bound) if whole else min(int(bound), coverage * n))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Distinct items in blocks of at most ``block_bytes``, or of one item that is longer; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), text_of().alias("text")).distinct()
    block, size = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = row.text.encode()
        if block and size + len(text) + 16 > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text) + 16
    if block:
        yield block


_LAST: dict[str, Items] = {}


def _items(name: str, rows: list[tuple[int, bytes]], min_match: int) -> Items:
    """The index of a block; a worker keeps the last one for its next task."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Items(rows, min_match)
    return _LAST[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched, tiles, coverage) of pairs whose coverage reaches ``coverage``.

    Null texts count as empty; items without tokens cover nothing; items of
    fewer than ``min_match`` tokens must occur whole.  Of matches of equal
    length the one earliest in the item, then in the document, is marked first.
    Repeated rows of documents repeat in the result, repeated items do not.
    Null ids are kept as such, other columns ignored.  No documents or no items
    give no rows.  Documents are scanned once for each block of items.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_tokens long, matched long, tiles long, coverage double"
    out = spark.createDataFrame([], schema)
    for rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows, min_match))  # at most block_bytes, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(*shared.value)
            for batch in (part for whole in batches for part in slices(whole, 1)):
                got = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    for i, matched, tiles in items.cover(text, coverage):
                        n = int(items.sizes[i])
                        if matched >= coverage * n:
                            got.append((doc, items.names[i], n, matched, tiles, matched / n))
                cols = zip(*got) if got else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.float64()])], ["doc_id", "item_id", "item_tokens", "matched", "tiles", "coverage"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that :func:`contaminated` lists, decided where each row is read.

    Null texts count as empty and stay, as do rows of null or repeated ids;
    repeated rows share their fate.  Columns are unchanged, whatever their
    names.  No items leave all rows, no rows give none.
    """
    spark, where = docs.sparkSession, docs.columns.index("text")
    for rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows, min_match))  # at most block_bytes, or one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(*shared.value)
            for batch in (part for whole in batches for part in slices(whole, where)):
                texts = batch.column(where).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not any(m >= coverage * items.sizes[i] for i, m, _ in items.cover(t or b"", coverage, False)) for t in texts], pa.bool_()))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
