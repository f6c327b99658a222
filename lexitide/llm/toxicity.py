"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Each text is the set of its hashed character n-grams.  A feature's value is its
naive Bayes log-count ratio, and a logistic regression weighs those values.
Learning takes a bounded sample of the labelled rows; scoring reads every row
and every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, text_of


@dataclass(frozen=True)
class ToxicityConfig:
    """``rows_per_class`` bounds the labelled rows learnt from, ``features`` the n-grams weighed: those whose shares of the classes differ most surely."""

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    rows_per_class: int = 6000
    features: int = 8_000
    smoothing: float = 1.0
    ridge: float = 60.0
    steps: int = 60
    folds: int = 5


class Grams:
    """The distinct hashed n-grams of a text."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits = orders, bits
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h, got = codes, []
        for n in range(1, max(self.orders) + 1):
            if len(codes) < n:
                break
            if n > 1:
                h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            if n in self.orders:
                x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
                got.append((x >> np.uint64(64 - self.bits)).astype(np.int32))
        if not got:
            return np.zeros(0, np.int32)
        at = np.concatenate(got)
        place = np.arange(len(at), dtype=np.int32)
        self.last[at] = place  # the last of equal ones stays
        return at[self.last[at] == place]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that learning never sees: crc32 of the id as text divisible by ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _sample(labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """At most ``rows_per_class`` rows of each class, the same ones for the same labels."""
    clean = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), config.folds)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    clean = clean.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [clean.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.rows_per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def _fit(indptr: np.ndarray, cols: np.ndarray, y: np.ndarray, ratio: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with classes weighed alike, by Adam steps over the whole sample."""
    n, k = len(y), len(ratio)
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(indptr))
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = (np.zeros(k + 1) for _ in range(3))  # the intercept last
    g = np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=(w[:k] * ratio)[cols], minlength=n) + w[k]
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weigh
        g[:k] = np.bincount(cols, weights=miss[rows], minlength=k) * ratio + ridge / max(1, n) * w[:k]
        g[k] = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        rate = 0.1 * min(1, 2 - 2 * t / (steps + 1))  # falls to 0 over the second half
        w -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:k] * ratio, float(w[k])


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> tuple[np.ndarray, float]:
    """(weights of the n-gram buckets, intercept) learnt from a sample of labelled rows outside the held-out fold.

    Without rows of both classes nothing can be learnt: all weights are zero and
    every score is below 0.5, so no document is rejected.
    """
    size = 1 << config.bits
    sample = F.broadcast(_sample(labels.select("doc_id", "toxic"), config))  # at most 2 x rows_per_class narrow rows
    chosen = docs.select("doc_id", text_of().alias("text")).join(sample, "doc_id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts, n = Grams(config.orders, config.bits), np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y, grams(text)] += 1
                n[y] += 1
        at = np.flatnonzero(counts.sum(0))
        at, c = np.append(at, -1), np.append(counts[:, at], n[:, None], axis=1)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(c[0, i : i + 50_000]), pa.array(c[1, i : i + 50_000])], ["at", "n0", "n1"])

    # at most one row a bucket, whatever the corpus; below, at most ``features`` ids a sampled row
    counted = chosen.mapInArrow(count, "at long, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("at < 0 or n0 + n1 > 2").toArrow()
    at, n0, n1 = (counted.column(c).to_numpy() for c in ("at", "n0", "n1"))
    none = np.zeros(size, np.float32)
    if not len(at) or min(n0[at < 0].sum(), n1[at < 0].sum()) == 0:
        return none, -1.0
    d0, d1 = n0[at < 0].sum(), n1[at < 0].sum()
    at, n0, n1 = at[at >= 0], n0[at >= 0], n1[at >= 0]
    ratio = np.log((n1 + config.smoothing) / (d1 + 2 * config.smoothing)) - np.log((n0 + config.smoothing) / (d0 + 2 * config.smoothing))
    spread = np.sqrt((n0 + n1 + 1) / (d0 + d1) * (1 / d0 + 1 / d1))  # of the difference of shares if the classes were alike
    best = np.lexsort((at, -np.abs(n1 / d1 - n0 / d0) / spread))[: config.features]
    at, ratio = at[best], ratio[best]
    slot = np.full(size, -1, np.int32)
    slot[at] = np.arange(len(at))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(config.orders, config.bits)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [slot[grams(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], ["toxic", "cols"])

    drawn = chosen.mapInArrow(rows, "toxic int, cols binary").orderBy("toxic", "cols").toArrow()
    cols = [np.frombuffer(x, np.int32) for x in drawn.column("cols").to_pylist()]
    indptr = np.concatenate(([0], np.cumsum([len(x) for x in cols])))
    w, b = _fit(indptr, np.concatenate(cols), drawn.column("toxic").to_numpy(), ratio, config.ridge, config.steps)
    del counted, drawn, cols
    release()
    weights = none.copy()
    weights[at] = w
    return weights, float(b)


def score(docs: DataFrame, weights: np.ndarray, intercept: float, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, score, predicted) of every row; only the text decides.

    Null text counts as empty and gets the score of a text without n-grams.
    Repeated rows repeat in the result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((weights, intercept))  # 4 bytes a bucket, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), grams = model.value, Grams(config.orders, config.bits)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            z = np.array([w[grams(t)].sum(dtype=np.float64) for t in batch.column(1).to_pylist()]) + b
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, weights: np.ndarray, intercept: float, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, columns unchanged: each row is decided where it is read."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((weights, intercept))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, b), grams = model.value, Grams(config.orders, config.bits)
        for batch in (part for whole in batches for part in slices(whole, where)):
            z = [w[grams(t or "")].sum(dtype=np.float64) + b for t in batch.column(where).to_pylist()]
            yield batch.filter(pa.array([x < 0 for x in z], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
