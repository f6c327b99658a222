"""Quantiles of the beta distribution, vectorised.

The regularised incomplete beta function by its continued fraction, inverted by
Newton steps kept inside a shrinking bracket.  Evaluated on distinct parameter
pairs, of which a corpus has few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joining import join_small

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _rest(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of log gamma, for z of 10 or more."""
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log B(a, b) without the cancellation of large log gammas."""
    p, q = np.minimum(a, b), np.maximum(a, b)
    out = np.empty_like(p)
    small = q < 10
    out[small] = _lgamma(p[small]) + _lgamma(q[small]) - _lgamma(p[small] + q[small]) if small.any() else 0
    mixed = ~small & (p < 10)
    x, y = p[mixed], q[mixed]
    if mixed.any():
        out[mixed] = _lgamma(x) - x * np.log(x + y) - (y - 0.5) * np.log1p(x / y) + x + _rest(y) - _rest(x + y)
    large = ~small & ~mixed
    x, y = p[large], q[large]
    if large.any():
        out[large] = 0.5 * math.log(2 * math.pi) - 0.5 * np.log(y) + (x - 0.5) * np.log(x / (x + y)) - y * np.log1p(x / y) + _rest(x) + _rest(y) - _rest(x + y)
    return out


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 5000) -> np.ndarray:
    """Lentz's evaluation of the continued fraction, each entry until it settles."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, live = d.copy(), np.arange(len(x))
    for m in range(1, steps):
        xa, aa, bb, cc, dd = x[live], a[live], b[live], c[live], d[live]
        factor = 1.0
        for term in (m * (bb - m) * xa / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xa / ((aa + 2 * m) * (aa + 2 * m + 1))):
            dd, cc = 1 + term * dd, 1 + term / cc
            dd = 1 / np.where(np.abs(dd) < tiny, tiny, dd)
            cc = np.where(np.abs(cc) < tiny, tiny, cc)
            factor = factor * dd * cc
        h[live] *= factor
        c[live], d[live] = cc, dd
        live = live[np.abs(dd * cc - 1) > 1e-15]
        if not len(live):
            break
    return h


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, a, b = (np.asarray(v, float).copy() for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta(p, q)) / p
    part = np.where(y <= 0, 0.0, front * _fraction(y, p, q))
    return np.where(flip, 1 - part, part)


def beta_ppf(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with cdf(x) = p; NaN where a or b is not positive or anything is NaN."""
    p, a, b = (np.asarray(v, float).copy().reshape(-1) for v in np.broadcast_arrays(p, a, b))
    out = np.full(len(p), np.nan)
    ok = (a > 0) & (b > 0) & (p >= 0) & (p <= 1)
    p, a, b = p[ok], a[ok], b[ok]
    low, high, x = np.zeros_like(p), np.ones_like(p), a / (a + b)
    norm, live = log_beta(a, b), np.arange(len(p))
    for _ in range(200):
        if not len(live):
            break
        xl, al, bl = x[live], a[live], b[live]
        miss = beta_cdf(xl, al, bl) - p[live]
        low[live], high[live] = np.where(miss < 0, xl, low[live]), np.where(miss >= 0, xl, high[live])
        with np.errstate(all="ignore"):
            slope = np.exp((al - 1) * np.log(xl) + (bl - 1) * np.log1p(-xl) - norm[live])
            step = miss / slope
        lo, hi = low[live], high[live]
        settled = (miss == 0) | (np.abs(step) <= 4e-16 * xl) | (hi - lo <= 4e-16 * hi)
        half = np.where((lo > 0) & (hi > 4 * lo), np.sqrt(lo * hi), np.where(lo > 0, (lo + hi) / 2, hi / 8))
        new = xl - step
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, half)
        x[live] = np.where(settled, xl, new)
        live = live[~settled]
    x = np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, x))
    out[ok] = x
    return out


def with_quantiles(df: DataFrame, a: Column, b: Column, quantiles: dict[str, float]) -> DataFrame:
    """``df`` with a column for each named probability, the quantile of Beta(a, b).

    Quantiles are computed once for each distinct (a, b), then joined back:
    most rows share the few parameters of rare words.
    """
    keyed = df.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{k: beta_ppf(q, frame["_a"].to_numpy(), frame["_b"].to_numpy()) for k, q in quantiles.items()})

    schema = "_a double, _b double, " + ", ".join(f"{k} double" for k in quantiles)
    pairs = keyed.select("_a", "_b").distinct().mapInPandas(run, schema)
    return join_small(keyed, pairs, ["_a", "_b"], "left").drop("_a", "_b")
