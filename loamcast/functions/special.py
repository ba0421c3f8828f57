"""Special functions that the JVM lacks, vectorised over numpy arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8, then the asymptotic series."""
    x, shift = np.array(x, float), 0.0
    for _ in range(8):
        small = x < 8
        shift = shift - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, float), 0.0
    for _ in range(8):
        small = x < 8
        shift = shift + np.where(small, 1 / (x * x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return shift + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray, log_beta: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction from
    the side where it converges fast (modified Lentz steps), until no entry
    changes. log_beta: the logarithm of the beta function, if it is known."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    swap = inner > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)
    tiny = 1e-300
    c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 200):
        for up in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.abs(c * d - 1).max(initial=0) < 1e-14:
            break
    logs = LGAMMA(p) + LGAMMA(q) - LGAMMA(p + q) if log_beta is None else log_beta
    front = np.exp(p * np.log(t) + q * np.log1p(-t) - logs) / p
    out = np.where(swap, 1 - front * total, front * total)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def beta_quantile(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Newton's steps on the CDF within a bracket that every step narrows;
    where a step leaves it, its middle. A value ends when it doesn't move."""
    shape = np.broadcast(np.asarray(u, float), a, b).shape
    u, a, b = (np.array(v, float).ravel() for v in np.broadcast_arrays(np.asarray(u, float), a, b))
    logs = LGAMMA(a) + LGAMMA(b) - LGAMMA(a + b)
    lo, hi, x = np.zeros_like(u), np.ones_like(u), a / (a + b)
    out, left = x.copy(), np.arange(len(u))
    for _ in range(100):
        gap = beta_cdf(x, a, b, logs) - u
        lo, hi = np.where(gap < 0, x, lo), np.where(gap < 0, hi, x)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            step = x - gap / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - logs)
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        moves = np.abs(new - x) >= 1e-12
        out[left] = x = new
        if not moves.all():
            left, x, u, a, b, logs, lo, hi = (v[moves] for v in (left, x, u, a, b, logs, lo, hi))
        if not len(left):
            break
    return out.reshape(shape)


def beta_fit(values: np.ndarray, low: float, high: float, steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Newton's method for each row of `values`, scaled
    to (0, 1); it starts from the moments."""
    y = np.clip((np.asarray(values, float) - low) / (high - low), 1e-6, 1 - 1e-6)
    mean, var = y.mean(axis=1), np.maximum(y.var(axis=1, ddof=1), 1e-9)
    common = mean * (1 - mean) / var - 1
    a, b = np.maximum(mean * common, 0.1), np.maximum((1 - mean) * common, 0.1)
    return beta_newton(np.log(y).mean(axis=1), np.log1p(-y).mean(axis=1), a, b, steps)


def beta_newton(ga: np.ndarray, gb: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Both shapes from the mean logarithms of the values and of what they
    leave to 1, starting at a and b."""
    for _ in range(steps):
        whole = digamma(a + b)
        f, g = digamma(a) - whole - ga, digamma(b) - whole - gb
        t = trigamma(a + b)
        faa, gbb, cross = trigamma(a) - t, trigamma(b) - t, -t
        det = faa * gbb - cross * cross
        a, b = np.maximum(a - (f * gbb - g * cross) / det, 0.01), np.maximum(b - (g * faa - f * cross) / det, 0.01)
    return a, b


def gamma_shape(gap: np.ndarray, steps: int = 30) -> np.ndarray:
    """Maximum-likelihood shape from the logarithm of the mean less the mean
    of the logarithms, which is above 0."""
    s = np.maximum(np.asarray(gap, float), 1e-14)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(steps):
        k = np.maximum(k - (np.log(k) - digamma(k) - s) / (1 / k - trigamma(k)), k / 4)
    return k


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(below, above): regularised incomplete gamma functions at x for rate 1;
    a power series below the shape, a continued fraction above it, each as
    long as the slowest needs."""
    x, a = np.broadcast_arrays(np.maximum(np.asarray(x, float), 0), np.asarray(shape, float))
    x, a = x.copy(), a.copy()
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) - x - LGAMMA(a))
    low = x < a + 1
    below, above = np.zeros(len(x)), np.ones(len(x))
    if low.any():
        y, b = x[low], a[low]
        term = total = 1 / b
        k = 1
        while (term > 1e-17 * total).any():
            term = term * y / (b + k)
            total = total + term
            k += 1
        below[low] = front[low] * total
        above[low] = 1 - below[low]
    if (~low).any():
        y, b = x[~low], a[~low]
        tiny = 1e-300
        t = y + 1 - b
        c, d = np.full(len(y), 1 / tiny), 1 / t
        h = d.copy()
        k = 1
        while True:
            up = -k * (k - b)
            t = t + 2
            d = 1 / np.where(np.abs(up * d + t) < tiny, tiny, up * d + t)
            c = np.where(np.abs(t + up / c) < tiny, tiny, t + up / c)
            h = h * d * c
            k += 1
            if (np.abs(d * c - 1) < 1e-15).all() or k > 100_000:
                break
        above[~low] = front[~low] * h
        below[~low] = 1 - above[~low]
    return below, above


def beta_draw(lo: Column, mid: Column, hi: Column, u: Column, low: float, high: float) -> Column:
    """Column of draws from the Beta that fits each row's triplet on the
    support; null where an input is."""

    @F.pandas_udf("double")
    def draw(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts in frames:
            x = np.column_stack([p.to_numpy(float) for p in parts])
            good = np.isfinite(x).all(axis=1)
            out = np.full(len(x), np.nan)
            if good.any():
                a, b = beta_fit(x[good, :3], low, high)
                out[good] = low + (high - low) * beta_quantile(x[good, 3], a, b)
            yield pd.Series(out).where(good, None).astype("Float64")

    return draw(lo, mid, hi, u)


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fritsch-Carlson slopes at the knots of rising curves, one a row of y."""
    d = np.diff(y) / np.diff(x)
    m = np.concatenate([d[:, :1], (d[:, :-1] + d[:, 1:]) / 2, d[:, -1:]], axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(d.shape[1]):
            s = d[:, k]
            a, b = m[:, k] / s, m[:, k + 1] / s
            r = a * a + b * b
            steep, flat = r > 9, s == 0
            for i, c in ((k, a), (k + 1, b)):
                m[:, i] = np.where(flat, 0.0, np.where(steep, 3 * s * c / np.sqrt(r), m[:, i]))
    return m


def spline_quantiles(probs: np.ndarray, values: np.ndarray, u: np.ndarray, bounds: tuple[float, float] | None = None) -> np.ndarray:
    """Monotone cubic inverse CDFs through the values of a row, each at its
    own u; without bounds the ends lie a twentieth of the range outside."""
    first, last = values[:, :1], values[:, -1:]
    pad = 0.05 * (last - first)
    p, v = list(probs), [values]
    if p[0] > 0:
        p, v = [0.0, *p], [np.minimum(bounds[0] if bounds else first - pad, first), *v]
    if p[-1] < 1:
        p, v = [*p, 1.0], [*v, np.maximum(bounds[1] if bounds else last + pad, last)]
    p, v = np.array(p), np.maximum.accumulate(np.concatenate(v, axis=1), axis=1)
    m = monotone_slopes(p, v)
    k = np.clip(np.searchsorted(p, u, side="right") - 1, 0, len(p) - 2)
    row = np.arange(len(u))
    h = p[k + 1] - p[k]
    t = (u - p[k]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * v[row, k] + t * (1 - t) ** 2 * h * m[row, k] + t * t * (3 - 2 * t) * v[row, k + 1] + t * t * (t - 1) * h * m[row, k + 1]


def spline_quantile(probs: np.ndarray, values: np.ndarray, u: np.ndarray, bounds: tuple[float, float] | None = None) -> np.ndarray:
    """spline_quantiles() of one set of values."""
    return spline_quantiles(probs, np.broadcast_to(np.asarray(values, float), (len(u), len(values))), u, bounds)
