"""Bayesian updating of samples by kernel densities, a batch of rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fuse_beta, fuse_gamma, update_normal

STEP = 0.25  # of the narrower bandwidth, between points of the grid
CELLS = 1 << 21  # kernel values held at once


def bandwidths(x: np.ndarray) -> np.ndarray:
    """Rule of thumb of each row: 0.9 min(sd, IQR / 1.34) n^-0.2; without
    spread by the value's size, else 1."""
    sd = x.std(axis=1, ddof=1) if x.shape[1] > 1 else np.zeros(len(x))
    low, high = np.percentile(x, [25, 75], axis=1)
    width = np.minimum(sd, (high - low) / 1.34)
    width = np.where(width > 0, width, np.where(sd > 0, sd, np.where(np.abs(x[:, 0]) > 0, np.abs(x[:, 0]), 1.0)))
    return 0.9 * width * x.shape[1] ** -0.2


def densities(x: np.ndarray, h: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Gaussian kernel densities of rows of x on rows of grid, a bounded block
    of kernels at a time."""
    out = np.zeros(grid.shape)
    step = max(1, CELLS // max(1, grid.size))
    for k in range(0, x.shape[1], step):
        d = (grid[:, :, None] - x[:, None, k : k + step]) / h[:, None, None]
        out += np.exp(-0.5 * d * d).sum(axis=2)
    return out / (h * np.sqrt(2 * np.pi) * x.shape[1])[:, None]


def posterior_of(a: np.ndarray, b: np.ndarray, u: np.ndarray, step: float = STEP) -> np.ndarray:
    """Quantiles u of the product of two kernel densities. The grid covers
    what both reach within six bandwidths, at `step` of the narrower one, and
    is walked in pieces, so that it is as fine for wide samples as for others.
    Samples that don't meet give what lies between their means."""
    a, b = a[None, :], b[None, :]
    ha, hb = bandwidths(a), bandwidths(b)
    low, high = max(a.min() - 6 * ha[0], b.min() - 6 * hb[0]), min(a.max() + 6 * ha[0], b.max() + 6 * hb[0])
    if low >= high:
        return np.full(len(u), (a.mean() + b.mean()) / 2)
    points = int(np.ceil((high - low) / (step * min(ha[0], hb[0])))) + 1
    grids, products = [], []
    for k in range(0, points, 4096):
        grid = low + (high - low) * np.arange(k, min(points, k + 4096)) / (points - 1)
        grids.append(grid)
        products.append((densities(a, ha, grid[None, :]) * densities(b, hb, grid[None, :]))[0])
    grid, product = np.concatenate(grids), np.concatenate(products)
    if product.sum() <= 0:
        return np.full(len(u), (a.mean() + b.mean()) / 2)
    cdf = np.concatenate([[0], np.cumsum((product[1:] + product[:-1]) / 2)])
    keep = np.append(True, np.diff(cdf) > 0)
    return np.interp(u, cdf[keep] / cdf[-1], grid[keep])


def posterior_samples(rows: DataFrame, prior: str, likelihood: str, name: str, keys: list[str], n: int = 1000, step: float = STEP, seed: int = 1) -> DataFrame:
    """rows with `name`, an array of n draws from the product of the kernel
    densities of two columns of samples (array<double>).

    Draws are inverse-CDF at one uniform in each of n even strata, hashed from
    keys and seed, in random order; so they don't depend on partitions. Nulls,
    NaN and infinite entries are no values; a side without values gives null.
    A row's task holds its own samples only.
    """
    schema = rows.select("*", F.lit(None).cast("array<double>").alias(name)).schema

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list = []
            for a, b, row in zip(frame[prior], frame[likelihood], frame["__seed"]):
                sides = [np.array([v for v in x if v is not None and np.isfinite(v)], float) if x is not None else np.zeros(0) for x in (a, b)]
                if not len(sides[0]) or not len(sides[1]):
                    found.append(None)
                    continue
                rng = np.random.default_rng([seed, int(row) & (1 << 63) - 1])
                found.append(posterior_of(*sides, (rng.permutation(n) + rng.random(n)) / n, step))
            out = frame.drop(columns="__seed")
            out[name] = found
            yield out[[f.name for f in schema]]

    return rows.withColumn("__seed", F.xxhash64(*[F.col(k) for k in keys])).mapInPandas(update, schema)


def fused_property(rows: DataFrame, prior: str, likelihood: str, keys: list[str], family: str | None = None, method: str | None = None, name: str = "posterior", n: int = 1000) -> DataFrame:
    """rows with the posterior of two columns, by their shape: arrays of
    samples give an array of draws ("general"), structs of parameters the
    parameters of their family ("closed_form"): normal (mean, sd), beta
    (alpha, beta) or gamma (shape, rate). Mixed shapes, a closed form without
    a family, and a `method` other than the shape's are errors."""
    kinds = [rows.schema[c].dataType.typeName() for c in (prior, likelihood)]
    if kinds[0] != kinds[1] or kinds[0] not in ("array", "struct"):
        raise ValueError("prior and likelihood have one shape: both samples, or both parameters")
    route = "general" if kinds[0] == "array" else "closed_form"
    if method is not None and method != route:
        raise ValueError(f"{method} was asked for, but the columns are for {route}")
    if route == "general":
        return posterior_samples(rows, prior, likelihood, name, keys, n)
    a, b = F.col(prior), F.col(likelihood)
    closed = {"normal": lambda: update_normal(a["mean"], a["sd"], b["mean"], b["sd"]), "beta": lambda: fuse_beta(a["alpha"], a["beta"], b["alpha"], b["beta"]), "gamma": lambda: fuse_gamma(a["shape"], a["rate"], b["shape"], b["rate"])}
    if family not in closed:
        raise ValueError("a closed form needs a family: normal, beta or gamma")
    return rows.withColumn(name, closed[family]())
