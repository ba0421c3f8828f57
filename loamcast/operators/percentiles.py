"""Simulation from any set of percentiles, and how well methods do it."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import qnorm_at
from ..functions.special import spline_quantiles
from .stats import parted

METHODS = ("linear_cdf", "spline", "kde", "normal")
_Z = NormalDist().inv_cdf


def pairs(columns: dict[float, str], absent: float = -1.0) -> Column:
    """array<struct(p, v)> of the percentile columns that hold a value, by
    probability; null with fewer than two."""
    all_of = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(c).cast("double").alias("v")) for p, c in sorted(columns.items())])
    held = F.filter(all_of, lambda x: x["v"].isNotNull() & (x["v"] != absent))
    return F.when(F.size(held) >= 2, held)


BLOCK = 256  # rows whose kernels are added up at once


def linear_at(probs: np.ndarray, values: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The lines through the values of a row, each at its own probability u;
    the ends hold outside."""
    row, below = np.arange(len(u)), np.searchsorted(probs, u, side="right")
    k = np.clip(below, 1, len(probs) - 1)
    a, b = values[row, k - 1], values[row, k]
    inner = a + (b - a) * (u - probs[k - 1]) / (probs[k] - probs[k - 1])
    return np.where(below == 0, values[:, 0], np.where(u >= probs[-1], values[:, -1], inner))


def normal_at(probs: np.ndarray, values: np.ndarray, u: np.ndarray) -> np.ndarray | None:
    """Normal quantiles around the median, by the spread of the outermost inner
    percentiles; None without a median, or with fewer than two others."""
    tails = np.flatnonzero((probs > 0) & (probs < 1) & (probs != 0.5))
    if 0.5 not in probs or len(tails) < 2:
        return None
    lo, hi = tails[0], tails[-1]
    low, high = (round(float(probs[i]), 3) for i in (lo, hi))
    if low == high or not 0 < low < 1 or not 0 < high < 1:
        return None
    sd = (values[:, hi] - values[:, lo]) / (_Z(high) - _Z(low))
    return values[:, int(np.flatnonzero(probs == 0.5)[0])] + sd * qnorm_at(u)


def smooth_quantiles(probs: np.ndarray, values: np.ndarray, u: np.ndarray, size: int = 512) -> np.ndarray:
    """A kernel at each percentile of a row, as wide as half the way to its
    nearer neighbour (a third at the ends, which are cut off), added up on a
    grid between the outermost values; its inverse CDF at the row's u."""
    k, out = values.shape[1], np.empty(len(u))
    for start in range(0, len(u), BLOCK):
        v, at = values[start : start + BLOCK], u[start : start + BLOCK]
        gap = np.abs(np.diff(v, axis=1))
        wide = np.maximum(np.column_stack([gap[:, 0] / 3, *[np.minimum(gap[:, i - 1], gap[:, i]) / 2 for i in range(1, k - 1)], gap[:, -1] / 3]), 0.1)
        x = np.linspace(v.min(axis=1), v.max(axis=1), size, axis=1)
        cdf, d = np.zeros(x.shape), np.empty(x.shape)
        for i in range(k):
            np.subtract(x, v[:, i, None], out=d)
            np.divide(d, wide[:, i, None], out=d)
            np.multiply(d, d, out=d)
            np.multiply(d, -0.5, out=d)
            np.exp(d, out=d)
            d *= ((2 if i in (0, k - 1) else 1) / wide[:, i])[:, None]
            cdf += d
        np.cumsum(cdf, axis=1, out=cdf)
        cdf /= cdf[:, -1:]
        row = np.arange(len(at))
        below = (cdf <= at[:, None]).sum(axis=1)
        j = np.clip(below, 1, size - 1)
        x0, x1, c0, c1 = x[row, j - 1], x[row, j], cdf[row, j - 1], cdf[row, j]
        with np.errstate(invalid="ignore", divide="ignore"):
            inner = (x1 - x0) / (c1 - c0) * (at - c0) + x0
        out[start : start + BLOCK] = np.where(below == 0, x[:, 0], np.where(below >= size, x[:, -1], inner))
    return out


def drawn_at(probs: np.ndarray, values: np.ndarray, there: np.ndarray, u: np.ndarray, method: str, bounds: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(draws, which are missing) by one of METHODS; rows that have the same
    percentiles, by `there`, are drawn together."""
    out, missing = np.full(len(u), np.nan), np.ones(len(u), bool)
    codes = there @ (1 << np.arange(len(probs)))
    for code in np.unique(codes):
        held = (code >> np.arange(len(probs)) & 1).astype(bool)
        rows = np.flatnonzero((codes == code) & ~np.isnan(u))
        if held.sum() < 2 or not len(rows):
            continue
        p, v, at = probs[held], values[np.ix_(rows, held)], u[rows]
        found = {"linear_cdf": linear_at, "normal": normal_at, "kde": smooth_quantiles}[method](p, v, at) if method != "spline" else spline_quantiles(p, v, at, bounds)
        if found is not None:
            out[rows], missing[rows] = found, False
    return out, missing


def draws(columns: dict[float, str], methods: tuple[str, ...], u: str, bounds: tuple[float, float] | None = None) -> Column:
    """A struct of a draw a method, at probability u of the distribution that
    the percentile columns give; null with fewer than two percentiles."""
    for method in methods:
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
    probs = np.array(sorted(columns), float)

    @F.arrow_udf("struct<" + ", ".join(f"{m}:double" for m in methods) + ">")
    def draw(at: pa.Array, *parts: pa.Array) -> pa.Array:
        point, *sides = (x.to_numpy(zero_copy_only=False).astype(float) for x in (at, *parts))
        values = np.column_stack(sides)
        there = np.column_stack([np.asarray(p.is_valid()) for p in parts]) & (values != -1)
        found = [drawn_at(probs, values, there & np.isfinite(values) if m in ("spline", "kde") else there, point, m, bounds) for m in methods]
        return pa.StructArray.from_arrays([pa.array(x, mask=m) for x, m in found], names=list(methods))

    return draw(F.col(u).cast("double"), *[F.col(columns[p]).cast("double") for p in sorted(columns)])


def simulate(rows: DataFrame, columns: dict[float, str], method: str, u: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """rows with `draw`: the value at probability u of the distribution that
    the percentile columns give, by one of METHODS. Rows with fewer than two
    percentiles have none."""
    return rows.withColumn("draw", draws(columns, (method,), u, bounds)[method])


def compared(rows: DataFrame, columns: dict[float, str], methods: tuple[str, ...], u: str, keys: list[str], bounds: tuple[float, float] | None = None) -> DataFrame:
    """(method, keys, n, mean, sd, min, max) of the draws of each method, all
    made in one pass."""
    drawn = rows.select(*keys, draws(columns, methods, u, bounds).alias("__d"))
    kinds = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    met = drawn.groupBy(*keys).agg(*[F.struct(F.lit(m).alias("method"), *[f(F.col("__d")[m]).alias(c) for c, f in kinds.items()]).alias(f"__{m}") for m in methods])
    return met.select(*keys, F.explode(F.array(*[f"__{m}" for m in methods])).alias("__x")).select("__x.method", *keys, *[f"__x.{c}" for c in kinds])


def ks_distance(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, ks, n_a, n_b): the largest gap between the two empirical
    distributions of each group. Both are counted by value first."""
    tagged = a.select(*keys, F.col(value).alias("__v"), F.lit(1).alias("__a")).unionByName(b.select(*keys, F.col(value).alias("__v"), F.lit(0).alias("__a")))
    both = tagged.where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.sum("__a").alias("a"), F.sum(1 - F.col("__a")).alias("b"))
    # Distinct values are dealt to parts; a group's window holds its parts only.
    dealt = parted(both.dropna(subset=keys), keys, "__v")
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"))
    by = Window.partitionBy(*keys)
    up_to = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select(*keys, "__part", *[(F.sum(f"__{s}").over(up_to) - F.col(f"__{s}")).alias(f"__base_{s}") for s in "ab"], *[F.sum(f"__{s}").over(by).alias(f"n{s}") for s in "ab"])
    inner = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    at = dealt.join(sizes, [*keys, "__part"]).select(*keys, "na", "nb", *[(F.col(f"__base_{s}") + F.sum(s).over(inner)).alias(f"r{s}") for s in "ab"])
    return at.groupBy(*keys).agg(F.max(F.abs(F.try_divide("ra", "na") - F.try_divide("rb", "nb"))).alias("ks"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def method_errors(truth: DataFrame, drawn: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, ks, mean_error, sd_error) of draws against the truth."""
    side = lambda df, s: df.groupBy(*keys).agg(F.avg(value).alias(f"{s}m"), F.stddev_samp(value).alias(f"{s}s"))
    both = side(truth, "t").join(side(drawn, "d"), keys).join(ks_distance(drawn, truth, keys, value), keys)
    return both.select(*keys, "ks", (F.abs(F.col("dm") - F.col("tm")) / F.abs("tm")).alias("mean_error"), (F.abs(F.col("ds") - F.col("ts")) / F.col("ts")).alias("sd_error"))
