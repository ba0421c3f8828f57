"""Distribution families of triplets: fits, quantiles and checks as columns.

A fit is a struct (family, valid, p, message); p holds the parameters:
triangular (low, mode, high), uniform (low, high), normal and lognormal (mean,
sd; of logarithms for the latter), metalog (coefficients, then 1 where they are
infeasible), linear_cdf (the values). Beta is fitted and drawn by
special.beta_draw(), in vectors.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special
from .normal import qnorm_sql
from .scalar import TINY, finite, quantile_linear, quantile_triangular, skew_of

FAMILIES = ("triangular", "uniform", "normal", "lognormal", "beta", "metalog", "linear_cdf")
KINDS = ("u", "sl", "su", "b")  # unbounded, bounded below, above, on both sides
Bounds = tuple[float, float] | None


def to_z(x: Column, bounds: Bounds, kind: str) -> Column:
    """The scale on which a metalog of that kind is linear."""
    if kind == "u":
        return x
    low, high = bounds
    return {"sl": lambda: F.log(x - low), "su": lambda: -F.log(high - x), "b": lambda: F.log((x - low) / (high - x))}[kind]()


def from_z(z: Column, bounds: Bounds, kind: str) -> Column:
    if kind == "u":
        return z
    low, high = bounds
    return {"sl": lambda: low + F.exp(z), "su": lambda: high - F.exp(-z), "b": lambda: (low + high * F.exp(z)) / (1 + F.exp(z))}[kind]()


def basis(y, terms: int, log=math.log) -> list:
    """The first basis functions of a metalog at probability y, a number or,
    with F.log, a column: 1, logit, centred times logit, centred, then powers
    of the centred probability, in turn with and without the logit."""
    c, logit = y - 0.5, log(y / (1 - y))
    out = [c * 0 + 1, logit, c * logit, c][:terms]
    for k in range(5, terms + 1):
        power = c
        for _ in range(2 + (k - 5) // 2):
            power = power * c
        out.append(power if k % 2 else logit * power)
    return out


def metalog(values: list[Column], probs: list[float], bounds: Bounds = None, kind: str = "u") -> list[Column]:
    """Coefficients of the metalog with as many terms as percentiles: the
    inverse of its k x k system is folded into the expression."""
    inverse = np.linalg.inv(np.array([basis(p, len(probs)) for p in probs]))
    z = [to_z(v, bounds, kind) for v in values]
    return [sum((float(w) * x for w, x in zip(row[1:], z[1:])), float(row[0]) * z[0]) for row in inverse]


def metalog_number(a: tuple[np.ndarray, ...], u) -> np.ndarray:
    """metalog_at() of an unbounded metalog, of numbers and arrays."""
    return sum(x * b for x, b in zip(a, basis(u, len(a), np.log)))


def metalog_z(a: list[Column], u: Column) -> Column:
    parts = [x * b for x, b in zip(a, basis(u, len(a), F.log))]
    return sum(parts[1:], parts[0])


def metalog_at(a: list[Column], u: Column, bounds: Bounds = None, kind: str = "u") -> Column:
    return from_z(metalog_z(a, u), bounds, kind)


@functools.cache
def _falling() -> Callable:
    @F.pandas_udf("boolean")
    def falls(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in frames:
            yield pd.Series(steps_down(np.array(rows.tolist(), float))) if len(rows) else pd.Series([], dtype=bool)

    return falls


def steps_down(a: np.ndarray) -> np.ndarray:
    """infeasible() of rows of coefficients."""
    values = sum(a[:, [i]] * np.array(b) for i, b in enumerate(zip(*(basis(k / 50.0, a.shape[1]) for k in range(1, 50)))))
    with np.errstate(invalid="ignore"):
        return (np.diff(values, axis=1) < 0).any(axis=1)


def infeasible(a: list[Column]) -> Column:
    """True where the quantile function steps down on 0.02, 0.04, ..., 0.98;
    every kind rises where its z does. In vectors: as expressions, every step
    of a row would work out its coefficients again."""
    known = a[0].isNotNull()
    for x in a[1:]:
        known = known & x.isNotNull()
    flat = F.array(*[F.coalesce(x, F.lit(0.0)) for x in a])
    return F.when(known, _falling()(flat))


def moments(a: np.ndarray, probs: np.ndarray, bounds: Bounds, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sd over the given probabilities of rows of coefficients."""
    z = sum(a[:, [i]] * np.array(b) for i, b in enumerate(zip(*(basis(u, a.shape[1]) for u in probs))))
    if kind != "u":
        low, high = bounds
        z = {"sl": lambda: low + np.exp(z), "su": lambda: high - np.exp(-z), "b": lambda: (low + high * np.exp(z)) / (1 + np.exp(z))}[kind]()
    mean = np.cumsum(z, axis=1)[:, -1] / len(probs)
    return mean, np.sqrt(np.cumsum(z * z, axis=1)[:, -1] / len(probs) - mean * mean)


def metalog_or_linear(a: list[Column], values: list[Column], probs: list[float], u: Column, bounds: Bounds = None, kind: str = "u") -> Column:
    """The metalog, or where it is infeasible the line through the percentiles."""
    return F.when(infeasible(a), quantile_linear(list(zip(probs, values)), u)).otherwise(metalog_at(a, u, bounds, kind))


def resolved(family: Column, lo: Column, mid: Column, hi: Column, bounds: Bounds = None, bar: float = 0.15) -> Column:
    """The family that a request stands for: auto is beta with bounds, else
    normal for small skew and lognormal for larger; what asks for logarithms of
    values that aren't positive is normal; no width is a triangle."""
    positive = (lo > 0) & (mid > 0) & (hi > 0)
    skew = skew_of(lo, mid, hi)
    auto = F.lit("beta") if bounds else F.when(finite(skew) & (F.abs(skew) < bar), "normal").otherwise("lognormal")
    found = F.when(family == "auto", auto).otherwise(family)
    flat = F.abs(hi - lo) < 1.5e-8 * F.greatest(F.abs(lo), F.lit(TINY))
    return F.when(flat, "triangular").when((found == "lognormal") & ~positive, "normal").otherwise(found)


def fit(lo: Column, mid: Column, hi: Column, family: Column | str, probs: tuple[float, float] = (0.05, 0.95), bounds: Bounds = None, kind: str | None = None) -> Column:
    """struct(family, valid, p) of each triplet. Values that aren't finite
    give no fit; a triplet without width is always its middle."""
    asked = F.lit(family) if isinstance(family, str) else family
    kind = kind or ("b" if bounds else "u")
    span = NormalDist().inv_cdf(probs[1]) - NormalDist().inv_cdf(probs[0])
    name = resolved(asked, lo, mid, hi, bounds)
    flat = F.abs(hi - lo) < 1.5e-8 * F.greatest(F.abs(lo), F.lit(TINY))
    a = metalog([lo, mid, hi], [probs[0], 0.5, probs[1]], bounds, kind)
    params = {
        "triangular": F.when(flat, F.array(mid, mid, mid)).otherwise(F.array(lo, mid, hi)), "uniform": F.array(lo, hi), "normal": F.array(mid, (hi - lo) / span),
        "lognormal": F.array(F.log(mid), (F.log(hi) - F.log(lo)) / span), "metalog": F.array(*a, infeasible(a).cast("double")), "linear_cdf": F.array(lo, mid, hi),
        "beta": F.array(*map(F.lit, bounds)) if bounds else F.lit(None).cast("array<double>"),
    }
    p = F.lit(None).cast("array<double>")
    for known, values in params.items():
        p = F.when(name == known, values).otherwise(p)
    good = finite(lo) & finite(mid) & finite(hi)
    return F.when(good, F.struct(name.alias("family"), p.isNotNull().alias("valid"), p.alias("p"))).otherwise(F.struct(asked.alias("family"), F.lit(False).alias("valid"), F.lit(None).cast("array<double>").alias("p")))


def quantile(f: Column, u: str, probs: tuple[float, float] = (0.05, 0.95), bounds: Bounds = None, kind: str | None = None, triplet: tuple[Column, Column, Column] | None = None) -> Column:
    """The value of a fit at the probability in column u; null without a fit.
    Beta needs the triplet and bounds, and leaves generated code."""
    kind, x = kind or ("b" if bounds else "u"), F.col(u)
    p = [F.get(f["p"], F.lit(i)) for i in range(4)]
    z = F.expr(qnorm_sql(u))
    out = F.when(f["family"] == "triangular", quantile_triangular(p[0], p[1], p[2], x))
    out = out.when(f["family"] == "uniform", p[0] + x * (p[1] - p[0])).when(f["family"] == "normal", p[0] + p[1] * z).when(f["family"] == "lognormal", F.exp(p[0] + p[1] * z))
    knots = [probs[0], 0.5, probs[1]]
    if triplet:
        line = quantile_linear(list(zip(knots, triplet)), x)
        out = out.when((f["family"] == "metalog") & (p[3] == 1), line)
    out = out.when(f["family"] == "metalog", metalog_at([p[0], p[1], p[2]], x, bounds, kind))
    out = out.when(f["family"] == "linear_cdf", quantile_linear(list(zip(knots, (p[0], p[1], p[2]))), x))
    if triplet and bounds:
        out = out.when(f["family"] == "beta", special.beta_draw(*triplet, x, *bounds))
    return F.when(f["valid"], out)


def check(f: Column) -> Column:
    """struct(valid, message) of a fit's parameters."""
    p, name = [F.get(f["p"], F.lit(i)) for i in range(4)], f["family"]
    last = F.get(f["p"], F.size(f["p"]) - 1)
    bad = F.when(f["p"].isNull(), "no fit")
    bad = bad.when(name.isin("triangular", "uniform") & ~(finite(p[0]) & finite(last) & (p[0] <= last)), "low must be finite and not above high")
    bad = bad.when((name == "triangular") & ((p[1] < p[0]) | (p[1] > p[2])), "mode outside the range")
    bad = bad.when(name.isin("normal", "lognormal") & ~(finite(p[0]) & finite(p[1]) & (p[1] >= 0)), "mean and sd must be finite, sd not negative")
    bad = bad.when((name == "beta") & ~(finite(p[0]) & finite(p[1]) & (p[0] < p[1])), "lower must be below upper")
    bad = bad.when(~name.isin(*FAMILIES), F.concat(F.lit("unknown family "), name))
    note = F.when((name == "metalog") & (p[3] == 1), "infeasible, drawn from the line").otherwise("")
    return F.struct(bad.isNull().alias("valid"), F.coalesce(bad, note).alias("message"))
