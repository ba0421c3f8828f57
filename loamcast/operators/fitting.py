"""Distribution families fitted to groups of values by maximum likelihood, and
how well they fit.

Fits need sums over a group only: moments of values and logarithms, and for
Weibull power sums in a few rounds. No group's values are collected. Tests of
fit need each value's rank in its group, from stats.positions().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.normal import tail_sql
from ..functions.scalar import finite
from .stats import positions

FAMILIES = ("normal", "lognormal", "exponential", "gamma", "weibull", "beta")
LEAST = 5  # values below which nothing is fitted
WEIBULL_ROUNDS = 8
EDGE = 1e-6  # scaled values of the beta family are kept this far from 0 and 1
TEXTURES = ("sand", "silt", "clay")


def candidates(name: str, requested: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """Families to try for a property: beta and normal for parts of a
    composition, normal and gamma for pH, else normal, lognormal, gamma and
    Weibull; of these the requested ones, or all that were requested where
    none of them is among these."""
    usual = ("beta", "normal") if name.startswith(TEXTURES) else ("normal", "gamma") if name.startswith("ph") else ("normal", "lognormal", "gamma", "weibull")
    if requested is None:
        return usual
    return tuple(f for f in requested if f in usual) or tuple(requested)


def _sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a group of LEAST finite values: their number, moments, range,
    and moments of logarithms where all are positive."""
    x = F.col(value)
    log = F.log(F.when(x > 0, x))
    found = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(log).alias("lm"), F.var_pop(log).alias("lv"))
    return found.where(F.col("n") >= LEAST)


def _weibull(rows: DataFrame, sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, shape, scale) by Newton's method on power sums: one aggregate
    over the rows a round. Groups with a value that isn't positive, or without
    spread, have none."""
    start = sums.where("lo > 0 and lo < hi").select(*keys, "n", "lm", (F.lit(np.pi / np.sqrt(6)) / F.sqrt("lv")).alias("shape"))
    t = F.log(value) - F.col("lm")  # about the mean logarithm, so powers stay in range
    for _ in range(WEIBULL_ROUNDS):
        power = F.exp(F.col("shape") * t)
        joined = rows.join(start, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("lm").alias("lm"), F.first("shape").alias("shape"), F.sum(power).alias("s0"), F.sum(t * power).alias("s1"), F.sum(t * t * power).alias("s2"))
        k, mean = F.col("shape"), F.col("s1") / F.col("s0")
        better = k - (mean - 1 / k) / (F.col("s2") / F.col("s0") - mean * mean + 1 / (k * k))
        start = joined.select(*keys, "n", "lm", F.greatest(better, k / 4).alias("shape"))
    power = F.exp(F.col("shape") * t)
    last = rows.join(start, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("lm").alias("lm"), F.first("shape").alias("shape"), F.sum(power).alias("s0"))
    return last.select(*keys, "shape", F.exp(F.col("lm") + F.log(F.col("s0") / F.col("n")) / F.col("shape")).alias("scale"))


def _beta_sums(rows: DataFrame, sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high, and moments of the scaled values and their
    logarithms); the support reaches from 0 to 100, or as far as values do."""
    support = sums.select(*keys, F.least("lo", F.lit(0.0)).alias("low"), F.greatest("hi", F.lit(100.0)).alias("high"))
    y = F.least(F.greatest((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")), F.lit(EDGE)), F.lit(1 - EDGE))
    return rows.join(support, keys).withColumn("__y", y).groupBy(*keys).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.avg("__y").alias("ym"), F.var_samp("__y").alias("yv"), F.avg(F.log("__y")).alias("ga"), F.avg(F.log1p(-F.col("__y"))).alias("gb"))


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gamma and beta parameters of groups, from their sums."""
    for frame in frames:
        out = frame.copy()
        m, lm = frame["m"].to_numpy(float), frame["lm"].to_numpy(float)
        apart = frame["lo"].to_numpy(float) < frame["hi"].to_numpy(float)
        good = apart & (frame["lo"].to_numpy(float) > 0)
        out["gamma_shape"] = np.nan
        if good.any():
            out.loc[good, "gamma_shape"] = special.gamma_shape(np.log(m[good]) - lm[good])
        spread = apart & (frame["yv"].to_numpy(float) > 0)
        out["beta_a"] = out["beta_b"] = np.nan
        if spread.any():
            ym, yv, ga, gb = (frame[c].to_numpy(float)[spread] for c in ("ym", "yv", "ga", "gb"))
            common = ym * (1 - ym) / np.maximum(yv, 1e-9) - 1
            out.loc[spread, "beta_a"], out.loc[spread, "beta_b"] = special.beta_newton(ga, gb, np.maximum(ym * common, 0.1), np.maximum((1 - ym) * common, 0.1), 40)
        for name, a in (("gamma_log", out["gamma_shape"]), ("beta_log", out["beta_a"]), ("beta_log2", out["beta_b"]), ("beta_log3", out["beta_a"] + out["beta_b"])):
            out[name] = special.LGAMMA(np.where(np.isfinite(a), a, 1.0))
        yield out.drop(columns=["lo", "hi", "m", "lm", "ym", "yv"])


def fitted(rows: DataFrame, keys: list[str], value: str, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(keys, family, a, b, low, high, n, loglik, aic, bic, place): each family
    fitted to each group by maximum likelihood, by AIC.

    a and b: mean and sd (of logarithms for lognormal), the rate, shape and
    rate (gamma), shape and scale (Weibull), or both shapes (beta, whose
    likelihood is that of values scaled from low..high to 0..1). Nulls, NaN and
    infinite values are no values; groups of fewer than LEAST have no fits.
    Families of positive values are left out where one isn't, and those with a
    spread where there is none. Null keys are in no group.
    """
    x = rows.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__x"))
    sums = _sums(x, keys, "__x")
    wide = sums
    if "weibull" in families:
        wide = wide.join(_weibull(x, sums, keys, "__x"), keys, "left")
    if {"gamma", "beta"} & set(families):
        stats = sums.select(*keys, "lo", "hi", "m", "lm").join(_beta_sums(x, sums, keys, "__x"), keys)
        added = "low double, high double, ga double, gb double, gamma_shape double, beta_a double, beta_b double, gamma_log double, beta_log double, beta_log2 double, beta_log3 double"
        kinds = ", ".join(f"`{k}` {x.schema[k].dataType.simpleString()}" for k in keys)
        wide = wide.join(stats.mapInPandas(_solved, f"{kinds}, {added}"), keys)
    n, m, v, lm, lv = (F.col(c) for c in ("n", "m", "v", "lm", "lv"))
    positive, apart, none = F.col("lo") > 0, F.col("lo") < F.col("hi"), F.lit(None).cast("double")  # moments of equal values may be off by rounding
    gauss = lambda s: -0.5 * n * (F.log(2 * np.pi * s) + 1)

    def one(name: str, a: Column, b: Column, loglik: Column, count: int, when: Column, low: Column = none, high: Column = none) -> Column:
        parts = {"a": a, "b": b, "low": low, "high": high, "loglik": loglik, "aic": 2 * count - 2 * loglik, "bic": F.log(n) * count - 2 * loglik}
        return F.struct(F.lit(name).alias("family"), *[F.when(when, c).alias(k) for k, c in parts.items()])

    known = {"normal": lambda: one("normal", m, F.sqrt(v), gauss(v), 2, apart), "lognormal": lambda: one("lognormal", lm, F.sqrt(lv), gauss(lv) - n * lm, 2, positive & apart), "exponential": lambda: one("exponential", 1 / m, none, -n * (F.log(m) + 1), 1, positive)}
    if "weibull" in families:
        k, c = F.col("shape"), F.col("scale")
        known["weibull"] = lambda: one("weibull", k, c, n * (F.log(k) - k * F.log(c) + (k - 1) * lm - 1), 2, positive & k.isNotNull())
    if {"gamma", "beta"} & set(families):
        g, p, q = F.col("gamma_shape"), F.col("beta_a"), F.col("beta_b")
        known["gamma"] = lambda: one("gamma", g, g / m, n * ((g - 1) * lm - g - g * F.log(m / g) - F.col("gamma_log")), 2, finite(g))
        beta = n * ((p - 1) * F.col("ga") + (q - 1) * F.col("gb") + F.col("beta_log3") - F.col("beta_log") - F.col("beta_log2"))
        known["beta"] = lambda: one("beta", p, q, beta, 2, finite(p) & finite(q), F.col("low"), F.col("high"))
    unknown = [f for f in families if f not in known]
    if unknown:
        raise ValueError(f"unknown families: {unknown}")
    long = wide.select(*keys, "n", F.explode(F.array(*[known[f]() for f in families])).alias("f")).select(*keys, "n", "f.*").where("aic is not null")
    ranked = long.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy("aic")))  # a group's families
    return ranked.select(*keys, "family", "a", "b", "low", "high", "n", "loglik", "aic", "bic", "place")


def _special(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for family, a, b, low, high, x in frames:
        a, b, low, high, x = (s.to_numpy(float) for s in (a, b, low, high, x))
        below, above = np.full(len(x), np.nan), np.full(len(x), np.nan)
        at = (family == "gamma").to_numpy()
        if at.any():
            below[at], above[at] = special.gamma_cdf(x[at] * b[at], a[at])
        at = (family == "beta").to_numpy()
        if at.any():
            y = np.clip((x[at] - low[at]) / (high[at] - low[at]), EDGE, 1 - EDGE)
            below[at], above[at] = special.beta_cdf(y, a[at], b[at]), special.beta_cdf(1 - y, b[at], a[at])
        yield pd.DataFrame({"below": below, "above": above})


def distribution(fits_and_values: DataFrame, value: str, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Rows (family, a, b, low, high, value) with `below` and `above`, the
    probabilities on both sides of the value, each in full precision. Gamma
    and beta leave generated code."""
    x, a, b = F.col(value), F.col("a"), F.col("b")
    df = fits_and_values.withColumn("__z", F.when(F.col("family") == "lognormal", (F.log(x) - a) / b).when(F.col("family") == "normal", (x - a) / b))
    decay = F.when(F.col("family") == "weibull", F.pow(x / b, a)).when(F.col("family") == "exponential", a * x)
    below, above = F.expr(tail_sql("-__z")), F.expr(tail_sql("__z"))
    below, above = F.when(decay.isNotNull(), -F.expm1(-decay)).otherwise(below), F.when(decay.isNotNull(), F.exp(-decay)).otherwise(above)
    if {"gamma", "beta"} & set(families):
        special_of = F.pandas_udf(_special, "below double, above double")
        df = df.withColumn("__s", special_of("family", "a", "b", "low", "high", x))
        hard = F.col("family").isin("gamma", "beta")
        below, above = F.when(hard, F.col("__s.below")).otherwise(below), F.when(hard, F.col("__s.above")).otherwise(above)
    return df.withColumns({"below": below, "above": above}).drop("__z", "__s")


def goodness(rows: DataFrame, fits: DataFrame, keys: list[str], value: str, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(keys, family, n, ks, cvm, ad) of fitted() families: the statistics of
    Kolmogorov-Smirnov, Cramér-von Mises and Anderson-Darling.

    Equal values are one row with their count, whose ranks' sums have closed
    forms; so a group's distinct values meet the fits once, and the statistics
    are sums. Probabilities of 0 count as 1e-300.
    """
    at = positions(rows.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__x")), keys, "__x").withColumnRenamed("n", "__m")
    met = at.join(fits.drop("n"), keys)
    m, n, before = F.col("__m"), F.col("total"), F.col("before")
    after = before + m
    p = distribution(met, "__x", families)
    below, above = F.greatest("below", F.lit(1e-300)), F.greatest("above", F.lit(1e-300))
    odd = after * after - before * before  # sum of 2i - 1 over the ranks
    cube = lambda k: k * (2 * k - 1) * (2 * k + 1) / 3  # noqa: E731  sum of (2i - 1)² up to k
    ks = F.max(F.greatest(after / n - F.col("below"), F.col("below") - before / n))
    cvm = F.sum(m * F.col("below") * F.col("below") - F.col("below") / n * odd + (cube(after) - cube(before)) / (4 * n * n)) + 1 / (12 * F.max(n))
    ad = -F.max(n) - F.sum(odd * F.log(below) + (2 * n * m - odd) * F.log(above)) / F.max(n)
    return p.groupBy(*keys, "family").agg(F.max(n).alias("n"), ks.alias("ks"), cvm.alias("cvm"), ad.alias("ad"))
