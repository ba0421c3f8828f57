"""Fusion of prior and likelihood percentiles by distribution family."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import families
from ..functions import scalar as S
from ..functions.normal import qnorm_sql, uniform
from . import simulate
from .stats import quantiles_at

ROUTES = ("normal", "lognormal", "gamma", "metalog")


def fused(family: str, prior: Column, likelihood: Column) -> Column:
    """The closed-form update of two parameter structs of one family: normal
    (mu, sigma), beta (alpha, beta) or gamma (shape, rate)."""
    a, b = prior, likelihood
    if family == "normal":
        return S.update_normal(a["mu"], a["sigma"], b["mu"], b["sigma"])
    if family == "beta":
        return S.fuse_beta(a["alpha"], a["beta"], b["alpha"], b["beta"])
    if family == "gamma":
        return S.fuse_gamma(a["shape"], a["rate"], b["shape"], b["rate"])
    raise ValueError(f"no closed form for {family}")


def interior(columns: dict[float, str]) -> dict[float, str]:
    return {p: c for p, c in sorted(columns.items()) if 0 < p < 1}


def outer(columns: dict[float, str]) -> tuple[float, float]:
    """The outermost inner probabilities beside the median."""
    tails = [p for p in interior(columns) if p != 0.5]
    if 0.5 not in columns or len(tails) < 2:
        raise ValueError("a median and two other inner percentiles are needed")
    return tails[0], tails[-1]


def aligned(rows: DataFrame, prior: dict[float, str], likelihood: dict[float, str]) -> tuple[DataFrame, dict[float, str], dict[float, str]]:
    """Both sides at the probabilities of the narrower one: the other is
    interpolated, and must reach as far."""
    if set(prior) == set(likelihood):
        return rows, prior, likelihood
    width = lambda c: max(c) - min(c)
    target, source, name = (prior, likelihood, "lik") if width(prior) <= width(likelihood) else (likelihood, prior, "pri")
    if min(target) < min(source) or max(target) > max(source):
        raise ValueError("probabilities lie outside the other side's range")
    knots = [(p, F.col(c)) for p, c in sorted(source.items())]
    new = {p: f"{name}_at_{round(p * 1000)}" for p in sorted(target)}
    rows = rows.withColumns({c: S.quantile_linear(knots, F.lit(p)) for p, c in new.items()})
    return (rows, prior, new) if target is prior else (rows, new, likelihood)


def normal_side(columns: dict[float, str]) -> Column:
    lo, hi = outer(columns)
    z = NormalDist().inv_cdf(hi) - NormalDist().inv_cdf(lo)
    return F.struct(F.col(columns[0.5]).alias("mu"), ((F.col(columns[hi]) - F.col(columns[lo])) / z).alias("sigma"))


def gamma_side(columns: dict[float, str]) -> Column:
    """By moments of the percentile values themselves."""
    values = [F.col(c) for c in columns.values()]
    mean = sum(values[1:], values[0]) / len(values)
    var = sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / len(values)
    return S.moments_to_gamma(mean, var)


def metalog_moments(columns: dict[float, str], bounds: families.Bounds, kind: str) -> Column:
    """struct(mu, sigma, infeasible) of the metalog through the inner
    percentiles, over 200 probabilities; of the normal where it is infeasible."""
    inner = interior(columns)
    a = families.metalog([F.col(c) for c in inner.values()], list(inner), bounds, kind)
    probs = np.array([0.001 + k * 0.005 for k in range(200)])

    @F.pandas_udf("mu double, sigma double, infeasible boolean")
    def found(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            x = np.array(rows.tolist(), float).reshape(len(rows), len(inner))
            with np.errstate(over="ignore", invalid="ignore"):
                mu, sigma = families.moments(x, probs, bounds, kind)
            yield pd.DataFrame({"mu": mu, "sigma": sigma, "infeasible": families.steps_down(x)})

    known = functools.reduce(lambda x, y: x & y, [x.isNotNull() for x in a])
    m, n = found(F.array(*[F.coalesce(x, F.lit(0.0)) for x in a])), normal_side(columns)
    bad = known & m["infeasible"]
    return F.struct(*[F.when(bad, n[c]).when(known, m[c]).alias(c) for c in ("mu", "sigma")], F.when(known, m["infeasible"]).alias("infeasible"))


def fuse_cells(rows: DataFrame, prior: dict[float, str], likelihood: dict[float, str], family: str, bounds: families.Bounds = None, kind: str = "b") -> DataFrame:
    """rows with `posterior` and `route`, in closed form by family.

    normal and metalog give (mu, sigma), lognormal the same on the linear
    scale, gamma (shape, rate): where its update is infeasible, that of the
    normal distributions of the same moments, with the route gamma_fallback.
    Sides with other probabilities are aligned() first.
    """
    rows, prior, likelihood = aligned(rows, prior, likelihood)
    if family == "normal":
        return rows.withColumns({"posterior": fused("normal", normal_side(prior), normal_side(likelihood)), "route": F.lit("normal")})
    if family == "lognormal":
        logs = rows.withColumns({"__a": normal_side(prior), "__b": normal_side(likelihood)})
        logs = logs.withColumns({c: S.normal_to_log(F.col(f"{c}.mu"), F.col(f"{c}.sigma")) for c in ("__a", "__b")}).withColumn("__p", fused("normal", F.col("__a"), F.col("__b")))
        return logs.withColumns({"posterior": S.log_to_normal(F.col("__p.mu"), F.col("__p.sigma")), "route": F.lit("lognormal")}).drop("__a", "__b", "__p")
    if family == "gamma":
        both = rows.withColumns({"__a": gamma_side(prior), "__b": gamma_side(likelihood)})
        both = both.withColumns({"__f": fused("gamma", F.col("__a"), F.col("__b")), "__m": S.gamma_to_moments(F.col("__a.shape"), F.col("__a.rate")), "__n": S.gamma_to_moments(F.col("__b.shape"), F.col("__b.rate"))})
        both = both.withColumn("__u", S.update_normal(F.col("__m.mean"), F.sqrt("__m.var"), F.col("__n.mean"), F.sqrt("__n.var")))
        back = S.moments_to_gamma(F.col("__u.mu"), F.col("__u.sigma") * F.col("__u.sigma"))
        whole = F.struct(F.col("__f.shape").alias("shape"), F.col("__f.rate").alias("rate"))
        return both.withColumns({"posterior": F.when(F.col("__f.feasible"), whole).otherwise(back), "route": F.when(F.col("__f.feasible"), "gamma").otherwise("gamma_fallback")}).drop("__a", "__b", "__f", "__m", "__n", "__u")
    if family == "metalog":
        both = rows.withColumns({"__a": metalog_moments(prior, bounds, kind), "__b": metalog_moments(likelihood, bounds, kind)})
        route = F.when(F.col("__a.infeasible") | F.col("__b.infeasible"), "metalog_fallback").otherwise("metalog")
        return both.withColumns({"posterior": fused("normal", F.col("__a"), F.col("__b")), "route": route}).drop("__a", "__b")
    raise ValueError(f"unknown family {family}")


def family_of_cells(cells: DataFrame, columns: dict[float, str], bounded: bool = False, bar: float = 0.15) -> DataFrame:
    """One row (family, skew): what auto stands for, by the medians of the
    outer percentiles over all cells."""
    lo, hi = outer(columns)
    # Medians by ranks of distinct values: no task holds all cells.
    names = F.array(*[F.struct(F.lit(n).alias("which"), F.col(columns[p]).cast("double").alias("v")) for p, n in ((lo, "lo"), (0.5, "mid"), (hi, "hi"))])
    each = quantiles_at(cells.select(F.explode(names).alias("x")).select("x.*"), ["which"], "v", {"md": 0.5})
    m = each.agg(*[F.max(F.when(F.col("which") == n, F.col("md"))).alias(n) for n in ("lo", "mid", "hi")])
    skew = (F.col("hi") + F.col("lo") - 2 * F.col("mid")) / (F.col("hi") - F.col("lo"))
    return m.select(F.lit("beta").alias("family") if bounded else F.when(F.abs(skew) < bar, "normal").otherwise("lognormal").alias("family"), skew.alias("skew"))


def fuse_composition(rows: DataFrame, keys: list[str], prior: dict[str, tuple[str, str, str]], likelihood: dict[str, tuple[str, str, str]], n: int, z_prior: float, z_likelihood: float) -> DataFrame:
    """Joint posterior of three parts that sum to 100: both sides' triplets
    become means and covariances of log-ratios, by n draws, which are fused;
    (keys, x, y, xx, xy, yy, one column a part). The parts sum to 100."""
    a = simulate.ilr_moments(rows, keys, prior, n, z_prior, seed=1)
    b = simulate.ilr_moments(rows, keys, likelihood, n, z_likelihood, seed=2)
    names = ("m1", "m2", "s11", "s12", "s22")
    both = a.join(b.select(*keys, *[F.col(c).alias(f"__{c}") for c in names]), keys)
    c = F.col
    post = S.fuse_bivariate((c("m1"), c("m2")), (c("s11"), c("s12"), c("s22")), (c("__m1"), c("__m2")), (c("__s11"), c("__s12"), c("__s22")))
    found = both.select(*keys, post.alias("p")).select(*keys, "p.*")
    return found.withColumns(dict(zip(prior, S.ilr_inverse(c("x"), c("y")))))


def composition_draws(posterior: DataFrame, keys: list[str], parts: tuple[str, str, str], n: int, seed: int = 1) -> DataFrame:
    """n draws of the parts from (x, y, xx, xy, yy): each sums to 100."""
    drawn = simulate.realizations(posterior, n).withColumns({f"__{k}": uniform(*[F.col(c) for c in keys], F.col("sim"), k, seed) for k in ("e1", "e2")})
    drawn = drawn.withColumns({f"__z{k}": F.expr(qnorm_sql(f"__e{k}")) for k in (1, 2)})
    first = F.sqrt("xx")
    x = F.col("x") + first * F.col("__z1")
    y = F.col("y") + F.col("xy") / first * F.col("__z1") + F.sqrt(F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0))) * F.col("__z2")
    return drawn.withColumns({"__x": x, "__y": y}).select(*keys, "sim", *[v.alias(p) for p, v in zip(parts, S.ilr_inverse(F.col("__x"), F.col("__y")))])


def composition_groups(properties: list[str], groups: dict[str, tuple[list[str], list[str]]]) -> tuple[list[str], dict[str, bool]]:
    """(properties to simulate, which groups are active): a group (members,
    stand-ins) whose members are all asked for is replaced by its stand-ins, at
    the place of its first member; others stay as they are."""
    out, active = list(properties), {}
    for name, (members, stand_ins) in groups.items():
        active[name] = all(m in out for m in members)
        if active[name]:
            at = min(out.index(m) for m in members)
            out = [p for p in out[:at] if p not in members] + list(stand_ins) + [p for p in out[at:] if p not in members]
    return out, active


def restored(draws: DataFrame, members: list[str], stand_ins: list[str], total: float = 100.0) -> DataFrame:
    """Draws of log-ratios back as the parts, which sum to the total."""
    parts = S.ilr_inverse(F.col(stand_ins[0]), F.col(stand_ins[1]), total)
    return draws.withColumns(dict(zip(members, parts))).drop(*stand_ins)
