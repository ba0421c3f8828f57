"""Priors of properties: families fitted to each horizon's triplets, fused
with observed data, and drawn under one copula.

A prior is a struct (family, p, source): p holds the parameters of
families.fit(), for beta both shapes and the bounds, and for `empirical` the
sorted values of a sample. Everything is a column expression, but beta and
fusion with samples, which run in vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import families, special
from ..functions.hashing import uniforms
from ..functions.normal import qnorm_at, qnorm_sql
from ..functions.scalar import finite, fuse_beta, moments_to_beta, normal_to_log, quantile_linear, quantile_triangular, update_normal
from .density import posterior_samples
from .simulate import cholesky, key_text, mixed

PRIOR = "struct<family: string, p: array<double>, source: string>"
SPREAD = 0.2  # of a value that stands alone
CLOSED = ("normal", "lognormal", "beta")


@dataclass(frozen=True)
class Setup:
    """How a property is fitted: its family, bounds, and the probabilities of
    low and high."""

    family: str = "auto"
    bounds: tuple[float, float] | None = None
    probs: tuple[float, float] = (0.05, 0.95)


@dataclass(frozen=True)
class Observed:
    """What was measured of a property, for all horizons alike: a sample, or
    mean and sd (for beta, var or both shapes instead of sd)."""

    sample: tuple[float, ...] = ()
    mean: float | None = None
    sd: float | None = None
    var: float | None = None
    shapes: tuple[float, float] | None = None
    names: tuple[str, ...] = field(default=(), repr=False)


def triplet_of(values, probs: tuple[float, float] = (0.05, 0.95)) -> tuple[float, float, float]:
    """low, representative and high: of a mapping with these names or l, r, h,
    of three values as they stand, or of a sample's own quantiles."""
    if isinstance(values, dict):
        for names in (("low", "rep", "high"), ("l", "r", "h")):
            if all(n in values for n in names):
                return tuple(float(values[n]) for n in names)
        raise ValueError("a triplet has low, rep and high, or l, r and h")
    held = np.array([v for v in values if v is not None and np.isfinite(v)] if len(values) != 3 else list(values), float)
    if len(values) == 3:
        return tuple(map(float, held))
    return tuple(map(float, np.quantile(held, [probs[0], 0.5, probs[1]])))


def _prior(family, p: Column, source) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(family).alias("family"), p.cast("array<double>").alias("p"), lit(source).alias("source"))


def _beta_shapes(lo: Column, mid: Column, hi: Column, bounds: tuple[float, float]) -> Column:
    def shapes(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in frames:
            x = np.column_stack([s.to_numpy(float) for s in parts])
            good = np.isfinite(x).all(axis=1)
            out: list = [None] * len(x)
            if good.any():
                a, b = special.beta_fit(x[good], *bounds)
                for k, values in zip(np.flatnonzero(good), np.column_stack([a, b, np.full(len(a), bounds[0]), np.full(len(a), bounds[1])])):
                    out[k] = values
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(shapes, "array<double>")(lo, mid, hi)


def _params(setup: Setup, lo: Column, mid: Column, hi: Column) -> Column:
    """Parameters of the families that a setup can resolve to, by __family;
    null for beta, which is fitted in vectors."""
    if setup.family not in (*families.FAMILIES, "auto"):
        raise ValueError(f"unknown family {setup.family}")
    span = NormalDist().inv_cdf(setup.probs[1]) - NormalDist().inv_cdf(setup.probs[0])
    flat = F.abs(hi - lo) < 1.5e-8 * F.greatest(F.abs(lo), F.lit(1e-12))
    found = {"triangular": F.when(flat, F.array(mid, mid, mid)).otherwise(F.array(lo, mid, hi))}
    if setup.family in ("normal", "lognormal", "auto"):
        found["normal"] = F.array(mid, (hi - lo) / span)
    if setup.family in ("lognormal", "auto"):
        found["lognormal"] = F.array(F.log(mid), (F.log(hi) - F.log(lo)) / span)
    if setup.family == "uniform":
        found["uniform"] = F.array(lo, hi)
    if setup.family == "linear_cdf":
        found["linear_cdf"] = F.array(lo, mid, hi)
    if setup.family == "metalog":
        a = families.metalog([lo, mid, hi], [setup.probs[0], 0.5, setup.probs[1]])
        found["metalog"] = F.array(*a, families.infeasible(a).cast("double"))
    out = F.lit(None).cast("array<double>")
    for name, p in found.items():
        out = F.when(F.col("__family") == name, p).otherwise(out)
    return out


def fitted(rows: DataFrame, properties: dict[str, Setup]) -> DataFrame:
    """rows with prior_<property>, from its columns _l, _r and _h.

    A missing low or high is SPREAD of r away; crossed values are put in
    order. A triplet that gives no valid fit falls back to a triangle around
    r, with source "fallback"; without r the prior is null.
    """
    for name, setup in properties.items():
        # Steps are columns of their own, so that expressions stay small.
        held = {c: F.col(f"{name}_{c}").cast("double") for c in "lrh"}
        rows = rows.withColumns({f"__{c}": F.when(finite(x), x) for c, x in held.items()})
        r, spread = F.col("__r"), SPREAD * F.abs("__r")
        rows = rows.withColumns({"__lo": F.when(r.isNotNull(), F.least(F.coalesce("__l", r - spread), r)), "__hi": F.when(r.isNotNull(), F.greatest(F.coalesce("__h", r + spread), r))})
        lo, hi = F.col("__lo"), F.col("__hi")
        whole = F.col("__l").isNotNull() & F.col("__h").isNotNull()
        rows = rows.withColumn("__family", families.resolved(F.lit(setup.family), lo, r, hi, setup.bounds))
        p = _params(setup, lo, r, hi)
        if setup.bounds and setup.family in ("auto", "beta"):
            p = F.when(F.col("__family") == "beta", _beta_shapes(lo, r, hi, setup.bounds)).otherwise(p)
        fallback = _prior("triangular", F.array(r - spread, r, r + spread), "fallback")
        rows = rows.withColumn("__params", p)
        rows = rows.withColumn("__good", F.coalesce(F.forall("__params", finite), F.lit(False)))
        own = _prior(F.col("__family"), F.col("__params"), F.when(whole, "triplet").otherwise("estimated"))
        rows = rows.withColumn(f"prior_{name}", F.when(r.isNull(), F.lit(None).cast(PRIOR)).when(F.col("__good"), own).otherwise(fallback))
        rows = rows.drop("__l", "__r", "__h", "__lo", "__hi", "__family", "__params", "__good")
    return rows


def outcomes(setup: Setup, observed: Observed | None = None) -> tuple[str, ...]:
    """The families that a prior of this setup can have, after fusion."""
    usual = {"auto": ("beta",) if setup.bounds else ("normal", "lognormal"), "lognormal": ("normal", "lognormal")}.get(setup.family, (setup.family,))
    return tuple(dict.fromkeys(("triangular", *usual, *(("empirical",) if observed and observed.sample else ()))))


def _beta_at(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for params, us in frames:
        found = np.full(len(us), np.nan)
        at = np.flatnonzero(params.notna().to_numpy())
        if len(at):
            a, b, lo, hi = np.array([params.iloc[k] for k in at], float).T
            found[at] = lo + (hi - lo) * special.beta_quantile(us.to_numpy(float)[at], a, b)
        yield pd.Series(found)


def quantile(prior: Column, u: str, kinds: tuple[str, ...] = (*families.FAMILIES, "empirical"), probs: tuple[float, float] = (0.05, 0.95)) -> Column:
    """The value of a prior at the probability in column u; null without.
    kinds: the families that occur; others are null."""
    f, x, values = prior["family"], F.col(u), prior["p"]
    p = [F.get(values, F.lit(i)) for i in range(4)]
    z = F.expr(qnorm_sql(u))
    size = F.size(values)
    at = x * size - 0.5  # a sorted sample's k-th value of n stands at (k - 1/2) / n
    low = F.greatest(F.least(F.floor(at), size - 1), F.lit(0)).cast("int")
    share = F.least(F.greatest(at - low, F.lit(0.0)), F.lit(1.0))
    through = lambda: quantile_linear([(q, families.metalog_at(p[:3], F.lit(q))) for q in (probs[0], 0.5, probs[1])], x)
    known = {
        "triangular": lambda: quantile_triangular(p[0], p[1], p[2], x), "uniform": lambda: p[0] + x * (p[1] - p[0]), "normal": lambda: p[0] + p[1] * z, "lognormal": lambda: F.exp(p[0] + p[1] * z),
        "linear_cdf": lambda: quantile_linear(list(zip((probs[0], 0.5, probs[1]), p[:3])), x), "metalog": lambda: F.when(p[3] == 1, through()).otherwise(families.metalog_at(p[:3], x)),
        "empirical": lambda: F.get(values, low) * (1 - share) + F.get(values, F.least(low + 1, size - 1)) * share,
        "beta": lambda: F.pandas_udf(_beta_at, "double")(F.when(f == "beta", values), x),
    }
    out = F.lit(None).cast("double")
    for kind in kinds:
        out = F.when(f == kind, known[kind]()).otherwise(out)
    return out


def fused(rows: DataFrame, name: str, observed: Observed, keys: list[str], n: int = 1000, seed: int = 1) -> DataFrame:
    """rows whose prior_<name> was updated by what was observed.

    A sample: the prior is sampled at n even probabilities, and the product of
    both kernel densities sampled in turn; the posterior is `empirical`, with
    source "fused_sample". Moments: normal, lognormal and beta priors are
    updated in closed form (a lognormal one by the moments' logarithms; a beta
    one that turns infeasible by its normal moments); other families stay as
    they are. Null priors stay null.
    """
    prior = F.col(f"prior_{name}")
    if observed.sample:
        u = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: (k - 0.5) / n)
        # Few rows, long work each: dealt to all tasks.
        dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        spread = dealt.withColumn("__rid", F.xxhash64(*[F.col(k) for k in keys]))
        sampled = spread.withColumn("__a", _sampled(prior, u, n)).withColumn("__b", F.array(*[F.lit(float(v)) for v in observed.sample]))
        posted = posterior_samples(sampled, "__a", "__b", "__post", ["__rid"], n, seed=seed)
        changed = _prior("empirical", F.array_sort("__post"), "fused_sample")
        return posted.withColumn(f"prior_{name}", F.when(prior.isNotNull() & F.col("__post").isNotNull(), changed).otherwise(prior)).drop("__rid", "__a", "__b", "__post")
    if observed.mean is None and observed.shapes is None:
        raise ValueError("observed data are a sample, a mean with sd or var, or beta shapes")
    steps = [f"__p{i}" for i in range(4)]
    rows = rows.withColumns({c: F.get(prior["p"], F.lit(i)) for i, c in enumerate(steps)})
    p = [F.col(c) for c in steps]
    f, out = prior["family"], F.when(prior.isNull(), prior)
    sd = observed.sd if observed.sd is not None else observed.var**0.5 if observed.var is not None else None
    if observed.mean is not None and sd is not None:
        mean, spread = F.lit(float(observed.mean)), F.lit(float(sd))
        post = update_normal(p[0], p[1], mean, spread)
        out = out.when(f == "normal", _prior("normal", F.array(post["mu"], post["sigma"]), "fused_normal"))
        logs = normal_to_log(mean, spread)
        post = update_normal(p[0], p[1], logs["mu"], logs["sigma"])
        out = out.when(f == "lognormal", _prior("lognormal", F.array(post["mu"], post["sigma"]), "fused_lognormal"))
    width = p[3] - p[2]
    if observed.shapes:
        a, b = (F.lit(float(x)) for x in observed.shapes)
    else:
        scaled = moments_to_beta((F.lit(float(observed.mean)) - p[2]) / width, F.lit(float(sd) ** 2) / (width * width))
        a, b = scaled["alpha"], scaled["beta"]
    is_beta = f == "beta"
    rows = rows.withColumns({"__a": F.when(is_beta, a), "__b": F.when(is_beta, b)})
    moments = lambda x, y: (x / (x + y), F.sqrt(x * y / ((x + y) * (x + y) * (x + y + 1))))
    (m1, s1), (m2, s2) = (moments(F.when(is_beta, x), F.when(is_beta, y)) for x, y in ((p[0], p[1]), (F.col("__a"), F.col("__b"))))
    rows = rows.withColumns({"__both": fuse_beta(p[0], p[1], F.col("__a"), F.col("__b")), "__normal": update_normal(m1, s1, m2, s2)})
    both, normal = F.col("__both"), F.col("__normal")
    back = moments_to_beta(normal["mu"], normal["sigma"] * normal["sigma"])
    alpha, beta = F.when(both["feasible"], both["alpha"]).otherwise(back["alpha"]), F.when(both["feasible"], both["beta"]).otherwise(back["beta"])
    out = out.when(f == "beta", _prior("beta", F.array(alpha, beta, p[2], p[3]), "fused_beta")).otherwise(prior)
    return rows.withColumn(f"prior_{name}", out).drop(*steps, "__a", "__b", "__both", "__normal")


def _sampled(prior: Column, u: Column, n: int) -> Column:
    """A prior's values at each of an array of probabilities, in vectors."""
    z = np.array([NormalDist().inv_cdf((k - 0.5) / n) for k in range(1, n + 1)])
    probs = (np.arange(n) + 0.5) / n

    def values(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for family, params in frames:
            out: list = []
            for f, p in zip(family, params):
                if f is None or p is None or pd.isna(f):
                    out.append(None)
                elif f == "normal":
                    out.append(p[0] + p[1] * z)
                elif f == "lognormal":
                    out.append(np.exp(p[0] + p[1] * z))
                elif f == "uniform":
                    out.append(p[0] + (p[1] - p[0]) * probs)
                elif f == "triangular":
                    lo, mode, hi = p[:3]
                    cut = (mode - lo) / (hi - lo) if hi > lo else 0.0
                    out.append(np.where(probs < cut, lo + np.sqrt(np.maximum(probs * (hi - lo) * (mode - lo), 0)), hi - np.sqrt(np.maximum((1 - probs) * (hi - lo) * (hi - mode), 0))) if hi > lo else np.full(n, mode))
                elif f == "beta":
                    out.append(p[2] + (p[3] - p[2]) * special.beta_quantile(probs, np.full(n, p[0]), np.full(n, p[1])))
                elif f == "linear_cdf":
                    out.append(np.interp(probs, [0.05, 0.5, 0.95], p[:3]))
                elif f == "empirical":
                    out.append(np.interp(probs, (np.arange(len(p)) + 0.5) / len(p), p))
                elif f == "metalog":
                    basis = np.array(families.basis(probs, 3, np.log))
                    out.append(np.asarray(p[:3], float) @ basis)
                else:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(values, "array<double>")(prior["family"], prior["p"])


def summary(rows: DataFrame, properties: list[str]) -> DataFrame:
    """(property, family, source, n): what the priors are."""
    parts = F.array(*[F.struct(F.lit(p).alias("property"), F.col(f"prior_{p}.family").alias("family"), F.col(f"prior_{p}.source").alias("source")) for p in properties])
    return rows.select(F.explode(parts).alias("x")).select("x.*").groupBy("property", "family", "source").agg(F.count("*").alias("n"))


def simulated(rows: DataFrame, properties: dict[str, tuple[str, ...]], keys: list[str], n: int, matrix: list[list[float]], seed: int = 1) -> DataFrame:
    """(keys, sim, one column a property): n draws of each row's priors, under
    the Gaussian copula of `matrix`. properties: name and families that occur,
    from outcomes(). A property without a prior is null."""
    names, lower = list(properties), cholesky(matrix)
    endings = [f"{sim}|{name}|{seed}".encode() for sim in range(1, n + 1) for name in names]
    # Few rows make many draws: they are dealt to all tasks.
    held = rows.select(*keys, key_text(keys).alias("__text"), *[f"prior_{p}" for p in names])
    held = held.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, LOT // (n * len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                u = uniforms([t.encode() for t in part.column(len(keys)).to_pylist()], endings).reshape(part.num_rows, n, len(names))
                u = mixed(u, lower)
                each = pa.array(np.repeat(np.arange(part.num_rows), n))
                columns = [part.column(k).take(each) for k in range(len(keys))]
                columns.append(pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), part.num_rows)))
                for i, kinds in enumerate(properties.values()):
                    found = prior_quantiles(part.column(len(keys) + 1 + i).to_pylist(), u[:, :, i], kinds).ravel()
                    columns.append(pa.array(found, mask=np.isnan(found)))
                yield pa.record_batch(columns, names=[*keys, "sim", *names])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return held.mapInArrow(drawn, f"{kinds}, sim int, " + ", ".join(f"`{p}` double" for p in names))


LOT = 500_000  # draws that simulated() makes at once


def prior_quantiles(priors: list[dict | None], u: np.ndarray, kinds: tuple[str, ...], probs: tuple[float, float] = (0.05, 0.95)) -> np.ndarray:
    """quantile() of rows of probabilities, a prior a row; NaN without."""
    out = np.full(u.shape, np.nan)
    families_of = np.array([p["family"] if p and p["p"] is not None and p["family"] in kinds else "" for p in priors])
    knots = (probs[0], 0.5, probs[1])
    for kind in np.unique(families_of):
        at = np.flatnonzero(families_of == kind)
        x = u[at]
        if kind == "":
            continue
        if kind == "empirical":
            for k in at:
                v = np.array(priors[k]["p"], float)
                place = u[k] * len(v) - 0.5
                low = np.clip(np.floor(place), 0, len(v) - 1).astype(int)
                share = np.clip(place - low, 0, 1)
                out[k] = v[low] * (1 - share) + v[np.minimum(low + 1, len(v) - 1)] * share
            continue
        p = np.array([(list(priors[k]["p"]) + [None] * 4)[:4] for k in at], float)[:, :, None]
        a, b, c, d = (p[:, i] for i in range(4))
        if kind == "triangular":
            width = c - a
            with np.errstate(invalid="ignore", divide="ignore"):
                sides = np.where(x < (b - a) / width, a + np.sqrt(x * width * (b - a)), c - np.sqrt((1 - x) * width * (c - b)))
            out[at] = np.where(width <= 0, b, sides)
        elif kind == "uniform":
            out[at] = a + x * (b - a)
        elif kind in ("normal", "lognormal"):
            z = a + b * qnorm_at(x)
            out[at] = z if kind == "normal" else np.exp(z)
        elif kind == "beta":
            out[at] = c + (d - c) * special.beta_quantile(x, np.broadcast_to(a, x.shape), np.broadcast_to(b, x.shape))
        elif kind in ("linear_cdf", "metalog"):
            at_knots = [families.metalog_number((a, b, c), q) for q in knots] if kind == "metalog" else [a, b, c]
            line = np.where(x <= knots[0], at_knots[0], at_knots[2])
            for i in (0, 1):
                inside = (x > knots[i]) & (x <= knots[i + 1])
                line = np.where(inside, at_knots[i] + (at_knots[i + 1] - at_knots[i]) * (x - knots[i]) / (knots[i + 1] - knots[i]), line)
            out[at] = line if kind == "linear_cdf" else np.where(d == 1, line, families.metalog_number((a, b, c), x))
    return out
