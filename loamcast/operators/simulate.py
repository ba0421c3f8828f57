"""Simulation as explode and transform: draws are hashed from keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_words, uniforms
from ..functions.normal import pnorm_at, qnorm_at, qnorm_sql, uniform
from ..functions.scalar import ilr, quantile_triangular, water_content


DRAWS = 1 << 16  # made at once


def realizations(rows: DataFrame, n: int) -> DataFrame:
    """Each row once for each realization 1..n, in column sim."""
    return rows.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n))))


def qnorm(u: Column, frame: DataFrame, name: str) -> DataFrame:
    """frame with the normal quantile of u as a column."""
    return frame.withColumn("__u", u).withColumn(name, F.expr(qnorm_sql("__u"))).drop("__u")


def cholesky(matrix: list[list[float]]) -> np.ndarray:
    """Lower factor of a correlation matrix, repaired first if needed."""
    return np.linalg.cholesky(positive_definite(np.array(matrix, float)))


def positive_definite(matrix: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Eigenvalues raised to `least`, then unit diagonal again."""
    matrix = (matrix + matrix.T) / 2
    values, vectors = np.linalg.eigh(matrix)
    if values.min() >= least:
        return matrix
    fixed = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def mixed(u: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Independent uniforms (..., k) under the Gaussian copula of a factor."""
    z = qnorm_at(u)
    out = np.empty_like(z)
    for i in range(z.shape[-1]):
        y = lower[i, 0] * z[..., 0]
        for j in range(1, i + 1):
            y = y + lower[i, j] * z[..., j]
        out[..., i] = pnorm_at(y)
    return out


def key_text(keys: list[str]) -> Column:
    """What stands before the name and seed in the hash of a draw."""
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))


def correlated_uniforms(rows: DataFrame, keys: list[str], names: list[str], matrix: list[list[float]], seed: int = 1) -> DataFrame:
    """Gaussian copula: columns u_<name> with the given normal correlations.
    Draws are those of uniform(keys, name, seed), made in vectors: as
    expressions they are more code than the JVM compiles."""
    lower = cholesky(matrix)
    endings = [f"{n}|{seed}".encode() for n in names]

    @F.pandas_udf(", ".join(f"u{i} double" for i in range(len(names))))
    def draw(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            u = mixed(uniforms([t.encode() for t in texts], endings), lower) if len(texts) else np.empty((0, len(endings)))
            yield pd.DataFrame(u, columns=[f"u{i}" for i in range(len(endings))])

    out = rows.withColumn("__u", draw(key_text(keys)))
    return out.withColumns({f"u_{n}": F.col(f"__u.u{i}") for i, n in enumerate(names)}).drop("__u")


def correlated_triangular(rows: DataFrame, keys: list[str], triplets: dict[str, tuple[str, str, str]], matrix: list[list[float]], seed: int = 1) -> DataFrame:
    """One column a property, drawn from its triangle under the copula."""
    drawn = correlated_uniforms(rows, keys, list(triplets), matrix, seed)
    out = drawn.withColumns({n: quantile_triangular(F.col(a), F.col(b), F.col(c), F.col(f"u_{n}")) for n, (a, b, c) in triplets.items()})
    return out.drop(*[f"u_{n}" for n in triplets])


def triangular_at(lo: np.ndarray, mode: np.ndarray, hi: np.ndarray, u: np.ndarray) -> np.ndarray:
    """quantile_triangular() of arrays, NaN above every number as in Spark."""
    with np.errstate(invalid="ignore", divide="ignore"):
        width = hi - lo
        sides = np.where(u >= (mode - lo) / width, hi - np.sqrt((1 - u) * width * (hi - mode)), lo + np.sqrt(u * width * (mode - lo)))
    return np.where(width <= 0, mode, sides)


def triangular_draws(texts: list[bytes], values: list[np.ndarray], names: list[str], lower: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(names, rows, n) draws of realizations 1..n under the copula of a
    factor: those of correlated_triangular() with keys and sim. texts are
    key_text() of the keys; values are low, mode and high of each name, null
    or NaN as NaN."""
    endings = [f"{sim}|{name}|{seed}".encode() for sim in range(1, n + 1) for name in names]
    out = np.empty((len(names), len(texts), n))
    step = max(1, DRAWS // len(endings))
    for k in range(0, len(texts), step):
        u = mixed(uniforms(texts[k : k + step], endings).reshape(-1, n, len(names)), lower)
        for i in range(len(names)):
            out[i, k : k + step] = triangular_at(*[v[k : k + step, None] for v in values[3 * i : 3 * i + 3]], u[:, :, i])
    return out


def repeated_triangular(rows: DataFrame, keys: list[str], triplets: dict[str, tuple[str, str, str]], matrix: list[list[float]], n: int, seed: int = 1) -> DataFrame:
    """rows once for each realization 1..n, in column sim, with one column a
    property: correlated_triangular() with keys and sim, where a row's draws
    are made together, from one text."""
    lower, names = cholesky(matrix), list(triplets)
    sides = [c for three in triplets.values() for c in three]
    fields = [f"p{i}" for i in range(len(names))]

    @F.arrow_udf(f"array<struct<sim:int, {', '.join(f'{p}:double' for p in fields)}>>")
    def draw(texts: pa.Array, *columns: pa.Array) -> pa.Array:
        whole = [np.asarray(c.is_valid()) for c in columns]
        out = triangular_draws(texts.to_pylist(), [c.to_numpy(zero_copy_only=False).astype(float) for c in columns], names, lower, n, seed)
        missing = [np.repeat(~(whole[3 * i] & whole[3 * i + 1] & whole[3 * i + 2]), n) for i in range(len(names))]
        sims = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(texts)))
        items = pa.StructArray.from_arrays([sims, *[pa.array(x.ravel(), mask=m) for x, m in zip(out, missing)]], names=["sim", *fields])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(texts) + 1, n, dtype=np.int32)), items)

    drawn = rows.withColumn("__x", F.explode(draw(key_text(keys).cast("binary"), *[F.col(c).cast("double") for c in sides])))
    return drawn.withColumns({"sim": F.col("__x.sim")} | {p: F.col(f"__x.p{i}") for i, p in enumerate(names)}).drop("__x")


def component_shares(components: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Percentages of the components of each map unit, closed to 100 in every
    realization."""
    drawn = realizations(components, n).withColumn("v", quantile_triangular(F.col("pct_l"), F.col("pct_r"), F.col("pct_h"), uniform(F.col("mukey"), F.col("cokey"), F.col("sim"), seed)))
    return drawn.withColumn("share", F.col("v") * 100 / F.sum("v").over(Window.partitionBy("mukey", "sim")))


def component_counts(components: DataFrame, n: int = 1000, seed: int = 1) -> DataFrame:
    """(cokey, sim_comppct): replications of each component, its n drawn
    percentages summed, by 100, to even. A missing low or high percentage is 2
    off; repeated rows count once."""
    ranges = {"pct_l": F.coalesce("pct_l", F.col("pct_r") - 2), "pct_h": F.coalesce("pct_h", F.col("pct_r") + 2)}
    # Few rows make many draws: they are dealt to all tasks, by the key that is grouped later.
    parts = int(components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = components.select("cokey", "pct_l", "pct_r", "pct_h").repartition(parts, "cokey").distinct().withColumns(ranges)
    rows = rows.select("cokey", F.concat_ws("|", F.col("cokey").cast("string"), F.lit("")).cast("binary").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("pct_l", "pct_r", "pct_h")])
    endings = [f"{sim}|{seed}".encode() for sim in range(1, n + 1)]
    block, few = max(1, (1 << 19) // n), max(1, (1 << 14) // n)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            lo, mode, hi = (batch.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in (2, 3, 4))
            sums = np.empty(len(keys))
            for k in range(0, len(keys), block):
                words = md5_words(keys[k : k + block], endings, 1)[:, :, 0]
                for at in range(0, len(words), few):  # so many that they stay in the cache
                    own = slice(k + at, min(k + at + few, k + block))
                    sums[own] = _triangular_sums(words[at : at + few], lo[own, 0], mode[own, 0], hi[own, 0])
            yield pa.record_batch([batch.column(0), pa.array(sums, mask=np.asarray(batch.column(3).is_null()))], names=["cokey", "total"])

    totals = rows.mapInArrow(drawn, f"cokey {rows.schema['cokey'].dataType.simpleString()}, total double")
    return totals.groupBy("cokey").agg(F.bround(F.sum("total") / 100, 0).cast("long").alias("sim_comppct"))


def _triangular_sums(words: np.ndarray, lo: np.ndarray, mode: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of the triangular draws of each row of digests' first words: those
    of quantile_triangular(), whose roots are added up before they are scaled."""
    u = words.byteswap() * 2.0**-32
    u += 2.0**-33
    n, width = u.shape[1], hi - lo
    with np.errstate(invalid="ignore", divide="ignore"):
        low = u < ((mode - lo) / width)[:, None]
        root = np.sqrt(np.where(low, u, 1 - u))
        left, count = np.where(low, root, 0.0).sum(axis=1), low.sum(axis=1)
        up, down = np.sqrt(np.maximum(width * (mode - lo), 0)), np.sqrt(np.maximum(width * (hi - mode), 0))
        total = count * lo + left * up + (n - count) * hi - (root.sum(axis=1) - left) * down
    return np.where(width <= 0, mode * n, total)


def constrained(draws: DataFrame, ranges: dict[str, tuple[float, float]], parts: list[str], total: float, ordered: list[tuple[str, str]]) -> DataFrame:
    """Clamps to ranges, closes parts to their total where they are off by
    more than 0.01, and keeps each first of a pair at or below the second.
    Nulls stay null. Adds `changed`: how many values the ranges changed."""
    clamped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in ranges.items()}
    changed = sum((F.coalesce((F.col(c) != v).cast("int"), F.lit(0)) for c, v in clamped.items()), F.lit(0))
    out = draws.withColumn("changed", changed).withColumns(clamped)
    if parts:
        whole = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
        off = (F.abs(whole - total) > 0.01) & (whole > 0)
        out = out.withColumns({c: F.when(off, F.col(c) * total / whole).otherwise(F.col(c)) for c in parts})
    return out.withColumns({low: F.when(F.col(low) > F.col(high), F.col(high)).otherwise(F.col(low)) for low, high in ordered})


def constrained_at(draws: dict[str, np.ndarray], ranges: dict[str, tuple[float, float]], parts: list[str], total: float, ordered: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    """constrained() of arrays, null as NaN."""
    out = draws | {c: np.minimum(np.maximum(draws[c], lo), hi) for c, (lo, hi) in ranges.items()}
    if parts:
        whole = sum(out[c] for c in parts)
        off = (np.abs(whole - total) > 0.01) & (whole > 0)
        out |= {c: np.where(off, out[c] * total / whole, out[c]) for c in parts}
    return out | {low: np.where(out[low] > out[high], out[high], out[low]) for low, high in ordered}


def ilr_moments(rows: DataFrame, keys: list[str], parts: dict[str, tuple[str, str, str]], n: int, z: float, seed: int = 1) -> DataFrame:
    """Means and covariances of the isometric log-ratios of three parts whose
    triplets are taken as normal; draws are kept above 0.01."""
    drawn = realizations(rows, n).withColumns({f"__{p}": uniform(*[F.col(k) for k in keys], F.col("sim"), p, seed) for p in parts})
    drawn = drawn.withColumns({p: F.greatest(F.col(mid) + (F.col(hi) - F.col(lo)) / (2 * z) * F.expr(qnorm_sql(f"__{p}")), F.lit(0.01)) for p, (lo, mid, hi) in parts.items()})
    z1, z2 = ilr(*[F.col(p) for p in parts])
    spread = drawn.withColumns({"z1": z1, "z2": z2})
    return spread.groupBy(*keys).agg(F.avg("z1").alias("m1"), F.avg("z2").alias("m2"), F.var_samp("z1").alias("s11"), F.covar_samp("z1", "z2").alias("s12"), F.var_samp("z2").alias("s22"))


FIELD, WILT, CM = -33.0, -1500.0, 10.19716  # suctions in kPa, and cm of water in one


def available_water(layers: DataFrame, n: int, seed: int = 123) -> DataFrame:
    """Draws of water held between field capacity and wilting point; alpha and
    n are drawn as base-10 logarithms. Layers with a missing parameter have no
    draws; every layer has a stream of its own."""
    params = ("alpha", "npar", "theta_r", "theta_s")
    whole = layers.dropna(subset=[*params, *(f"{p}_sd" for p in params)])
    drawn = realizations(whole, n).withColumns({f"__{p}": uniform(F.col("layer"), F.col("sim"), p, seed) for p in params})
    drawn = drawn.withColumns({f"d_{p}": F.col(p) + F.col(f"{p}_sd") * F.expr(qnorm_sql(f"__{p}")) for p in params})
    alpha, shape = F.pow(F.lit(10.0), F.col("d_alpha")), F.pow(F.lit(10.0), F.col("d_npar"))
    held = lambda kpa: water_content(kpa * CM, alpha, shape, F.col("d_theta_r"), F.col("d_theta_s"))
    return drawn.withColumns({"field": held(FIELD), "wilt": held(WILT)}).withColumn("awhc", F.col("field") - F.col("wilt")).drop(*[f"__{p}" for p in params], *[f"d_{p}" for p in params])
