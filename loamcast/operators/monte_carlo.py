"""The simulation pipeline: configuration, checks, draws, limits, scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, unsuitable
from .simulate import cholesky, constrained, constrained_at, key_text, positive_definite, repeated_triangular, triangular_draws
from .stats import column_quantiles

#: Physical limits of common properties.
LIMITS = {"sand": (0.0, 100.0), "silt": (0.0, 100.0), "clay": (0.0, 100.0), "bulk_density": (0.3, 3.0), "ph": (2.5, 11.0)}


@dataclass(frozen=True)
class Config:
    n: int = 1000
    seed: int = 1
    max_depth: float = 250.0
    least_points: int = 3
    least_share: float = 0.5
    limits: dict = field(default_factory=lambda: dict(LIMITS))
    parts: tuple = ()
    ordered: tuple = ()

    def checked(self) -> "Config":
        if self.n < 1:
            raise ValueError("n is at least 1")
        if not 0 <= self.least_share <= 1:
            raise ValueError("least_share is from 0 to 1")
        if self.max_depth <= 0:
            raise ValueError("max_depth is above 0")
        return self


def configured(base: Config | None = None, **changes) -> Config:
    """Defaults with changes; nested maps are merged, unknown names refused."""
    base = base or Config()
    if "limits" in changes:
        changes["limits"] = base.limits | changes["limits"]
    return replace(base, **changes).checked()


def usable(horizons: DataFrame, properties: list[str], config: Config) -> DataFrame:
    """Suitable horizons within the depth limit that have any property."""
    some = F.coalesce(*[F.col(f"{p}_r") for p in properties]).isNotNull()
    return horizons.where(~unsuitable(F.col("hzname")) & (F.col("hzdept_r") <= config.max_depth) & some)


def coverage(horizons: DataFrame, properties: list[str]) -> DataFrame:
    """Per property: rows with a whole triplet, with r alone, and without."""
    def kinds(p: str) -> list:
        whole = finite(F.col(f"{p}_l")) & finite(F.col(f"{p}_r")) & finite(F.col(f"{p}_h"))
        alone = finite(F.col(f"{p}_r")) & ~whole
        return [F.sum(F.when(c, 1).otherwise(0)).alias(f"{p}|{n}") for c, n in ((whole, "whole"), (alone, "estimated"), (~whole & ~alone, "missing"))]

    wide = horizons.agg(*[c for p in properties for c in kinds(p)])
    rows = F.array(*[F.struct(F.lit(p).alias("property"), *[F.col(f"`{p}|{n}`").alias(n) for n in ("whole", "estimated", "missing")]) for p in properties])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def completed(horizons: DataFrame, properties: list[str], share: float = 0.2) -> DataFrame:
    """Triplets with r alone become r less and plus a fifth; crossed ones are
    put in order."""
    out = horizons
    for p in properties:
        r = F.col(f"{p}_r")
        low, high = F.coalesce(f"{p}_l", r - share * F.abs(r)), F.coalesce(f"{p}_h", r + share * F.abs(r))
        out = out.withColumns({f"{p}_l": F.when(r.isNotNull(), F.least(low, r)), f"{p}_h": F.when(r.isNotNull(), F.greatest(high, r))})
    return out


def _checked(properties: list[str], matrix: list[list[float]] | None, config: Config | None) -> tuple[Config, list[list[float]]]:
    config = (config or Config()).checked()
    matrix = matrix or [[float(i == j) for j in properties] for i in properties]
    if len(matrix) != len(properties):
        raise ValueError("the matrix has a row for each property")
    return config, positive_definite(np.array(matrix, float)).tolist()


def simulate(horizons: DataFrame, properties: list[str], matrix: list[list[float]] | None = None, config: Config | None = None) -> DataFrame:
    """Draws of the properties for every usable horizon: (cokey, hz, sim,
    properties..., changed). One lazy plan: filter, copula, explode, limits."""
    config, matrix = _checked(properties, matrix, config)
    rows = completed(usable(horizons, properties, config), properties)
    drawn = repeated_triangular(rows, ["cokey", "hz"], {p: (f"{p}_l", f"{p}_r", f"{p}_h") for p in properties}, matrix, config.n, config.seed)
    limits = {p: config.limits[p] for p in properties if p in config.limits}
    return constrained(drawn, limits, list(config.parts), 100.0, list(config.ordered)).select("mukey", "cokey", "hz", "hzdept_r", "hzdepb_r", "sim", *properties, "changed")


def summaries(horizons: DataFrame, keys: list[str], properties: list[str], probs: list[float], matrix: list[list[float]] | None = None, config: Config | None = None) -> DataFrame:
    """(keys, n, <property>_mean, <property>_q): count, means and exact
    quantiles of the draws that simulate() makes of each group's horizons.
    Horizons meet by group and are drawn there, so draws are never rows; a
    group's draws are held by one task, as by percentile()."""
    config, matrix = _checked(properties, matrix, config)
    rows, lower = completed(usable(horizons, properties, config), properties), cholesky(matrix)
    limits = {p: config.limits[p] for p in properties if p in config.limits}
    sides = [F.col(f"{p}_{s}").cast("double").alias(f"__{i}{s}") for i, p in enumerate(properties) for s in "lrh"]
    rows = rows.select(*keys, key_text(["cokey", "hz"]).cast("binary").alias("__text"), *sides)
    names = [*keys, "n", *[f"{p}_{x}" for p in properties for x in ("mean", "q")]]

    def summary(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: list[list[np.ndarray]] = [[] for _ in properties]
        for batch in parts:
            values = [batch.column(f"__{i}{s}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(properties)) for s in "lrh"]
            found = triangular_draws(batch.column("__text").to_pylist(), values, properties, lower, config.n, config.seed)
            held = constrained_at(dict(zip(properties, found)), limits, list(config.parts), 100.0, list(config.ordered))
            for column, p in zip(drawn, properties):
                column.append(held[p].ravel())
        out, n = [], 0
        for column in drawn:
            every = np.concatenate(column)
            n, good = len(every), every[~np.isnan(every)]
            out += [[good.mean() if len(good) else None], [np.quantile(good, probs).tolist() if len(good) else None]]
        kinds = [pa.float64(), pa.list_(pa.float64())] * len(properties)
        columns = [*[pa.array([k.as_py()], k.type) for k in key], pa.array([n], pa.int64()), *[pa.array(x, t) for x, t in zip(out, kinds)]]
        yield pa.record_batch(columns, names=names)

    kinds = [*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "n long", *[f"`{p}_mean` double, `{p}_q` array<double>" for p in properties]]
    return rows.groupBy(*keys).applyInArrow(summary, ", ".join(kinds))


def quality(draws: DataFrame, properties: list[str]) -> DataFrame:
    """Per property: share of finite draws and of draws within the fences of
    one and a half quartile ranges, and their difference from 1 as a score."""
    # One row a draw and property; fences from the few draws beside them, so no task holds a property's draws.
    parts = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("v")) for p in properties])
    long = draws.select(F.explode(parts).alias("x")).select("x.*")
    fences = column_quantiles(draws, properties, {"q1": 0.25, "q3": 0.75})
    out = (F.col("v") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    rates = long.join(F.broadcast(fences), "property").groupBy("property").agg(F.avg(finite(F.col("v")).cast("double")).alias("finite"), F.avg(F.coalesce(out, F.lit(False)).cast("double")).alias("outliers"))
    return rates.withColumn("score", F.col("finite") - F.col("outliers"))
