"""Fitted depth models as a table: written, read and joined like any other,
and evaluated in one expression; and draws reordered by their correlation
across depths, gated at distinct boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gp

MODEL = "x array<double>, alpha array<double>, mean double, length double, family string, low double, span double, scale double, rmse double, score double"


def _fall(family: str) -> float:
    """The distance, in lengths, at which a correlation falls to exp(-1)."""
    low, high = 0.0, 4.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if gp.kernel(np.array([mid]), 1.0, family)[0] > np.exp(-1) else (low, mid)
    return (low + high) / 2


FALLS = {family: _fall(family) for family in ("exponential", "matern32", "matern52")}
#: Boundary widths (cm) that close a boundary most and not at all, and the least gate.
SHARP, DIFFUSE, LEAST_GATE = 1.0, 10.0, 0.05


def fitted(rows: DataFrame, group: str, depth: str, value: str, least: int = 3) -> DataFrame:
    """(group, model columns): a Gaussian process for each group with `least`
    distinct depths and variation, fitted to means by depth.

    scale is the depth (in its own unit) at which the correlation falls to
    exp(-1); rmse the error at the fitted depths. A group's task holds its
    depths. With the profile's key as group these are local models. Groups
    with a null key have none.
    """
    points = gp.depth_means(rows.where(F.col(group).isNotNull()), group, depth, value)

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("depth")
        d, y = frame["depth"].to_numpy(float), frame["v"].to_numpy(float)
        names = [group, *[c.split()[0] for c in MODEL.split(", ")]]
        if len(d) < least or y.std() == 0 or np.ptp(d) == 0:
            return pd.DataFrame({n: np.array([], object) for n in names})
        x = (d - d.min()) / np.ptp(d)
        m = gp.fit(x, y, gp.chosen_family(x, y))
        rmse = float(np.sqrt(np.mean((gp.predict(m, x) - y) ** 2)))
        row = (frame[group].iloc[0], x, m["alpha"], m["mean"], m["length"], m["family"], float(d.min()), float(np.ptp(d)), m["length"] * float(np.ptp(d)) * FALLS[m["family"]], rmse, m["score"])
        return pd.DataFrame([row], columns=names)

    return points.groupBy(group).applyInPandas(model, f"`{group}` {points.schema[group].dataType.simpleString()}, {MODEL}")


def trend(depth: Column) -> Column:
    """The model's value at a depth, from its columns; depths outside those it
    was fitted to take its ends. Null without a model or a depth."""
    at = F.least(F.greatest((depth - F.col("low")) / F.col("span"), F.lit(0.0)), F.lit(1.0))
    family = F.col("family")

    def kernel(x: Column) -> Column:
        r = F.abs(at - x) / F.col("length")
        a, b = np.sqrt(3.0) * r, np.sqrt(5.0) * r
        return F.when(family == "exponential", F.exp(-r)).when(family == "matern32", (1 + a) * F.exp(-a)).otherwise((1 + b + b * b / 3) * F.exp(-b))

    value = F.col("mean") + F.aggregate(F.zip_with("x", "alpha", lambda x, w: w * kernel(x)), F.lit(0.0), lambda t, v: t + v)
    return F.when(depth.isNotNull(), value)


def predicted(rows: DataFrame, models: DataFrame, key: str, depth: str, name: str = "trend") -> DataFrame:
    """rows (key, depth, ...) with the value of their model at their depth;
    models has the column key. A model is evaluated once for each distinct
    depth that its rows ask for, and rows are joined to those values."""
    asked = rows.select(F.col(key).alias("__key"), F.col(depth).alias("__depth")).where("__key is not null and __depth is not null").distinct()
    # Few rows, long work each: dealt to all tasks.
    asked = asked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key", "__depth")
    held = models.select(F.col(key).alias("__key"), *[c.split()[0] for c in MODEL.split(", ")])
    found = asked.join(held, "__key").select("__key", "__depth", trend(F.col("__depth")).alias(name))
    return rows.join(found, (F.col(key) == F.col("__key")) & (F.col(depth) == F.col("__depth")), "left").select(*rows.columns, name)


def gates(bound_sd: np.ndarray) -> np.ndarray:
    """How much correlation each boundary lets through: from LEAST_GATE for
    sharp ones to 1 for diffuse and unknown ones."""
    raw = (np.asarray(bound_sd, float) - SHARP) / (DIFFUSE - SHARP)
    return np.clip(np.where(np.isnan(raw), 1.0, raw), LEAST_GATE, 1.0)


def gated_correlation(depth: np.ndarray, scale: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
    """Correlations of the depths (profiles, horizons) of profiles, by the
    scale of each, gated by the widths of the boundaries above horizons;
    without a scale above 0 depths are independent."""
    good = np.isfinite(scale) & (scale > 0)
    r = np.where(good[:, None, None], gp.depth_correlation(depth, np.where(good, scale, 1.0)[:, None, None]), np.eye(depth.shape[1]))
    if bound is None or depth.shape[1] == 1:
        return r
    logs = np.concatenate([np.zeros((len(depth), 1)), np.cumsum(np.log(gates(bound[:, 1:])), axis=1)], axis=1)
    return r * np.exp(-np.abs(logs[:, :, None] - logs[:, None, :]))


def reordered(draws: DataFrame, values: list[str], matrix: list[list[float]], scales: DataFrame, bound: str | None = None, seed: int = 1) -> DataFrame:
    """Draws (cokey, hz, hzdept_r, sim, values) whose order at each depth
    follows one copula of depths and properties; every margin stays.

    scales: (cokey, scale), the depth over which correlation falls, as from
    fitted(); profiles without one, or with none above 0, have independent
    depths. bound: a column with the width of the boundary above each horizon,
    which gates correlation across it. Depths may lack realizations and
    values: a depth's values are put in the order of the copula's draws of the
    realizations that it has. Repeated rows of one realization and depth keep
    their own values. A batch of rows is taken at a time, and of longer
    profiles one.
    """
    prop = np.array(matrix, float)
    rows = draws.join(scales.select("cokey", F.col("scale").alias("__scale")), "cokey", "left")

    columns = draws.columns

    def reorder(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, begins in gp.whole_profiles(frames):
            depth, hz, sim, key = (frame[c].to_numpy() for c in ("hzdept_r", "hz", "sim", "cokey"))
            scale = frame["__scale"].to_numpy(float)
            width = frame[bound].to_numpy(float) if bound is not None else None
            held = [frame[name].to_numpy(float) for name in values]
            done = [v.copy() for v in held]
            for low, high in zip(begins, np.append(begins[1:], len(frame))):
                part = slice(low, high)
                starts = np.append(0, np.flatnonzero((depth[low + 1 : high] != depth[low : high - 1]) | (hz[low + 1 : high] != hz[low : high - 1])) + 1)
                ends = np.append(starts[1:], high - low)
                sims, place = np.unique(sim[part], return_inverse=True)
                d = depth[part][starts].astype(float)
                at_scale = scale[low]
                r = gp.depth_correlation(d, float(at_scale)) if np.isfinite(at_scale) and at_scale > 0 else np.eye(len(d))
                if width is not None and len(d) > 1:
                    logs = np.append(0, np.cumsum(np.log(gates(width[part][starts][1:]))))
                    r = r * np.exp(-np.abs(logs[:, None] - logs[None, :]))
                z = gp.joint_normals(r + 1e-9 * np.eye(len(d)), prop, len(sims), seed + int(key[low]) % 2**31)
                for k, (v, out) in enumerate(zip(held, done)):
                    for i, (first, last) in enumerate(zip(starts, ends)):
                        at = np.arange(first, last)
                        at = at[~np.isnan(v[low + first : low + last])]
                        out[low + at[np.argsort(z[i, k, place[at]], kind="stable")]] = np.sort(v[low + at])
            yield frame[columns].assign(**dict(zip(values, done)))

    rows = rows.repartition("cokey").sortWithinPartitions("cokey", "hzdept_r", "hz", "sim")
    return rows.mapInPandas(reorder, draws.schema)
