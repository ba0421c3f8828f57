"""Whitening of embeddings by tall-skinny QR.

Rows are centred by exact sums. Each partition is reduced, a block at a time,
to the triangular factor of its centred rows, and the factors are merged
pairwise in a tree. The right singular vectors of the last factor are the
components; no covariance matrix of the input is formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, written
from .vectors import blocks, column_sums, combined, finite, floors

SCALE, SHIFT = 64, 1_000_000  # entries become floor(SCALE * entry) + SHIFT
COMPONENTS = 16
FLAT = 1e-12  # a component of a smaller share of the largest singular value has no variance


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their exact sums, unit components (a row each) by
    falling variance, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied by; NaN without variance."""
        flat = self.variances <= FLAT**2 * self.variances.max(initial=0)
        return np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1, self.variances)))


def offsets(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: int64 where that holds them, else Python integers."""
    safe = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62
    return x * n - np.array(sums, np.int64) if safe else x.astype(object) * n - np.array(sums, object)


def squares(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows; None where a long can't hold one."""
    if y.dtype != object and y.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _merged(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    """The factor of both factors' rows."""
    return b if a is None else a if b is None else triangle(np.vstack([a, b]))


def _pooled(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred products of two sets of rows as one."""
    (n, mean, products), (m, other, more) = a, b
    if not n or not m:
        return b if not n else a
    gap = other - mean
    return n + m, mean + gap * (m / (n + m)), products + more + np.outer(gap, gap) * (n * m / (n + m))


def _dimension(vectors: DataFrame) -> int:
    """The commonest length, the longer of equally common ones; 0 without any."""
    sizes = vectors.groupBy(F.size("x").alias("d")).count().where("d > 0")
    found = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _sums(vectors: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of each column."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for _, x in blocks(batches, width):
            n, total = n + len(x), total + column_sums(x)
        if n:
            yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array([str(v) for v in total], pa.string()), pa.array([n] * width, pa.int64())], names=["place", "total", "n"])

    parts = vectors.mapInArrow(add, "place int, total string, n long")
    rows = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["place"])
    return (rows[0]["n"], tuple(int(r["total"]) for r in rows)) if rows else (0, ())


def fit(vectors: DataFrame, width: int) -> Whitening | None:
    """The whitening of integer rows (x array<long>), all of `width` entries;
    None without rows.

    Two passes. A partition keeps one triangle of width² numbers; triangles
    meet in a tree, at most eight in a task.
    """
    n, sums = _sums(vectors, width)
    if not n:
        return None

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in blocks(batches, width):
            r = _merged(r, triangle((offsets(x, n, sums) / n).astype(np.float64)))
        if r is not None:
            yield pa.record_batch([pa.array([r.tobytes()], pa.binary())], names=["r"])

    r = combined(vectors.mapInArrow(factor, "r binary"), None, _merged, lambda b: np.frombuffer(b).reshape(-1, width))
    _, singular, right = np.linalg.svd(np.vstack([r, np.zeros((max(0, width - len(r)), width))]))
    right = right * np.where(right[np.arange(width), np.abs(right).argmax(axis=1)] < 0, -1, 1)[:, None]
    variances = singular**2 / n
    return Whitening(n, sums, right, variances, float(variances.sum()))


def identity_error(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the
    identity, over components with variance; None without any. Covariances of
    blocks are centred before they are multiplied, and pooled in a tree."""
    scales = model.scales[:components]
    live = np.flatnonzero(~np.isnan(scales))
    turn = (model.components[live] * scales[live, None]).T
    n, sums, width = model.n, model.sums, len(model.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (0, np.zeros(len(live)), np.zeros((len(live), len(live))))
        for _, x in blocks(batches, width):
            w = (offsets(x, n, sums) / n).astype(np.float64) @ turn
            mean = w.mean(axis=0)
            found = _pooled(found, (len(w), mean, (w - mean).T @ (w - mean)))
        if found[0]:
            yield pa.record_batch([pa.array([np.concatenate([[found[0]], found[1], found[2].ravel()]).tobytes()], pa.binary())], names=["part"])

    def read(b: bytes) -> tuple:
        v, k = np.frombuffer(b), len(live)
        return int(v[0]), v[1 : k + 1], v[k + 1 :].reshape(k, k)

    if not len(live):
        return None
    count, _, total = combined(vectors.mapInArrow(products, "part binary"), (0, np.zeros(len(live)), np.zeros((len(live), len(live)))), _pooled, read)
    return float(np.abs(total / count - np.eye(len(live))).max())


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS, error: float | None = None) -> DataFrame:
    """(vec_id, x) to one row per input row and component, from 1: n,
    deviation, whitened, explained, and the identity error given.

    Repeated rows and null ids are kept. Without variance `whitened` is null,
    and without any variance so is `explained`; `deviation` is null where a
    long can't hold it. A map over rows: nothing is shuffled.
    """
    k, n, sums, width = min(components, len(model.sums)), model.n, model.sums, len(model.sums)
    turn, scales = model.components[:k].T, model.scales[:k]
    shares = model.variances[:k] / model.trace if model.trace > 0 else np.full(k, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, width):
            y = offsets(x, n, sums)
            w = ((y / n).astype(np.float64) @ turn * scales).ravel()
            spots = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [
                part.column("vec_id").take(spots),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(w), n)),
                pa.array(squares(y), pa.int64()).take(spots),
                pa.array(w, from_pandas=True),
                pa.array(np.tile(shares, len(x)), from_pandas=True),
                pa.array([error] * len(w), pa.float64()),
            ]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, schema)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scope: Scratch | None = None) -> DataFrame:
    """(vec_id, embedding) whitened on the distinct vectors.

    Rows whose vector is null, empty, or holds a null or a non-finite entry
    are left out; so are those of another length than the commonest, which
    have no place in one covariance. Entries beyond 2^52 / SCALE are cut to
    that. Copies count once in the fit and all get their rows. Tables without
    such rows give none. Further columns are ignored. Distinct vectors are
    found by a shuffle in which copies meet early, and written once.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding").where(finite("embedding")).select("vec_id", floors("embedding", SCALE, SHIFT).alias("x"))
    width = _dimension(rows)
    rows = rows.where(F.size("x") == width)
    vectors = written(rows.select("x").distinct(), scope)
    model = fit(vectors, width) if width else None
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, model, components, identity_error(vectors, model, components))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
