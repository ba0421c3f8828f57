"""Lloyd's centroid clustering in exact integers.

Squared distances are |x|² - 2x·c + |c|², one matrix product a block. They run
in float64 BLAS while all terms stay below 2^53, where every sum is exact;
beyond that in int64, and beyond that in Python integers. A round is one pass;
each partition's sums are combined by treeAggregate.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import blocks, column_sums, combined, finite, floors

SCALE, WIDTH, CLUSTERS, ROUNDS = 256, 64, 40, 5
CELLS = 1 << 21  # distances that are held at once


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances: float64, int64 or Python integers."""
    largest = int(np.abs(x).max(initial=0)) + max((abs(int(v)) for v in centroids.ravel()), default=0)
    bound = x.shape[1] * largest**2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 61 else object
    a, c = x.astype(kind), centroids.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(cluster, squared distance) of each row; the smaller number of ties."""
    clusters, found = np.zeros(len(x), np.int32), []
    step = max(1, CELLS // len(centroids))
    for start in range(0, len(x), step):
        d = distances(x[start : start + step], centroids)
        best = d.argmin(axis=1)
        clusters[start : start + step] = best
        found += map(int, d[np.arange(len(d)), best])
    return clusters, found


def _tally(vectors: DataFrame, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and summed distances of the clusters of one pass."""
    k = len(centroids)

    def add(a: tuple, b: tuple) -> tuple:
        return tuple(x + y for x, y in zip(a, b))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, spread = np.zeros(k, object), np.zeros((k, width), object), np.zeros(k, object)
        for _, x in blocks(batches, width):
            clusters, away = nearest(x, centroids)
            order = np.argsort(clusters, kind="stable")
            present, starts = np.unique(clusters[order], return_index=True)
            for c, rows in zip(present, np.split(order, starts[1:])):
                counts[c] += len(rows)
                sums[c] += column_sums(x[rows])
                spread[c] += sum(away[r] for r in rows)
        yield pa.record_batch([pa.array([pickle.dumps((counts, sums, spread))], pa.binary())], names=["part"])

    zero = np.zeros(k, object), np.zeros((k, width), object), np.zeros(k, object)
    return combined(vectors.select("x").mapInArrow(tally, "part binary"), zero, add, pickle.loads)


def lloyd(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds over (x array<long>); a new one is the
    floor of its vectors' mean, and one without vectors stays."""
    centroids = start
    for _ in range(rounds):
        counts, sums, _ = _tally(vectors, centroids, start.shape[1])
        centroids = np.array([s // n if n else c for n, s, c in zip(counts, sums, centroids)], object).reshape(start.shape)
    return centroids


def _long(v: int) -> int | None:
    return v if v < 1 << 63 else None


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, x) to (vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256), one row per input row; nothing is shuffled. Sums that a
    long can't hold are null."""
    width = centroids.shape[1]
    _, _, spread = _tally(vectors, centroids, width)
    total = _long(int(spread.sum()))
    inertias = pa.array([_long(int(v)) for v in spread], pa.int64())
    digests = pa.array([hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, width):
            clusters, away = nearest(x, centroids)
            spots = pa.array(clusters)
            columns = [part.column("vec_id"), spots, pa.array(map(_long, away), pa.int64()), inertias.take(spots), pa.array([total] * len(x), pa.int64()), digests.take(spots)]
            yield pa.record_batch(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(assign, SCHEMA)


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) in `clusters` clusters after `rounds` rounds.

    Vectors are kept that have `width` entries, none null or non-finite;
    entries become floor(scale * entry), those beyond 2^52 / scale are cut to
    that. The first centroids are the kept vectors of the smallest sha256 of
    "2:" and their id (a null id: "2:" alone; of equal ids the smaller
    vector first). Fewer vectors than clusters make fewer clusters, and none
    gives no rows. Repeated rows are kept, further columns ignored. Only the
    centroids and sums of them are on the driver.
    """
    spark = embeddings.sparkSession
    kept = embeddings.select("vec_id", "embedding").where((F.size("embedding") == width) & finite("embedding"))
    kept = kept.select("vec_id", floors("embedding", scale).alias("x"))
    order = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("x", order.alias("order")).orderBy("order", "x").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    return assigned(kept, lloyd(kept, np.array([r["x"] for r in first], object), rounds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _oracle() -> str:
    """The rounds, one after the other, over one row per vector and entry."""
    kept = f"SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {WIDTH}"
    steps = [f"kept AS MATERIALIZED ({kept})", f"entries AS MATERIALIZED (SELECT rid, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM kept)", f"c0 AS MATERIALIZED (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x FROM kept QUALIFY k < {CLUSTERS}))"]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, k, distance FROM (SELECT rid, k, CAST(sum((e.v - c.v) * (e.v - c.v)) AS BIGINT) AS distance FROM entries e JOIN c{r} c USING (d) GROUP BY rid, k) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, k) = 1)")
        if r < ROUNDS:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.d, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT k, d, (s - ((s % n) + n) % n) // n AS v FROM (SELECT k, d, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN entries USING (rid) GROUP BY k, d)) m USING (k, d))")
    last = f"SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN kept USING (rid) JOIN (SELECT k, sha256(string_agg(v, ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k) USING (k)"
    return f"WITH {', '.join(steps)} {last}"


ORACLE = _oracle()
