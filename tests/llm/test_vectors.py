"""Whitening and clustering against plain numpy and Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.llm import clusters, whitening
from loamcast.llm.common import Scratch

VECTORS = "vec_id long, embedding array<double>"


def table_of(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    return df.select(F.lit(1).alias("n"), F.lit([1]).alias("x"), "*", F.lit(2).alias("component"), F.lit("c").alias("cluster"))


def cloud(seed, n, width):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) / 4).tolist()


BAD = [(900, None), (901, [None] * 6), (902, [1.0, 2.0, float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf")] * 6), (904, []), (905, [1.0] * 5), (906, [0.1, None, 0.2, 0.3, 0.4, 0.5])]


# 11: whitening


def brute_whitening(good, k):
    """Covariance and eigenvectors over distinct vectors, in plain numpy."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in good], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((x * n - sums) ** 2).sum(axis=1), ((x * n - sums) / n).astype(float) @ vectors[:, :k] / np.sqrt(values[:k]), values / values.sum()


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_whitening_is_brute_force(spark, shift):
    good = [[c + shift for c in v] for v in cloud(1, 300, 6)]
    good += [good[0]] * 40 + good[5:9]
    rows = [*enumerate(good), *BAD]
    scope = Scratch()
    found = whitening.whitened(table_of(spark, [*rows, (None, good[3])]), 4, scope).collect()
    n, deviation, want, shares = brute_whitening(good, 4)
    assert len(found) == 4 * (len(good) + 1) and {r["n"] for r in found} == {n}
    by = {(r["vec_id"], r["component"]): r for r in found}
    sign = [1 if by[0, j + 1]["whitened"] * want[0][j] > 0 else -1 for j in range(4)]
    for i in range(len(good)):
        for j in range(4):
            r = by[i, j + 1]
            assert r["deviation"] == deviation[i] and abs(r["whitened"] - sign[j] * want[i][j]) < 1e-6
            assert abs(r["explained"] - shares[j]) < 1e-9 and r["identity_error"] < 1e-9
    assert [by[None, 1][c] for c in ("deviation", "whitened")] == [by[3, 1][c] for c in ("deviation", "whitened")]
    scope.drop(spark)


def test_whitening_does_not_depend_on_partitions(spark):
    rows = [*enumerate(cloud(2, 200, 5))]
    a, b = (sorted((r["vec_id"], r["component"], round(r["whitened"], 9)) for r in whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(p)).collect()) for p in (1, 30))
    assert a == b and len(a) == 200 * 5


def test_whitening_without_variance(spark):
    flat = [(1, [2.0, 3.0, 1.0]), (2, [2.0, 5.0, 1.0]), (3, [2.0, 3.0, 1.0])]
    found = sorted(whitening.whitened(spark.createDataFrame(flat, VECTORS)).collect())
    assert [r["n"] for r in found] == [2] * 9
    first = {r["vec_id"]: r["whitened"] for r in found if r["component"] == 1}
    assert abs(abs(first[1]) - 1) < 1e-12 and first[1] == first[3] == -first[2]
    assert {r["whitened"] for r in found if r["component"] > 1} == {None}
    one = whitening.whitened(spark.createDataFrame(flat[:1], VECTORS)).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 3
    assert whitening.whitened(spark.createDataFrame(BAD[:5], VECTORS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_very_large_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    found = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(found) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in found)


def test_sums_beyond_a_long_are_exact():
    x = np.full((3000, 2), (1 << 52) - 1, np.int64)
    assert whitening.column_sums(x).tolist() == [3000 * ((1 << 52) - 1)] * 2
    assert whitening.offsets(x[:1], 1 << 20, (5, 7)).tolist() == [[((1 << 52) - 1 << 20) - 5, ((1 << 52) - 1 << 20) - 7]]


# 12: clustering


def brute_lloyd(rows, k, rounds, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def close():
        away = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in away]

    for _ in range(rounds):
        found = close()
        for c in range(len(centres)):
            own = [v for (_, v), (j, _) in zip(kept, found) if j == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    found = close()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for _, d in found)
    return [(i, c, d, sum(e for b, e in found if b == c), total, digest[c]) for (i, _), (c, d) in zip(kept, found)]


@pytest.mark.parametrize("size", [1.0, 1e5, 1e8, 1e12])
def test_clusters_are_brute_force(spark, size):
    """In float64, in int64 and in Python integers."""
    good = [[c * size for c in v] for v in cloud(3, 150, 6)]
    rows = [*enumerate(good), (0, good[7]), (4, good[4]), (None, good[2]), (8000, [-x for x in good[8]])]
    found = clusters.clustered(table_of(spark, [*rows, *BAD]), 7, 3, 6).collect()
    want = [tuple(v if not isinstance(v, int) or v < 1 << 63 else None for v in r) for r in brute_lloyd(rows, 7, 3)]
    key = lambda r: (r[0] is None, *(str(x) for x in r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)]
    found = clusters.clustered(spark.createDataFrame(rows, VECTORS), 10, 5, 2).collect()
    assert sorted(map(tuple, found)) == sorted(brute_lloyd(rows, 10, 5)) and len({r["cluster"] for r in found}) == 2


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 1.0]), (2, [3.0, 1.0])]
    assert sorted(r["distance"] for r in clusters.clustered(spark.createDataFrame(rows, VECTORS), 40, 2, 2).collect()) == [0, 0]
    assert clusters.clustered(spark.createDataFrame(BAD, VECTORS)).collect() == []
    assert clusters.clustered(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_distances_are_exact_where_doubles_would_round():
    rng = random.Random(4)
    for top in (1 << 10, 1 << 24, 1 << 28, 1 << 50):
        x = np.array([[rng.randrange(-top, top) for _ in range(8)] for _ in range(20)], np.int64)
        c = np.array([[rng.randrange(-top, top) for _ in range(8)] for _ in range(5)], object)
        want = [[sum((int(a) - b) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert [[int(v) for v in r] for r in clusters.distances(x, c)] == want
