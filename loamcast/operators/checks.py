"""Validation of simulations: convergence, coverage, fidelity, structure.

Each check is a table of figures with its verdict, computed by aggregates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from . import stats


def convergence(draws: DataFrame, sim: str, columns: list[str], batches: int = 5, tolerance: float = 0.05) -> DataFrame:
    """(column, change, converged): by how much the mean of the last batch of
    realizations differs from that of the one before, in relation to it.

    Realizations are cut into batches of equal size by their order, whatever
    their numbers; with fewer of them than batches, into as many. Without two
    there is no row."""
    count = draws.agg(F.count_distinct(sim).alias("n")).first()["n"]
    n = min(batches, count)
    if n < 2:
        return draws.sparkSession.createDataFrame([], "column string, change double, converged boolean")
    # The distinct realizations, of which there are as many as a simulation has draws.
    numbers = draws.where(F.col(sim).isNotNull()).select(sim).distinct().withColumn("__k", F.row_number().over(Window.orderBy(sim)))
    size = count / n
    batch = F.least(F.floor((F.col("__k") - 1) / size), F.lit(n - 1))
    late = numbers.withColumn("__batch", batch).where(F.col("__batch") >= n - 2).drop("__k")
    means = [F.avg(F.when(F.col("__batch") == k, F.col(c))).alias(f"{c}|{k}") for c in columns for k in (n - 2, n - 1)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.abs(F.col(f"`{c}|{n - 1}`") - F.col(f"`{c}|{n - 2}`")) / F.greatest(F.abs(F.col(f"`{c}|{n - 2}`")), F.lit(1e-8))).alias("change")) for c in columns])
    return draws.join(late, sim).agg(*means).select(F.explode(rows).alias("x")).select("x.column", "x.change", (F.col("x.change") <= tolerance).alias("converged"))


def range_coverage(simulated: DataFrame, observed: DataFrame, keys: list[str], value: str, factor: float = 1.2) -> DataFrame:
    """(keys, coverage, extrapolated, good): how much of the observed range is
    reached, in percent, and whether values lie beyond `factor` times it."""
    side = lambda df, s: df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(f"{s}lo"), F.max(value).alias(f"{s}hi"))
    both = side(observed, "o").join(side(simulated, "s"), keys)
    span = F.col("ohi") - F.col("olo")
    shared = F.greatest(F.least("ohi", "shi") - F.greatest("olo", "slo"), F.lit(0.0))
    coverage = F.when(span > 0, 100 * shared / span).otherwise(100.0)
    middle, reach = (F.col("ohi") + F.col("olo")) / 2, span / 2 * factor
    beyond = (F.col("slo") < middle - reach) | (F.col("shi") > middle + reach)
    return both.select(*keys, coverage.alias("coverage"), beyond.alias("extrapolated"), ((coverage >= 90) & ~beyond).alias("good"))


def spread_coverage(rows: DataFrame, keys: list[str], value: str, most: float = 10.0) -> DataFrame:
    """(keys, spread, outliers, adequate): the inner 90 percent as a share of
    the range, and the percentage outside the quartile fences. Rows are only
    counted by value; the counts give the rest."""
    q = stats.quantiles_at(rows, keys, value, {"p05": 0.05, "q1": 0.25, "q3": 0.75, "p95": 0.95})
    out = stats.counted(rows, keys, value).join(stats.small(q, rows, keys), keys)
    x, width, n = F.col(value), 1.5 * (F.col("q3") - F.col("q1")), F.col("n")
    far = (x < F.col("q1") - width) | (x > F.col("q3") + width)
    span = F.max(x) - F.min(x)
    outside = F.sum(F.when(far, n).otherwise(0)) / F.sum(n)
    found = out.groupBy(*keys).agg(F.when(span > 0, F.max(F.col("p95") - F.col("p05")) / span).otherwise(0.0).alias("spread"), (100 * outside).alias("outliers"))
    return found.withColumn("adequate", F.col("outliers") <= most)


def representation(draws: DataFrame, key: str, least: int = 10) -> DataFrame:
    """One row (groups, represented, short): groups with `least` draws."""
    each = draws.groupBy(key).agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("groups"), F.avg((F.col("n") >= least).cast("double")).alias("represented"), F.count_if(F.col("n") < least).alias("short"))


def quantile_gaps(draws: DataFrame, keys: list[str], value: str, expected: dict[float, str], tolerance: float = 0.05) -> DataFrame:
    """(keys, one gap a probability, good): relative differences of exact
    quantiles of the draws from the expected ones, columns of the draws that
    are the same in a group."""
    names = {f"gap_{round(p * 1000)}": p for p in expected}
    p = F.percentile(value, [float(x) for x in expected])
    rows = draws.groupBy(*keys).agg(p.alias("p"), *[F.any_value(c).alias(f"__{n}") for n, c in zip(names, expected.values())])
    gaps = [(F.abs(F.col("p")[i] - F.col(f"__{n}")) / F.greatest(F.abs(F.col(f"__{n}")), F.lit(1e-8))).alias(n) for i, n in enumerate(names)]
    return rows.select(*keys, *gaps).withColumn("good", F.greatest(*names) <= tolerance if len(names) > 1 else F.col(next(iter(names))) <= tolerance)


def correlation_gaps(observed: DataFrame, simulated: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, most, mean, rmse, preserved) of two tables of correlations (keys,
    a, b, r): absolute differences of pairs, and 1 less their mean."""
    both = observed.select(*keys, "a", "b", F.col("r").alias("__o")).join(simulated.select(*keys, "a", "b", F.col("r").alias("__s")), [*keys, "a", "b"])
    gap = F.abs(F.col("__o") - F.col("__s"))
    found = both.groupBy(*keys).agg(F.max(gap).alias("most"), F.avg(gap).alias("mean"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return found.withColumn("preserved", F.greatest(1 - F.col("mean"), F.lit(0.0)))


def depth_stability(rows: DataFrame, columns: list[str], edges: list[float], least: int = 5) -> DataFrame:
    """(a, b, bins, sd, stable) of each pair: how much its correlation varies
    over the depth bins with `least` rows; stable where one less the spread is
    0.7 or more."""
    bin_of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("hzdept_r")))
    each = stats.correlations(rows.withColumn("bin", bin_of), ["bin"], columns).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    found = each.groupBy("a", "b").agg(F.count("*").alias("bins"), F.stddev_samp("r").alias("sd"))
    return found.withColumn("stable", F.greatest(1 - F.col("sd"), F.lit(0.0)) >= 0.7)


def smoothness(rows: DataFrame, keys: list[str], order: str, value: str, rough: float = 0.1) -> DataFrame:
    """(keys, smooth, reasonable): one less the mean absolute second
    difference along the order, as a share of the range."""
    by = Window.partitionBy(*keys).orderBy(order)
    x = F.col(value)
    bent = rows.withColumn("__d", F.abs(F.lead(x).over(by) - 2 * x + F.lag(x).over(by)))
    span = F.max(x) - F.min(x)
    found = bent.groupBy(*keys).agg(F.count("__d").alias("n"), F.greatest(1 - F.when(span > 0, F.avg("__d") / span).otherwise(0.0), F.lit(0.0)).alias("smooth")).where("n > 0").drop("n")
    return found.withColumn("reasonable", F.col("smooth") >= 1 - rough)


def multivariate_outliers(rows: DataFrame, keys: list[str], a: str, b: str, alpha: float = 0.975) -> DataFrame:
    """mahalanobis() with `far`: beyond the alpha quantile of the chi-square
    distribution of two degrees, -2 ln(1 - alpha)."""
    return stats.mahalanobis(rows, keys, a, b).withColumn("far", F.col("d2") > -2 * math.log(1 - alpha))


def chi_square(p: float, degrees: int) -> float:
    """Quantile of the chi-square distribution, by bisection of its CDF."""
    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(200):
        mid = (low + high) / 2
        below = special.gamma_cdf(np.array([mid / 2]), np.array([degrees / 2]))[0][0]
        low, high = (mid, high) if below < p else (low, mid)
    return (low + high) / 2


def distances(rows: DataFrame, keys: list[str], columns: list[str], alpha: float = 0.975) -> DataFrame:
    """rows with `d2`, the squared Mahalanobis distance from the group's centre
    in any number of columns, and `far`: beyond the alpha quantile of the
    chi-square distribution of as many degrees.

    Centres and covariances come from complete rows; others have nulls, and so
    have groups of fewer complete rows than columns and one. A singular
    covariance is repaired by raising its eigenvalues. Covariances are sums;
    a group is one small row when it is inverted.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    whole = rows.dropna(subset=[*keys, *columns])
    moments = whole.groupBy(*keys).agg(F.count("*").alias("__n"), F.array(*[F.avg(c) for c in columns]).alias("__m"), F.array(*[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).alias("__c")).where(F.col("__n") > k)

    def inverted(frames):
        for frame in frames:
            out = frame[[*keys, "__m"]].copy()
            found = []
            for flat in frame["__c"]:
                m = np.zeros((k, k))
                for (i, j), v in zip(pairs, flat):
                    m[i, j] = m[j, i] = v
                values, vectors = np.linalg.eigh(m)
                values = np.maximum(values, 1e-8 * max(values.max(), 1e-300))
                found.append((vectors / values @ vectors.T).ravel())
            out["__i"] = found
            yield out

    kinds = ", ".join(f"`{c}` {moments.schema[c].dataType.simpleString()}" for c in keys)
    inverses = moments.mapInPandas(inverted, f"{kinds}, __m array<double>, __i array<double>")
    joined = rows.join(inverses, keys, "left").withColumns({f"__d{i}": F.col(c) - F.get("__m", F.lit(i)) for i, c in enumerate(columns)})
    terms = [F.get("__i", F.lit(i * k + j)) * F.col(f"__d{i}") * F.col(f"__d{j}") * (1 if i == j else 2) for i, j in pairs]
    d2 = sum(terms[1:], terms[0])
    out = joined.withColumn("d2", d2).withColumn("far", F.col("d2") > chi_square(alpha, k))
    return out.select(*rows.columns, "d2", "far")


def overall(scores: list[Column]) -> tuple[Column, Column]:
    """(mean, confidence) of the scores that are there: the mean, less its
    variance up to a fifth, from 0 to 1."""
    held = F.filter(F.array(*scores), lambda s: s.isNotNull())
    n = F.size(held)
    mean = F.aggregate(held, F.lit(0.0), lambda t, s: t + s) / F.nullif(n, F.lit(0))
    var = F.aggregate(held, F.lit(0.0), lambda t, s: t + (s - mean) * (s - mean)) / F.nullif(n - 1, F.lit(0))
    return mean, F.least(F.greatest(mean * (1 - F.least(F.coalesce(var, F.lit(0.0)), F.lit(0.2))), F.lit(0.0)), F.lit(1.0))


def matrix_quality(matrix: list[list[float]], most: float = 1e12) -> dict:
    """What a small correlation matrix is worth: whether it is valid, its least
    eigenvalue, condition number and the error of its Cholesky factor."""
    m = np.array(matrix, float)
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        return {"valid": False, "message": "not square"}
    values = np.linalg.eigvalsh((m + m.T) / 2)
    message = "" if np.allclose(np.diag(m), 1, atol=1e-10) else "the diagonal is not 1"
    message = message or ("" if values.min() > 0 else "not positive definite")
    condition = float(values.max() / values[values > 1e-12].min()) if (values > 1e-12).any() else float("inf")
    error = None
    if values.min() > 0:
        lower = np.linalg.cholesky(m)
        error = float(np.linalg.norm(lower @ lower.T - m))
    return {"valid": not message, "message": message, "least": float(values.min()), "condition": condition, "good": not message and condition <= most, "cholesky_error": error}
