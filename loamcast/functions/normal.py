"""The normal distribution and hashed draws as expressions.

One text serves both engines: literals are written with exponents, which both
read as doubles. The coefficients are published approximations.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = NormalDist().inv_cdf(0.95)

# P. J. Acklam's rational approximation of the inverse normal CDF.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
LOW = 0.02425
# Abramowitz and Stegun 26.2.17.
P, T = 0.2316419, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0)

# J. F. Hart's rational approximation of the normal tail, to double precision.
HART_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_EDGE, HART_ROOT = 7.07106781186547, 2.506628274631


def number(x: float) -> str:
    return f"{x:.17e}"


def polynomial(coefficients: tuple, x: str) -> str:
    out = number(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + {number(c)})"
    return out


def qnorm_sql(u: str) -> str:
    """Text of the inverse CDF of the expression u, strictly between 0 and 1."""
    middle, tail = f"(({u}) - 5e-1)", f"sqrt(-2e0 * ln({u}))"
    square, other = f"({middle} * {middle})", f"sqrt(-2e0 * ln(1e0 - ({u})))"
    centre = f"{middle} * {polynomial(A, square)} / {polynomial(B, square)}"
    low, high = (f"{polynomial(C, t)} / {polynomial(D, t)}" for t in (tail, other))
    return f"(CASE WHEN ({u}) < {number(LOW)} THEN {low} WHEN ({u}) > {number(1 - LOW)} THEN -({high}) ELSE {centre} END)"


def pnorm_sql(z: str) -> str:
    t = f"(1e0 / (1e0 + {number(P)} * abs({z})))"
    tail = f"(exp(-({z}) * ({z}) / 2e0) * 3.98942280401432678e-01 * {polynomial(T, t)})"
    return f"(CASE WHEN ({z}) > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def qnorm_at(u: np.ndarray) -> np.ndarray:
    """qnorm_sql() of an array."""
    middle = u - 0.5
    square = middle * middle
    out = middle * np.polyval(A, square) / np.polyval(B, square)
    for at, p, sign in ((u < LOW, u, 1), (u > 1 - LOW, 1 - u, -1)):
        t = np.sqrt(-2.0 * np.log(p[at]))
        out[at] = sign * (np.polyval(C, t) / np.polyval(D, t))
    return out


def pnorm_at(z: np.ndarray) -> np.ndarray:
    """pnorm_sql() of an array."""
    t = 1.0 / (1.0 + P * np.abs(z))
    tail = np.exp(-z * z / 2.0) * 3.98942280401432678e-01 * np.polyval(T, t)
    return np.where(z > 0, 1.0 - tail, tail)


def tail_sql(z: str) -> str:
    """Text of the probability above z, with small tails in full precision;
    phi(z) is the tail of -z."""
    x = f"abs({z})"
    near = f"{polynomial(HART_UP, x)} / {polynomial(HART_DOWN, x)}"
    far = f"1e0 / ({x} + 1e0 / ({x} + 2e0 / ({x} + 3e0 / ({x} + 4e0 / ({x} + 65e-2))))) / {number(HART_ROOT)}"
    small = f"(CASE WHEN {x} > 37e0 THEN 0e0 WHEN {x} < {number(HART_EDGE)} THEN exp(-({z}) * ({z}) / 2e0) * {near} ELSE exp(-({z}) * ({z}) / 2e0) * {far} END)"
    return f"(CASE WHEN ({z}) > 0e0 THEN {small} ELSE 1e0 - {small} END)"


def uniform(*parts: Column | str | int) -> Column:
    """A draw in (0, 1) that depends on the given parts alone, so it doesn't
    change with the partitioning."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def uniform_sql(*parts: str) -> str:
    """The same draw for DuckDB; parts are SQL texts."""
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT) + 5e-1) / 4294967296e0)"
