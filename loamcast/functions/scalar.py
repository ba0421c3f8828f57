"""Column builders: distributions, conjugate updates, compositions, hydrology
and text rules. All but metalog_feasible() are plain expressions that stay in
generated code."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import Z95

TINY = 1e-12


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


# Conjugate updates


def update_normal(mu1: Column, sd1: Column, mu2: Column, sd2: Column) -> Column:
    """Precision-weighted posterior: struct(mu, sigma)."""
    w1, w2 = 1 / (sd1 * sd1), 1 / (sd2 * sd2)
    return F.struct(((mu1 * w1 + mu2 * w2) / (w1 + w2)).alias("mu"), F.sqrt(1 / (w1 + w2)).alias("sigma"))


def normal_to_log(mu: Column, sd: Column) -> Column:
    s2 = F.log1p((sd / mu) * (sd / mu))
    return F.struct((F.log(mu) - s2 / 2).alias("mu"), F.sqrt(s2).alias("sigma"))


def log_to_normal(mu: Column, sd: Column) -> Column:
    mean = F.exp(mu + sd * sd / 2)
    return F.struct(mean.alias("mu"), (mean * F.sqrt(F.exp(sd * sd) - 1)).alias("sigma"))


def fuse_beta(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return F.struct((a1 + a2 - 1).alias("alpha"), (b1 + b2 - 1).alias("beta"), ((a1 + a2 > 1) & (b1 + b2 > 1)).alias("feasible"))


def fuse_gamma(k1: Column, r1: Column, k2: Column, r2: Column) -> Column:
    return F.struct((k1 + k2 - 1).alias("shape"), (r1 + r2).alias("rate"), (k1 + k2 > 1).alias("feasible"))


def moments_to_gamma(mean: Column, var: Column) -> Column:
    return F.struct((mean * mean / var).alias("shape"), (mean / var).alias("rate"))


def gamma_to_moments(shape: Column, rate: Column) -> Column:
    return F.struct((shape / rate).alias("mean"), (shape / (rate * rate)).alias("var"))


def moments_to_beta(mean: Column, var: Column) -> Column:
    c = mean * (1 - mean) / var - 1
    return F.struct((mean * c).alias("alpha"), ((1 - mean) * c).alias("beta"))


def beta_to_moments(a: Column, b: Column) -> Column:
    return F.struct((a / (a + b)).alias("mean"), (a * b / ((a + b) * (a + b) * (a + b + 1))).alias("var"))


def fuse_bivariate(m1: tuple, s1: tuple, m2: tuple, s2: tuple) -> Column:
    """(x, y) means and (xx, xy, yy) covariances of two sources to the joint
    posterior, by closed 2x2 inverses: struct(x, y, xx, xy, yy)."""

    def inverse(s: tuple) -> tuple:
        det = s[0] * s[2] - s[1] * s[1]
        return s[2] / det, -s[1] / det, s[0] / det

    p, q = inverse(s1), inverse(s2)
    total = tuple(a + b for a, b in zip(p, q))
    s = inverse(total)
    h = [p[i] * m1[0] + p[i + 1] * m1[1] + q[i] * m2[0] + q[i + 1] * m2[1] for i in (0, 1)]
    return F.struct((s[0] * h[0] + s[1] * h[1]).alias("x"), (s[1] * h[0] + s[2] * h[1]).alias("y"), s[0].alias("xx"), s[1].alias("xy"), s[2].alias("yy"))


# Fits and quantiles of triplets (low, representative, high)


def fit_normal(lo: Column, mid: Column, hi: Column, z: float = Z95) -> Column:
    """mean = mid; the outer percentiles are z standard deviations away."""
    return F.struct(mid.alias("mean"), ((hi - lo) / F.lit(2 * z)).alias("sd"))


def quantile_triangular(lo: Column, mode: Column, hi: Column, u: Column) -> Column:
    """Inverse CDF; a triangle without width is its mode."""
    width = hi - lo
    rising = lo + F.sqrt(u * width * (mode - lo))
    falling = hi - F.sqrt((1 - u) * width * (hi - mode))
    return F.when(width <= 0, mode).otherwise(F.when(u < (mode - lo) / width, rising).otherwise(falling))


def triangular_draw(lo: Column, mode: Column, hi: Column, u: Column) -> Column:
    """As a draw: NaN where lo <= mode <= hi fails, or a bound is not finite."""
    good = finite(lo) & finite(mode) & finite(hi) & (lo <= mode) & (mode <= hi)
    return F.when(good, quantile_triangular(lo, mode, hi, u)).otherwise(F.lit(float("nan")))


def quantile_linear(knots: list[tuple[float, Column]], u: Column) -> Column:
    """Piecewise linear inverse CDF through (probability, value); clamped."""
    out = knots[-1][1]
    for (p0, v0), (p1, v1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(u <= p1, v0 + (v1 - v0) * (u - p0) / (p1 - p0)).otherwise(out)
    return F.when(u <= knots[0][0], knots[0][1]).otherwise(out)


def metalog_fit(lo: Column, mid: Column, hi: Column, p: float = 0.05) -> tuple[Column, Column, Column]:
    """Three-term unbounded metalog through symmetric percentiles p, 1/2 and
    1 - p: the 3x3 system solves to these closed forms."""
    logit = math.log((1 - p) / p)
    return mid, (hi - lo) / (2 * logit), (hi + lo - 2 * mid) / ((1 - 2 * p) * logit)


def metalog_quantile(a: tuple[Column, Column, Column], u: Column) -> Column:
    logit = F.log(u / (1 - u))
    return a[0] + a[1] * logit + a[2] * (u - 0.5) * logit


@functools.cache
def _rising() -> Callable:
    u = np.arange(1, 50) / 50.0
    logit = np.array([math.log(x / (1 - x)) for x in u])

    @F.pandas_udf("boolean")
    def rises(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in frames:
            a = [x.to_numpy(float)[:, None] for x in parts]
            with np.errstate(invalid="ignore"):
                yield pd.Series(~(np.diff(a[0] + a[1] * logit + a[2] * (u - 0.5) * logit, axis=1) < 0).any(axis=1))

    return rises


def metalog_feasible(a: tuple[Column, Column, Column]) -> Column:
    """No step down on the grid 0.02, 0.04, ..., 0.98; in vectors."""
    return F.when(a[0].isNotNull() & a[1].isNotNull() & a[2].isNotNull(), _rising()(*a))


def skew_of(lo: Column, mid: Column, hi: Column) -> Column:
    return (hi + lo - 2 * mid) / (hi - lo)


def family_of(lo: Column, mid: Column, hi: Column, bounded: bool = False, bar: float = 0.15) -> Column:
    """beta for bounded properties; else normal for small skew, lognormal for
    larger, unless a value is not positive."""
    if bounded:
        return F.lit("beta")
    positive = (lo > 0) & (mid > 0) & (hi > 0)
    return F.when((F.abs(skew_of(lo, mid, hi)) < bar) | ~positive, "normal").otherwise("lognormal")


def fit_triplet(lo: Column, mid: Column, hi: Column, z: float = Z95) -> Column:
    """struct(family, p1, p2, p3, valid) by the automatic family. Values that
    aren't finite give no fit; no width gives a point triangle at mid."""
    good = finite(lo) & finite(mid) & finite(hi)
    flat = F.abs(hi - lo) < 1.5e-8 * F.greatest(F.abs(lo), F.lit(TINY))
    family = family_of(lo, mid, hi)
    none = F.lit(None).cast("double")

    def row(name: Column, p1: Column, p2: Column, p3: Column, valid: bool) -> Column:
        return F.struct(name.alias("family"), p1.alias("p1"), p2.alias("p2"), p3.alias("p3"), F.lit(valid).alias("valid"))

    log_sd = (F.log(hi) - F.log(lo)) / (2 * z)
    fitted = F.when(family == "normal", row(family, mid, (hi - lo) / (2 * z), none, True)).otherwise(row(family, F.log(mid), log_sd, none, True))
    return F.when(~good, row(F.lit("none"), none, none, none, False)).when(flat, row(F.lit("triangular"), mid, mid, mid, True)).otherwise(fitted)


# Compositions of three parts


def ilr(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    return F.sqrt(F.lit(2 / 3)) * F.log(a / F.sqrt(b * c)), F.sqrt(F.lit(0.5)) * F.log(b / c)


def ilr_inverse(z1: Column, z2: Column, total: float = 100.0) -> tuple[Column, Column, Column]:
    logs = (F.sqrt(F.lit(2 / 3)) * z1, -z1 / F.sqrt(F.lit(6.0)) + z2 / F.sqrt(F.lit(2.0)), -z1 / F.sqrt(F.lit(6.0)) - z2 / F.sqrt(F.lit(2.0)))
    parts = [F.exp(x) for x in logs]
    whole = parts[0] + parts[1] + parts[2]
    return tuple(total * p / whole for p in parts)


def texture_class(sand: Column, silt: Column, clay: Column) -> Column:
    """USDA texture class of percentages."""
    s, i, c = sand, silt, clay
    return (
        F.when(i + 1.5 * c < 15, "sand")
        .when(i + 2 * c < 30, "loamy sand")
        .when((c >= 7) & (c < 20) & (s > 52) | (c < 7) & (i < 50), "sandy loam")
        .when((c >= 7) & (c < 27) & (i >= 28) & (i < 50) & (s <= 52), "loam")
        .when((i >= 50) & (c >= 12) & (c < 27) | (i >= 50) & (i < 80) & (c < 12), "silt loam")
        .when((i >= 80) & (c < 12), "silt")
        .when((c >= 20) & (c < 35) & (i < 28) & (s > 45), "sandy clay loam")
        .when((c >= 27) & (c < 40) & (s > 20) & (s <= 45), "clay loam")
        .when((c >= 27) & (c < 40) & (s <= 20), "silty clay loam")
        .when((c >= 35) & (s > 45), "sandy clay")
        .when((c >= 40) & (i >= 40), "silty clay")
        .otherwise("clay")
    )


# Hydrology


def water_content(h: float, alpha: Column, n: Column, theta_r: Column, theta_s: Column) -> Column:
    """Van Genuchten retention at suction h."""
    return theta_r + (theta_s - theta_r) / F.pow(1 + F.pow(F.abs(alpha * h), n), 1 - 1 / n)


# Names and text

#: Words for amounts that tables hold instead of numbers.
AMOUNTS = {
    "TRACE": 0.1, "TRACES": 0.1, "TR": 0.1, "NONE": 0.01, "ABSENT": 0.01, "NIL": 0.01, "LOW": 15.0, "MODERATE": 35.0, "MOD": 35.0, "HIGH": 65.0,
    "VERY LOW": 5.0, "V LOW": 5.0, "VL": 5.0, "VERY HIGH": 85.0, "V HIGH": 85.0, "VH": 85.0, "SLIGHT": 10.0, "STRONG": 60.0, "WEAK": 20.0,
    "SANDY": 75.0, "CLAYEY": 45.0, "SILTY": 50.0, "COARSE": 70.0, "FINE": 25.0, "MEDIUM": 45.0, "ND": 0.01, "BDL": 0.01, "LOD": 0.01,
    "SCAT": 5.0, "FEW": 8.0, "COMMON": 15.0, "MANY": 25.0,
}
NUMBER = r"\d+\.?\d*"


def parse_amount(text: Column) -> Column:
    """struct(value, type, confidence) of messy text. A bound "<=" halves as
    "<" does. Null and unreadable text have no value."""
    x = F.upper(F.trim(text))
    number = F.regexp_extract(x, NUMBER, 0).cast("double")
    numbers = F.regexp_extract_all(x, F.lit(f"({NUMBER})"), 1)
    words = F.create_map(*[F.lit(y) for pair in AMOUNTS.items() for y in pair])

    def row(value: Column, kind: str, confidence: float) -> Column:
        return F.struct(value.cast("double").alias("value"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

    return (
        F.when(x.rlike(rf"{NUMBER}\s*([-–—]|TO|T|O)\s*{NUMBER}") & (F.size(numbers) == 2), row((numbers[0].cast("double") + numbers[1].cast("double")) / 2, "range", 0.8))
        .when(x.rlike(rf"^[<≤]\s*=?\s*{NUMBER}"), row(number * 0.5, "upper_bound", 0.6))
        .when(x.rlike(rf"^[>≥]\s*=?\s*{NUMBER}"), row(number * 1.5, "lower_bound", 0.6))
        .when(F.map_contains_key(words, F.coalesce(x, F.lit(""))), row(words[x], "qualitative", 0.4))
        .when(x.rlike("%|PCT|PERCENT") & number.isNotNull(), row(number, "percentage", 0.9))
        .when(x.rlike(NUMBER), row(number, "numeric", 0.9))
        .otherwise(row(F.lit(None), "unparseable", 0.0))
    )


def general_horizon(name: Column) -> Column:
    """First of Cr, R, O, A, E, B, C that opens the name after its digits."""
    x = F.regexp_replace(F.upper(F.trim(name)), "^[0-9]+", "")
    found = F.when(x.startswith("CR"), "Cr")
    for letter in "ROAEBC":
        found = found.when(x.startswith(letter), letter)
    return found


HARD = "fragipan|duripan|petrocalcic|petrogypsic|cemented|indurated"


def unsuitable(name: Column, master: Column | None = None, depth: Column | None = None, strict: bool = False) -> Column:
    """Rock, organic, cemented and restrictive horizons, by name; strictly
    also parent material and what lies below 250 cm. Blank names are judged
    by their master designation alone."""
    raw = F.coalesce(F.trim(name), F.lit(""))
    x = F.upper(raw)
    by_name = x.rlike("(^|[0-9]+)(R$|CR|CD|CX)") | x.rlike(rf"(?i)\b({HARD})\b") | ((F.length(x) > 1) & x.rlike("M$")) | x.rlike("(^|[0-9]+)O")
    out = F.when(x == "", False).otherwise(by_name)
    if master is not None:
        out = out | F.coalesce(F.upper(F.trim(master)).isin("R", "O"), F.lit(False))
    if strict:
        out = out | raw.rlike("^C$|^C[0-9]|BC|CB|2C|3C|4C")
        if depth is not None:
            out = out | F.coalesce(depth > 250, F.lit(False))
    return out
