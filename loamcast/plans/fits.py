"""Queries of fitted families, their tests, and perturbed profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.normal import number, qnorm_sql, tail_sql, uniform_sql
from ..operators import fitting, profiles, simulate
from ..sources.tables import horizons as hz
from ..sources.tables import read
from .more import depths
from .registry import TRI, query, rounded

FOUR = ("normal", "lognormal", "exponential", "weibull")


def weibull_sql() -> str:
    """Newton's steps, one table each; w holds shape k and scale c."""
    steps = [f"w0 AS (SELECT mukey, count(*) AS n, avg(ln(r)) AS lm, {number(fitting.np.pi / 6**0.5)} / sqrt(var_pop(ln(r))) AS k FROM hz GROUP BY mukey HAVING count(*) >= 5 AND var_pop(ln(r)) > 0)"]
    for i in range(fitting.WEIBULL_ROUNDS):
        steps.append(f"w{i + 1} AS (SELECT mukey, n, lm, greatest(k - (s1 / s0 - 1 / k) / (s2 / s0 - s1 / s0 * s1 / s0 + 1 / (k * k)), k / 4) AS k FROM (SELECT mukey, n, lm, k, sum(exp(k * (ln(r) - lm))) AS s0, sum((ln(r) - lm) * exp(k * (ln(r) - lm))) AS s1, sum((ln(r) - lm) * (ln(r) - lm) * exp(k * (ln(r) - lm))) AS s2 FROM hz JOIN w{i} USING (mukey) GROUP BY ALL))")
    last = fitting.WEIBULL_ROUNDS
    steps.append(f"w AS (SELECT mukey, n, lm, k, exp(lm) * pow(sum(exp(k * (ln(r) - lm))) / n, 1 / k) AS c FROM hz JOIN w{last} USING (mukey) GROUP BY mukey, n, lm, k)")
    return ", ".join(steps)


FITS = f""", {weibull_sql()}, s AS (SELECT mukey, count(r) AS n, avg(r) AS m, var_pop(r) AS v, avg(ln(r)) AS lm, var_pop(ln(r)) AS lv FROM hz GROUP BY mukey HAVING count(r) >= 5),
  f AS (SELECT mukey, n, 'normal' AS family, m AS a, sqrt(v) AS b, -5e-1 * n * (ln(2 * pi() * v) + 1) AS loglik, 2 AS k FROM s UNION ALL SELECT mukey, n, 'lognormal', lm, sqrt(lv), -5e-1 * n * (ln(2 * pi() * lv) + 1) - n * lm, 2 FROM s
    UNION ALL SELECT mukey, n, 'exponential', 1 / m, NULL, -n * (ln(m) + 1), 1 FROM s UNION ALL SELECT mukey, n, 'weibull', k, c, n * (ln(k) - k * ln(c) + (k - 1) * lm - 1), 2 FROM w)"""


@query(
    "likelihood_fits",
    f"{FITS} SELECT mukey, family, round(a, 8) AS a, round(b, 6) AS b, n, round(loglik, 4) AS loglik, round(2 * k - 2 * loglik, 4) AS aic, round(k * ln(n) - 2 * loglik, 4) AS bic, CAST(rank() OVER (PARTITION BY mukey ORDER BY 2 * k - 2 * loglik) AS INTEGER) AS place FROM f",
)
def likelihood_fits(spark, sf_dir):
    x = fitting.fitted(hz(spark, sf_dir), ["mukey"], "r", FOUR)
    return x.select("mukey", "family", F.round("a", 8).alias("a"), F.round("b", 6).alias("b"), "n", *[F.round(c, 4).alias(c) for c in ("loglik", "aic", "bic")], "place")


BOTH = f"""SELECT mukey, family, n, i, CASE family WHEN 'weibull' THEN 1 - exp(-pow(r / b, a)) WHEN 'exponential' THEN 1 - exp(-a * r) WHEN 'normal' THEN {tail_sql('(a - r) / b')} ELSE {tail_sql('(a - ln(r)) / b')} END AS p,
  CASE family WHEN 'weibull' THEN exp(-pow(r / b, a)) WHEN 'exponential' THEN exp(-a * r) WHEN 'normal' THEN {tail_sql('(r - a) / b')} ELSE {tail_sql('(ln(r) - a) / b')} END AS q FROM (SELECT mukey, r, row_number() OVER (PARTITION BY mukey ORDER BY r) AS i FROM hz) JOIN f USING (mukey)"""


@query(
    "goodness_of_fit",
    f"{FITS} SELECT mukey, family, n, round(max(greatest(i / n - p, p - (i - 1) / n)), 8) AS ks, round(1 / (12 * n) + sum(pow(p - (2 * i - 1) / (2 * n), 2)), 8) AS cvm, round(-n - sum((2 * i - 1) * ln(p) + (2 * n + 1 - 2 * i) * ln(q)) / n, 6) AS ad FROM ({BOTH}) GROUP BY mukey, family, n",
)
def goodness_of_fit(spark, sf_dir):
    fits = fitting.fitted(hz(spark, sf_dir), ["mukey"], "r", FOUR)
    x = fitting.goodness(hz(spark, sf_dir), fits, ["mukey"], "r", FOUR)
    return x.select("mukey", "family", "n", F.round("ks", 8).alias("ks"), F.round("cvm", 8).alias("cvm"), F.round("ad", 6).alias("ad"))


@query("family_tests")
def family_tests(spark, sf_dir):
    """All six families, of quantities as parts of a hundred."""
    fits = fitting.fitted(hz(spark, sf_dir), ["mukey"], "p1")
    tested = fitting.goodness(hz(spark, sf_dir), fits, ["mukey"], "p1")
    return rounded(fits.join(tested.drop("n"), ["mukey", "family"]))


def components(spark, sf_dir):
    """Orders as components of their customer's map unit."""
    pct = (F.col("o_orderkey") % 9 + 1).cast("double")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mukey"), F.col("o_orderkey").alias("cokey"), F.when(F.col("o_orderkey") % 4 != 0, pct * 0.6).alias("pct_l"), pct.alias("pct_r"), (pct * 1.5).alias("pct_h"))


COUNTS = f"""c AS (SELECT cokey, CAST(round_even(sum({TRI}) / 100, 0) AS BIGINT) AS sim_comppct FROM (SELECT cokey, md, coalesce(lo, md - 2) AS lo, md * 15e-1 AS hi, {uniform_sql('cokey', 'sim', '1')} AS u
  FROM (SELECT o_orderkey AS cokey, CAST(o_orderkey % 9 + 1 AS DOUBLE) AS md, CASE WHEN o_orderkey % 4 != 0 THEN (o_orderkey % 9 + 1) * 6e-1 END AS lo FROM orders), range(1, 1001) s(sim)) GROUP BY cokey)"""


@query("component_counts", f"WITH {COUNTS} SELECT * FROM c")
def component_counts(spark, sf_dir):
    return simulate.component_counts(components(spark, sf_dir))


def spreads(x):
    """Layers with spreads: an eighth of the thickness, and none where mark is even; 1 to 10 cm at boundaries."""
    return x.select("cokey", "hz", F.col("hzdept_r").alias("top"), F.col("hzdepb_r").alias("bottom"), F.when(F.col("mark") % 2 == 1, (F.col("hzdepb_r") - F.col("hzdept_r")) / 8).alias("thickness_sd"), (F.col("mark") % 10 + 1).cast("double").alias("bound_sd"))


@query(
    "profiles_perturbed",
    f""", {COUNTS}, d AS (SELECT cokey, sim, hz, hzdept_r AS top, hzdepb_r AS bottom, CASE WHEN mark % 2 = 1 THEN (hzdepb_r - hzdept_r) / 8 ELSE 0 END AS ts, CAST(mark % 10 + 1 AS DOUBLE) AS bs, {uniform_sql('cokey', 'sim', 'hz', "'thickness'", '1')} AS ut, {uniform_sql('cokey', 'sim', 'hz', "'bound'", '1')} AS ub
    FROM hz JOIN c USING (cokey), range(1, 1000) s(sim) WHERE sim <= sim_comppct),
  t AS (SELECT *, first(top) OVER (PARTITION BY cokey, sim ORDER BY hz) + sum(greatest(CASE WHEN ts = 0 THEN bottom - top ELSE round_even(bottom - top + ts * {qnorm_sql('ut')}, 0) END, 1)) OVER (PARTITION BY cokey, sim ORDER BY hz) AS stacked FROM d),
  b AS (SELECT cokey, sim, hz, bottom AS was, greatest(max(round_even(stacked + bs * {qnorm_sql('ub')}, 0) - hz) OVER (PARTITION BY cokey, sim ORDER BY hz) + hz, first(top) OVER (PARTITION BY cokey, sim ORDER BY hz) + hz) AS bottom, first(top) OVER (PARTITION BY cokey, sim ORDER BY hz) AS surface FROM t)
  SELECT cokey, hz, count(*) AS n, round(avg(thick), 6) AS thickness, min(thick) AS least, round(stddev_samp(bottom - was), 6) AS offset_sd FROM (SELECT *, bottom - coalesce(lag(bottom) OVER (PARTITION BY cokey, sim ORDER BY hz), surface) AS thick FROM b) GROUP BY cokey, hz""",
)
def profiles_perturbed(spark, sf_dir):
    def figures(top, bottom, first, own):
        thick = bottom - top
        n = np.diff(np.append(first, len(own))) * top.shape[1]
        seen = ~np.isnan(thick)
        mean = np.add.reduceat(np.where(seen, thick, 0.0).sum(axis=1), first) / np.add.reduceat(seen.sum(axis=1), first)
        least = np.minimum.reduceat(np.where(seen, thick, np.inf).min(axis=1), first)
        # Bottoms of a group have one offset from where they were, so their spread is that of the offsets.
        return n, mean, np.where(np.isinf(least), np.nan, least), profiles.sd_at(bottom, first, own)

    x = profiles.perturbed_counts(spreads(hz(spark, sf_dir, dealt=True)), simulate.component_counts(components(spark, sf_dir)), ["cokey"], figures=figures, kinds="n long, thickness double, least double, offset_sd double")
    return x.select("cokey", F.col("hz").cast("long").alias("hz"), "n", F.round("thickness", 6).alias("thickness"), "least", F.round("offset_sd", 6).alias("offset_sd"))


@query("profiles_simulated")
def profiles_simulated(spark, sf_dir):
    """Spread of layers over simulated, perturbed and held profiles, each
    repeated 2 to 18 times."""
    x = profiles.perturbed_profiles(depths(spark, sf_dir).withColumn("distinctness", F.lit(None).cast("string")), simulate.component_counts(components(spark, sf_dir), 200))
    thick = F.col("bottom") - F.col("top")
    return rounded(x.groupBy("cokey", "hz").agg(F.count("*").alias("n"), F.avg(thick).alias("thickness"), F.min(thick).alias("least"), F.stddev_samp("bottom").alias("bottom_sd")))
