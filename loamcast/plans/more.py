"""Queries of families, fusion, profiles, infilling, cleaning and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import families
from ..functions import scalar as S
from ..functions.normal import number, qnorm_sql, uniform, uniform_sql
from ..operators import checks, cleaning, fusion, infill, percentiles, profiles, simulate, stats
from ..sources.tables import HORIZONS, read
from ..sources.tables import horizons as hz
from .registry import MATRIX, ORACLE_SQL, TRIANGLE, Z, query, rounded

U = uniform_sql("cokey", "hz", "'family'")
KNOTS = "CASE WHEN u <= 5e-2 THEN l WHEN u <= 5e-1 THEN l + (r - l) * (u - 5e-2) / 45e-2 WHEN u <= 95e-2 THEN r + (h - r) * (u - 5e-1) / 45e-2 ELSE h END"


def asked() -> F.Column:
    names = F.array(*map(F.lit, ("triangular", "uniform", "normal", "lognormal", "linear_cdf", "auto", "gumbel")))
    return F.get(names, (F.col("mark") % 7).cast("int"))


@query(
    "family_draws",
    f"""SELECT cokey, hz, CASE WHEN f != 'auto' THEN f WHEN abs((h + l - 2 * r) / (h - l)) < 15e-2 THEN 'normal' ELSE 'lognormal' END AS family, round(CASE
    WHEN f = 'gumbel' THEN NULL WHEN f = 'triangular' THEN {TRIANGLE} WHEN f = 'uniform' THEN l + u * (h - l) WHEN f = 'linear_cdf' THEN {KNOTS}
    WHEN f = 'normal' OR f = 'auto' AND abs((h + l - 2 * r) / (h - l)) < 15e-2 THEN r + (h - l) / (2 * {Z}) * {qnorm_sql('u')} ELSE exp(ln(r) + (ln(h) - ln(l)) / (2 * {Z}) * {qnorm_sql('u')}) END, 4) AS draw, f != 'gumbel' AS valid
  FROM (SELECT cokey, hz, l, r, h, u, CASE k WHEN 0 THEN 'triangular' WHEN 1 THEN 'uniform' WHEN 2 THEN 'normal' WHEN 3 THEN 'lognormal' WHEN 4 THEN 'linear_cdf' WHEN 5 THEN 'auto' ELSE 'gumbel' END AS f FROM (SELECT cokey, hz, l - 1 AS l, r, h + 2 AS h, mark % 7 AS k, {U} AS u FROM hz))""",
)
def family_draws(spark, sf_dir):
    x = hz(spark, sf_dir).withColumns({"l": F.col("l") - 1, "h": F.col("h") + 2}).withColumn("u", uniform(F.col("cokey"), F.col("hz"), "family"))
    x = x.withColumn("f", families.fit(F.col("l"), F.col("r"), F.col("h"), asked()))
    x = x.withColumns({"draw": families.quantile(F.col("f"), "u"), "ok": families.check(F.col("f"))})
    return x.select("cokey", "hz", "f.family", F.round("draw", 4).alias("draw"), "ok.valid")


Q = lambda x: f"ln(({x} - 0) / (60 - ({x})))"
LG = "ln(u / (1 - u))"
STEP = "a2 * ln({k} / (50e0 - {k})) + a3 * ({k} / 50e0 - 5e-1) * ln({k} / (50e0 - {k}))"


@query(
    "bounded_metalog",
    f"""SELECT cokey, hz, bad, round(CASE WHEN bad THEN {KNOTS} ELSE (60 * exp(a1 + a2 * {LG} + a3 * (u - 5e-1) * {LG})) / (1 + exp(a1 + a2 * {LG} + a3 * (u - 5e-1) * {LG})) END, 5) AS draw FROM (
  SELECT *, (SELECT bool_or({STEP.format(k="(k + 1)")} - ({STEP.format(k="k")}) < 0) FROM range(1, 49) t(k)) AS bad
  FROM (SELECT *, z2 AS a1, (z3 - z1) / (2 * ln(19e0)) AS a2, (z3 + z1 - 2 * z2) / (9e-1 * ln(19e0)) AS a3 FROM (SELECT *, {Q('l')} AS z1, {Q('r')} AS z2, {Q('h')} AS z3 FROM (SELECT cokey, hz, p1 * 1e-1 AS l, p1 * CASE mark % 3 WHEN 0 THEN 11e-2 WHEN 1 THEN 5e-1 ELSE 109e-2 END AS r, p1 * 11e-1 AS h, {U} AS u FROM hz))))""",
)
def bounded_metalog(spark, sf_dir):
    mid = F.col("p1") * F.when(F.col("mark") % 3 == 0, 0.11).when(F.col("mark") % 3 == 1, 0.5).otherwise(1.09)
    x = hz(spark, sf_dir).select("cokey", "hz", (F.col("p1") * 0.1).alias("l"), mid.alias("r"), (F.col("p1") * 1.1).alias("h"), uniform(F.col("cokey"), F.col("hz"), "family").alias("u"))
    values, probs = [F.col(c) for c in "lrh"], [0.05, 0.5, 0.95]
    a = families.metalog(values, probs, (0.0, 60.0), "b")
    return x.select("cokey", "hz", families.infeasible(a).alias("bad"), F.round(families.metalog_or_linear(a, values, probs, F.col("u"), (0.0, 60.0), "b"), 5).alias("draw"))


COLUMNS = {0.0: "v0", 0.05: "v5", 0.5: "v50", 0.95: "v95", 1.0: "v100"}


def measured(spark, sf_dir):
    """Five percentiles, of which some are missing or marked as absent."""
    x = hz(spark, sf_dir).withColumn("u", uniform(F.col("cokey"), F.col("hz"), "family"))
    return x.withColumns({"v0": F.when(F.col("mark") % 4 != 0, F.col("l") * 0.9).otherwise(-1.0), "v5": F.col("l"), "v50": F.when(F.col("mark") % 5 != 0, F.col("r")), "v95": F.col("h"), "v100": F.when(F.col("mark") % 3 != 0, F.col("h") * 1.1)})


@query(
    "percentile_draws",
    f"""SELECT cokey, hz, len(p) AS n, round(CASE WHEN len(c) = 0 THEN p[1].v WHEN len(c) = len(p) THEN p[len(p)].v ELSE p[len(c)].v + (p[len(c) + 1].v - p[len(c)].v) * (u - p[len(c)].p) / (p[len(c) + 1].p - p[len(c)].p) END, 4) AS draw,
  round(CASE WHEN mark % 5 != 0 THEN r + (h - l) / (2 * {Z}) * {qnorm_sql('u')} END, 4) AS gauss FROM (SELECT *, list_filter(p, lambda x: x.p <= u) AS c FROM (SELECT *, {U} AS u,
  list_filter([{{'p': 0e0, 'v': CASE WHEN mark % 4 != 0 THEN l * 9e-1 ELSE -1e0 END}}, {{'p': 5e-2, 'v': l}}, {{'p': 5e-1, 'v': CASE WHEN mark % 5 != 0 THEN r END}}, {{'p': 95e-2, 'v': h}}, {{'p': 1e0, 'v': CASE WHEN mark % 3 != 0 THEN h * 11e-1 END}}], lambda x: x.v IS NOT NULL AND x.v != -1) AS p FROM hz ))""",
)
def percentile_draws(spark, sf_dir):
    x = measured(spark, sf_dir).withColumn("d", percentiles.draws(COLUMNS, ("linear_cdf", "normal"), "u"))
    return x.select("cokey", "hz", F.size(percentiles.pairs(COLUMNS)).cast("long").alias("n"), F.round("d.linear_cdf", 4).alias("draw"), F.round("d.normal", 4).alias("gauss"))


@query("percentile_methods")
def percentile_methods(spark, sf_dir):
    return percentiles.compared(measured(spark, sf_dir), COLUMNS, percentiles.METHODS, "u", ["genhz"])


@query(
    "ks_distances",
    """, v AS (SELECT genhz, p2 AS v, 1 AS a, 0 AS b FROM hz UNION ALL SELECT genhz, p3, 0, 1 FROM hz)
  SELECT genhz, round(max(abs(ra / na - rb / nb)), 8) AS ks, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM (SELECT genhz, sum(a) OVER w AS ra, sum(b) OVER w AS rb, sum(a) OVER (PARTITION BY genhz) AS na, sum(b) OVER (PARTITION BY genhz) AS nb FROM v WINDOW w AS (PARTITION BY genhz ORDER BY v RANGE UNBOUNDED PRECEDING)) GROUP BY genhz""",
)
def ks_distances(spark, sf_dir):
    x = hz(spark, sf_dir)
    return rounded(percentiles.ks_distance(x.select("genhz", F.col("p2").alias("v")), x.select("genhz", F.col("p3").alias("v")), ["genhz"], "v"), digits=8)


PRIOR, LIKELIHOOD = {0.05: "a05", 0.5: "a50", 0.95: "a95"}, {0.05: "b05", 0.5: "b50", 0.95: "b95"}
SIDES = f"(SELECT p_partkey AS cell, p_retailprice * 8e-1 AS a05, p_retailprice AS a50, p_retailprice * 13e-1 AS a95, p_retailprice * 9e-1 + p_size AS b05, p_retailprice + p_size AS b50, p_retailprice * 12e-1 + p_size AS b95, 2 * {Z} AS z FROM part)"


def two_sides(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), (price * 0.8).alias("a05"), price.alias("a50"), (price * 1.3).alias("a95"), (price * 0.9 + size).alias("b05"), (price + size).alias("b50"), (price * 1.2 + size).alias("b95"))


@query(
    "cells_lognormal",
    f"""SELECT cell, round(exp(m + v / 2), 4) AS mu, round(exp(m + v / 2) * sqrt(exp(v) - 1), 4) AS sigma, 'lognormal' AS route FROM (SELECT cell, (m1 / v1 + m2 / v2) / (1 / v1 + 1 / v2) AS m, 1 / (1 / v1 + 1 / v2) AS v FROM (
  SELECT cell, ln(a50) - ln(1 + pow((a95 - a05) / z / a50, 2)) / 2 AS m1, ln(1 + pow((a95 - a05) / z / a50, 2)) AS v1, ln(b50) - ln(1 + pow((b95 - b05) / z / b50, 2)) / 2 AS m2, ln(1 + pow((b95 - b05) / z / b50, 2)) AS v2 FROM {SIDES}))""",
)
def cells_lognormal(spark, sf_dir):
    x = fusion.fuse_cells(two_sides(spark, sf_dir), PRIOR, LIKELIHOOD, "lognormal")
    return x.select("cell", F.round("posterior.mu", 4).alias("mu"), F.round("posterior.sigma", 4).alias("sigma"), "route")


@query(
    "cells_gamma",
    f"""SELECT cell, round(ln(m1 * m1 / v1 + m2 * m2 / v2 - 1), 7) AS log_shape, round(m1 / v1 + m2 / v2, 7) AS rate, 'gamma' AS route FROM (SELECT cell, m1, (pow(a05 - m1, 2) + pow(a50 - m1, 2) + pow(a95 - m1, 2)) / 3 AS v1, m2, (pow(b05 - m2, 2) + pow(b50 - m2, 2) + pow(b95 - m2, 2)) / 3 AS v2
  FROM (SELECT *, (a05 + a50 + a95) / 3 AS m1, (b05 + b50 + b95) / 3 AS m2 FROM {SIDES}))""",
)
def cells_gamma(spark, sf_dir):
    x = fusion.fuse_cells(two_sides(spark, sf_dir), PRIOR, LIKELIHOOD, "gamma")
    return x.select("cell", F.round(F.log("posterior.shape"), 7).alias("log_shape"), F.round("posterior.rate", 7).alias("rate"), "route")


@query("cells_metalog")
def cells_metalog(spark, sf_dir):
    return rounded(fusion.fuse_cells(two_sides(spark, sf_dir), PRIOR, LIKELIHOOD, "metalog", (0.0, 5000.0)).select("cell", "posterior.mu", "posterior.sigma", "route"), digits=4)


@query("family_of_cells", "SELECT CASE WHEN abs(s) < 15e-2 THEN 'normal' ELSE 'lognormal' END AS family, round(s, 8) AS skew FROM (SELECT (h + l - 2 * m) / (h - l) AS s FROM (SELECT median(p_retailprice * 8e-1) AS l, median(p_retailprice) AS m, median(p_retailprice * 13e-1) AS h FROM part))")
def family_of_cells(spark, sf_dir):
    return rounded(fusion.family_of_cells(two_sides(spark, sf_dir), PRIOR), digits=8)


@query("composition_posterior")
def composition_posterior(spark, sf_dir):
    x = hz(spark, sf_dir).groupBy("mukey").agg(*[F.avg(p).alias(p) for p in ("p1", "p2", "p3")])
    for p, k in (("p1", 1.0), ("p2", 1.1), ("p3", 0.9)):
        x = x.withColumns({f"{p}_{s}{e}": F.col(p) * k * w for s, k in (("a", 1.0), ("b", k)) for e, w in (("l", 0.8), ("m", 1.0), ("h", 1.2))})
    sides = [{p: (f"{p}_{s}l", f"{p}_{s}m", f"{p}_{s}h") for p in ("p1", "p2", "p3")} for s in "ab"]
    post = fusion.fuse_composition(x, ["mukey"], *sides, 200, float(1.6448536269514722), float(1.6448536269514722))
    drawn = fusion.composition_draws(post, ["mukey"], ("sand", "silt", "clay"), 100)
    spread = drawn.groupBy("mukey").agg(*[F.stddev_samp(c).alias(f"{c}_sd") for c in ("sand", "silt", "clay")], F.max(F.abs(F.col("sand") + F.col("silt") + F.col("clay") - 100)).alias("off"))
    return rounded(post.join(spread, "mukey"))


def depths(spark, sf_dir, dealt=False):
    x = hz(spark, sf_dir, dealt)
    low = lambda c: F.when(F.col("mark") % 4 != 0, F.greatest(F.col(c) - 3, F.lit(0.0)))
    return x.select("mukey", "cokey", "hz", "hzname", "genhz", "hzdept_r", "hzdepb_r", low("hzdept_r").alias("hzdept_l"), (F.col("hzdept_r") + 4).alias("hzdept_h"), low("hzdepb_r").alias("hzdepb_l"), (F.col("hzdepb_r") + 5).alias("hzdepb_h"))


def tri(low: str, mode: str, high: str, u: str) -> str:
    return f"CASE WHEN {high} - {low} <= 0 THEN {mode} WHEN {u} < ({mode} - {low}) / ({high} - {low}) THEN {low} + sqrt({u} * ({high} - {low}) * ({mode} - {low})) ELSE {high} - sqrt((1 - {u}) * ({high} - {low}) * ({high} - {mode})) END"


@query("profiles_top_down")
def profiles_top_down(spark, sf_dir):
    return profiles.simulated(depths(spark, sf_dir), ["cokey"], "top_down", 5).select("cokey", F.col("sim").cast("long").alias("sim"), F.col("hz").cast("long").alias("hz"), "top", "bottom")


ORACLE_SQL["profiles_top_down"] = f"""WITH RECURSIVE {HORIZONS}, d AS (SELECT cokey, sim, hz, {uniform_sql('cokey', 'sim', 'hz', "'bottom'")} AS u, coalesce(CASE WHEN mark % 4 != 0 THEN greatest(hzdepb_r - 3, 0) END, greatest(hzdepb_r - 2, 0)) AS l, hzdepb_r AS r, hzdepb_r + 5 AS h FROM hz, range(1, 6) s(sim)),
p AS (SELECT cokey, sim, hz, 0e0 AS top, greatest(0e0, round_even({tri('lo', 'mo', 'hi', 'u')}, 0)) AS bottom FROM (SELECT *, greatest(l, 0e0) AS lo, greatest(greatest(l, 0e0), h) AS hi, least(greatest(r, greatest(l, 0e0)), greatest(greatest(l, 0e0), h)) AS mo FROM d WHERE hz = 1)
  UNION ALL SELECT cokey, sim, hz, bottom AS top, greatest(bottom, round_even({tri('lo', 'mo', 'hi', 'u')}, 0)) FROM (SELECT d.cokey, d.sim, d.hz, u, p.bottom, greatest(l, p.bottom) AS lo, greatest(greatest(l, p.bottom), h) AS hi, least(greatest(r, greatest(l, p.bottom)), greatest(greatest(l, p.bottom), h)) AS mo FROM p JOIN d ON d.cokey = p.cokey AND d.sim = p.sim AND d.hz = p.hz + 1))
SELECT cokey, sim, hz, top, bottom FROM p"""


@query("profiles_mixed")
def profiles_mixed(spark, sf_dir):
    return profiles.mixed_spread(depths(spark, sf_dir, dealt=True), ["cokey"], 20)


@query(
    "distinctness",
    "SELECT cokey, hz, d AS distinctness, CASE d WHEN 'diffuse' THEN 10e0 WHEN 'clear' THEN 25e-1 WHEN 'gradual' THEN 75e-1 WHEN 'abrupt' THEN 1e0 END AS bound_sd FROM (SELECT cokey, hz, CASE WHEN mark % 5 = 0 THEN 'abrupt' WHEN g = 'O' THEN 'diffuse' WHEN g = 'A' THEN 'clear' WHEN g = 'Cr' THEN 'gradual' END AS d FROM (SELECT *, CASE mark % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'A' WHEN 2 THEN 'Cr' ELSE 'X' END AS g FROM hz))",
)
def distinctness(spark, sf_dir):
    general = F.get(F.array(*map(F.lit, ("O", "A", "Cr", "X"))), (F.col("mark") % 4).cast("int"))
    x = hz(spark, sf_dir).withColumns({"genhz": general, "distinctness": F.when(F.col("mark") % 5 == 0, "abrupt")})
    return profiles.with_distinctness(x).select("cokey", "hz", "distinctness", "bound_sd")


@query(
    "rock_fragments",
    """SELECT cokey, hz, CASE WHEN v IS NULL OR v <= 0 THEN 'none' WHEN v <= 5 THEN 'low' WHEN v <= 15 THEN 'moderate' WHEN v <= 35 THEN 'high' WHEN v <= 60 THEN 'very_high' ELSE 'extreme' END AS class,
  round(CASE WHEN v IS NULL AND s BETWEEN 95 AND 105 THEN 1e-1 WHEN v IS NULL THEN 5e-1 WHEN v <= 1e-2 THEN 5e-2 ELSE greatest(5e-2, least(greatest(v, 1e-1), 85) * 7e-1) END, 6) AS l, round(CASE WHEN v IS NULL AND s BETWEEN 95 AND 105 THEN 5e-1 WHEN v IS NULL THEN 2 WHEN v <= 1e-2 THEN 1e-1 ELSE least(greatest(v, 1e-1), 85) END, 6) AS r,
  round(CASE WHEN v IS NULL AND s BETWEEN 95 AND 105 THEN 1 WHEN v IS NULL THEN 5 WHEN v <= 1e-2 THEN 5e-1 ELSE least(85, least(greatest(v, 1e-1), 85) * 13e-1) END, 6) AS h FROM (SELECT *, CASE WHEN mark % 4 = 0 THEN NULL ELSE p1 * 2 - 3 END AS v, 60 + p1 AS s FROM hz)""",
)
def rock_fragments(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("v", F.when(F.col("mark") % 4 != 0, F.col("p1") * 2 - 3))
    x = x.withColumn("f", infill.rock_fragments(F.col("v"), F.lit(30.0), F.lit(30.0), F.col("p1")))
    return x.select("cokey", "hz", infill.fragment_class(F.col("v")).alias("class"), *[F.round(f"f.{c}", 6).alias(c) for c in "lrh"])


@query(
    "pedotransfer",
    """, i AS (SELECT cokey, hz, 2 * p1 * k / 100 AS s, p1 / 2 * k / 100 AS c, d, greatest(1e-1, o) / 100 AS o FROM (SELECT *, CASE WHEN abs(t - 100) > 5 THEN 100 / t ELSE 1 END AS k FROM (SELECT *, 2 * p1 + p1 / 2 + 10 AS t, 1 + p2 / 10 AS d, p3 / 2 AS o FROM hz WHERE 2 * p1 <= 100))),
  j AS (SELECT *, -251e-3 * s + 195e-3 * c + 11e-3 * o + 6e-3 * s * o - 27e-3 * c * o + 452e-3 * s * c + 299e-3 AS t, exp(ln(33) + 154e-2 * s + 95e-2 * c + 25e-3 * o - 351e-3 * s * o - 23e-3 * c * o - 427e-3 * s * c + 15e-3 * s * s * c * c) AS a, exp(ln(1500) + 2e-2 * c * c + 14e-2 * s - 2e-4 * s * s * c - 2e-3 * c * c * s - 2e-4 * c * c * o + 3e-4 * c * c * s * o) AS b FROM i),
  k AS (SELECT cokey, hz, least(greatest(t * pow(a / (a + 31e-2), 17e-2) * d * 100, 3), 65) AS f, least(greatest(t * pow(b / (b + 31e-2), 17e-2) * d * 100, 1), 45) AS w FROM j)
  SELECT cokey, hz, round(f, 2) AS field, round(CASE WHEN w >= f THEN f * 6e-1 ELSE w END, 2) AS wilt FROM k""",
)
def pedotransfer(spark, sf_dir):
    x = hz(spark, sf_dir).where("2 * p1 <= 100")
    w = infill.water_retention(x, 2 * F.col("p1"), F.lit(10.0), F.col("p1") / 2, 1 + F.col("p2") / 10, F.lit(None).cast("double"), F.col("p3") / 2)
    return w.select("cokey", "hz", "field", "wilt")


@query(
    "related_properties",
    """SELECT cokey, hz, round(greatest(0, least(100, 100 - p1 - p2)), 6) AS sand, round(CASE WHEN c IS NOT NULL THEN greatest(0, least(60, 3e-1 * c + 10)) END, 6) AS water, round(CASE WHEN c IS NOT NULL OR o IS NOT NULL THEN least(100, greatest(2, coalesce(c * 5e-1, 0) + coalesce(o * 20, 0))) END, 6) AS cec,
  round(62e-1 + CASE g WHEN 'A' THEN -3e-1 WHEN 'C' THEN 2e-1 ELSE 0 END + CASE WHEN o > 5 THEN -4e-1 ELSE 0 END, 6) AS ph, round(CASE g WHEN 'C' THEN 2e-1 ELSE dm * CASE g WHEN 'A' THEN 15e-1 ELSE 1 END END * CASE WHEN c > 35 THEN 13e-1 WHEN c < 15 THEN 7e-1 ELSE 1 END, 6) AS om,
  round(CASE WHEN c IS NOT NULL THEN least(22e-1, greatest(8e-1, 14e-1 - (c - 20) * 1e-2)) END, 6) AS density FROM (SELECT *, CASE WHEN mark % 3 != 0 THEN p1 END AS c, CASE WHEN mark % 5 != 0 THEN p2 END AS o, CASE mark % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'B' END AS g,
  CASE WHEN hzdept_r <= 15 THEN 35e-1 WHEN hzdept_r <= 30 THEN 18e-1 WHEN hzdept_r <= 50 THEN 8e-1 ELSE 3e-1 END AS dm FROM hz )""",
)
def related_properties(spark, sf_dir):
    clay, om = F.when(F.col("mark") % 3 != 0, F.col("p1")), F.when(F.col("mark") % 5 != 0, F.col("p2"))
    name = F.get(F.array(F.lit("Ap"), F.lit("C1"), F.lit("Bt"), F.lit(None).cast("string")), (F.col("mark") % 4).cast("int"))
    whole = {"claytotal": F.col("p1"), "silttotal": F.col("p2")}
    some = {"claytotal": clay, "om": om, "hzname": name, "depth": F.col("hzdept_r")}
    asked_for = {"sand": ("sandtotal", whole), "water": ("wthirdbar", some), "cec": ("cec7", some), "ph": ("ph1to1h2o", some), "om": ("om", some), "density": ("dbovendry", some)}
    return rounded(hz(spark, sf_dir).select("cokey", "hz", *[infill.related(n, c)["value"].alias(k) for k, (n, c) in asked_for.items()]))


@query(
    "learned_bounds",
    """, t AS (SELECT cokey, hz, genhz AS hzname, hzdepb_r, CASE WHEN mark % 3 = 0 THEN NULL ELSE p1 - p2 / 2 END AS l, p1 AS r, CASE WHEN mark % 4 = 0 THEN NULL ELSE p1 + p3 END AS h, mark % 11 != 0 AS ok FROM hz),
  w AS (SELECT *, CASE WHEN hzdepb_r <= 30 THEN 's' WHEN hzdepb_r <= 100 THEN 'm' WHEN hzdepb_r <= 200 THEN 'd' END AS zone FROM t WHERE ok AND l IS NOT NULL AND h IS NOT NULL), n AS (SELECT hzname, median(r - l) AS d, median(h - r) AS u FROM w GROUP BY hzname HAVING count(*) >= 3)
  SELECT t.cokey, t.hz, round(CASE WHEN ok THEN least(greatest(coalesce(l, greatest(r - d, 0)), 0), r) ELSE l END, 6) AS l, round(CASE WHEN ok THEN greatest(least(coalesce(h, least(r + u, 100)), 100), r) ELSE h END, 6) AS h, CASE WHEN ok AND l IS NULL THEN 'name' END AS spread_from FROM t JOIN n USING (hzname)""",
)
def learned_bounds(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "hz", F.col("genhz").alias("hzname"), "hzdepb_r", F.when(F.col("mark") % 3 != 0, F.col("p1") - F.col("p2") / 2).alias("v_l"), F.col("p1").alias("v_r"), F.when(F.col("mark") % 4 != 0, F.col("p1") + F.col("p3")).alias("v_h"), (F.col("mark") % 11 != 0).alias("suitable"))
    return infill.with_bounds(x, "v", "claytotal").select("cokey", "hz", F.round("v_l", 6).alias("l"), F.round("v_h", 6).alias("h"), "spread_from")


@query(
    "clean_horizons",
    "SELECT cokey, hz, round(hzdepb_r - hzdept_r, 6) AS hzthk_r, (hzdept_r + hzdepb_r) / 2 AS mid, round(p2 - p3, 6) AS awc_r, round(hzdept_r / 254e-2, 2) AS inches FROM (SELECT *, CASE WHEN mark % 6 = 0 THEN NULL ELSE hz.hzdept_r END AS top FROM hz) WHERE top IS NOT NULL AND hzdepb_r > hzdept_r AND hzdepb_r <= 120",
)
def clean_horizons(spark, sf_dir):
    x = hz(spark, sf_dir).withColumns({"hzdept_r": F.when(F.col("mark") % 6 != 0, F.col("hzdept_r")), "wthirdbar_r": F.col("p2"), "wfifteenbar_r": F.col("p3")})
    x = cleaning.derived(cleaning.valid_horizons(x, 120.0))
    return x.select("cokey", "hz", F.round("hzthk_r", 6).alias("hzthk_r"), "mid", F.round("awc_r", 6).alias("awc_r"), cleaning.converted(F.col("hzdept_r"), "cm", "in").alias("inches"))


@query("standard_names", "SELECT cokey, hz, p1 AS claytotal_r, p2 AS sandtotal_r, r AS cec7_r FROM hz")
def standard_names(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "hz", F.col("p1").alias("clay"), F.col("p3").alias("claytotal"), F.col("p2").alias("sand_r"), F.col("r").alias("cec_r"))
    return cleaning.renamed(x)


@query("range_violations", "SELECT 'p1' AS \"column\", count(*) FILTER (p1 > 45) AS n, count(*) FILTER (p1 > 45) / count(*) AS share FROM hz UNION ALL SELECT 'p2', count(*) FILTER (p2 < 2), count(*) FILTER (p2 < 2) / count(*) FROM hz")
def range_violations(spark, sf_dir):
    return cleaning.range_violations(hz(spark, sf_dir), {"p1": (0.0, 45.0), "p2": (2.0, 100.0)})


@query(
    "processing_report",
    "SELECT *, CASE WHEN score >= 9e-1 THEN 'Excellent' WHEN score >= 8e-1 THEN 'Good' WHEN score >= 7e-1 THEN 'Acceptable' WHEN score >= 6e-1 THEN 'Needs Improvement' ELSE 'Poor' END AS grade FROM (SELECT a AS rows_before, b AS rows_after, round(c, 8) AS completeness, round(b / a, 8) AS retention, round((4e-1 * 9e-1 + 25e-2 * b / a + 25e-2 * c) / 9e-1, 8) AS score FROM (SELECT count(*) AS a, count(*) FILTER (hzdepb_r <= 120) AS b, (1 + avg(CASE WHEN mark % 3 != 0 THEN 1e0 ELSE 0e0 END) FILTER (hzdepb_r <= 120)) / 2 AS c FROM hz))",
)
def processing_report(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("v", F.when(F.col("mark") % 3 != 0, F.col("r")))
    return rounded(cleaning.processing_report(x, cleaning.valid_horizons(x, 120.0), ["r", "v"], 0.9), digits=8)


@query(
    "convergence",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(abs(b - a) / abs(a), 8) AS change, abs(b - a) / abs(a) <= 5e-2 AS converged FROM (SELECT avg({c}) FILTER (hz % 5 = 3) AS a, avg({c}) FILTER (hz % 5 = 4) AS b FROM hz)" for c in ("r", "p1")),
)
def convergence(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("sim", F.col("hz") % 5)
    return rounded(checks.convergence(x, "sim", ["r", "p1"]), digits=8)


@query(
    "range_coverage",
    """SELECT mukey, round(c, 6) AS coverage, x AS extrapolated, c >= 90 AND NOT x AS good FROM (SELECT mukey, 100 * greatest(least(oh, sh) - greatest(ol, sl), 0) / (oh - ol) AS c, sl < (oh + ol) / 2 - (oh - ol) * 6e-1 OR sh > (oh + ol) / 2 + (oh - ol) * 6e-1 AS x FROM (SELECT mukey, min(r) AS ol, max(r) AS oh, min(l) AS sl, max(h) AS sh FROM hz GROUP BY mukey))""",
)
def range_coverage(spark, sf_dir):
    x = hz(spark, sf_dir)
    drawn = x.select("mukey", F.col("l").alias("r")).unionByName(x.select("mukey", F.col("h").alias("r")))
    return rounded(checks.range_coverage(drawn, x, ["mukey"], "r"))


@query(
    "spread_coverage",
    """, q AS (SELECT genhz, quantile_cont(r, 5e-2) AS a, quantile_cont(r, 25e-2) AS b, quantile_cont(r, 75e-2) AS c, quantile_cont(r, 95e-2) AS d FROM hz GROUP BY genhz)
  SELECT genhz, round(max(d - a) / (max(r) - min(r)), 8) AS spread, round(100 * avg(CASE WHEN r < b - 15e-1 * (c - b) OR r > c + 15e-1 * (c - b) THEN 1e0 ELSE 0e0 END), 8) AS outliers, 100 * avg(CASE WHEN r < b - 15e-1 * (c - b) OR r > c + 15e-1 * (c - b) THEN 1e0 ELSE 0e0 END) <= 10 AS adequate FROM hz JOIN q USING (genhz) GROUP BY genhz""",
)
def spread_coverage(spark, sf_dir):
    return rounded(checks.spread_coverage(hz(spark, sf_dir), ["genhz"], "r"), digits=8)


@query(
    "correlation_gaps",
    """, o AS (SELECT genhz, corr(r, p1) AS a, corr(r, p2) AS b, corr(p1, p2) AS c FROM hz WHERE mark % 2 = 0 GROUP BY genhz), s AS (SELECT genhz, corr(r, p1) AS d, corr(r, p2) AS e, corr(p1, p2) AS f FROM hz WHERE mark % 2 = 1 GROUP BY genhz)
  SELECT genhz, round(greatest(abs(a - d), abs(b - e), abs(c - f)), 7) AS most, round((abs(a - d) + abs(b - e) + abs(c - f)) / 3, 7) AS mean, round(sqrt((pow(a - d, 2) + pow(b - e, 2) + pow(c - f, 2)) / 3), 7) AS rmse, round(1 - (abs(a - d) + abs(b - e) + abs(c - f)) / 3, 7) AS preserved FROM o JOIN s USING (genhz)""",
)
def correlation_gaps(spark, sf_dir):
    side = lambda k: stats.correlations(hz(spark, sf_dir).where(F.col("mark") % 2 == k), ["genhz"], ["r", "p1", "p2"])
    return rounded(checks.correlation_gaps(side(0), side(1), ["genhz"]), digits=7)


@query(
    "depth_stability",
    "SELECT 'r' AS a, 'p1' AS b, count(*) AS bins, round(stddev_samp(c), 7) AS sd, 1 - stddev_samp(c) >= 7e-1 AS stable FROM (SELECT CASE WHEN hzdept_r < 30 THEN 0 WHEN hzdept_r < 60 THEN 1 ELSE 2 END AS k, corr(r, p1) AS c FROM hz GROUP BY k HAVING count(*) >= 5)",
)
def depth_stability(spark, sf_dir):
    return rounded(checks.depth_stability(hz(spark, sf_dir), ["r", "p1"], [30.0, 60.0]), digits=7)


@query(
    "smoothness",
    "SELECT cokey, round(greatest(1 - CASE WHEN max(r) > min(r) THEN avg(d) / (max(r) - min(r)) ELSE 0 END, 0), 8) AS smooth, greatest(1 - CASE WHEN max(r) > min(r) THEN avg(d) / (max(r) - min(r)) ELSE 0 END, 0) >= 9e-1 AS reasonable FROM (SELECT cokey, r, abs(lead(r) OVER w - 2 * r + lag(r) OVER w) AS d FROM hz WINDOW w AS (PARTITION BY cokey ORDER BY hz)) GROUP BY cokey HAVING count(d) > 0",
)
def smoothness(spark, sf_dir):
    return rounded(checks.smoothness(hz(spark, sf_dir), ["cokey"], "hz", "r"), digits=8)


@query(
    "multivariate_outliers",
    f""", g AS (SELECT genhz, avg(r) AS ma, avg(p2) AS mb, var_samp(r) AS saa, var_samp(p2) AS sbb, covar_samp(r, p2) AS sab FROM hz GROUP BY genhz)
  SELECT genhz, count(*) AS n, count(*) FILTER ((pow(r - ma, 2) * sbb - 2 * (r - ma) * (p2 - mb) * sab + pow(p2 - mb, 2) * saa) / (saa * sbb - sab * sab) > {number(4.605170185988091)}) AS far FROM hz JOIN g USING (genhz) GROUP BY genhz""",
)
def multivariate_outliers(spark, sf_dir):
    x = checks.multivariate_outliers(hz(spark, sf_dir).select("genhz", "r", "p2"), ["genhz"], "r", "p2", 0.9)
    return x.groupBy("genhz").agg(F.count("*").alias("n"), F.count_if("far").alias("far"))
