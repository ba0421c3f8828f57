"""Queries of bootstrap limits, distances in several columns, and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import Z95, number
from ..operators import checks, rules, stage_one, stats
from ..sources.tables import horizons as hz
from ..sources.tables import read
from .registry import query

CUTS = stats.poisson_cuts()
WEIGHT = " + ".join(f"CAST(c >= {c} AS INTEGER)" for c in CUTS)


@query(
    "bootstrap_intervals",
    f""", h AS (SELECT mukey, r, lot, md5(concat_ws('|', CAST(cokey AS VARCHAR), CAST(hz AS VARCHAR), CAST(lot AS VARCHAR), '1')) AS m FROM hz, range(0, 125) t(lot)),
  w AS (SELECT mukey, lot, j, r, {WEIGHT} AS w FROM (SELECT mukey, lot, j, r, CAST('0x' || substr(m, CAST(4 * j + 1 AS BIGINT), 4) AS BIGINT) AS c FROM h, range(0, 8) u(j))),
  b AS (SELECT mukey, lot, j, sum(w * r) / sum(w) AS v FROM w GROUP BY ALL HAVING sum(w) > 0)
  SELECT mukey, n, round(estimate, 5) AS estimate, round(low, 4) AS low, round(high, 4) AS high FROM (SELECT mukey, count(*) AS n, avg(r) AS estimate FROM hz GROUP BY mukey) JOIN (SELECT mukey, quantile_cont(v, {number(0.025)}) AS low, quantile_cont(v, {number(0.975)}) AS high FROM b GROUP BY mukey) USING (mukey)""",
)
def bootstrap_intervals(spark, sf_dir):
    x = stats.bootstrap(hz(spark, sf_dir), ["mukey"], "r", ["cokey", "hz"])
    return x.select("mukey", "n", F.round("estimate", 5).alias("estimate"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


CHI3 = number(checks.chi_square(0.975, 3))


@query(
    "robust_distances",
    f""", m AS (SELECT mukey, avg(p1) AS m1, avg(p2) AS m2, avg(p3) AS m3, covar_samp(p1, p1) AS a, covar_samp(p1, p2) AS b, covar_samp(p1, p3) AS c, covar_samp(p2, p2) AS d, covar_samp(p2, p3) AS e, covar_samp(p3, p3) AS f FROM hz WHERE mark % 9 != 0 GROUP BY mukey),
  k AS (SELECT cokey, hz, p1 - m1 AS x, p2 - m2 AS y, p3 - m3 AS z, a, b, c, d, e, f, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS g FROM hz JOIN m USING (mukey) WHERE mark % 9 != 0)
  SELECT hz.cokey, hz.hz, round(q, 6) AS d2, q > {CHI3} AS far FROM hz LEFT JOIN (SELECT cokey, hz, (x * x * (d * f - e * e) + y * y * (a * f - c * c) + z * z * (a * d - b * b) + 2 * x * y * (c * e - b * f) + 2 * x * z * (b * e - c * d) + 2 * y * z * (b * c - a * e)) / g AS q FROM k) s ON hz.cokey = s.cokey AND hz.hz = s.hz""",
)
def robust_distances(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("p2", F.when(F.col("mark") % 9 != 0, F.col("p2")))
    return checks.distances(x, ["mukey"], ["p1", "p2", "p3"]).select("cokey", "hz", F.round("d2", 6).alias("d2"), "far")


RULES = [
    rules.between("p1", 2, 49),
    rules.sums_to(("p1", "p2", "p3"), 30, 10, "warning"),
    rules.ordered("l", "r"),
    rules.conditional("small where returned", ("genhz", "p1"), lambda: F.col("genhz") == "R", lambda: F.col("p1") <= 25),
    rules.custom("top above bottom", ("hzdept_r", "hzdepb_r"), "hzdept_r < hzdepb_r"),
    rules.between("absent", 0, 1),
]
TESTS = [("v IS NOT NULL", "v BETWEEN 2 AND 49"), ("v IS NOT NULL", "abs(v + p2 + p3 - 30) <= 10"), ("true", "l <= r"), ("genhz = 'R'", "v <= 25"), ("true", "hzdept_r < hzdepb_r")]


def ruled(spark, sf_dir):
    return hz(spark, sf_dir).withColumn("p1", F.when(F.col("mark") % 8 != 0, F.col("p1")))


@query(
    "rule_report",
    ", x AS (SELECT *, CASE WHEN mark % 8 != 0 THEN p1 END AS v FROM hz) " + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, '{r.severity}' AS severity, count(*) FILTER ({w}) AS applied, count(*) FILTER ({w} AND NOT coalesce({t}, false)) AS broken, round(count(*) FILTER ({w} AND NOT coalesce({t}, false)) / nullif(count(*) FILTER ({w}), 0), 8) AS share FROM x" for r, (w, t) in zip(RULES, TESTS)) + " UNION ALL SELECT 'absent in range', 'error', NULL, NULL, NULL",
)
def rule_report(spark, sf_dir):
    return rules.report(ruled(spark, sf_dir), RULES).withColumn("share", F.round("share", 8))


@query(
    "rule_reasons",
    ", x AS (SELECT *, CASE WHEN mark % 8 != 0 THEN p1 END AS v FROM hz) SELECT cokey, hz, concat_ws('; ', " + ", ".join(f"CASE WHEN {w} AND NOT coalesce({t}, false) THEN '{r.name}' END" for r, (w, t) in zip(RULES, TESTS)) + ") AS reasons, NOT (" + " OR ".join(f"({w} AND NOT coalesce({t}, false))" for r, (w, t) in zip(RULES, TESTS) if r.severity == "error") + ") AS accepted FROM x",
)
def rule_reasons(spark, sf_dir):
    x = rules.judged(ruled(spark, sf_dir), RULES)
    return x.select("cokey", "hz", F.concat_ws("; ", "reasons.rule").alias("reasons"), "accepted")


COARSE, FINE = stage_one.Grid(0.0, 0.0, 3.0), stage_one.Grid(2.0, 1.0, 1.0)


@query(
    "stage_one",
    f"""WITH p AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y, p_retailprice * 8e-1 AS lo, p_retailprice AS md, p_retailprice * 12e-1 AS hi FROM part), l AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_retailprice * 9e-1 + p_size AS b05, p_retailprice + p_size AS b50, p_retailprice * 11e-1 + p_size AS b95 FROM part WHERE p_partkey % 7 != 0),
  t AS (SELECT x, y, b05, b50, b95, (2 + (x + 5e-1)) / 3 - 5e-1 AS px, (1 + (y + 5e-1)) / 3 - 5e-1 AS py FROM l),
  a AS (SELECT t.x, t.y, sum(lo * w) / sum(w) AS a05, sum(md * w) / sum(w) AS a50, sum(hi * w) / sum(w) AS a95 FROM (SELECT t.x, t.y, lo, md, hi, (1 - abs(px - p.x)) * (1 - abs(py - p.y)) AS w FROM t JOIN p ON p.x BETWEEN px - 1 AND px + 1 AND p.y BETWEEN py - 1 AND py + 1) t WHERE w > 1e-12 GROUP BY ALL),
  m AS (SELECT t.x, t.y, a50, (a95 - a05) / (2 * {number(Z95)}) AS sa, b50, (b95 - b05) / (2 * {number(Z95)}) AS sb FROM t LEFT JOIN a ON t.x = a.x AND t.y = a.y)
  SELECT x, y, CASE WHEN a50 IS NULL THEN 'likelihood' ELSE 'normal' END AS route, round(CASE WHEN a50 IS NULL THEN b50 ELSE (a50 / (sa * sa) + b50 / (sb * sb)) / (1 / (sa * sa) + 1 / (sb * sb)) END, 4) AS mu, round(CASE WHEN a50 IS NULL THEN sb ELSE sqrt(1 / (1 / (sa * sa) + 1 / (sb * sb))) END, 5) AS sigma FROM m""",
)
def stage_one_query(spark, sf_dir):
    part, price, size = read(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_size")
    prior = part.select((F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), (price * 0.8).alias("a05"), price.alias("a50"), (price * 1.2).alias("a95"))
    seen = part.where("p_partkey % 7 != 0").select((F.col("p_partkey") % 50).alias("x"), F.floor(F.col("p_partkey") / 50).alias("y"), (price * 0.9 + size).alias("b05"), (price + size).alias("b50"), (price * 1.1 + size).alias("b95"))
    x = stage_one.fused(prior, COARSE, seen, FINE, {0.05: "a05", 0.5: "a50", 0.95: "a95"}, {0.05: "b05", 0.5: "b50", 0.95: "b95"})
    return x.select("x", "y", "route", F.round("posterior.mu", 4).alias("mu"), F.round("posterior.sigma", 5).alias("sigma"))
