"""Queries over the driver's tables, and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import special
from ..functions.normal import Z95, number, pnorm_sql, qnorm_sql, uniform, uniform_sql
from ..operators import cells, gp, horizons, matching, monte_carlo, simulate, stats
from ..sources.tables import HORIZONS, read
from ..sources.tables import horizons as hz
from ..streaming import quality

QUERIES: dict = {}
ORACLE_SQL: dict = {}
Z = number(Z95)


def query(name: str, sql: str | None = None):
    """Registers a query; sql may use the view hz."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {HORIZONS} {sql}" if " hz" in sql or "(hz" in sql else sql
        return f

    return add


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["cells_fused"](spark, sf_dir)


@query(
    "quantiles_mukey",
    "SELECT mukey, genhz, round(quantile_cont(r, 0.05), 6) AS p05, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, round(quantile_cont(r, 0.95) - quantile_cont(r, 0.05), 6) AS piw90 FROM hz GROUP BY ALL",
)
def quantiles_mukey(spark, sf_dir):
    return rounded(cells.percentiles(hz(spark, sf_dir), ["mukey", "genhz"], "r"))


@query("normal_fit", f"SELECT cokey, hz, round(r, 6) AS mean, round((h - l) / (2 * {Z}), 6) AS sd, round(r + (h - l) / (2 * {Z}) * {number(1.2815515655446004)}, 6) AS p90 FROM hz")
def normal_fit(spark, sf_dir):
    fit = hz(spark, sf_dir).withColumn("f", S.fit_normal(F.col("l"), F.col("r"), F.col("h")))
    return rounded(fit.select("cokey", "hz", "f.mean", "f.sd", (F.col("f.mean") + F.col("f.sd") * 1.2815515655446004).alias("p90")))


@query(
    "conjugate_normal",
    "SELECT cokey, hz, round((l / (s1 * s1) + h / (s2 * s2)) / (1 / (s1 * s1) + 1 / (s2 * s2)), 6) AS mu, round(sqrt(1 / (1 / (s1 * s1) + 1 / (s2 * s2))), 6) AS sigma FROM (SELECT *, p1 AS s1, p2 + p3 AS s2 FROM hz)",
)
def conjugate_normal(spark, sf_dir):
    post = S.update_normal(F.col("l"), F.col("p1"), F.col("h"), F.col("p2") + F.col("p3"))
    return rounded(hz(spark, sf_dir).select("cokey", "hz", post.alias("x")).select("cokey", "hz", "x.*"))


@query(
    "lognormal_moments",
    "SELECT cokey, hz, round(ln(r) - ln(1 + pow(p1 / r, 2)) / 2, 8) AS mu_log, round(sqrt(ln(1 + pow(p1 / r, 2))), 8) AS sigma_log, round(r, 4) AS mu_back, round(p1, 4) AS sigma_back FROM hz",
)
def lognormal_moments(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "hz", S.normal_to_log(F.col("r"), F.col("p1")).alias("g"))
    x = x.withColumn("b", S.log_to_normal(F.col("g.mu"), F.col("g.sigma")))
    return x.select("cokey", "hz", F.round("g.mu", 8).alias("mu_log"), F.round("g.sigma", 8).alias("sigma_log"), F.round("b.mu", 4).alias("mu_back"), F.round("b.sigma", 4).alias("sigma_back"))


@query(
    "conjugate_beta",
    "SELECT cokey, hz, round(a + p2 - 1, 6) AS alpha, round(b + p3 - 1, 6) AS beta, a + p2 > 1 AND b + p3 > 1 AS feasible, round((a + p2 - 1) / (a + p2 + b + p3 - 2), 8) AS mean FROM (SELECT *, m * (m * (1 - m) / v - 1) AS a, (1 - m) * (m * (1 - m) / v - 1) AS b FROM (SELECT *, p1 / 100 AS m, p2 / 1000 AS v FROM hz))",
)
def conjugate_beta(spark, sf_dir):
    start = S.moments_to_beta(F.col("p1") / 100, F.col("p2") / 1000)
    x = hz(spark, sf_dir).select("cokey", "hz", "p2", "p3", start.alias("s"))
    x = x.select("cokey", "hz", S.fuse_beta(F.col("s.alpha"), F.col("s.beta"), F.col("p2"), F.col("p3")).alias("f")).withColumn("m", S.beta_to_moments(F.col("f.alpha"), F.col("f.beta"))["mean"])
    return x.select("cokey", "hz", F.round("f.alpha", 6).alias("alpha"), F.round("f.beta", 6).alias("beta"), "f.feasible", F.round("m", 8).alias("mean"))


@query(
    "conjugate_gamma",
    "SELECT cokey, hz, round(ln(r * r / p1 + p2 - 1), 8) AS log_shape, round(r / p1 + p3, 8) AS rate, r * r / p1 + p2 > 1 AS feasible, round((r * r / p1 + p2 - 1) / (r / p1 + p3), 6) AS mean FROM hz",
)
def conjugate_gamma(spark, sf_dir):
    start = S.moments_to_gamma(F.col("r"), F.col("p1"))
    x = hz(spark, sf_dir).select("cokey", "hz", S.fuse_gamma(start["shape"], start["rate"], F.col("p2"), F.col("p3")).alias("f")).withColumn("m", S.gamma_to_moments(F.col("f.shape"), F.col("f.rate")))
    return x.select("cokey", "hz", F.round(F.log("f.shape"), 8).alias("log_shape"), F.round("f.rate", 8).alias("rate"), "f.feasible", F.round("m.mean", 6).alias("mean"))


@query(
    "bivariate_fusion",
    """SELECT cokey, hz, round(xx * h1 + xy * h2, 6) AS x, round(xy * h1 + yy * h2, 6) AS y, round(xx, 8) AS xx, round(xy, 8) AS xy, round(yy, 8) AS yy FROM (
  SELECT *, c / (a * c - b * b) AS xx, -b / (a * c - b * b) AS xy, a / (a * c - b * b) AS yy FROM (
    SELECT *, p3 / d1 + 2 / d2 AS a, -1e-1 / d1 - 5e-1 / d2 AS b, p2 / d1 + 3 / d2 AS c, (p3 * p1 - 1e-1 * p2) / d1 + (2 * p2 - 5e-1 * p3) / d2 AS h1, (-1e-1 * p1 + p2 * p2) / d1 + (-5e-1 * p2 + 3 * p3) / d2 AS h2
    FROM (SELECT *, p2 * p3 - 1e-2 AS d1, 575e-2 AS d2 FROM hz)))""",
)
def bivariate_fusion(spark, sf_dir):
    c, k = F.col, lambda v: F.lit(float(v))
    post = S.fuse_bivariate((c("p1"), c("p2")), (c("p2"), k(0.1), c("p3")), (c("p2"), c("p3")), (k(3), k(0.5), k(2)))
    x = hz(spark, sf_dir).select("cokey", "hz", post.alias("f")).select("cokey", "hz", "f.*")
    return x.select("cokey", "hz", *[F.round(n, d).alias(n) for n, d in (("x", 6), ("y", 6), ("xx", 8), ("xy", 8), ("yy", 8))])


U = uniform_sql("cokey", "hz", "'tri'")
TRIANGLE = "CASE WHEN h - l <= 0 THEN r WHEN u < (r - l) / (h - l) THEN l + sqrt(u * (h - l) * (r - l)) ELSE h - sqrt((1 - u) * (h - l) * (h - r)) END"


@query("triangular_draws", f"SELECT cokey, hz, round(u, 9) AS u, round({TRIANGLE}, 6) AS draw FROM (SELECT *, {U} AS u FROM hz)")
def triangular_draws(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("u", uniform(F.col("cokey"), F.col("hz"), "tri"))
    return x.select("cokey", "hz", F.round("u", 9).alias("u"), F.round(S.triangular_draw(F.col("l"), F.col("r"), F.col("h"), F.col("u")), 6).alias("draw"))


@query("normal_draws", f"SELECT cokey, hz, round({qnorm_sql('u')}, 6) AS z, round({pnorm_sql(qnorm_sql('u'))}, 6) AS back FROM (SELECT *, {uniform_sql('cokey', 'hz', chr(39) + 'n' + chr(39))} AS u FROM hz)")
def normal_draws(spark, sf_dir):
    x = simulate.qnorm(uniform(F.col("cokey"), F.col("hz"), "n"), hz(spark, sf_dir), "q")
    return x.select("cokey", "hz", F.round("q", 6).alias("z"), F.round(F.expr(pnorm_sql("q")), 6).alias("back"))


@query(
    "linear_cdf",
    f"SELECT cokey, hz, round(CASE WHEN u <= 5e-2 THEN l WHEN u <= 5e-1 THEN l + (r - l) * (u - 5e-2) / 45e-2 WHEN u <= 95e-2 THEN r + (h - r) * (u - 5e-1) / 45e-2 ELSE h END, 6) AS draw FROM (SELECT *, {U} AS u FROM hz)",
)
def linear_cdf(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("u", uniform(F.col("cokey"), F.col("hz"), "tri"))
    return x.select("cokey", "hz", F.round(S.quantile_linear([(0.05, F.col("l")), (0.5, F.col("r")), (0.95, F.col("h"))], F.col("u")), 6).alias("draw"))


@query(
    "metalog",
    f"""SELECT cokey, hz, round(r + a2 * lg + a3 * (u - 5e-1) * lg, 6) AS draw, feasible FROM (
  SELECT *, ln(u / (1 - u)) AS lg, (SELECT bool_and(q1 - q0 >= 0) FROM (SELECT a2 * ln(k / (50e0 - k)) + a3 * (k / 50e0 - 5e-1) * ln(k / (50e0 - k)) AS q0, a2 * ln((k + 1) / (49e0 - k)) + a3 * ((k + 1) / 50e0 - 5e-1) * ln((k + 1) / (49e0 - k)) AS q1 FROM range(1, 49) t(k))) AS feasible
  FROM (SELECT *, {U} AS u, (h - l) / (2 * ln(19e0)) AS a2, (h + l - 2 * r) / (9e-1 * ln(19e0)) AS a3 FROM hz))""",
)
def metalog(spark, sf_dir):
    a = S.metalog_fit(F.col("l"), F.col("r"), F.col("h"))
    x = hz(spark, sf_dir).withColumn("u", uniform(F.col("cokey"), F.col("hz"), "tri"))
    shift = (F.lit(0.0), a[1], a[2])
    return x.select("cokey", "hz", F.round(S.metalog_quantile(a, F.col("u")), 6).alias("draw"), S.metalog_feasible(shift).alias("feasible"))


@query(
    "triplet_fit",
    f"""SELECT cokey, hz, CASE WHEN l IS NULL THEN 'none' WHEN abs(h - l) < 15e-9 * abs(l) THEN 'triangular' WHEN f THEN 'normal' ELSE 'lognormal' END AS family,
  round(CASE WHEN l IS NULL THEN NULL WHEN abs(h - l) < 15e-9 * abs(l) OR f THEN r ELSE ln(r) END, 6) AS p1,
  round(CASE WHEN l IS NULL THEN NULL WHEN abs(h - l) < 15e-9 * abs(l) THEN r WHEN f THEN (h - l) / (2 * {Z}) ELSE (ln(h) - ln(l)) / (2 * {Z}) END, 6) AS p2, l IS NOT NULL AS valid
  FROM (SELECT cokey, hz, r, h, CASE WHEN mark % 7 = 0 THEN NULL ELSE l END AS l, abs((h + l - 2 * r) / nullif(h - l, 0)) < 15e-2 AS f FROM hz)""",
)
def triplet_fit(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("l", F.when(F.col("mark") % 7 != 0, F.col("l")))
    x = x.select("cokey", "hz", S.fit_triplet(F.col("l"), F.col("r"), F.col("h")).alias("f"))
    return x.select("cokey", "hz", "f.family", F.round("f.p1", 6).alias("p1"), F.round("f.p2", 6).alias("p2"), "f.valid")


@query(
    "ilr_round_trip",
    "SELECT cokey, hz, round(sqrt(2e0 / 3) * ln(p1 / sqrt(p2 * p3)), 8) AS z1, round(sqrt(5e-1) * ln(p2 / p3), 8) AS z2, round(100 * p1 / (p1 + p2 + p3), 6) AS a, round(100 * p2 / (p1 + p2 + p3), 6) AS b, round(100 * p3 / (p1 + p2 + p3), 6) AS c FROM hz",
)
def ilr_round_trip(spark, sf_dir):
    z1, z2 = S.ilr(F.col("p1"), F.col("p2"), F.col("p3"))
    x = hz(spark, sf_dir).select("cokey", "hz", z1.alias("z1"), z2.alias("z2"))
    a, b, c = S.ilr_inverse(F.col("z1"), F.col("z2"))
    return x.select("cokey", "hz", F.round("z1", 8).alias("z1"), F.round("z2", 8).alias("z2"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(c, 6).alias("c"))


@query(
    "texture_classes",
    """SELECT cokey, hz, CASE WHEN i + 15e-1 * c < 15 THEN 'sand' WHEN i + 2 * c < 30 THEN 'loamy sand' WHEN (c >= 7 AND c < 20 AND s > 52) OR (c < 7 AND i < 50) THEN 'sandy loam'
  WHEN c >= 7 AND c < 27 AND i >= 28 AND i < 50 AND s <= 52 THEN 'loam' WHEN (i >= 50 AND c >= 12 AND c < 27) OR (i >= 50 AND i < 80 AND c < 12) THEN 'silt loam' WHEN i >= 80 AND c < 12 THEN 'silt'
  WHEN c >= 20 AND c < 35 AND i < 28 AND s > 45 THEN 'sandy clay loam' WHEN c >= 27 AND c < 40 AND s > 20 AND s <= 45 THEN 'clay loam' WHEN c >= 27 AND c < 40 AND s <= 20 THEN 'silty clay loam'
  WHEN c >= 35 AND s > 45 THEN 'sandy clay' WHEN c >= 40 AND i >= 40 THEN 'silty clay' ELSE 'clay' END AS class
  FROM (SELECT cokey, hz, 100 * p1 / (p1 + p2 + p3) AS s, 100 * p2 / (p1 + p2 + p3) AS i, 100 * p3 / (p1 + p2 + p3) AS c FROM hz)""",
)
def texture_classes(spark, sf_dir):
    whole = F.col("p1") + F.col("p2") + F.col("p3")
    return hz(spark, sf_dir).select("cokey", "hz", S.texture_class(100 * F.col("p1") / whole, 100 * F.col("p2") / whole, 100 * F.col("p3") / whole).alias("class"))


@query(
    "modal_classes",
    "SELECT mukey, genhz, share FROM (SELECT mukey, genhz, round(n / sum(n) OVER (PARTITION BY mukey), 8) AS share, rank() OVER (PARTITION BY mukey ORDER BY n DESC) AS k FROM (SELECT mukey, genhz, count(*) AS n FROM hz GROUP BY ALL)) WHERE k = 1",
)
def modal_classes(spark, sf_dir):
    return rounded(horizons.modal_class(hz(spark, sf_dir), ["mukey"], "genhz"), digits=8)


@query(
    "water_retention",
    "SELECT cokey, hz, round(4e-2 + 4e-1 / pow(1 + pow(abs(a * 33650628e-5), n), 1 - 1 / n), 8) AS field, round(4e-2 + 4e-1 / pow(1 + pow(abs(a * 1529574e-2), n), 1 - 1 / n), 8) AS wilt FROM (SELECT cokey, hz, p2 / 1000 AS a, 1 + p3 / 10 AS n FROM hz)",
)
def water_retention(spark, sf_dir):
    held = lambda h: S.water_content(h, F.col("p2") / 1000, 1 + F.col("p3") / 10, F.lit(0.04), F.lit(0.44))
    return hz(spark, sf_dir).select("cokey", "hz", F.round(held(336.50628), 8).alias("field"), F.round(held(15295.74), 8).alias("wilt"))


MESSY = ["'12.5-20'", "'<' || x", "'>' || x", "'TRACE'", "x || '%'", "' ' || x || ' '", "'n/a'"]


@query(
    "messy_amounts",
    """SELECT p_partkey, round(CASE k WHEN 0 THEN 1625e-2 WHEN 1 THEN x * 5e-1 WHEN 2 THEN x * 15e-1 WHEN 3 THEN 1e-1 WHEN 4 THEN x WHEN 5 THEN x END, 6) AS value,
  CASE k WHEN 0 THEN 'range' WHEN 1 THEN 'upper_bound' WHEN 2 THEN 'lower_bound' WHEN 3 THEN 'qualitative' WHEN 4 THEN 'percentage' WHEN 5 THEN 'numeric' ELSE 'unparseable' END AS type,
  CASE k WHEN 0 THEN 8e-1 WHEN 1 THEN 6e-1 WHEN 2 THEN 6e-1 WHEN 3 THEN 4e-1 WHEN 4 THEN 9e-1 WHEN 5 THEN 9e-1 ELSE 0e0 END AS confidence
  FROM (SELECT p_partkey, p_partkey % 7 AS k, CAST(p_size AS DOUBLE) AS x FROM part)""",
)
def messy_amounts(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("x", F.col("p_size").cast("string"))
    text = F.expr("CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(MESSY)) + " END")
    x = part.select("p_partkey", S.parse_amount(text).alias("a"))
    return x.select("p_partkey", F.round("a.value", 6).alias("value"), "a.type", "a.confidence")


NAMES = "(VALUES (0, 'Ap'), (1, '2Bt1'), (2, 'Cr'), (3, ' bw '), (4, 'R'), (5, 'Oi'), (6, 'Bkm'), (7, ''), (8, 'BC'), (9, 'E'), (10, 'fragipan'), (11, 'X'))"
LABELS = "(VALUES (0, 'A', false, false), (1, 'B', false, false), (2, 'Cr', true, true), (3, 'B', false, false), (4, 'R', true, true), (5, 'O', true, true), (6, 'B', true, true), (7, NULL, false, false), (8, 'B', false, true), (9, 'E', false, false), (10, NULL, true, true), (11, NULL, false, false))"


@query(
    "horizon_names",
    f"SELECT p_partkey, name, genhz_name, bad, bad OR strict AS bad_strict FROM part JOIN {NAMES} n(k, name) ON p_partkey % 12 = n.k JOIN {LABELS} g(k, genhz_name, bad, strict) ON g.k = n.k",
)
def horizon_names(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Ap", "2Bt1", "Cr", " bw ", "R", "Oi", "Bkm", "", "BC", "E", "fragipan", "X")])
    x = read(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 12).cast("int")).alias("name"))
    return x.select("p_partkey", "name", S.general_horizon(F.col("name")).alias("genhz_name"), S.unsuitable(F.col("name")).alias("bad"), S.unsuitable(F.col("name"), strict=True).alias("bad_strict"))


@query(
    "organic_removed",
    "SELECT cokey, hz, round(sum(p1) OVER w - p1, 6) AS hzdept_r, round(sum(p1) OVER w, 6) AS hzdepb_r FROM (SELECT * FROM hz WHERE genhz != 'R') WINDOW w AS (PARTITION BY cokey ORDER BY hz ROWS UNBOUNDED PRECEDING)",
)
def organic_removed(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("hzname", F.when(F.col("genhz") == "R", "O1").otherwise(F.col("hzname")))
    return rounded(horizons.without_organic(x).select("cokey", "hz", "hzdept_r", "hzdepb_r"))


@query(
    "depth_slices",
    """SELECT cokey, top, bottom, round(avg(r), 6) AS mean, coalesce(max(d) + 1, bottom) AS reached
  FROM (SELECT cokey, top, bottom, s.r, s.d FROM (SELECT DISTINCT cokey FROM hz), (VALUES (0, 30), (30, 100)) w(top, bottom)
  LEFT JOIN (SELECT cokey AS ck, round(r * 100) AS r, unnest(range(CAST(hzdept_r AS BIGINT), CAST(hzdepb_r AS BIGINT))) AS d FROM hz) s ON ck = cokey AND d >= top AND d < bottom) GROUP BY cokey, top, bottom""",
)
def depth_slices(spark, sf_dir):
    # Whole cents: their sums are exact in both engines.
    x = horizons.slices(hz(spark, sf_dir).withColumn("r", F.round(F.col("r") * 100)), [(0, 30), (30, 100)], "r")
    return x.select("cokey", "top", "bottom", F.round("mean", 6).alias("mean"), F.col("reached").cast("long").alias("reached"))


@query(
    "window_means",
    "SELECT mukey, cokey, round(sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS mean, sum(w) AS covered FROM (SELECT mukey, cokey, CASE WHEN mark % 7 = 0 THEN NULL ELSE r END AS v, least(hzdepb_r, 100) - greatest(hzdept_r, 5) AS w FROM hz) WHERE w > 0 GROUP BY ALL",
)
def window_means(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("v", F.when(F.col("mark") % 7 != 0, F.col("r")))
    return rounded(horizons.overlap_mean(x, 5.0, 100.0, "v", ["mukey", "cokey"]))


@query("fragment_sums", "SELECT l_orderkey, round(sum(v), 4) AS l_extendedprice FROM (SELECT l_orderkey, l_quantity, min(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL")
def fragment_sums(spark, sf_dir):
    return rounded(horizons.summed_fragments(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice"), digits=4)


@query(
    "component_recovery",
    """, c AS (SELECT o_orderkey AS cokey, o_custkey AS name FROM orders), own AS (SELECT c.cokey, name, genhz, hzname, hzdept_r, hzdepb_r, round(r * 100) AS r FROM c JOIN hz ON c.cokey = hz.cokey WHERE c.cokey % 5 != 0),
  p AS (SELECT name, genhz, avg(hzdept_r) AS a, avg(hzdepb_r) AS b, avg(r) AS r FROM own GROUP BY ALL), u AS (SELECT name, count(DISTINCT cokey) AS s FROM own GROUP BY ALL),
  m AS (SELECT name, genhz, hzname FROM (SELECT *, row_number() OVER (PARTITION BY name, genhz ORDER BY n DESC, hzname) AS k FROM (SELECT name, genhz, hzname, count(*) AS n FROM own GROUP BY ALL)) WHERE k = 1)
  SELECT cokey, name, genhz, hzname, round(hzdept_r, 6) AS hzdept_r, round(hzdepb_r, 6) AS hzdepb_r, round(r, 6) AS r, false AS recovered, NULL::BIGINT AS siblings FROM own UNION ALL
  SELECT c.cokey, c.name, p.genhz, m.hzname, round(p.a, 6), round(p.b, 6), round(p.r, 6), true, u.s FROM c JOIN p USING (name) JOIN u USING (name) JOIN m ON m.name = p.name AND m.genhz = p.genhz WHERE c.cokey NOT IN (SELECT cokey FROM own)""",
)
def component_recovery(spark, sf_dir):
    components = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cokey"), F.col("o_custkey").alias("name"))
    known = hz(spark, sf_dir).withColumn("r", F.round(F.col("r") * 100)).where("cokey % 5 != 0").join(components.select("cokey"), "cokey", "left_semi")
    x, _ = horizons.recovered(components, known, "name", ["hzdept_r", "hzdepb_r", "r"], ["hzname"])
    return x.select("cokey", "name", "genhz", "hzname", F.round("hzdept_r", 6).alias("hzdept_r"), F.round("hzdepb_r", 6).alias("hzdepb_r"), F.round("r", 6).alias("r"), "recovered", "siblings")


@query(
    "restrictions",
    """SELECT cokey, hz, miss AS missing_required, below AS below_restriction, p3 > 4 AS is_cemented, nm IN ('Cr1', 'Bkm') AS named_restriction, nm = 'Oi' AS organic_horizon, (p2 > 3 AND miss AND below) OR p3 > 4 OR nm IN ('Cr1', 'Bkm') AS restrictive
  FROM (SELECT *, mark % 7 = 0 AS miss, hzdept_r >= p1 AS below, CASE mark % 4 WHEN 0 THEN 'Cr1' WHEN 1 THEN 'Bkm' WHEN 2 THEN 'Oi' ELSE 'Ap' END AS nm FROM hz)""",
)
def restrictions(spark, sf_dir):
    x = hz(spark, sf_dir).withColumns({
        "need": F.when(F.col("mark") % 7 != 0, F.col("r")), "resdept_l": F.when(F.col("hz") % 2 == 0, F.col("p1")), "resdept_r": F.col("p1"),
        "reskind": F.when(F.col("p2") > 3, "Lithic bedrock"), "texcl": F.when(F.col("p3") > 4, "Cemented"), "lieutex": F.lit(None).cast("string"), "desgnmaster": F.lit(None).cast("string"),
        "hzname": F.get(F.array(*map(F.lit, ("Cr1", "Bkm", "Oi", "Ap"))), (F.col("mark") % 4).cast("int")),
    })
    return horizons.restriction_flags(x, ["need"]).select("cokey", "hz", "missing_required", "below_restriction", "is_cemented", "named_restriction", "organic_horizon", "restrictive")


@query(
    "infill_ladder",
    """, v AS (SELECT *, CASE WHEN mark % 3 = 0 THEN NULL ELSE r END AS v, (hzdept_r + hzdepb_r) / 2 AS mid FROM hz),
  w AS (SELECT *, avg(v) OVER (PARTITION BY cokey, genhz) AS same, avg(v) OVER (PARTITION BY cokey ORDER BY mid RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS band,
    last_value(CASE WHEN v IS NOT NULL THEN mid END IGNORE NULLS) OVER b AS px, last_value(v IGNORE NULLS) OVER b AS py, first_value(CASE WHEN v IS NOT NULL THEN mid END IGNORE NULLS) OVER f AS qx, first_value(v IGNORE NULLS) OVER f AS qy
    FROM v WINDOW b AS (PARTITION BY cokey ORDER BY mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY cokey ORDER BY mid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  x AS (SELECT w.*, CASE WHEN px IS NULL THEN qy WHEN qx IS NULL THEN py ELSE py + (qy - py) * (mid - px) / (qx - px) END AS line, u.m AS unit, g.m AS alls FROM w
    LEFT JOIN (SELECT mukey, genhz, median(v) AS m FROM v GROUP BY ALL) u USING (mukey, genhz) LEFT JOIN (SELECT genhz, median(v) AS m FROM v GROUP BY ALL) g USING (genhz))
  SELECT cokey, hz, round(coalesce(v, same, band, line, unit, alls), 8) AS filled, CASE WHEN v IS NOT NULL THEN 'own' WHEN same IS NOT NULL THEN 'same' WHEN band IS NOT NULL THEN 'band' WHEN line IS NOT NULL THEN 'line' WHEN unit IS NOT NULL THEN 'group' WHEN alls IS NOT NULL THEN 'all' END AS rung FROM x""".replace("FROM hz)", "FROM hz )"),
)
def infill_ladder(spark, sf_dir):
    x = hz(spark, sf_dir).withColumns({"v": F.when(F.col("mark") % 3 != 0, F.col("r")), "mid": (F.col("hzdept_r") + F.col("hzdepb_r")) / 2})
    return horizons.ladder_infill(x, "v").select("cokey", "hz", F.round("filled", 8).alias("filled"), "rung")


TRI = "CASE WHEN hi - lo <= 0 THEN md WHEN u < (md - lo) / (hi - lo) THEN lo + sqrt(u * (hi - lo) * (md - lo)) ELSE hi - sqrt((1 - u) * (hi - lo) * (hi - md)) END"


@query(
    "component_shares",
    f"""SELECT mukey, cokey, sim, round(v * 100 / sum(v) OVER (PARTITION BY mukey, sim), 6) AS share FROM (SELECT mukey, cokey, sim, {TRI} AS v FROM (SELECT *, {uniform_sql('mukey', 'cokey', 'sim', '1')} AS u
  FROM (SELECT o_custkey AS mukey, o_orderkey AS cokey, o_totalprice * 8e-1 AS lo, o_totalprice AS md, o_totalprice * 11e-1 AS hi FROM orders), range(1, 5) s(sim)))""",
)
def component_shares(spark, sf_dir):
    c = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mukey"), F.col("o_orderkey").alias("cokey"), (F.col("o_totalprice") * 0.8).alias("pct_l"), F.col("o_totalprice").alias("pct_r"), (F.col("o_totalprice") * 1.1).alias("pct_h"))
    return simulate.component_shares(c, 4).select("mukey", "cokey", F.col("sim").cast("long").alias("sim"), F.round("share", 6).alias("share"))


MATRIX = [[1.0, 0.6], [0.6, 1.0]]
LOW2 = simulate.cholesky(MATRIX)


@query(
    "copula_draws",
    f"""SELECT cokey, hz, sim, round(l + (h - l) * {pnorm_sql('y1')}, 4) AS a, round(p2 + p3 * {pnorm_sql('y2')}, 4) AS b FROM (SELECT *, z1 AS y1, {number(LOW2[1, 0])} * z1 + {number(LOW2[1, 1])} * z2 AS y2
  FROM (SELECT *, {qnorm_sql('e1')} AS z1, {qnorm_sql('e2')} AS z2 FROM (SELECT *, {uniform_sql('cokey', 'hz', 'sim', "'a'", '1')} AS e1, {uniform_sql('cokey', 'hz', 'sim', "'b'", '1')} AS e2 FROM hz, range(1, 4) s(sim))))""",
)
def copula_draws(spark, sf_dir):
    x = simulate.correlated_uniforms(simulate.realizations(hz(spark, sf_dir), 3), ["cokey", "hz", "sim"], ["a", "b"], MATRIX)
    return x.select("cokey", "hz", F.col("sim").cast("long").alias("sim"), F.round(F.col("l") + (F.col("h") - F.col("l")) * F.col("u_a"), 4).alias("a"), F.round(F.col("p2") + F.col("p3") * F.col("u_b"), 4).alias("b"))


@query(
    "ilr_moments",
    f"""SELECT mukey, round(avg(z1), 6) AS m1, round(avg(z2), 6) AS m2, round(var_samp(z1), 6) AS s11, round(covar_samp(z1, z2), 6) AS s12, round(var_samp(z2), 6) AS s22 FROM (
  SELECT mukey, sqrt(2e0 / 3) * ln(a / sqrt(b * c)) AS z1, sqrt(5e-1) * ln(b / c) AS z2 FROM (SELECT mukey, {", ".join(f"greatest({m} + {m} * 2e-1 / (2 * {Z}) * {qnorm_sql('u' + m)}, 1e-2) AS {n}" for m, n in (("p1", "a"), ("p2", "b"), ("p3", "c")))}
  FROM (SELECT *, {", ".join(f"{uniform_sql('mukey', 'sim', f"'{m}'", '1')} AS u{m}" for m in ("p1", "p2", "p3"))} FROM (SELECT mukey, avg(p1) AS p1, avg(p2) AS p2, avg(p3) AS p3 FROM hz GROUP BY mukey), range(1, 101) s(sim)))) GROUP BY mukey""",
)
def ilr_moments(spark, sf_dir):
    x = hz(spark, sf_dir).groupBy("mukey").agg(*[F.avg(p).alias(f"{p}_m") for p in ("p1", "p2", "p3")])
    x = x.withColumns({f"{p}_{e}": F.col(f"{p}_m") * k for p in ("p1", "p2", "p3") for e, k in (("l", 0.9), ("h", 1.1))})
    return rounded(simulate.ilr_moments(x, ["mukey"], {p: (f"{p}_l", f"{p}_m", f"{p}_h") for p in ("p1", "p2", "p3")}, 100, Z95))


@query(
    "constraints",
    """, c AS (SELECT cokey, hz, CASE WHEN r != greatest(least(r, 50000), 2000) THEN 1 ELSE 0 END + CASE WHEN p1 != least(p1, 45) THEN 1 ELSE 0 END AS changed, greatest(least(r, 50000), 2000) AS r, least(p1, 45) AS p1, p2, p3 FROM hz)
  SELECT cokey, hz, changed, round(r, 4) AS r, round(a, 6) AS p1, round(least(b, c), 6) AS p2, round(c, 6) AS p3 FROM (SELECT *, 100 * p1 / (p1 + p2 + p3) AS a, 100 * p2 / (p1 + p2 + p3) AS b, 100 * p3 / (p1 + p2 + p3) AS c FROM c)""",
)
def constraints(spark, sf_dir):
    x = simulate.constrained(hz(spark, sf_dir), {"r": (2000.0, 50000.0), "p1": (0.0, 45.0)}, ["p1", "p2", "p3"], 100.0, [("p2", "p3")])
    return x.select("cokey", "hz", "changed", F.round("r", 4).alias("r"), *[F.round(p, 6).alias(p) for p in ("p1", "p2", "p3")])


@query(
    "available_water",
    f"""SELECT layer, sim, round(f - w, 8) AS awhc FROM (SELECT layer, sim, tr + (ts - tr) / pow(1 + pow(abs(a * 33650628e-5), n), 1 - 1 / n) AS f, tr + (ts - tr) / pow(1 + pow(abs(a * 1529574e-2), n), 1 - 1 / n) AS w FROM (
  SELECT layer, sim, pow(10, -16e-1 + 1e-1 * {qnorm_sql('u1')}) AS a, pow(10, 13e-2 + 2e-2 * {qnorm_sql('u2')}) AS n, 6e-2 + 1e-2 * {qnorm_sql('u3')} AS tr, 4e-1 + 1e-2 * {qnorm_sql('u4')} AS ts
  FROM (SELECT s_suppkey AS layer, sim, {", ".join(f"{uniform_sql('s_suppkey', 'sim', f"'{p}'", '123')} AS u{k}" for k, p in enumerate(('alpha', 'npar', 'theta_r', 'theta_s'), 1))} FROM supplier, range(1, 21) t(sim) WHERE s_suppkey % 7 != 0)))""",
)
def available_water(spark, sf_dir):
    x = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("layer"), F.when(F.col("s_suppkey") % 7 != 0, -1.6).alias("alpha"), *[F.lit(v).alias(n) for n, v in (("npar", 0.13), ("theta_r", 0.06), ("theta_s", 0.4), ("alpha_sd", 0.1), ("npar_sd", 0.02), ("theta_r_sd", 0.01), ("theta_s_sd", 0.01))])
    return simulate.available_water(x, 20).select("layer", F.col("sim").cast("long").alias("sim"), F.round("awhc", 8).alias("awhc"))


@query(
    "summaries",
    """, m AS (SELECT mukey, median(r) AS md, avg(r) AS mu FROM hz GROUP BY ALL), j AS (SELECT hz.mukey, r, md, mu FROM hz JOIN m ON hz.mukey = m.mukey)
  SELECT mukey, count(r) AS n, round(avg(r), 4) AS mean, round(stddev_samp(r), 4) AS sd, round(min(r), 4) AS min, round(max(r), 4) AS max, round(quantile_cont(r, 25e-2), 6) AS q1, round(median(r), 6) AS median, round(quantile_cont(r, 75e-2), 6) AS q3,
  round(14826e-4 * median(abs(r - md)), 4) AS mad, round(stddev_samp(r) / sqrt(count(r)), 4) AS se, round(100 * stddev_samp(r) / avg(r), 4) AS cv,
  round(avg(pow(r - mu, 3)) / pow(avg(pow(r - mu, 2)), 15e-1) * pow((count(r) - 1e0) / count(r), 15e-1), 5) AS skewness, round(avg(pow(r - mu, 4)) / pow(avg(pow(r - mu, 2)), 2) * pow((count(r) - 1e0) / count(r), 2) - 3, 5) AS kurtosis FROM j GROUP BY mukey""",
)
def summaries(spark, sf_dir):
    x = stats.summary(hz(spark, sf_dir), ["mukey"], "r")
    digits = {"q1": 6, "median": 6, "q3": 6, "skewness": 5, "kurtosis": 5}
    return x.select("mukey", "n", *[F.round(c, digits.get(c, 4)).alias(c) for c in ("mean", "sd", "min", "max", "q1", "median", "q3", "mad", "se", "cv", "skewness", "kurtosis")])


@query(
    "outliers",
    """, g AS (SELECT mukey, avg(r) AS m, stddev_samp(r) AS s, quantile_cont(r, 25e-2) AS q1, quantile_cont(r, 75e-2) AS q3, median(r) AS md FROM hz GROUP BY ALL), j AS (SELECT cokey, hz, r, g.* FROM hz JOIN g ON hz.mukey = g.mukey), d AS (SELECT mukey, median(abs(r - md)) AS dev FROM j GROUP BY ALL)
  SELECT cokey, hz, r < q1 - 5e-1 * (q3 - q1) OR r > q3 + 5e-1 * (q3 - q1) AS by_fence, abs(r - m) > 15e-1 * s AS by_z, dev > 0 AND abs(6745e-4 * (r - md) / dev) > 15e-1 AS by_median FROM j JOIN d ON j.mukey = d.mukey""",
)
def outliers(spark, sf_dir):
    return stats.outliers(hz(spark, sf_dir).select("mukey", "cokey", "hz", "r"), ["mukey"], "r", 1.5, 1.5, 0.5).select("cokey", "hz", "by_fence", "by_z", "by_median")


@query(
    "correlations",
    " UNION ALL ".join(f"SELECT genhz, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r, count(*) AS n FROM hz GROUP BY genhz" for a, b in (("r", "p1"), ("r", "p2"), ("p1", "p2"))),
)
def correlations(spark, sf_dir):
    return rounded(stats.correlations(hz(spark, sf_dir), ["genhz"], ["r", "p1", "p2"]), digits=8)


@query(
    "rank_correlations",
    "SELECT genhz, 'p1' AS a, 'p2' AS b, round(corr(ra, rb), 8) AS r, count(*) AS n FROM (SELECT genhz, rank() OVER (PARTITION BY genhz ORDER BY p1) + (count(*) OVER (PARTITION BY genhz, p1) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY genhz ORDER BY p2) + (count(*) OVER (PARTITION BY genhz, p2) - 1) / 2e0 AS rb FROM hz) GROUP BY genhz",
)
def rank_correlations(spark, sf_dir):
    return rounded(stats.correlations(hz(spark, sf_dir).select("genhz", "p1", "p2"), ["genhz"], ["p1", "p2"], ranks=True), digits=8)


@query(
    "pooled_correlation",
    "SELECT round(sum(n * r) / sum(n), 8) AS r, CAST(sum(n) AS BIGINT) AS n, 'grouped' AS method FROM (SELECT mukey, count(*) AS n, corr(r, p1) AS r FROM hz GROUP BY mukey) WHERE n > 5 AND r IS NOT NULL",
)
def pooled_correlation(spark, sf_dir):
    return rounded(stats.pooled_correlation(hz(spark, sf_dir), "mukey", "r", "p1"), digits=8)


@query(
    "mahalanobis",
    """, g AS (SELECT genhz, avg(r) AS ma, avg(p2) AS mb, var_samp(r) AS saa, var_samp(p2) AS sbb, covar_samp(r, p2) AS sab FROM hz GROUP BY genhz)
  SELECT cokey, hz, round((pow(r - ma, 2) * sbb - 2 * (r - ma) * (p2 - mb) * sab + pow(p2 - mb, 2) * saa) / (saa * sbb - sab * sab), 6) AS d2 FROM hz JOIN g ON hz.genhz = g.genhz""",
)
def mahalanobis(spark, sf_dir):
    return rounded(stats.mahalanobis(hz(spark, sf_dir).select("genhz", "cokey", "hz", "r", "p2"), ["genhz"], "r", "p2").select("cokey", "hz", "d2"))


@query(
    "normalized",
    """, g AS (SELECT genhz, avg(r) AS m, stddev_samp(r) AS s, min(r) AS lo, max(r) AS hi, median(r) AS md, quantile_cont(r, 25e-2) AS q1, quantile_cont(r, 75e-2) AS q3 FROM hz GROUP BY genhz)
  SELECT cokey, hz, round((r - m) / s, 6) AS z, round((r - lo) / (hi - lo), 8) AS scaled, round((r - md) / (q3 - q1), 8) AS robust, round(cume_dist() OVER (PARTITION BY hz.genhz ORDER BY r), 8) AS ecdf FROM hz JOIN g ON hz.genhz = g.genhz""",
)
def normalized(spark, sf_dir):
    x = stats.normalized(hz(spark, sf_dir).select("genhz", "cokey", "hz", "r"), ["genhz"], "r")
    return x.select("cokey", "hz", F.round("z", 6).alias("z"), *[F.round(c, 8).alias(c) for c in ("scaled", "robust", "ecdf")])


@query(
    "filled_forward",
    "SELECT event_id, round(last_value(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS value FROM events",
)
def filled_forward(spark, sf_dir):
    x = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return x.select("event_id", F.round(stats.filled_forward(x, ["user_id"], ["ts", "event_id"], "v"), 6).alias("value"))


@query(
    "quantile_mapped",
    "SELECT cokey, hz, round(mapped, 6) AS mapped FROM (SELECT cokey, hz, genhz, row_number() OVER (PARTITION BY genhz ORDER BY r, p1, cokey, hz) AS k FROM hz) a JOIN (SELECT genhz, p1 AS mapped, row_number() OVER (PARTITION BY genhz ORDER BY p1) AS k FROM hz) b ON a.genhz = b.genhz AND a.k = b.k",
)
def quantile_mapped(spark, sf_dir):
    x = hz(spark, sf_dir).select("genhz", "cokey", "hz", "p1", "r")
    return rounded(stats.quantile_mapped(x, ["genhz"], ["r", "p1", "cokey", "hz"], "p1").select("cokey", "hz", "mapped"))


@query(
    "monotone_share",
    "SELECT cokey, round(greatest(count(*) FILTER (s > 0), count(*) FILTER (s < 0)) / count(*), 8) AS share, count(*) AS steps FROM (SELECT cokey, r - lag(r) OVER (PARTITION BY cokey ORDER BY hz) AS s FROM hz) WHERE s IS NOT NULL GROUP BY cokey",
)
def monotone_share(spark, sf_dir):
    return rounded(stats.monotone_share(hz(spark, sf_dir), ["cokey"], ["hz"], "r"), digits=8)


FUSED = f"""a AS (SELECT cell, quantile_cont(r, 5e-1) AS m1, (quantile_cont(r, 95e-2) - quantile_cont(r, 5e-2)) / (2 * {Z}) AS s1 FROM hz GROUP BY cell),
  b AS (SELECT p_partkey AS cell, p_retailprice * 30 AS m2, p_retailprice * 4 / (2 * {Z}) AS s2 FROM part)"""


@query(
    "cells_fused",
    f""", {FUSED} SELECT coalesce(a.cell, b.cell) AS cell, round(CASE WHEN s1 > 0 AND s2 > 0 THEN (m1 / (s1 * s1) + m2 / (s2 * s2)) / (1 / (s1 * s1) + 1 / (s2 * s2)) WHEN s2 > 0 THEN m2 ELSE m1 END, 4) AS mu,
  round(CASE WHEN s1 > 0 AND s2 > 0 THEN sqrt(1 / (1 / (s1 * s1) + 1 / (s2 * s2))) WHEN s2 > 0 THEN s2 ELSE s1 END, 4) AS sigma, CASE WHEN s1 > 0 AND s2 > 0 THEN 'fused' WHEN s2 > 0 THEN 'likelihood' ELSE 'prior' END AS route FROM a FULL JOIN b ON a.cell = b.cell""",
)
def cells_fused(spark, sf_dir):
    return rounded(cells.fuse_normal(*sides(spark, sf_dir), "cell"), digits=4)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prior = cells.percentiles(hz(spark, sf_dir), ["cell"], "r")
    around = lambda k: (F.col("p_retailprice") * k)
    return prior, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), around(28).alias("p05"), around(30).alias("p50"), around(32).alias("p95"))


@query(
    "resampled_cells",
    """, g AS (SELECT (p_partkey % 40)::BIGINT AS x, (p_partkey // 40)::BIGINT AS y, p_retailprice AS v FROM part), t AS (SELECT s_suppkey AS id, (s_suppkey % 38) + 25e-2 AS x, (s_suppkey % 4) + 5e-1 AS y FROM supplier)
  SELECT id, round(sum(v * w) / sum(w), 6) AS v FROM (SELECT id, v, (1 - abs(t.x - g.x)) * (1 - abs(t.y - g.y)) AS w FROM t JOIN g ON abs(t.x - g.x) < 1 AND abs(t.y - g.y) < 1) WHERE w > 0 GROUP BY id""".lstrip(", "),
)
def resampled_cells(spark, sf_dir):
    grid = read(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), F.col("p_retailprice").alias("v"))
    targets = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") % 38) + 0.25).alias("x"), ((F.col("s_suppkey") % 4) + 0.5).alias("y"))
    return rounded(cells.resampled(grid, targets, "v"))


ORACLE_SQL["resampled_cells"] = "WITH " + ORACLE_SQL["resampled_cells"]


@query("event_quality", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_quality(spark, sf_dir):
    return rounded(quality.windowed(read(spark, sf_dir, "events")))


@query("cells_density")
def cells_density(spark, sf_dir):
    return cells.fuse_kde(*sides(spark, sf_dir), "cell")


@query("depth_trends")
def depth_trends(spark, sf_dir):
    return gp.trends(hz(spark, sf_dir).withColumn("decimetre", F.floor(F.col("hzdept_r") / 10) * 10), "genhz", "decimetre", "r", [float(d) for d in range(0, 201, 10)])


@query("depth_copula")
def depth_copula(spark, sf_dir):
    x = hz(spark, sf_dir, dealt=True).withColumns({"q_l": F.col("p1") * 0.8, "q_h": F.col("p1") * 1.2})
    lower, sides = simulate.cholesky(MATRIX), ["l", "r", "h", "q_l", "p1", "q_h"]
    make = lambda texts, values: simulate.triangular_draws(texts, values, ["a", "b"], lower, 50, 1)
    return gp.drawn(x, sides, ["a", "b"], make, lambda depth, _: gp.depth_correlation(depth, 50.0), MATRIX, 50)


@query(
    "band_infill",
    """, m AS (SELECT cokey, hz, (hzdept_r + hzdepb_r) / 2 AS mid, CASE WHEN mark % 9 = 0 THEN NULL ELSE r END AS v FROM hz), k AS (SELECT mid AS its, sum(v) AS s, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY mid),
  w AS (SELECT mid, sum(s / (1 + abs(mid - its))) / sum(n / (1 + abs(mid - its))) AS near, sum(n) AS n FROM (SELECT DISTINCT mid FROM m WHERE v IS NULL) JOIN k ON abs(mid - its) <= 15 GROUP BY mid)
  SELECT cokey, hz, round(coalesce(v, near), 3) AS v, CASE WHEN v IS NULL THEN CAST(n AS BIGINT) END AS n FROM m LEFT JOIN w USING (mid)""",
)
def band_infill(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "hz", ((F.col("hzdept_r") + F.col("hzdepb_r")) / 2).alias("mid"), F.when(F.col("mark") % 9 != 0, F.col("r")).alias("v"))
    return matching.across_components(x, "v").select("cokey", "hz", F.round(F.coalesce("v", "near"), 3).alias("v"), F.col("n_near").alias("n"))


@query(
    "overlaps",
    "SELECT a.cokey, a.hz, b.hz AS hz2, round(least(a.hzdepb_r, b.hzdepb_r + 10) - greatest(a.hzdept_r, b.hzdept_r + 10), 6) AS shared FROM hz a JOIN hz b ON a.cokey = b.cokey AND least(a.hzdepb_r, b.hzdepb_r + 10) > greatest(a.hzdept_r, b.hzdept_r + 10)",
)
def overlaps(spark, sf_dir):
    x = hz(spark, sf_dir)
    left = x.select("cokey", "hz", F.col("hzdept_r").alias("top"), F.col("hzdepb_r").alias("bottom"))
    right = x.select("cokey", F.col("hz").alias("hz2"), (F.col("hzdept_r") + 10).alias("top2"), (F.col("hzdepb_r") + 10).alias("bottom2"))
    return rounded(matching.overlapping(left, right, ["cokey"]).select("cokey", "hz", "hz2", "shared"))


@query("nearest_slices", "SELECT cokey, hz, CASE WHEN m <= 25e-1 THEN 0e0 WHEN m <= 10 THEN 5e0 WHEN m <= 225e-1 THEN 15e0 WHEN m <= 45 THEN 30e0 WHEN m <= 80 THEN 60e0 ELSE 100e0 END AS slice FROM (SELECT cokey, hz, (hzdept_r + hzdepb_r) / 2 AS m FROM hz)")
def nearest_slices(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("m", (F.col("hzdept_r") + F.col("hzdepb_r")) / 2)
    return matching.nearest(x, [0, 5, 15, 30, 60, 100], "m").select("cokey", "hz", "slice")


STD = "coalesce(regexp_replace(regexp_replace(upper(trim(x)), '[0-9]+$', ''), '[^A-Za-z0-9_/]', '', 'g'), '')"
LIKE = "CASE WHEN a = b THEN 1e0 WHEN a != '' AND b != '' AND substr(a, 1, 1) = substr(b, 1, 1) THEN least(1e0, 8e-1 + 2e-1 * len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / greatest(length(a), length(b))) ELSE 0e0 END"
NAMED = "(VALUES (0, 'Ap'), (1, 'Bt1'), (2, 'Bt2'), (3, ' bw '), (4, 'B/C'), (5, 'Apk2'), (6, NULL), (7, ''), (8, '2Bt'), (9, 'A'), (10, 'E-b'))"


def named(x: DataFrame) -> DataFrame:
    """Horizons with names that reach every rule."""
    names = F.array(*[F.lit(n).cast("string") for n in ("Ap", "Bt1", "Bt2", " bw ", "B/C", "Apk2", None, "", "2Bt", "A", "E-b")])
    return x.withColumn("hzname", F.get(names, (F.pmod(F.col("mark") * 7 + F.col("hz"), F.lit(11))).cast("int")))


@query(
    "name_similarity",
    f""", n AS (SELECT cokey, hz, {STD} AS s FROM (SELECT cokey, hz, n.v AS x FROM hz JOIN {NAMED} n(k, v) ON (mark * 7 + hz) % 11 = n.k)) SELECT cokey, hz, hz2, round({LIKE}, 8) AS score FROM (SELECT a.cokey, a.hz, b.hz AS hz2, a.s AS a, b.s AS b FROM n a JOIN n b ON a.cokey = b.cokey AND a.hz < b.hz)""",
)
def name_similarity(spark, sf_dir):
    x = named(hz(spark, sf_dir)).select("cokey", "hz", matching.standard_name(F.col("hzname")).alias("a"))
    y = x.select("cokey", F.col("hz").alias("hz2"), F.col("a").alias("b"))
    return x.join(y, "cokey").where("hz < hz2").select("cokey", "hz", "hz2", F.round(matching.name_similarity(F.col("a"), F.col("b")), 8).alias("score"))


@query(
    "name_infill",
    f""", n AS (SELECT cokey, hz, {STD} AS s, CASE WHEN mark % 3 = 0 THEN NULL ELSE r END AS v, mark % 13 != 0 AS ok FROM (SELECT cokey, hz, mark, r, n.v AS x FROM hz JOIN {NAMED} n(k, v) ON (mark * 7 + hz) % 11 = n.k)),
  p AS (SELECT cokey, hz, v, {LIKE} AS w FROM (SELECT a.cokey, a.hz, a.s AS a, b.s AS b, b.v FROM n a JOIN n b ON a.cokey = b.cokey WHERE a.v IS NULL AND a.ok AND a.s != '' AND b.v IS NOT NULL AND b.ok AND b.s != ''))
  SELECT n.cokey, n.hz, round(coalesce(n.v, q.m), 8) AS v, q.n FROM n LEFT JOIN (SELECT cokey, hz, sum(v * w) / sum(w) AS m, count(*) AS n FROM p WHERE w > 5e-1 GROUP BY ALL) q ON n.cokey = q.cokey AND n.hz = q.hz""",
)
def name_infill(spark, sf_dir):
    x = named(hz(spark, sf_dir)).withColumns({"v": F.when(F.col("mark") % 3 != 0, F.col("r")), "suitable": F.col("mark") % 13 != 0})
    return matching.name_infill(x, "v").select("cokey", "hz", F.round(F.coalesce("v", "by_name"), 8).alias("v"), F.col("n_names").alias("n"))


def triplets(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    x = hz(spark, sf_dir, dealt).withColumn("hzname", F.when(F.col("genhz") == "R", "Cr").otherwise(F.col("hzname")))
    return x.select("mukey", "cokey", "hz", "hzname", "hzdept_r", "hzdepb_r", F.when(F.col("mark") % 7 != 0, F.col("l")).alias("a_l"), F.col("r").alias("a_r"), F.col("h").alias("a_h"), (F.col("p1") * 0.9).alias("b_l"), F.col("p1").alias("b_r"), (F.col("p1") * 1.2).alias("b_h"))


MC = f"""m AS (SELECT mukey, cokey, hz, sim, {TRI.replace("lo", "a_l").replace("hi", "a_h").replace("md", "r").replace("u", "ua")} AS a, greatest(least({TRI.replace("lo", "b_l").replace("hi", "b_h").replace("md", "p1").replace("u", "ub")}, 40), 5) AS b
  FROM (SELECT *, {pnorm_sql('y1')} AS ua, {pnorm_sql('y2')} AS ub FROM (SELECT *, z1 AS y1, {number(LOW2[1, 0])} * z1 + {number(LOW2[1, 1])} * z2 AS y2 FROM (SELECT *, {qnorm_sql('e1')} AS z1, {qnorm_sql('e2')} AS z2
  FROM (SELECT *, coalesce(CASE WHEN mark % 7 = 0 THEN NULL ELSE l END, r * 8e-1) AS a_l, h AS a_h, p1 * 9e-1 AS b_l, p1 * 12e-1 AS b_h, {uniform_sql('cokey', 'hz', 'sim', "'a'", '1')} AS e1, {uniform_sql('cokey', 'hz', 'sim', "'b'", '1')} AS e2 FROM hz, range(1, 11) s(sim) WHERE genhz != 'R' AND hzdept_r <= 250)))))"""


@query("monte_carlo", f", {MC} SELECT mukey, count(*) AS n, round(quantile_cont(a, 5e-2), 3) AS a05, round(quantile_cont(a, 5e-1), 3) AS a50, round(quantile_cont(a, 95e-2), 3) AS a95, round(avg(b), 4) AS b FROM m GROUP BY mukey")
def mc(spark, sf_dir):
    x = monte_carlo.summaries(triplets(spark, sf_dir), ["mukey"], ["a", "b"], [0.05, 0.5, 0.95], MATRIX, monte_carlo.configured(n=10, limits={"b": (5.0, 40.0)}))
    return x.select("mukey", "n", *[F.round(F.col("a_q")[k], 3).alias(c) for k, c in enumerate(("a05", "a50", "a95"))], F.round("b_mean", 4).alias("b"))


@query("property_coverage", "SELECT 'a' AS property, count(*) FILTER (mark % 7 != 0) AS whole, count(*) FILTER (mark % 7 = 0) AS estimated, 0::BIGINT AS missing FROM hz UNION ALL SELECT 'b', count(*), 0, 0 FROM hz")
def property_coverage(spark, sf_dir):
    return monte_carlo.coverage(triplets(spark, sf_dir), ["a", "b"])


FREE = MC.replace("greatest(least(", "((").replace(", 40), 5) AS b", ")) AS b")


@query(
    "simulation_quality",
    f", {FREE}, v AS (SELECT 'a' AS property, a AS v FROM m UNION ALL SELECT 'b', b FROM m), q AS (SELECT property, quantile_cont(v, 25e-2) AS q1, quantile_cont(v, 75e-2) AS q3 FROM v GROUP BY property) SELECT property, 1e0 AS finite, round(avg(CAST(v < q1 - 15e-1 * (q3 - q1) OR v > q3 + 15e-1 * (q3 - q1) AS INTEGER)), 8) AS outliers, round(1 - avg(CAST(v < q1 - 15e-1 * (q3 - q1) OR v > q3 + 15e-1 * (q3 - q1) AS INTEGER)), 8) AS score FROM v JOIN q USING (property) GROUP BY property",
)
def simulation_quality(spark, sf_dir):
    return rounded(monte_carlo.quality(monte_carlo.simulate(triplets(spark, sf_dir, dealt=True), ["a", "b"], MATRIX, monte_carlo.configured(n=10)), ["a", "b"]), digits=8)


@query("beta_draws")
def beta_draws(spark, sf_dir):
    x = hz(spark, sf_dir).withColumn("u", uniform(F.col("cokey"), F.col("hz"), "beta"))
    return x.select("cokey", "hz", special.beta_draw(F.col("p1") * 0.8, F.col("p1"), F.col("p1") * 1.3, F.col("u"), 0.0, 100.0).alias("draw"))


@query(
    "ranked_fits",
    """, s AS (SELECT mukey, count(r) AS n, avg(r) AS m, var_pop(r) AS v, avg(ln(r)) AS lm, var_pop(ln(r)) AS lv FROM hz GROUP BY mukey),
  f AS (SELECT mukey, 'normal' AS family, 4 + n * (ln(6283185307179586e-15 * v) + 1) AS aic FROM s UNION ALL SELECT mukey, 'lognormal', 4 + n * (ln(6283185307179586e-15 * lv) + 1) + 2 * n * lm FROM s UNION ALL SELECT mukey, 'exponential', 2 + 2 * n * (ln(m) + 1) FROM s)
  SELECT mukey, family, round(aic, 4) AS aic, CAST(rank() OVER (PARTITION BY mukey ORDER BY aic) AS INTEGER) AS place FROM f""",
)
def ranked_fits(spark, sf_dir):
    return rounded(stats.ranked_fits(hz(spark, sf_dir), ["mukey"], "r"), digits=4)


@query(
    "mean_intervals",
    "SELECT mukey, genhz, count(r) AS n, round(avg(r), 5) AS mean, round(avg(r) - 1959963984540054e-15 * stddev_samp(r) / sqrt(count(r)), 5) AS low, round(avg(r) + 1959963984540054e-15 * stddev_samp(r) / sqrt(count(r)), 5) AS high FROM hz GROUP BY ALL",
)
def mean_intervals(spark, sf_dir):
    return rounded(stats.intervals(hz(spark, sf_dir), ["mukey", "genhz"], "r"), digits=5)


@query(
    "missing_profile",
    "SELECT 'v' AS \"column\", count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS missing, round(count(*) FILTER (event_id % 3 = 0) / count(*), 8) AS share FROM events UNION ALL SELECT 'user_id', count(*), 0, 0 FROM events",
)
def missing_profile(spark, sf_dir):
    x = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return rounded(stats.missing(x, ["v", "user_id"]), digits=8)


@query(
    "simulation_scores",
    f", {MC}, s AS (SELECT mukey, avg(a) AS m, stddev_samp(a) AS d FROM m GROUP BY mukey), o AS (SELECT mukey, avg(r) AS m, stddev_samp(r) AS d FROM hz WHERE genhz != 'R' AND hzdept_r <= 250 GROUP BY mukey) SELECT o.mukey, round(s.m - o.m, 4) AS bias, round(abs((s.m - o.m) / o.m), 8) AS relative, round(s.d / o.d, 8) AS spread FROM o JOIN s ON o.mukey = s.mukey",
)
def simulation_scores(spark, sf_dir):
    draws = monte_carlo.simulate(triplets(spark, sf_dir), ["a", "b"], MATRIX, monte_carlo.configured(n=10, limits={"b": (5.0, 40.0)}))
    seen = monte_carlo.usable(triplets(spark, sf_dir), ["a"], monte_carlo.configured()).withColumnRenamed("a_r", "a")
    x = stats.scores(seen, draws, ["mukey"], "a")
    return x.select("mukey", F.round("bias", 4).alias("bias"), F.round("relative", 8).alias("relative"), F.round("spread", 8).alias("spread"))


from . import fits, judged, models, more, validity  # noqa: E402, F401  (they register further queries)
