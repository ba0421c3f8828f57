"""Queries of realism checks, of model groups and of updates and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, realism
from ..sources.tables import horizons as hz
from .registry import query, rounded


def _share(column: str, low: str, high: str, place: str) -> str:
    return f"avg(CASE WHEN {column} BETWEEN {low} AND {high} THEN 1e0 ELSE 0e0 END) FILTER ({place})"


@query(
    "layer_quality",
    "SELECT genhz, " + ", ".join(f"round(({_share('p1', '5', '45', w)} + {_share('p2', '225e-2', '525e-2', w)}) / 2, 8) AS {n}" for n, w in (("surface", "hzdept_r <= 30"), ("subsurface", "hzdept_r > 30"))) + " FROM hz GROUP BY genhz",
)
def layer_quality(spark, sf_dir):
    return rounded(realism.layers(hz(spark, sf_dir), ["genhz"], {"p1": (5.0, 45.0), "p2": (2.25, 5.25), "none": (0.0, 1.0)}), digits=8)


STEPS = "(SELECT {k}, hzdept_r, v, v - lag(v) OVER (PARTITION BY {k} ORDER BY hzdept_r) AS step FROM (SELECT {k}, hzdept_r, avg({v}) AS v FROM hz GROUP BY {k}, hzdept_r))"


@query("depth_transitions", f"SELECT genhz, round(greatest(1 - max(abs(step)) / (max(v) - min(v)), 0), 6) AS transition FROM {STEPS.format(k='genhz', v='r')} GROUP BY genhz HAVING count(step) > 0")
def depth_transitions(spark, sf_dir):
    return rounded(realism.transitions(hz(spark, sf_dir), ["genhz"], "r"))


@query(
    "trend_jumps",
    f""", s AS {STEPS.format(k='mukey', v='p1')}, d AS (SELECT mukey, stddev_samp(step) AS sd FROM s GROUP BY mukey HAVING count(*) >= 3)
  SELECT mukey, extreme, outside, extreme = 0 AND outside = 0 AS realistic FROM (SELECT mukey, count(*) FILTER (abs(step) > 2 * sd) AS extreme, count(*) FILTER (NOT v BETWEEN 5 AND 45) AS outside FROM s JOIN d USING (mukey) GROUP BY mukey)""",
)
def trend_jumps(spark, sf_dir):
    return realism.jumps(hz(spark, sf_dir), ["mukey"], "p1", (5.0, 45.0), far=2.0)


@query(
    "steep_steps",
    "SELECT genhz, count(g) AS steps, count(*) FILTER (g > 501e-4) AS steep FROM (SELECT genhz, abs(p2 - lag(p2) OVER w) / nullif(hzdept_r - lag(hzdept_r) OVER w, 0) AS g FROM hz WINDOW w AS (PARTITION BY cokey, genhz ORDER BY hzdept_r)) WHERE g IS NOT NULL GROUP BY genhz",
)
def steep_steps(spark, sf_dir):
    x = realism.steep(hz(spark, sf_dir), ["cokey", "genhz"], "hzdept_r", "p2", 0.0501)
    return x.groupBy("genhz").agg(F.sum("steps").alias("steps"), F.sum("steep").alias("steep"))


@query(
    "trend_realism",
    """SELECT genhz, CAST(sum(violations) AS BIGINT) AS violations, round(avg(CASE WHEN violations = 0 AND coalesce(monotone, true) THEN 1e0 ELSE 0e0 END), 8) AS compliance FROM (
  SELECT genhz, cokey, count(*) FILTER (NOT r BETWEEN 1000 AND 90000) AS violations, greatest(count(*) FILTER (step > 0), count(*) FILTER (step < 0)) / nullif(count(step), 0) >= 7e-1 AS monotone
  FROM (SELECT *, r - lag(r) OVER (PARTITION BY genhz, cokey ORDER BY hz) AS step FROM hz) GROUP BY genhz, cokey) GROUP BY genhz""",
)
def trend_realism(spark, sf_dir):
    found = realism.trends(hz(spark, sf_dir), ["genhz", "cokey"], "hz", "r", (1000.0, 90000.0))
    return rounded(realism.compliance(found, ["genhz"]), digits=8)


@query(
    "soil_relationships",
    "SELECT genhz, round(avg(CASE WHEN abs(p1 + p2 + p3 - 30) <= 51e-1 THEN 1e0 ELSE 0e0 END), 8) AS texture, round((corr(p1, r) + 1) / 2, 7) AS chemical, round((1 - corr(p2, hzdept_r)) / 2, 7) AS physical FROM hz GROUP BY genhz",
)
def soil_relationships(spark, sf_dir):
    found = realism.relationships(hz(spark, sf_dir), ["genhz"], ["p1", "p2", "p3"], ("p1", "r"), ("p2", "hzdept_r"), 30.0, 5.1)
    return found.select("genhz", F.round("texture", 8).alias("texture"), F.round("chemical", 7).alias("chemical"), F.round("physical", 7).alias("physical"))


@query(
    "depth_agreement",
    ", m AS (" + " UNION ALL ".join(f"SELECT genhz, '{c}' AS \"column\", hzdept_r, avg({c}) FILTER (mark % 2 = 1) AS s, avg({c}) FILTER (mark % 2 = 0) AS o FROM hz GROUP BY genhz, hzdept_r" for c in ("p1", "r"))
    + ') SELECT genhz, "column", round(corr(s, o), 7) AS r, round((corr(s, o) + 1) / 2, 7) AS realism, corr(s, o) < 5e-1 AS violated FROM m WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY genhz, "column" HAVING count(*) >= 3 AND stddev_samp(s) > 0 AND stddev_samp(o) > 0',
)
def depth_agreement(spark, sf_dir):
    x = hz(spark, sf_dir)
    return rounded(realism.agreement(x.where("mark % 2 = 1"), x.where("mark % 2 = 0"), ["genhz"], ["p1", "r"]), digits=7)


@query(
    "column_anomalies",
    ", a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (v < a - (b - a) * 25e-2 OR v > b + (b - a) * 25e-2) AS n, count(*) AS t FROM (SELECT {c} AS v FROM hz), (SELECT quantile_cont({c}, 25e-2) AS a, quantile_cont({c}, 75e-2) AS b FROM hz)" for c in ("r", "p1"))
    + ") SELECT \"column\", n, round(n / t, 8) AS share, CASE WHEN n = 0 THEN 'none' WHEN n / t < 5e-2 THEN 'minor' ELSE 'major' END AS severity FROM a",
)
def column_anomalies(spark, sf_dir):
    return rounded(realism.anomalies(hz(spark, sf_dir), ["r", "p1"], 0.25), digits=8)


@query(
    "integration_scores",
    """, c AS (SELECT count(*) AS a, count(*) FILTER (mark % 7 != 0) AS b, count(*) FILTER (mark % 7 != 0 AND mark % 5 = 0) AS m FROM hz)
  SELECT "column", increase, a AS rows_before, b AS rows_after, round((CASE WHEN a = b THEN 1e0 ELSE 5e-1 END + 8e-1 + 7e-1) / 3, 8) AS score, (CASE WHEN a = b THEN 1e0 ELSE 5e-1 END + 8e-1 + 7e-1) / 3 >= 8e-1 AS passed FROM (SELECT 'p1' AS "column", m AS increase, a, b FROM c UNION ALL SELECT 'p2', 0, a, b FROM c)""",
)
def integration_scores(spark, sf_dir):
    x = hz(spark, sf_dir)
    found = realism.integrity(x, x.where("mark % 7 != 0").withColumn("p1", F.when(F.col("mark") % 5 != 0, F.col("p1"))), ["p1", "p2"])
    s = realism.integration_score(F.col("preserved"), F.lit(0.2), F.lit(False))
    return found.select("column", "increase", "rows_before", "rows_after", F.round(s["score"], 8).alias("score"), s["passed"].alias("passed"))


LEVELS = {"cell": "CAST(cell AS VARCHAR)", "mukey": "CAST(mukey AS VARCHAR)", "genhz": "genhz", "none": "'all'"}


@query(
    "group_strategies",
    ", x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS level, {i} AS place, {g} AS g, cokey, hzdept_r FROM hz" for i, (n, g) in enumerate(LEVELS.items()))
    + """), s AS (SELECT level, place, count(*) FILTER (ok) AS adequate, 100 * coalesce(sum(n) FILTER (ok), 0) / sum(n) AS covered FROM (SELECT level, place, g, count(*) AS n, count(DISTINCT cokey) >= 40 AND count(*) >= 60 AND max(hzdept_r) - min(hzdept_r) >= 20 AS ok FROM x GROUP BY level, place, g) GROUP BY level, place)
  SELECT level, CAST(place AS INTEGER) AS place, adequate, round(covered, 6) AS covered, adequate >= 3 AS meets, row_number() OVER (ORDER BY adequate >= 3 DESC, CASE WHEN adequate >= 3 THEN 0 ELSE -adequate END, place) = 1 AS chosen FROM s""",
)
def group_strategies(spark, sf_dir):
    return rounded(grouping.strategies(hz(spark, sf_dir), ["cell", "mukey", "taxorder", "genhz", "none"], 40, 60, 3))


@query(
    "training_coverage",
    """, g AS (SELECT mukey FROM hz GROUP BY mukey HAVING count(DISTINCT cokey) >= 3 AND count(*) >= 15 AND max(hzdept_r) - min(hzdept_r) >= 20), e AS (SELECT mukey, count(*) AS n, count(*) FILTER (mark % 3 = 0) AS k FROM hz WHERE mukey IN (SELECT mukey FROM g) GROUP BY mukey)
  SELECT 'p1' AS "column", count(*) AS groups, round(sum(k) / sum(n), 8) AS rate, count(*) FILTER (k / n >= 5e-1) AS well, sum(k) / sum(n) < 3e-1 AS low FROM e""",
)
def training_coverage(spark, sf_dir):
    return rounded(grouping.coverage(hz(spark, sf_dir).withColumn("p1", F.when(F.col("mark") % 3 == 0, F.col("p1"))), "mukey", ["p1"]), digits=8)


@query(
    "model_fallbacks",
    """, g AS (SELECT cell FROM hz GROUP BY cell HAVING count(DISTINCT cokey) >= 30 AND count(*) >= 30 AND max(hzdept_r) - min(hzdept_r) >= 20),
  f AS (SELECT *, CASE WHEN cell IN (SELECT cell FROM g) THEN CAST(cell AS VARCHAR) WHEN mark % 3 != 0 THEN 'name_' || hzname WHEN mark % 4 != 0 THEN 'class_' || genhz ELSE 'fallback_general' END AS fg FROM hz),
  s AS (SELECT fg FROM f GROUP BY fg HAVING NOT (count(DISTINCT cokey) >= 30 AND count(*) >= 30 AND max(hzdept_r) - min(hzdept_r) >= 20))
  SELECT CASE WHEN fg IN (SELECT fg FROM s) THEN 'general_pool' ELSE fg END AS final_group, count(*) AS n FROM f GROUP BY 1""",
)
def model_fallbacks(spark, sf_dir):
    x = hz(spark, sf_dir).withColumns({"name": F.when(F.col("mark") % 3 != 0, F.col("hzname")), "class": F.when(F.col("mark") % 4 != 0, F.col("genhz"))})
    found = grouping.with_fallbacks(x, "cell", "r", {"name": "name_", "class": "class_"}, 30, 30)
    return found.groupBy("final_group").agg(F.count("*").alias("n"))


@query(
    "matched_models",
    "SELECT cokey, CASE WHEN mukey % 2 = 0 THEN CAST(mukey AS VARCHAR) WHEN genhz = 'R' THEN 'class_R' ELSE (SELECT min(CAST(mukey AS VARCHAR)) FROM hz WHERE hz = 1 AND mukey % 2 = 0) END AS model FROM hz WHERE hz = 1",
)
def matched_models(spark, sf_dir):
    x = hz(spark, sf_dir).where("hz = 1").select("cokey", "mukey", "genhz")
    models = x.where("mukey % 2 = 0").select(F.col("mukey").cast("string").alias("model")).unionByName(x.where("genhz = 'R'").select(F.concat(F.lit("class_"), "genhz").alias("model")))
    return grouping.matched(x, "cokey", models, ["mukey"], {"genhz": "class_"})


@query("trend_ratios", "SELECT cokey, hz, round(CASE WHEN lag(p1) OVER w IS NULL THEN 1 ELSE greatest(least(p1 / lag(p1) OVER w, 10), 1e-1) END, 8) AS ratio FROM hz WINDOW w AS (PARTITION BY cokey ORDER BY hz)")
def trend_ratios(spark, sf_dir):
    return grouping.ratios(hz(spark, sf_dir), ["cokey"], "hz", "p1").select("cokey", "hz", F.round("ratio", 8).alias("ratio"))


@query(
    "updated_rows",
    """, o AS (SELECT cokey, genhz FROM hz GROUP BY cokey, genhz HAVING count(*) = 1), c AS (SELECT cokey, genhz, max(r * 2) AS x FROM hz WHERE mark % 3 = 0 GROUP BY cokey, genhz)
  SELECT cokey, hz, genhz, round(coalesce(c.x, r), 4) AS r FROM hz LEFT JOIN (SELECT * FROM c SEMI JOIN o USING (cokey, genhz)) c USING (cokey, genhz)""",
)
def updated_rows(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "hz", "genhz", "r")
    changes = hz(spark, sf_dir).where("mark % 3 = 0").select("cokey", "genhz", (F.col("r") * 2).alias("r"))
    return grouping.updated(x, changes, ["cokey", "genhz"], ["r"]).withColumn("r", F.round("r", 4))


@query("packed_draws", "SELECT genhz, hzdept_r, count(*) AS n, round(sum(r), 2) AS total, min(cokey * 1000 + hz) AS least FROM hz GROUP BY genhz, hzdept_r")
def packed_draws(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "genhz", "hzdept_r", (F.col("cokey") * 1000 + F.col("hz")).alias("sim"), "r", "p1")
    back = grouping.unpacked(grouping.arrays(x, "cokey", ["r", "p1"]), "cokey", ["r", "p1"])
    return back.join(x.select("sim", "genhz"), "sim").groupBy("genhz", "hzdept_r").agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("total"), F.min("sim").alias("least"))


@query(
    "trend_scaled",
    """, a AS (SELECT *, CASE WHEN mark % 5 != 0 THEN p1 END AS t FROM hz), b AS (SELECT *, t / nullif(lag(t) OVER (PARTITION BY cokey ORDER BY hz), 0) AS s FROM a), c AS (SELECT *, count(*) FILTER (s IS NULL) OVER (PARTITION BY cokey ORDER BY hz) AS part FROM b)
  SELECT cokey, hz, round(ln(first_value(r) OVER w) + sum(CASE WHEN s IS NULL THEN 0 ELSE ln(least(greatest(s, 1e-1), 10)) END) OVER w, 7) AS log_v FROM c WINDOW w AS (PARTITION BY cokey, part ORDER BY hz)""",
)
def trend_scaled(spark, sf_dir):
    x = hz(spark, sf_dir).select("cokey", "hz", F.col("r").alias("v"), F.when(F.col("mark") % 5 != 0, F.col("p1")).alias("t"))
    return grouping.scaled(x, ["cokey"], "hz", "v", "t").select("cokey", "hz", F.round(F.log("v"), 7).alias("log_v"))


@query(
    "rank_retrofitted",
    """, t AS (SELECT mukey, min(hz) AS top FROM hz GROUP BY mukey), p AS (SELECT mukey, cokey, top, cume_dist() OVER (PARTITION BY mukey ORDER BY r) AS p FROM hz JOIN t USING (mukey) WHERE hz = top), q AS (SELECT mukey, hz, list_sort(list(r)) AS q FROM hz GROUP BY mukey, hz)
  SELECT mukey, hz, cokey, round(CASE WHEN p IS NULL OR hz = top THEN r ELSE q[CAST(floor(p * (len(q) - 1)) AS INT) + 1] + (q[CAST(ceil(p * (len(q) - 1)) AS INT) + 1] - q[CAST(floor(p * (len(q) - 1)) AS INT) + 1]) * (p * (len(q) - 1) - floor(p * (len(q) - 1))) END, 3) AS v FROM hz LEFT JOIN p USING (mukey, cokey) JOIN q USING (mukey, hz)""",
)
def rank_retrofitted(spark, sf_dir):
    x = hz(spark, sf_dir).select("mukey", "hz", "cokey", F.col("r").alias("v"))
    return grouping.retrofitted(x, "mukey", "hz", "cokey", "v").withColumn("v", F.round("v", 3))
