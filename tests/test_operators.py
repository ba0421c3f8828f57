"""Closed forms, invariants and edge cases of the library's operators."""

import math
import os
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.functions import normal, scalar
from loamcast.operators import cells, gp, horizons, simulate, stats
from loamcast.sources import tables
from loamcast.streaming import quality

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_conjugate_updates(spark):
    post = one(spark, scalar.update_normal(*lit(10, 2, 14, 2)))
    assert (post.mu, round(post.sigma, 9)) == (12.0, round(math.sqrt(2), 9))
    assert one(spark, scalar.fuse_beta(*lit(0.4, 3, 0.5, 3))).feasible is False
    gamma = one(spark, scalar.gamma_to_moments(*lit(4, 2)))
    assert (gamma.mean, gamma.var) == (2.0, 1.0)
    s = ((2, 0.5, 1), (3, -0.2, 2))
    m = ((1, 2), (3, 5))
    got = one(spark, scalar.fuse_bivariate(tuple(lit(*m[0])), tuple(lit(*s[0])), tuple(lit(*m[1])), tuple(lit(*s[1]))))
    a, b = (np.linalg.inv(np.array([[x[0], x[1]], [x[1], x[2]]])) for x in s)
    cov = np.linalg.inv(a + b)
    mean = cov @ (a @ m[0] + b @ m[1])
    assert np.allclose([got.x, got.y, got.xx, got.xy, got.yy], [*mean, cov[0, 0], cov[0, 1], cov[1, 1]])


def test_quantiles(spark):
    assert one(spark, scalar.quantile_triangular(*lit(0, 1, 2, 0.5))) == 1.0
    assert one(spark, scalar.quantile_triangular(*lit(3, 3, 3, 0.9))) == 3.0
    assert math.isnan(one(spark, scalar.triangular_draw(*lit(5, 1, 2, 0.5))))
    knots = list(zip((0.05, 0.5, 0.95), lit(1, 2, 5)))
    assert [one(spark, scalar.quantile_linear(knots, F.lit(u))) for u in (0.01, 0.05, 0.5, 0.725, 0.99)] == [1, 1, 2, 3.5, 5]
    a = scalar.metalog_fit(*lit(2, 10, 20))
    assert np.allclose([one(spark, scalar.metalog_quantile(a, F.lit(u))) for u in (0.05, 0.5, 0.95)], [2, 10, 20])
    assert one(spark, scalar.metalog_feasible(a)) and not one(spark, scalar.metalog_feasible(scalar.metalog_fit(*lit(0, 99, 100))))


def test_triplet_families(spark):
    rows = [(1.0, 2.0, 3.0), (1.0, 2.0, 9.0), (-1.0, 2.0, 30.0), (2.0, 2.0, 2.0), (None, 1.0, 2.0), (float("nan"), 1.0, 2.0), (1.0, float("inf"), 2.0)]
    x = spark.createDataFrame(rows, "l double, r double, h double").select(scalar.fit_triplet(F.col("l"), F.col("r"), F.col("h")).alias("f")).collect()
    assert [r.f.family for r in x] == ["normal", "lognormal", "normal", "triangular", "none", "none", "none"]
    assert [r.f.valid for r in x] == [True] * 4 + [False] * 3


def test_normal_functions(spark):
    u = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.7, 0.98, 0.999, 1 - 1e-6]
    got = spark.createDataFrame([(x,) for x in u], "u double").select(F.expr(normal.qnorm_sql("u")).alias("z")).withColumn("p", F.expr(normal.pnorm_sql("z"))).collect()
    assert np.allclose([r.z for r in got], [NormalDist().inv_cdf(x) for x in u], atol=2e-8, rtol=2e-8)
    assert np.allclose([r.p for r in got], u, atol=1e-7)


def test_ilr_and_textures(spark):
    z = scalar.ilr(*lit(20, 30, 50))
    assert np.allclose([one(spark, p) for p in scalar.ilr_inverse(*z)], [20, 30, 50])
    texture = lambda *x: one(spark, scalar.texture_class(*lit(*x)))
    assert [texture(92, 5, 3), texture(40, 40, 20), texture(20, 20, 60), texture(10, 85, 5), texture(65, 25, 10)] == ["sand", "loam", "clay", "silt", "sandy loam"]


def test_names_and_amounts(spark):
    names = [" a ", "Bw", "R", "2Cr1", "", None, "Om", "Bkm", "B"]
    x = spark.createDataFrame([(n,) for n in names], "n string").select(scalar.general_horizon(F.col("n")).alias("g"), scalar.unsuitable(F.col("n")).alias("u")).collect()
    assert [r.g for r in x] == ["A", "B", "R", "Cr", None, None, "O", "B", "B"]
    assert [r.u for r in x] == [False, False, True, True, False, False, True, True, False]
    text = ["35-45", "30", ">70", "<= 4", "TRACE", "10 to 20", "25.5%", None, "", "5–15", "unknown"]
    y = spark.createDataFrame([(t,) for t in text], "t string").select(scalar.parse_amount(F.col("t")).alias("a")).collect()
    assert [r.a.value for r in y] == [40.0, 30.0, 105.0, 2.0, 0.1, 15.0, 25.5, None, None, 10.0, None]


def test_copula_hits_its_correlation(spark):
    x = simulate.correlated_uniforms(simulate.realizations(spark.range(4), 2500), ["id", "sim"], ["a", "b", "c"], [[1, 0.7, -0.3], [0.7, 1, 0], [-0.3, 0, 1]])
    z = x.select(*[F.expr(normal.qnorm_sql(f"u_{n}")).alias(n) for n in "abc"]).agg(F.corr("a", "b"), F.corr("a", "c"), F.corr("b", "c"), F.stddev("b")).first()
    assert np.allclose(z, [0.7, -0.3, 0, 1], atol=0.04)
    assert np.linalg.eigvalsh(simulate.positive_definite(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))).min() > 0


def test_draws_ignore_partitions(spark):
    draw = lambda n: sorted(simulate.realizations(spark.range(50).repartition(n), 3).select(normal.uniform(F.col("id"), F.col("sim"), "x").alias("u")).collect())
    assert draw(1) == draw(8)


def test_slices_and_windows(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 20.0, 10.0), (1, 2, 20.0, 40.0, 30.0), (2, 1, 0.0, 10.0, None)], "cokey long, hz int, hzdept_r double, hzdepb_r double, v double")
    got = {(r.cokey, r.top): (r["mean"], r.reached) for r in horizons.slices(rows, [(0, 30), (30, 100), (100, 150)], "v").collect()}
    assert got[1, 0] == ((20 * 10 + 10 * 30) / 30, 30.0) and got[1, 30] == (30.0, 40.0) and got[1, 100] == (None, 150.0) and got[2, 0] == (None, 10.0)
    assert horizons.overlap_mean(rows, 10.0, 30.0, "v", ["cokey"]).where("cokey = 1").first()["mean"] == 20.0


def test_infill_reads_what_came_in(spark):
    rows = [(1, 1, "A", 1, 5.0, 1.0), (1, 1, "A", 2, 15.0, None), (1, 1, "B", 3, 20.0, None), (1, 1, "B", 4, 100.0, None), (1, 2, "A", 1, 5.0, None), (2, 3, "C", 1, 5.0, None)]
    x = spark.createDataFrame(rows, "mukey long, cokey long, genhz string, hz int, mid double, v double")
    got = {(r.cokey, r.hz): (r.filled, r.rung) for r in horizons.ladder_infill(x, "v").collect()}
    assert got == {(1, 1): (1.0, "own"), (1, 2): (1.0, "same"), (1, 3): (1.0, "band"), (1, 4): (1.0, "line"), (2, 1): (1.0, "group"), (3, 1): (None, None)}


def test_available_water_skips_layers_without_parameters(spark):
    names = ["alpha", "npar", "theta_r", "theta_s"]
    row = (-1.5, 0.15, 0.06, 0.42, 0.1, 0.02, 0.01, 0.01)
    x = spark.createDataFrame([(1, *row), (2, None, *row[1:])], "layer long, " + ", ".join(f"{n} double" for n in [*names, *(f"{n}_sd" for n in names)]))
    got = simulate.available_water(x, 200).collect()
    assert {r.layer for r in got} == {1} and len(got) == 200 and 0.05 < np.mean([r.awhc for r in got]) < 0.3


def test_fusion_routes(spark):
    side = lambda rows: spark.createDataFrame(rows, "cell long, p05 double, p50 double, p95 double")
    prior, like = side([(1, 8.0, 10.0, 12.0), (2, 5.0, 5.0, 5.0), (3, 1.0, 2.0, 3.0)]), side([(1, 10.0, 12.0, 14.0), (2, 1.0, 2.0, 3.0), (4, 1.0, 4.0, 7.0)])
    got = {r.cell: r for r in cells.fuse_normal(prior, like, "cell").collect()}
    assert got[1].mu == pytest.approx(11) and got[1].route == "fused" and (got[2].mu, got[2].route) == (2.0, "likelihood") and got[3].route == "prior" and got[4].route == "likelihood"
    density = {r.cell: r for r in cells.fuse_adaptive(prior, like, "cell").collect()}
    assert density[1].mu == pytest.approx(11, abs=0.2) and density[1].sigma < 2 / normal.Z95
    assert {r.route for r in cells.fuse_adaptive(prior, like, "cell", threshold=1).collect()} > {"fused"}


def test_depth_models(spark):
    rows = [(g, c, float(d), 20.0 + (0.1 * d if g == "a" else 0)) for g in ("a", "b") for c in range(3) for d in (0, 20, 50, 80, 100)]
    got = gp.trends(spark.createDataFrame(rows, "g string, cokey long, d double, v double"), "g", "d", "v", [0.0, 35.0, 100.0, 500.0]).collect()
    assert {r.g for r in got} == {"a"}  # b does not vary
    assert np.allclose([r.trend for r in sorted(got, key=lambda r: r.depth)], [20, 23.5, 30, 30], atol=0.3)
    z = gp.joint_normals(gp.depth_correlation(np.array([0.0, 10, 40]), 20), np.array([[1, 0.5], [0.5, 1]]), 20000, 1)
    assert np.corrcoef(z[0, 0], z[0, 1])[0, 1] == pytest.approx(0.5, abs=0.03) and np.corrcoef(z[0, 0], z[1, 0])[0, 1] == pytest.approx(math.exp(-0.5), abs=0.03)


def test_reordering_keeps_margins(spark):
    x = simulate.realizations(spark.createDataFrame([(1, 1, 0.0), (1, 2, 30.0)], "cokey long, hz int, hzdept_r double"), 400).withColumns({n: normal.uniform(F.col("hz"), F.col("sim"), n) for n in "ab"})
    y = gp.reordered(x, ["a", "b"], [[1, 0.8], [0.8, 1]])
    for n in "ab":
        assert sorted(x.select("hz", n).collect()) == sorted(y.select("hz", n).collect())
    assert y.where("hz = 1").agg(F.corr("a", "b")).first()[0] == pytest.approx(0.79, abs=0.08)


def test_depth_copula_reorders_every_map_unit(spark, tmp_path):
    from loamcast.plans import registry

    lines = [(o, k, 10 * o + k, (o + k) % 6, 5.0 + k, 900.0 + 7 * o + k, 0.05, 0.02, "ANR"[o % 3]) for o in range(1, 9) for k in range(1, 2 + o % 4)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, cols).withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["depth_copula"](spark, str(tmp_path)).toPandas()
    x = tables.horizons(spark, str(tmp_path)).withColumns({"q_l": F.col("p1") * 0.8, "q_h": F.col("p1") * 1.2})
    draws = simulate.correlated_triangular(simulate.realizations(x, 50), ["cokey", "hz", "sim"], {"a": ("l", "r", "h"), "b": ("q_l", "p1", "q_h")}, registry.MATRIX).toPandas()
    assert len(got) == len(draws) == 50 * len(lines) and set(got.cokey) == set(range(1, 9))
    for cokey, profile in draws.groupby("cokey"):
        depths = profile.groupby("hz").hzdept_r.first().to_numpy()
        z = gp.joint_normals(gp.depth_correlation(depths, 50.0) + 1e-9 * np.eye(len(depths)), np.array(registry.MATRIX), 50, 1 + cokey)
        for i, (hz, horizon) in enumerate(profile.groupby("hz")):
            mine = got[(got.cokey == cokey) & (got.hz == hz)].sort_values("sim")
            for k, name in enumerate("ab"):
                want = [sorted(horizon[name])[sum(z[i, k] < v)] for v in z[i, k]]
                assert np.allclose(mine[name], want, rtol=1e-12)


def test_summary_moments(spark):
    v = [1.0, 2.0, 2.0, 9.0, 4.0]
    r = stats.summary(spark.createDataFrame([(1, x) for x in v], "k int, v double"), ["k"], "v").first()
    sd = np.std(v, ddof=1)
    assert np.allclose([r.sd, r.mad, r.skewness, r.kurtosis], [sd, 1.4826, np.mean((np.array(v) - np.mean(v)) ** 3) / sd**3, np.mean((np.array(v) - np.mean(v)) ** 4) / sd**4 - 3])


def test_readers_and_writers(spark, tmp_path):
    x = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for ending in ("parquet", "orc", "json", "csv", "tsv"):
        tables.save(x, f"{tmp_path}/t.{ending}")
        assert sorted(tables.load(spark, f"{tmp_path}/t.{ending}", "k int, v string").collect(), key=lambda r: r.k) == x.collect()
    with pytest.raises(ValueError):
        tables.load(spark, f"{tmp_path}/t.xlsx")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stream_is_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = quality.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("quality").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("quality").drop("mean").collect()) == sorted(quality.windowed(events).drop("mean").collect())


def test_every_query_has_a_name():
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 30


def test_cache_is_reused_and_ages(spark, tmp_path):
    from loamcast.sources import cache

    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    key = cache.key_of(b=2, a=[1])
    assert key == cache.key_of(a=[1], b=2) != cache.key_of(a=[2], b=2)
    assert [cache.cached(spark, str(tmp_path), key, make).count() for _ in range(2)] == [1, 1]
    assert cache.cached(spark, str(tmp_path), key, make, max_age=-1).count() == 2


def test_special_functions():
    from loamcast.functions import special

    assert np.allclose(special.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525891])
    assert np.allclose(special.trigamma(np.array([1.0, 0.5])), [1.6449340668, 4.9348022005])
    u = np.linspace(0.01, 0.99, 21)
    for a, b in ((0.5, 0.5), (2, 5), (30, 4), (1, 1)):
        assert np.allclose(special.beta_cdf(special.beta_quantile(u, a, b), a, b), u)
    assert np.allclose(special.beta_cdf(u, 2, 2), 3 * u**2 - 2 * u**3)
    rng = np.random.default_rng(0)
    a, b = special.beta_fit(100 * rng.beta(2, 5, (1, 20000)), 0, 100)
    assert abs(a[0] - 2) < 0.1 and abs(b[0] - 5) < 0.2
    q = special.spline_quantile(np.array([0.05, 0.5, 0.95]), np.array([1.0, 2.0, 9.0]), u)
    assert (np.diff(q) >= 0).all() and np.allclose(special.spline_quantile(np.array([0.05, 0.5, 0.95]), np.array([1.0, 2.0, 9.0]), np.array([0.05, 0.5, 0.95])), [1, 2, 9])


def test_band_join_is_brute_force(spark):
    from loamcast.operators import matching

    rng = np.random.default_rng(1)
    x = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 80), rng.uniform(-60, 60, 80))]
    left, right = spark.createDataFrame(x, "k int, a double"), spark.createDataFrame(x, "k int, b double")
    got = sorted(map(tuple, matching.within(left, right, ["k"], "a", "b", 7.5).collect()))
    assert got == sorted((k, a, b) for k, a in x for j, b in x if j == k and abs(a - b) <= 7.5)


def test_monte_carlo_configuration(spark):
    from loamcast.operators import monte_carlo

    config = monte_carlo.configured(n=5, limits={"ph": (4.0, 9.0)})
    assert config.limits["ph"] == (4.0, 9.0) and config.limits["clay"] == (0.0, 100.0)
    with pytest.raises(ValueError):
        monte_carlo.configured(n=0)
    rows = [(1, 1, 1, "A", 0.0, 10.0, None, 6.0, None), (1, 1, 2, "Cr", 10.0, 20.0, 5.0, 6.0, 7.0), (1, 2, 1, "B", 300.0, 310.0, 5.0, 6.0, 7.0), (1, 3, 1, "B", 0.0, 9.0, None, None, None)]
    x = spark.createDataFrame(rows, "mukey int, cokey int, hz int, hzname string, hzdept_r double, hzdepb_r double, ph_l double, ph_r double, ph_h double")
    got = monte_carlo.simulate(x, ["ph"], config=config).collect()
    assert len(got) == 5 and {r.cokey for r in got} == {1} and all(4.8 <= r.ph <= 7.2 for r in got)


# Families, fusion, profiles, infilling, cleaning and checks


def test_metalogs_of_any_size_pass_their_percentiles(spark):
    from loamcast.functions import families

    probs, values = [0.05, 0.2, 0.5, 0.7, 0.95], [3.0, 8.0, 20.0, 26.0, 55.0]
    x = spark.createDataFrame([tuple(values)], "a double, b double, c double, d double, e double")
    for kind, bounds in (("u", None), ("sl", (1.0, 90.0)), ("su", (1.0, 90.0)), ("b", (1.0, 90.0))):
        a = families.metalog([F.col(c) for c in "abcde"], probs, bounds, kind)
        got = x.select(*[families.metalog_at(a, F.lit(p), bounds, kind).alias(f"p{i}") for i, p in enumerate(probs)]).first()
        assert list(got) == pytest.approx(values, rel=1e-9)


def test_families_and_their_checks(spark):
    from loamcast.functions import families

    rows = [(1.0, 2.0, 3.0, f) for f in ("triangular", "uniform", "normal", "lognormal", "metalog", "linear_cdf", "auto", "odd")] + [(-1.0, 2.0, 9.0, "auto"), (2.0, 2.0, 2.0, "normal"), (None, 2.0, 3.0, "normal"), (float("nan"), 2.0, 3.0, "uniform"), (1.0, 1.01, 9.0, "metalog")]
    x = spark.createDataFrame(rows, "l double, r double, h double, f string").withColumn("u", F.lit(0.5))
    fit = families.fit(F.col("l"), F.col("r"), F.col("h"), F.col("f"))
    got = x.withColumn("fit", fit).select("fit.family", families.quantile(F.col("fit"), "u", triplet=(F.col("l"), F.col("r"), F.col("h"))).alias("q"), families.check(F.col("fit")).alias("c")).collect()
    assert [r.family for r in got] == ["triangular", "uniform", "normal", "lognormal", "metalog", "linear_cdf", "normal", "odd", "normal", "triangular", "normal", "uniform", "metalog"]
    assert [None if r.q is None else round(r.q, 6) for r in got] == [2.0] * 7 + [None, 2.0, 2.0, None, None, 1.01]
    assert [r.c.valid for r in got] == [True] * 7 + [False, True, True, False, False, True]
    assert got[-1].c.message.startswith("infeasible")
    beta = spark.createDataFrame([(10.0, 30.0, 60.0, u) for u in (0.05, 0.5, 0.95)], "l double, r double, h double, u double")
    drawn = beta.withColumn("fit", families.fit(F.col("l"), F.col("r"), F.col("h"), "auto", bounds=(0.0, 100.0))).select(families.quantile(F.col("fit"), "u", bounds=(0.0, 100.0), triplet=(F.col("l"), F.col("r"), F.col("h"))).alias("q"))
    low, mid, high = (r.q for r in drawn.collect())
    assert 0 < low < 25 < mid < 40 < high < 100


def test_percentile_methods_agree_on_a_smooth_set(spark):
    from loamcast.operators import percentiles

    columns = {0.0: "a", 0.05: "b", 0.5: "c", 0.95: "d", 1.0: "e"}
    rows = [(k, 0.0, 5.0, 50.0, 95.0, 100.0, (k + 0.5) / 400) for k in range(400)] + [(900, -1.0, None, 50.0, None, -1.0, 0.5), (901, -1.0, 20.0, 50.0, 80.0, None, 0.5)]
    x = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, u double")
    for method in percentiles.METHODS:
        got = {r.id: r.draw for r in percentiles.simulate(x, columns, method, "u").collect()}
        assert got[900] is None or got[900] != got[900]
        assert got[901] == pytest.approx(50, abs=2) and sum(got[k] for k in range(400)) / 400 == pytest.approx(50, abs=1)
    line = {r.id: r.draw for r in percentiles.simulate(x, columns, "linear_cdf", "u").collect()}
    assert line[0] == pytest.approx(0.125) and line[200] == pytest.approx(50 + 45 * 0.00125 / 0.45)


def test_fusion_by_family(spark):
    from loamcast.operators import fusion

    prior, likelihood = {0.05: "a", 0.5: "b", 0.95: "c"}, {0.05: "d", 0.5: "e", 0.95: "f"}
    x = spark.createDataFrame([(8.0, 10.0, 13.0, 9.0, 11.0, 14.0), (1.0, 50.0, 99.0, 2.0, 50.0, 98.0)], "a double, b double, c double, d double, e double, f double")
    for family in fusion.ROUTES:
        for r in fusion.fuse_cells(x, prior, likelihood, family, (0.0, 200.0)).collect():
            p = r.posterior.asDict()
            mean = p["shape"] / p["rate"] if "shape" in p else p["mu"]
            low, high = min(r.a, r.d), max(r.c, r.f)
            assert low < mean < high, (family, mean)
    wide = spark.createDataFrame([(0.0, 5.0, 10.0, 15.0, 20.0, 6.0, 10.0, 14.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    rows, p, q = fusion.aligned(wide, {0.0: "a", 0.05: "b", 0.5: "c", 0.95: "d", 1.0: "e"}, {0.1: "f", 0.5: "g", 0.9: "h"})
    assert [rows.first()[c] for c in p.values()] == pytest.approx([5 + 5 / 9, 10, 15 - 5 / 9]) and list(q) == [0.1, 0.5, 0.9]
    with pytest.raises(ValueError):
        fusion.aligned(wide, {0.2: "a", 0.5: "b", 0.8: "c"}, {0.3: "d", 0.9: "e"})
    assert fusion.composition_groups(["ph", "sand", "om", "silt", "clay"], {"texture": (["sand", "silt", "clay"], ["z1", "z2"]), "other": (["a", "ph"], ["y"])}) == (["ph", "z1", "z2", "om"], {"texture": True, "other": False})


def test_compositions_sum_to_their_total(spark):
    from loamcast.operators import fusion

    parts = {"sand": (30.0, 40.0, 50.0), "silt": (30.0, 35.0, 40.0), "clay": (20.0, 25.0, 30.0)}
    x = spark.createDataFrame([(1, *[v for t in parts.values() for v in t])], "id long, " + ", ".join(f"{p}_{e} double" for p in parts for e in "lrh"))
    side = {p: tuple(f"{p}_{e}" for e in "lrh") for p in parts}
    post = fusion.fuse_composition(x, ["id"], side, side, 2000, 1.645, 1.645)
    r = post.first()
    assert r.sand + r.silt + r.clay == pytest.approx(100) and r.sand == pytest.approx(40, abs=1.5) and r.clay == pytest.approx(25, abs=1.5)
    draws = fusion.composition_draws(post, ["id"], ("sand", "silt", "clay"), 500).collect()
    assert all(d.sand + d.silt + d.clay == pytest.approx(100) for d in draws)
    z = spark.createDataFrame([(0.3, -0.2, 7.0)], "z1 double, z2 double, ph double")
    back = fusion.restored(z, ["sand", "silt", "clay"], ["z1", "z2"])
    assert back.columns == ["ph", "sand", "silt", "clay"] and sum(back.first()[1:]) == pytest.approx(100)


def test_profiles_hang_together(spark):
    from loamcast.operators import profiles

    rows = [(1, 1, "A", 0.0, None, 2.0, 20.0, 15.0, 28.0), (1, 2, "Bt", 20.0, 14.0, 27.0, 60.0, None, None), (1, 3, "C", 60.0, 50.0, 70.0, 150.0, 140.0, 180.0), (2, 1, "A", 0.0, 0.0, 0.0, 30.0, 30.0, 30.0)]
    x = spark.createDataFrame(rows, "cokey long, hz int, hzname string, hzdept_r double, hzdept_l double, hzdept_h double, hzdepb_r double, hzdepb_l double, hzdepb_h double")
    drawn = simulate.realizations(x, 60)
    for method in ("top_down", "bottom_up", "mixed"):
        layers = profiles.simulated(drawn, ["cokey", "sim"], method)
        by = {}
        for r in layers.collect():
            by.setdefault((r.cokey, r.sim), []).append(r)
        assert len(by) == 120
        for (cokey, _), parts in by.items():
            parts.sort(key=lambda r: r.hz)
            assert parts[0].top == 0 and all(a.bottom == b.top for a, b in zip(parts, parts[1:])) and all(p.bottom >= p.top for p in parts)
            if cokey == 2:
                assert (parts[0].top, parts[0].bottom) == (0, 30)
            elif method == "top_down":
                assert 15 <= parts[0].bottom <= 28 and 58 <= parts[1].bottom <= 62 and 140 <= parts[2].bottom <= 180
        assert {r.method for r in layers.select("method").distinct().collect()} == ({"top_down", "bottom_up"} if method == "mixed" else {method})
    spread = {(r.cokey, r.hz): r.thickness_sd for r in profiles.thickness_spread(layers, ["cokey"]).collect()}
    assert spread[2, 1] == 0 and spread[1, 1] > 1
    assert profiles.out_of_range(profiles.clipped(layers, profiles.with_variability(x), ["cokey", "hz"]), profiles.with_variability(x), ["cokey", "hz"]).count() == 0


def test_recovery_reports_what_it_cannot_do(spark):
    components = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "lone")], "cokey long, compname string")
    rows = [(1, "A", "Ap", 0.0, 20.0), (2, "A", "A1", 0.0, 30.0), (2, "A", "Ap", 30.0, 40.0), (2, None, "?", 40.0, 50.0)]
    known = spark.createDataFrame(rows, "cokey long, genhz string, hzname string, hzdept_r double, hzdepb_r double")
    found, lost = horizons.recovered(components, known, "compname", ["hzdept_r", "hzdepb_r"], ["hzname"])
    new = [r for r in found.collect() if r.recovered]
    assert [(r.cokey, r.genhz, r.hzname, r.hzdept_r, r.hzdepb_r, r.siblings) for r in new] == [(3, "A", "Ap", 10.0, 30.0, 2)]
    assert [r.cokey for r in lost.collect()] == [4]


def test_positions_are_ranks(spark):
    import random

    rng = random.Random(1)
    rows = [(g, float(rng.choice([1, 2, 3, rng.random() * 50]))) for g in "ab" for _ in range(700)] + [("c", 5.0), ("a", None)]
    x = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v): r for r in stats.positions(x, ["g"], "v", parts=7).collect()}
    for (g, v), r in got.items():
        mine = [y for k, y in rows if k == g and y is not None]
        assert (r.n, r.before, r.total) == (mine.count(v), sum(y < v for y in mine), len(mine))
    q = {r.g: r for r in stats.quantiles_at(x, ["g"], "v", {"m": 0.5, "q": 0.9}).collect()}
    import numpy as np

    for g in "abc":
        assert (q[g].m, q[g].q) == pytest.approx(tuple(np.quantile([y for k, y in rows if k == g and y is not None], [0.5, 0.9])))


def test_cleaning_rules(spark):
    from loamcast.operators import cleaning

    x = spark.createDataFrame([(1.0, 2.0, "3.5 %", None), (None, 4.0, "x", "7")], "clay double, clay_total double, a string, b string")
    assert cleaning.renamed(x).columns == ["claytotal_r", "a", "b"]
    assert [r.v for r in x.select(cleaning.as_number(F.col("a")).alias("v")).collect()] == [3.5, None]
    assert [r.v for r in x.select(cleaning.coalesced(x, ["clay", "none", "b"], "double", -1.0).alias("v")).collect()] == [1.0, 7.0]
    assert x.select(cleaning.converted(F.lit(3.0), "ft", "m").alias("v")).first().v == 0.91
    with pytest.raises(ValueError):
        cleaning.converted(F.lit(1.0), "mile", "m")
    assert cleaning.required(x, {"clay": "double", "a": "double", "zz": None}) == ["zz is missing", "a is string, not double"]
    parts = cleaning.valid_components(spark.createDataFrame([("1", 120.0), ("", 5.0), ("3", None)], "cokey string, comppct_r double"))
    assert [r.cokey for r in parts.collect()] == ["3"]
    assert [r.broken for r in cleaning.rule_violations(spark.createDataFrame([(60.0, 40.0), (60.0, 10.0)], "s double, c double"), [(["s", "c"], 100.0, 0.1)]).collect()] == [0, 1]


def test_checks_of_matrices_and_scores(spark):
    from loamcast.operators import checks

    good, bad = checks.matrix_quality([[1.0, 0.5], [0.5, 1.0]]), checks.matrix_quality([[1.0, 1.2], [1.2, 1.0]])
    assert good["valid"] and good["condition"] == pytest.approx(3) and good["cholesky_error"] < 1e-12 and not bad["valid"] and bad["cholesky_error"] is None
    mean, sure = checks.overall([F.lit(0.8), F.lit(None).cast("double"), F.lit(0.6)])
    r = spark.range(1).select(mean.alias("m"), sure.alias("s")).first()
    assert r.m == pytest.approx(0.7) and r.s == pytest.approx(0.7 * (1 - 0.02))
    draws = spark.createDataFrame([(k, 1.0 if k < 8 else 2.0) for k in range(10)], "sim long, v double")
    assert [(round(r.change, 6), r.converged) for r in checks.convergence(draws, "sim", ["v"]).collect()] == [(1.0, False)]
    assert checks.convergence(draws.limit(0), "sim", ["v"]).count() == 0
    assert checks.representation(draws.withColumn("k", F.col("sim") % 3), "k", 4).first().short == 2


def test_metalogs_in_vectors(spark):
    from loamcast.functions import families
    from loamcast.operators import fusion

    rng = np.random.default_rng(8)
    rows = [tuple(map(float, np.sort(rng.uniform(5, 95, 3)) if k % 3 else np.array([10, 10.5 + k / 100, 90]))) for k in range(200)]
    df = spark.createDataFrame([*rows, (1.0, None, 3.0)], "l double, r double, h double")
    a = families.metalog([F.col(c) for c in "lrh"], [0.05, 0.5, 0.95], (0.0, 100.0), "b")
    x = df.select("l", "r", "h", families.infeasible(a).alias("bad"), scalar.metalog_feasible(scalar.metalog_fit(*[F.col(c) for c in "lrh"])).alias("rises"), fusion.metalog_moments({0.05: "l", 0.5: "r", 0.95: "h"}, (0.0, 100.0), "b").alias("m"))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # no step of a row works its coefficients out again
    u, seen = np.arange(1, 50) / 50, set()
    for r in x.collect():
        if r["r"] is None:
            assert r["bad"] is None and r["rises"] is None and r["m"]["mu"] is None
            continue
        v = np.array([r["l"], r["r"], r["h"]])
        system = np.linalg.inv(np.array([families.basis(p, 3) for p in (0.05, 0.5, 0.95)]))
        at = lambda a, p: a[0] + (a[1] + a[2] * (p - 0.5)) * np.log(p / (1 - p))
        z = system @ np.log(v / (100 - v))
        assert r["bad"] == bool((np.diff(at(z, u)) < 0).any()) == r["m"]["infeasible"] and r["rises"] == (not (np.diff(at(system @ v, u)) < 0).any())
        seen.add(r["bad"])
        if not r["bad"]:
            q = 100 / (1 + np.exp(-at(z, 0.001 + 0.005 * np.arange(200))))
            assert r["m"]["mu"] == pytest.approx(q.mean()) and r["m"]["sigma"] == pytest.approx(q.std())
        else:
            assert r["m"]["mu"] == r["r"]
    assert seen == {True, False}
