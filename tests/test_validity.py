"""Bootstrap limits, distances, rules, ranks and batches against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.operators import checks, grouping, monte_carlo, percentiles, rules, stage_one, stats


def test_bootstrap_covers_and_ignores_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{g}", k, float(v)) for g in range(60) for k, v in enumerate(rng.exponential(5, 80))] + [("one", 0, 3.0), ("none", 0, None), ("flat", 0, 2.0), ("flat", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    a, b = (sorted(map(tuple, stats.bootstrap(df.repartition(p), ["g"], "v", ["g", "k"], 400).collect())) for p in (1, 7))
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2:] for r in a], [r[2:] for r in b])
    found = {r[0]: r for r in a}
    assert found["one"][1:] == (1, 3.0, 3.0, 3.0) and found["flat"][2:] == (2.0, 2.0, 2.0) and "none" not in found
    inside = [r for g, r in found.items() if g.startswith("g")]
    assert sum(r[3] <= 5 <= r[4] for r in inside) >= 50
    width = np.mean([r[4] - r[3] for r in inside])
    assert width == pytest.approx(2 * 1.96 * 5 / np.sqrt(80), rel=0.1)


def test_poisson_counts_have_mean_one(spark):
    n = spark.range(65536).select(stats.poisson(F.col("id").cast("int")).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert n[0] == pytest.approx(1, abs=1e-3) and n[1] == pytest.approx(1, abs=1e-2)


def test_distances_in_several_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4))
    rows = [("a", *map(float, v)) for v in x] + [("a", None, 1.0, 1.0, 1.0), ("few", 1.0, 2.0, 3.0, 4.0)] + [("flat", float(k), 2.0 * k, 1.0, 0.5) for k in range(9)]
    found = checks.distances(spark.createDataFrame(rows, "g string, a double, b double, c double, d double"), ["g"], list("abcd")).collect()
    inverse, centre = np.linalg.inv(np.cov(x.T)), x.mean(axis=0)
    for r in found:
        if r["g"] == "a" and r["a"] is not None:
            d = np.array([r[c] for c in "abcd"]) - centre
            assert r["d2"] == pytest.approx(d @ inverse @ d) and r["far"] == (r["d2"] > checks.chi_square(0.975, 4))
        elif r["g"] == "flat":
            assert np.isfinite(r["d2"])
        else:
            assert r["d2"] is None and r["far"] is None
    assert len(found) == len(rows) and checks.chi_square(0.975, 2) == pytest.approx(-2 * np.log(0.025)) and checks.chi_square(0.95, 10) == pytest.approx(18.307, abs=1e-3)


def test_rules_in_one_pass(spark):
    rows = [(1, 10.0, 60.0, 30.0, "A"), (2, -1.0, 50.0, 51.0, "B"), (3, None, 50.0, 40.0, "A"), (4, float("nan"), 1.0, 1.0, None), (5, 20.0, 40.0, 40.0, "R")]
    df = spark.createDataFrame(rows, "k int, clay double, sand double, silt double, genhz string")
    held = [rules.between("clay", 0, 100), rules.sums_to(("clay", "sand", "silt"), 100, 1), rules.ordered("clay", "sand", "warning"), rules.conditional("rock has no clay", ("genhz", "clay"), lambda: F.col("genhz") == "R", lambda: F.col("clay") == 0), rules.custom("named", ("genhz",), "genhz in ('A', 'B', 'R')"), rules.between("missing", 0, 1)]
    found = {r["k"]: ([x["rule"] for x in r["reasons"]], r["accepted"]) for r in rules.judged(df, held).collect()}
    assert found == {1: ([], True), 2: (["clay in range"], False), 3: ([], True), 4: (["clay in range", "clay + sand + silt = 100", "clay <= sand"], False), 5: (["rock has no clay"], True)}
    report = {r["rule"]: (r["applied"], r["broken"]) for r in rules.report(df, held).collect()}
    assert report == {"clay in range": (4, 2), "clay + sand + silt = 100": (4, 1), "clay <= sand": (4, 1), "rock has no clay": (1, 1), "named": (4, 0), "missing in range": (None, None)}
    assert rules.report(df.where("false"), held).where("broken > 0").count() == 0 and rules.judged(df, []).where("accepted").count() == 5
    out = rules.unsuitable_summary(df.withColumn("bad", F.col("genhz") == "A"), "bad", "genhz").first()
    assert (out["genhz"], out["n"], out["share"]) == ("A", 2, 0.4)


def test_convergence_counts_realizations_not_their_numbers(spark):
    rows = [(k, 1.0, float(k)) for k in (1, 2, 3, 4, 100)]
    found = {r["column"]: r for r in checks.convergence(spark.createDataFrame(rows, "sim int, v double, w double"), "sim", ["v", "w"]).collect()}
    assert found["v"]["change"] == 0 and found["v"]["converged"] and found["w"]["change"] == pytest.approx(24) and not found["w"]["converged"]
    assert checks.convergence(spark.createDataFrame([(1, 1.0)], "sim int, v double"), "sim", ["v"]).count() == 0


def test_ranks_of_large_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v), k) for k, v in enumerate(rng.integers(0, 300, 5000))] + [("b", None, 1), ("b", 2.0, 2), ("b", 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    out = stats.ranked(df.repartition(6), ["g"], ["v", "k"], "place").collect()
    want = {(g, k): i + 1 for g in "ab" for i, (v, k) in enumerate(sorted(((-1.0 if v is None else v, k) for h, v, k in rows if h == g)))}
    assert {(r["g"], r["k"]): r["place"] for r in out} == want


def test_ks_of_large_groups(spark):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(0, 1, 3000), 3), np.round(rng.normal(0.2, 1, 2000), 3)
    side = lambda x: spark.createDataFrame([("g", float(v)) for v in x] + [("g", None)], "g string, v double")
    r = percentiles.ks_distance(side(a), side(b), ["g"], "v").first()
    at = np.union1d(a, b)
    want = np.abs(np.searchsorted(np.sort(a), at, "right") / 3000 - np.searchsorted(np.sort(b), at, "right") / 2000).max()
    assert r["ks"] == pytest.approx(want) and (r["n_a"], r["n_b"]) == (3000, 2000)


def test_errors_of_methods(spark):
    side = lambda x: spark.createDataFrame([("g", float(v)) for v in x], "g string, v double")
    r = percentiles.method_errors(side([1, 2, 3, 4]), side([2, 3, 4, 5]), ["g"], "v").first()
    assert r["ks"] == 0.25 and r["mean_error"] == pytest.approx(0.4) and r["sd_error"] == pytest.approx(0)


def test_retrofitted_draws_keep_their_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(1, float(d), s, float(v)) for d in (0, 20, 50) for s, v in enumerate(rng.normal(d, 1, 40))] + [(1, 20.0, 99, 7.0), (2, 0.0, 1, 5.0), (2, 10.0, 1, None)]
    x = grouping.retrofitted(spark.createDataFrame(rows, "cokey int, depth double, sim int, v double"), "cokey", "depth", "sim", "v").toPandas()
    assert len(x) == len(rows)
    wide = x[(x.cokey == 1) & (x.sim < 99)].pivot(index="sim", columns="depth", values="v")
    p = wide[0.0].rank() / 40
    values = np.array([r[3] for r in rows if r[0] == 1 and r[1] == 20])
    assert np.allclose(wide[20.0], np.quantile(values, p)) and (wide[50.0].rank() == wide[0.0].rank()).all()
    assert x[(x.cokey == 1) & (x.sim == 99)].v.tolist() == [7.0]


def test_simulation_quality_by_ranks(spark):
    rng = np.random.default_rng(6)
    v = np.append(rng.normal(0, 1, 500), [50.0, float("nan")])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, rng.random(502))], "a double, b double")
    got = {r["property"]: r for r in monte_carlo.quality(df.withColumn("a", F.when(~F.isnan("a"), F.col("a"))), ["a", "b"]).collect()}
    good = v[np.isfinite(v)]
    q1, q3 = np.quantile(good, [0.25, 0.75])
    far = ((good < q1 - 1.5 * (q3 - q1)) | (good > q3 + 1.5 * (q3 - q1))).sum() / 502
    assert got["a"]["finite"] == pytest.approx(501 / 502) and got["a"]["outliers"] == pytest.approx(far) and got["b"]["outliers"] == 0


def test_grids_of_different_steps_are_aligned_and_fused(spark):
    """A plane is the same on any grid; missing cells drop out."""
    coarse, fine = stage_one.Grid(0.0, 0.0, 3.0), stage_one.Grid(1.0, 2.0, 1.0)
    plane = lambda x, y: 2 * x + 3 * y + 100
    rows = [(i, j, *[plane(3 * (i + 0.5), 3 * (j + 0.5)) + d for d in (-10.0, 0.0, 10.0)]) for i in range(6) for j in range(6) if (i, j) != (3, 3)]
    prior = spark.createDataFrame(rows, "x long, y long, a05 double, a50 double, a95 double")
    asked = [(i, j, *[plane(1 + i + 0.5, 2 + j + 0.5) + 6 + d for d in (-5.0, 0.0, 5.0)]) for i in range(1, 13) for j in range(12)] + [(90, 90, 1.0, 2.0, 3.0), (2, 80, None, None, None), (5, 90, None, 1.0, None)]
    seen = spark.createDataFrame(asked, "x long, y long, b05 double, b50 double, b95 double")
    p, q = {0.05: "a05", 0.5: "a50", 0.95: "a95"}, {0.05: "b05", 0.5: "b50", 0.95: "b95"}
    found = {(r["x"], r["y"]): r for r in stage_one.fused(prior, coarse, seen, fine, p, q).collect()}
    assert len(found) == len(asked) and found[90, 90]["route"] == "likelihood" and found[2, 80]["route"] == "none" and found[5, 90]["posterior"] is None
    inner = [r for (x, y), r in found.items() if x < 7 and y < 6]
    assert inner and all(r["route"] == "normal" and r["a50"] == pytest.approx(plane(1 + r["x"] + 0.5, 2 + r["y"] + 0.5)) for r in inner)
    w = 1 / 10**2, 1 / 5**2
    assert all(r["posterior"]["mu"] == pytest.approx(r["a50"] + 6 * w[1] / sum(w)) for r in inner)
    with pytest.raises(ValueError):
        stage_one.onto(prior, coarse, prior, fine, ["a50"])


def test_parts_are_fused_together(spark):
    parts = {p: ((f"{p}_l", f"{p}_r", f"{p}_h"), (f"{p}_a", f"{p}_b", f"{p}_c")) for p in ("clay", "sand", "silt")}
    middle = {"clay": 20.0, "sand": 50.0, "silt": 30.0}
    side = lambda k, shift: spark.createDataFrame([(i, j, *[(middle[p] + s) * w for p, s in zip(middle, shift) for w in (0.8, 1.0, 1.2)]) for i in range(3) for j in range(3)], "x long, y long, " + ", ".join(f"{c} double" for p in parts for c in parts[p][k]))
    out = stage_one.fused_group(side(0, (0, 0, 0)), stage_one.Grid(0, 0, 2), side(1, (4, -4, 0)), stage_one.Grid(1, 1, 1), parts).collect()
    assert len(out) == 9
    for r in out:
        assert r["clay"] + r["sand"] + r["silt"] == pytest.approx(100) and 20 < r["clay"] < 24.5


def test_bootstrap_adds_up_large_groups_without_repeating_rows(spark, monkeypatch):
    rows = [(g, k, float((k * 37 + g) % 101)) for g in (1, 2) for k in range(300)] + [(3, 1, 5.0), (None, 1, 5.0)]
    df = spark.createDataFrame(rows, "g int, k int, v double")
    whole = stats.bootstrap(df, ["g"], "v", ["g", "k"], 100)
    assert "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()
    a = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(stats, "LOT", 50)
    assert np.allclose(a, sorted(map(tuple, stats.bootstrap(df, ["g"], "v", ["g", "k"], 100).collect()))) and [r[:2] for r in a] == [(1, 300), (2, 300), (3, 1)]
    # The first replicate by hand: a Poisson number of four hex digits of the row's MD5.
    text = F.md5(F.concat_ws("|", F.col("g").cast("string"), F.col("k").cast("string"), F.lit("0"), F.lit("1")))
    drawn = df.where("g = 2").withColumn("w", stats.poisson(F.conv(F.substring(text, 1, 4), 16, 10).cast("int")))
    by_hand = drawn.agg(F.sum(F.col("w") * F.col("v")) / F.sum("w")).first()[0]
    one = [r for r in stats.bootstrap(df, ["g"], "v", ["g", "k"], 1).collect() if r["g"] == 2][0]
    assert one["low"] == pytest.approx(by_hand) and one["high"] == pytest.approx(by_hand)


def test_parts_do_not_depend_on_the_order_of_rows(spark):
    x = spark.range(0, 120_000, 1, 6).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 120_000).cast("double").alias("v"))
    x = x.unionByName(spark.createDataFrame([("few", 1.0), ("few", None), (None, 1.0)], "g string, v double"))
    up, down = (stats.parted(x.orderBy(o), ["g"], "v").groupBy("g", "__part").agg(F.min("v"), F.max("v"), F.count("*")) for o in (F.asc("v"), F.desc("v")))
    assert sorted(map(str, up.collect())) == sorted(map(str, down.collect())) and up.where("g = 'g'").count() == 200
    at = stats.positions(x, ["g"], "v")
    assert at.where("g = 'g' and before = v and total = 120000").count() == 120_000 and at.where("g = 'few'").first()[1:] == (1.0, 1, 0, 1)
    assert stats.ranked(x, ["g"], ["v"], "k").where("g = 'g' and k = v + 1").count() == 120_000


def test_quantiles_sort_only_the_parts_that_hold_them(spark):
    x = spark.range(0, 120_001, 1, 6).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 120_001).cast("double").alias("v"))
    got = stats.quantiles_at(x, ["g"], "v", {"a": 0.0, "b": 0.25, "c": 0.3333, "d": 1.0}).first()
    assert got[1:4] == pytest.approx((0.0, 30_000.0, 39_996.0)) and got[4] == 120_000.0
    counts = x.groupBy("g", "v").agg(F.count("*").alias("n"))
    dealt, sizes = stats._sized(counts, ["g"], "v", 200)
    assert sizes.agg(F.sum("__n"), F.max("total")).first()[:] == (120_001, 120_001) and dealt.count() == 120_001


def test_draws_are_summarised_where_horizons_meet(spark):
    from loamcast.operators import simulate

    rows = [(u, c, h, "A", 10.0 * h, 10.0 * h + 10, 1.0 * c if c % 3 else None, 2.0 + c, 9.0 + c + h, 3.0, 5.0 * h, 40.0) for u in (1, 2) for c in range(u * 10, u * 10 + 6) for h in range(3)]
    df = spark.createDataFrame(rows, "mukey int, cokey int, hz int, hzname string, hzdept_r double, hzdepb_r double, a_l double, a_r double, a_h double, b_l double, b_r double, b_h double").repartition(3)
    matrix, config = [[1.0, 0.6], [0.6, 1.0]], monte_carlo.configured(n=7, limits={"b": (6.0, 20.0)}, ordered=(("a", "b"),))
    drawn = monte_carlo.simulate(df, ["a", "b"], matrix, config)
    # The draws are those of one row and expression a realization.
    sides = {p: (f"{p}_l", f"{p}_r", f"{p}_h") for p in "ab"}
    slow = simulate.correlated_triangular(simulate.realizations(monte_carlo.completed(df, ["a", "b"]), 7), ["cokey", "hz", "sim"], sides, matrix)
    slow = simulate.constrained(slow, {"b": (6.0, 20.0)}, [], 100.0, [("a", "b")])
    each = lambda x: sorted(map(tuple, x.select("cokey", "hz", "sim", "a", "b").collect()))
    assert len(each(drawn)) == 252
    assert [v for r in each(drawn) for v in r] == pytest.approx([v for r in each(slow) for v in r], rel=1e-12)
    found = {r["mukey"]: r for r in monte_carlo.summaries(df, ["mukey"], ["a", "b"], [0.05, 0.5, 0.95], matrix, config).collect()}
    for u, part in drawn.toPandas().groupby("mukey"):
        assert found[u]["n"] == 126
        for p in "ab":
            assert found[u][f"{p}_mean"] == pytest.approx(part[p].mean(), rel=1e-12)
            assert found[u][f"{p}_q"] == pytest.approx(part[p].quantile([0.05, 0.5, 0.95]).tolist(), rel=1e-12)


def test_percentile_draws_are_made_in_vectors(spark):
    from loamcast.functions import special

    columns, rng = {0.0: "a", 0.05: "b", 0.5: "c", 0.95: "d", 1.0: "e"}, np.random.default_rng(3)
    rows = []
    for k in range(300):
        v = [*np.sort(rng.normal(50, 20, 5)).tolist(), float(rng.random())]
        rows.append((k % 2, k, *[None if rng.random() < 0.2 else -1.0 if rng.random() < 0.1 else x for x in v[:5]], v[5]))
    x = spark.createDataFrame(rows, "g int, id int, a double, b double, c double, d double, e double, u double").repartition(3)
    found = {m: {r["id"]: r["draw"] for r in percentiles.simulate(x, columns, m, "u").collect()} for m in percentiles.METHODS}
    for r in rows:
        held = [(p, v) for p, v in zip(columns, r[2:7]) if v is not None and v != -1]
        p, v = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        if len(held) < 2:
            assert all(found[m][r[1]] is None for m in percentiles.METHODS)
            continue
        assert found["linear_cdf"][r[1]] == pytest.approx(np.interp(r[7], p, v))
        assert found["spline"][r[1]] == pytest.approx(special.spline_quantile(p, v, np.array([r[7]]))[0])
        gap, k = np.abs(np.diff(v)), len(v)
        wide = np.maximum([gap[0] / 3, *[min(gap[i - 1], gap[i]) / 2 for i in range(1, k - 1)], gap[-1] / 3], 0.1)
        grid = np.linspace(v.min(), v.max(), 512)
        cdf = np.cumsum(sum(np.exp(-0.5 * ((grid - c) / s) ** 2) / s * (2 if i in (0, k - 1) else 1) for i, (c, s) in enumerate(zip(v, wide))))
        assert found["kde"][r[1]] == pytest.approx(np.interp(r[7], cdf / cdf[-1], grid))
        assert (found["normal"][r[1]] is None) == (0.5 not in p or sum(0 < q < 1 and q != 0.5 for q in p) < 2)
    plan = percentiles.compared(x, columns, percentiles.METHODS, "u", ["g"])
    assert {(r["method"], r["g"], r["n"]) for r in plan.collect()} == {(m, g, sum(found[m][i] is not None for i in range(300) if i % 2 == g)) for m in percentiles.METHODS for g in (0, 1)}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # one pass for all methods


def test_quantiles_of_columns_sort_only_their_spans(spark):
    """Exact among ties, both signs, zeros, infinite values and NaN; only the
    spans that hold ranks are sorted, so values are never shuffled by value."""
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(0, 3, 4000), np.full(900, 1.25), [0.0, -0.0, np.inf, -np.inf, 1e300, -1e-300]])
    rng.shuffle(a)
    b = np.where(rng.random(len(a)) < 0.2, np.nan, np.exp(rng.normal(5, 4, len(a))))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(5)
    probs = {"q1": 0.25, "md": 0.5, "q3": 0.75, "top": 0.99}
    got = {r["property"]: r for r in stats.column_quantiles(df.withColumn("b", F.nanvl("b", F.lit(None).cast("double"))), ["a", "b"], probs).collect()}
    for c, v in (("a", a), ("b", b[~np.isnan(b)])):
        for name, p in probs.items():
            assert got[c][name] == pytest.approx(np.quantile(v[np.isfinite(v)] if c == "b" else v, p), rel=1e-12), (c, name)
    sums = {(r["property"], r["low"] <= 1.25 <= r["high"]): r["n"] for r in stats.spans(df.where("a = 1.25"), ["a"]).collect()}
    assert sums == {("a", True): 900}
    inside = stats.spans(df.where("not isnan(a)"), ["a"]).agg(F.sum("n")).first()[0]
    assert inside == len(a)
    q = monte_carlo.quality(df.select("a", F.col("a").alias("c")), ["a", "c"])
    assert "v#" not in "".join(line for line in q._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "span" not in line)
