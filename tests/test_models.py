"""Fits, tests of fit, structures, priors, densities and perturbed profiles
against plain numpy."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamcast.functions import special
from loamcast.operators import density, fitting, priors, profiles, simulate, structure


def grouped(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values], "g string, v double").repartition(3)


def loglik(family, x, a, b, low=None, high=None):
    x = np.asarray(x, float)
    if family == "normal":
        return (-0.5 * ((x - a) / b) ** 2 - np.log(b * np.sqrt(2 * np.pi))).sum()
    if family == "lognormal":
        return (-0.5 * ((np.log(x) - a) / b) ** 2 - np.log(b * np.sqrt(2 * np.pi)) - np.log(x)).sum()
    if family == "exponential":
        return (np.log(a) - a * x).sum()
    if family == "gamma":
        return ((a - 1) * np.log(x) - b * x + a * np.log(b) - math.lgamma(a)).sum()
    if family == "weibull":
        return (np.log(a / b) + (a - 1) * np.log(x / b) - (x / b) ** a).sum()
    y = np.clip((x - low) / (high - low), 1e-6, 1 - 1e-6)
    return ((a - 1) * np.log(y) + (b - 1) * np.log1p(-y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)).sum()


def test_fits_have_the_largest_likelihood(spark):
    rng = np.random.default_rng(1)
    groups = {"gamma": rng.gamma(3, 7, 200), "weibull": 20 * rng.weibull(2.5, 200), "beta": 100 * rng.beta(2, 5, 200), "lognormal": np.exp(rng.normal(2, 0.5, 200)), "signed": rng.normal(0, 3, 50), "few": [1, 2, 3], "flat": [5.0] * 9}
    rows = grouped(spark, groups).unionByName(spark.createDataFrame([("gamma", None), ("gamma", float("nan")), (None, 3.0)], "g string, v double"))
    found = {}
    for r in fitting.fitted(rows, ["g"], "v").collect():
        found.setdefault(r["g"], {})[r["family"]] = r
    assert set(found) == set(groups) - {"few"} and set(found["gamma"]) == set(fitting.FAMILIES)
    assert set(found["signed"]) == {"normal", "beta"} and set(found["flat"]) == {"exponential"}
    for g in ("gamma", "weibull", "beta", "lognormal"):
        for family, r in found[g].items():
            x = groups[g]
            best = loglik(family, x, r["a"], r["b"], r["low"], r["high"])
            assert best == pytest.approx(r["loglik"], rel=1e-8) and r["n"] == 200
            assert r["aic"] == pytest.approx(2 * (1 if family == "exponential" else 2) - 2 * best)
            for da, db in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
                assert loglik(family, x, r["a"] * (1 + da), (r["b"] or 0) * (1 + db), r["low"], r["high"]) <= best + 1e-9
        assert [r["place"] for r in sorted(found[g].values(), key=lambda r: r["aic"])] == list(range(1, len(found[g]) + 1))
    assert fitting.fitted(rows.where("false"), ["g"], "v").count() == 0
    with pytest.raises(ValueError):
        fitting.fitted(rows, ["g"], "v", ("normal", "cauchy"))


def test_candidates_follow_the_property():
    assert fitting.candidates("claytotal_r") == ("beta", "normal") and fitting.candidates("ph1to1h2o_r") == ("normal", "gamma")
    assert fitting.candidates("om_r", ("gamma", "beta")) == ("gamma",) and fitting.candidates("sandtotal_r", ("gamma",)) == ("gamma",)


def test_goodness_of_fit_by_hand(spark):
    rng = np.random.default_rng(2)
    groups = {"a": np.round(rng.gamma(3, 7, 150), 0) + 1, "b": 100 * rng.beta(2, 5, 80)}
    rows = grouped(spark, groups)
    fits = fitting.fitted(rows, ["g"], "v")
    params = {(r["g"], r["family"]): r for r in fits.collect()}
    found = fitting.goodness(rows, fits, ["g"], "v").collect()
    assert len(found) == len(params) == 12
    for r in found:
        p, x = params[r["g"], r["family"]], np.sort(groups[r["g"]])
        a, b = p["a"], p["b"]
        cdf = {"normal": lambda v: NormalDist(a, b).cdf(v), "lognormal": lambda v: NormalDist(a, b).cdf(math.log(v)), "exponential": lambda v: 1 - math.exp(-a * v), "weibull": lambda v: 1 - math.exp(-((v / b) ** a)), "gamma": lambda v: special.gamma_cdf(np.array([v * b]), np.array([a]))[0][0], "beta": lambda v: float(special.beta_cdf(np.array([(v - p["low"]) / (p["high"] - p["low"])]), a, b)[0])}[r["family"]]
        f, n, i = np.array([cdf(v) for v in x]), len(x), np.arange(1, len(x) + 1)
        assert r["ks"] == pytest.approx(max((i / n - f).max(), (f - (i - 1) / n).max()), abs=1e-9)
        assert r["cvm"] == pytest.approx(1 / (12 * n) + ((f - (2 * i - 1) / (2 * n)) ** 2).sum(), abs=1e-8)
        assert r["ad"] == pytest.approx(-n - ((2 * i - 1) * (np.log(f) + np.log1p(-f[::-1]))).sum() / n, abs=1e-5)


def test_special_distribution_functions():
    shape, x = np.array([0.3, 1.0, 2.5, 60.0, 400.0]), np.array([0.2, 0.7, 3.0, 55.0, 460.0])
    below, above = special.gamma_cdf(x, shape)
    for a, v, got in zip(shape, x, below):
        t = np.linspace(0, 1, 400_001)[1:]
        y = v * t ** (1 / a if a < 1 else 1.0)  # even steps of the density
        mass = np.exp((a - 1) * np.log(y) - y - math.lgamma(a))
        assert got == pytest.approx(np.trapezoid(np.append(mass[:1], mass), np.append(0, y)), rel=2e-3)
    assert np.allclose(below + above, 1)
    u = np.linspace(0.001, 0.999, 50)
    for a, b in ((0.4, 3), (2, 5), (80, 40)):
        assert np.allclose(special.beta_cdf(special.beta_quantile(u, a, b), a, b), u, atol=1e-9)


def test_structures_and_their_draws(spark):
    rng = np.random.default_rng(3)
    lower = np.linalg.cholesky(np.array([[1, 0.8, -0.4], [0.8, 1, 0], [-0.4, 0, 1]]))
    rows = [("big", *map(float, v)) for v in rng.normal(size=(400, 3)) @ lower.T] + [("small", *map(float, v)) for v in rng.normal(size=(4, 3))] + [("known", 1.0, 1.0, 1.0)] * 9 + [(None, 1.0, 2.0, 3.0), ("big", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double")
    bad = [1.0, 0.9, 0.9, 0.9, 1.0, -0.9, 0.9, -0.9, 1.0]
    references = spark.createDataFrame([("known", bad)], "g string, matrix array<double>")
    found = {r["g"]: r for r in structure.factored(structure.structures(df, ["g"], ["a", "b", "c"], references=references)).collect()}
    assert {g: r["source"] for g, r in found.items()} == {"big": "empirical", "small": "pooled", "known": "reference"}
    x = np.array([r[1:] for r in rows if r[0] == "big" and r[1] is not None])
    assert np.allclose(np.reshape(found["big"]["matrix"], (3, 3)), np.corrcoef(x.T)) and found["big"]["n"] == 400
    fixed, low = np.reshape(found["known"]["matrix"], (3, 3)), np.reshape(found["known"]["lower"], (3, 3))
    assert found["known"]["repaired"] and found["known"]["least"] < 0 and np.allclose(low @ low.T, fixed) and np.allclose(np.diag(fixed), 1)
    factors = structure.factored(structure.structures(df, ["g"], ["a", "b", "c"], references=references))
    draws = spark.createDataFrame([("big", k) for k in range(4000)] + [("none", k) for k in range(4000)], "g string, k int")
    u = structure.drawn(draws, ["g", "k"], ["a", "b", "c"], factors, ["g"]).toPandas()
    z = {g: np.array([[NormalDist().inv_cdf(v) for v in u.loc[u.g == g, f"u_{c}"]] for c in "abc"]) for g in ("big", "none")}
    assert np.abs(np.corrcoef(z["big"]) - np.reshape(found["big"]["matrix"], (3, 3))).max() < 0.06 and np.abs(np.corrcoef(z["none"]) - np.eye(3)).max() < 0.06
    own = structure.empirical(df, ["g"], ["a", "b", "c"])
    mean = structure.combined(own, ["g"], references=references, groups=df).first()
    want = (400 * np.reshape(found["big"]["matrix"], (3, 3)) + 5 * np.reshape(bad, (3, 3))) / 405
    assert mean["method"] == "blended" and mean["n"] == 405 and np.allclose(np.reshape(mean["matrix"], (3, 3)), want)
    alone = structure.structures(df.where("g = 'small'"), ["g"], ["a", "b", "c"]).first()
    assert alone["source"] == "independent" and alone["matrix"] == np.eye(3).ravel().tolist()


def test_reference_matrices_are_embedded():
    known = {"A": np.array([[1, 0.3], [0.3, 1]]), "B": np.array([[1, 0.5], [0.5, 1]])}
    assert structure.embedded(known, ["db", "ph"], ["ph", "x", "db"], "A") == [1, 0, 0.3, 0, 1, 0, 0.3, 0, 1]
    assert structure.embedded(known, ["db", "ph"], ["db", "ph"])[1] == pytest.approx(0.4)
    assert structure.embedded(known, ["db", "ph"], ["db", "x"]) is None and structure.embedded(known, ["db", "ph"], ["db", "ph"], "R") is None


def test_modal_matrices(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "R"), (2, None), (3, "B"), (3, "A")], "cokey int, genhz string")
    matrices = spark.createDataFrame([("A", [1.0]), ("B", [2.0])], "genhz string, matrix array<double>")
    assert {r["cokey"]: (r["genhz"], r["matrix"]) for r in structure.modal_matrix(rows, "cokey", "genhz", matrices).collect()} == {1: ("A", [1.0]), 2: ("A", [1.0]), 3: ("A", [1.0])}


def test_priors_follow_what_was_observed(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0, 30.0), (2, None, 20.0, None), (3, None, None, 5.0), (4, 25.0, 20.0, 22.0), (5, 20.0, 20.0, 20.0), (6, float("nan"), -4.0, 3.0)], "k int, x_l double, x_r double, x_h double")
    z = NormalDist().inv_cdf(0.95)
    normal = {r["k"]: r["prior_x"] for r in priors.fitted(rows, {"x": priors.Setup("normal")}).collect()}
    assert normal[1]["family"] == "normal" and normal[1]["p"] == pytest.approx([20, 10 / z]) and normal[1]["source"] == "triplet"
    assert normal[2]["p"] == pytest.approx([20, 4 / z]) and normal[2]["source"] == "estimated" and normal[3] is None
    assert normal[4]["p"] == pytest.approx([20, 1 / z]) and normal[5]["family"] == "triangular" and normal[6]["p"] == pytest.approx([-4, 3.9 / z], rel=0.02)
    post = {r["k"]: r["prior_x"] for r in priors.fused(priors.fitted(rows, {"x": priors.Setup("normal")}), "x", priors.Observed(mean=24.0, sd=2.0), ["k"]).collect()}
    w = (z / 10) ** 2
    assert post[1]["p"] == pytest.approx([(20 * w + 24 / 4) / (w + 0.25), (w + 0.25) ** -0.5]) and post[1]["source"] == "fused_normal"
    assert post[5]["source"] == "triplet" and post[3] is None
    beta = {r["k"]: r["prior_x"] for r in priors.fused(priors.fitted(rows, {"x": priors.Setup("beta", (0.0, 100.0))}), "x", priors.Observed(shapes=(3.0, 9.0)), ["k"]).collect()}
    first = {r["k"]: r["prior_x"] for r in priors.fitted(rows, {"x": priors.Setup("beta", (0.0, 100.0))}).collect()}
    assert first[1]["family"] == "beta" and len(first[1]["p"]) == 4 and beta[1]["p"] == pytest.approx([first[1]["p"][0] + 2, first[1]["p"][1] + 8, 0, 100])
    sampled = priors.fused(priors.fitted(rows.where("k = 1"), {"x": priors.Setup("normal")}), "x", priors.Observed(sample=tuple(np.random.default_rng(0).normal(26, 2, 400))), ["k"], n=2000)
    got = sampled.first()["prior_x"]
    assert got["family"] == "empirical" and got["source"] == "fused_sample" and np.all(np.diff(got["p"]) >= 0)
    v = (w + 0.25) ** -1
    assert np.mean(got["p"]) == pytest.approx((20 * w + 26 / 4) * v, abs=0.4) and np.std(got["p"]) == pytest.approx(math.sqrt(v), rel=0.25)
    with pytest.raises(ValueError):
        priors.fused(priors.fitted(rows, {"x": priors.Setup()}), "x", priors.Observed(), ["k"])
    with pytest.raises(ValueError):
        priors.fitted(rows, {"x": priors.Setup("cauchy")})


def test_triplets_of_any_shape():
    assert priors.triplet_of({"low": 1, "rep": 2, "high": 3}) == priors.triplet_of({"l": 1, "r": 2, "h": 3}) == priors.triplet_of([1, 2, 3]) == (1, 2, 3)
    assert priors.triplet_of(list(range(101))) == (5, 50, 95)


def test_draws_of_priors(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0, 40.0)], "k int, x_l double, x_r double, x_h double").withColumns({f"y_{c}": F.col(f"x_{c}") for c in "lrh"})
    setups = {"x": priors.Setup("beta", (0.0, 100.0)), "y": priors.Setup("metalog")}
    draws = priors.simulated(priors.fitted(rows, setups), {k: priors.outcomes(s) for k, s in setups.items()}, ["k"], 3000, [[1, 0.7], [0.7, 1]]).toPandas()
    a, b = special.beta_fit(np.array([[10.0, 20.0, 40.0]]), 0, 100)
    assert draws.x.mean() == pytest.approx(100 * a[0] / (a[0] + b[0]), rel=0.03) and draws.x.between(0, 100).all()
    assert np.quantile(draws.y, [0.05, 0.5, 0.95]) == pytest.approx([10, 20, 40], rel=0.08) and draws.x.rank().corr(draws.y.rank()) > 0.6


def test_posterior_samples_are_the_product(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(10, 2, 500), rng.normal(13, 1, 500)
    rows = [(1, a.tolist(), b.tolist()), (2, [1.0, None, float("nan")], [1.0, 2.0]), (3, None, [1.0]), (4, [0.0, 1.0], [900.0, 901.0]), (5, [], [2.0])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    found = {r["k"]: r["p"] for r in density.posterior_samples(df.repartition(4), "a", "b", "p", ["k"], 4000).collect()}
    again = {r["k"]: r["p"] for r in density.fused_property(df.repartition(1), "a", "b", ["k"], name="p", n=4000).collect()}
    assert found == again and len(found[1]) == 4000 and found[3] is None and found[5] is None and len(found[2]) == 4000
    grid = np.linspace(5, 18, 20_001)
    kernel = lambda x: np.exp(-0.5 * ((grid[:, None] - x) / density.bandwidths(x[None, :])) ** 2).sum(axis=1)
    w = kernel(a) * kernel(b)
    mean = (w * grid).sum() / w.sum()
    assert np.mean(found[1]) == pytest.approx(mean, abs=0.02) and np.std(found[1]) == pytest.approx(math.sqrt((w * (grid - mean) ** 2).sum() / w.sum()), rel=0.03)
    assert set(found[4]) == {450.5}
    closed = spark.createDataFrame([((10.0, 2.0), (13.0, 1.0))], "a struct<mean: double, sd: double>, b struct<mean: double, sd: double>")
    assert density.fused_property(closed, "a", "b", [], "normal").first()["posterior"]["mu"] == pytest.approx(12.4)
    for bad in (lambda: density.fused_property(df.withColumn("b", F.struct("k")), "a", "b", ["k"]), lambda: density.fused_property(df, "a", "b", ["k"], method="closed_form"), lambda: density.fused_property(closed, "a", "b", [])):
        with pytest.raises(ValueError):
            bad()


def test_perturbed_layers(spark):
    rows = [(k, s, h, t, b, 2.0, 3.0) for k in (1, 2) for s in range(300) for h, t, b in ((1, 0.0, 10.0), (2, 10.0, 30.0), (3, 30.0, 80.0))] + [(3, 0, 1, 5.0, 9.0, None, None), (3, 0, 2, 9.0, 9.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cokey int, sim int, hz int, top double, bottom double, thickness_sd double, bound_sd double")
    x = profiles.perturbed(df.repartition(5), ["cokey", "sim"]).toPandas().sort_values(["cokey", "sim", "hz"])
    assert len(x) == len(rows) and (x.bottom - x.top >= 1).all()
    inner = x[x.cokey < 3]
    assert (inner.groupby(["cokey", "sim"]).top.shift(-1).dropna() == inner.groupby(["cokey", "sim"]).bottom.shift(0)[inner.hz < 3]).all() and (inner[inner.hz == 1].top == 0).all()
    last = inner[inner.hz == 3].bottom - 80
    assert abs(last.mean()) < 0.5 and last.std() == pytest.approx(math.sqrt(3 * 4 + 9), rel=0.12)
    assert x[x.cokey == 3][["top", "bottom"]].to_numpy().tolist() == [[5, 9], [9, 10]]


def test_simulated_and_perturbed_profiles(spark):
    rows = [(1, 1, "A", "A", 0.0, 10.0), (1, 2, "Bt", "B", 10.0, 40.0), (1, 3, "C", "C", 40.0, 90.0), (2, 1, "R", "R", 0.0, 20.0), (3, 1, "A", "A", 0.0, 8.0)]
    df = spark.createDataFrame(rows, "cokey int, hz int, hzname string, genhz string, hzdept_r double, hzdepb_r double")
    for c in ("hzdept", "hzdepb"):
        df = df.withColumns({f"{c}_l": F.greatest(F.col(f"{c}_r") - 4, F.lit(0.0)), f"{c}_h": F.col(f"{c}_r") + 4})
    df = df.withColumn("distinctness", F.lit(None).cast("string"))
    counts = spark.createDataFrame([(1, 200), (2, 3), (3, 0)], "cokey int, sim_comppct int")
    x = profiles.perturbed_profiles(df, counts).toPandas()
    assert x.groupby("cokey").sim.nunique().to_dict() == {1: 200, 2: 3} and (x.bottom >= x.top).all()
    assert (x[x.cokey == 2].bottom == 20).all() and x[(x.cokey == 1) & (x.hz == 1)].bottom.std() > 0.5
    ranges = df.toPandas().set_index(["cokey", "hz"])
    for r in x.itertuples():
        assert r.top >= ranges.loc[(r.cokey, r.hz), "hzdept_l"] and r.bottom <= max(r.top, ranges.loc[(r.cokey, r.hz), "hzdepb_h"])


def test_component_counts(spark):
    rows = spark.createDataFrame([(1, 10.0, 20.0, 30.0), (1, 10.0, 20.0, 30.0), (2, None, 5.0, None)], "cokey int, pct_l double, pct_r double, pct_h double")
    found = dict(map(tuple, simulate.component_counts(rows).collect()))
    assert found[1] == pytest.approx(200, abs=3) and found[2] == pytest.approx(50, abs=1)


def test_bounds_of_series_are_attached(spark):
    horizons = spark.createDataFrame([("Alpha", "A", "A"), ("alpha", "Bt", "B"), ("beta", "A", "A")], "compname string, hzname string, genhz string")
    series = spark.createDataFrame([("ALPHA", "A1", "A", "abrupt"), ("ALPHA", "A2", "A", "diffuse"), ("ALPHA", "B", "B", None)], "compname string, hzname string, genhz string, distinctness string")
    assert [r["bound_sd"] for r in profiles.attach_bounds(horizons, series).orderBy("compname", "genhz").collect()] == [5.5, 7.5, None]


def test_profiles_meet_before_they_are_repeated(spark):
    rows = [(c, h, 10.0 * (h - 1), 10.0 * h, 10.0 * (h - 1) - 1 if h % 2 else None, 10.0 * h + 3) for c in range(40) for h in range(1, 2 + c % 4)]
    df = spark.createDataFrame(rows, "cokey long, hz int, hzdept_r double, hzdepb_r double, hzdept_l double, hzdepb_h double").withColumns({"hzdept_h": F.col("hzdept_r") + 2, "hzdepb_l": F.col("hzdepb_r") - 4})
    from loamcast.operators import simulate

    for method in ("top_down", "bottom_up", "mixed"):
        before = profiles.simulated(simulate.realizations(df, 6), ["cokey", "sim"], method)
        plain = profiles.clipped(before, profiles.with_variability(df), ["cokey", "hz"]).select("cokey", "sim", "method", "hz", "top", "bottom")
        once = profiles.simulated(df, ["cokey"], method, 6, held=True)
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.collect()))
        assert sorted(map(tuple, profiles.simulated(df, ["cokey"], method, 6).collect())) == sorted(map(tuple, before.select("cokey", "sim", "method", "hz", "top", "bottom").collect()))
    # Only horizons are shuffled, none of their repetitions.
    plan = profiles.thickness_spread(once, ["cokey"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_structures_keep_groups_without_spread(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16, 3))
    x[:8, 2] = 4.0
    df = spark.createDataFrame([("flat" if k < 8 else "own", *map(float, v)) for k, v in enumerate(x)], "g string, a double, b double, c double")
    r = float(np.corrcoef(x[:8, 0], x[:8, 1])[0, 1])
    got = {v["g"]: v for v in structure.factored(structure.structures(df, ["g"], ["a", "b", "c"], flat=True)).collect()}
    assert {g: (v["source"], v["n"], v["repaired"]) for g, v in got.items()} == {"flat": ("empirical", 8, False), "own": ("empirical", 8, False)}
    nan = float("nan")
    assert np.allclose(got["flat"]["matrix"], [1, r, nan, r, 1, nan, nan, nan, 1], equal_nan=True)
    assert np.allclose(got["flat"]["lower"], [1, 0, 0, r, np.sqrt(1 - r * r), 0, nan, nan, nan], equal_nan=True)
    own = structure.empirical(df, ["g"], ["a", "b", "c"], flat=True)
    mean = structure.combined(own, ["g"]).first()
    assert mean["n"] == 16 and np.isnan(mean["matrix"][2]) and mean["matrix"][1] == pytest.approx((r + np.corrcoef(x[8:, 0], x[8:, 1])[0, 1]) / 2)


def test_profiles_are_repeated_in_vectors(spark):
    rows = [(c, h, "ABC"[h % 3], 10.0 * (h - 1), 10.0 * h, 10.0 * (h - 1) - 1 if c % 2 else None, 10.0 * h + 3, 1.5 if h % 2 else None, 2.0 if c % 3 else 0.0) for c in range(30) for h in range(1, 2 + c % 4)]
    df = spark.createDataFrame(rows, "cokey long, hz int, genhz string, hzdept_r double, hzdepb_r double, hzdept_l double, hzdepb_h double, thickness_sd double, bound_sd double").withColumns({"hzdept_h": F.col("hzdept_r") + 2, "hzdepb_l": F.col("hzdepb_r") - 4, "hzname": F.lit("x"), "distinctness": F.lit(None).cast("string")})
    counts = spark.createDataFrame([(c, c % 7) for c in range(29)], "cokey long, sim_comppct long")
    layers = df.select("cokey", "hz", F.col("hzdept_r").alias("top"), F.col("hzdepb_r").alias("bottom"), "thickness_sd", "bound_sd")
    each = lambda x: sorted(map(tuple, x.select("cokey", "sim", "hz", "top", "bottom").collect()))
    fast = profiles.perturbed_counts(layers, counts, ["cokey"])
    assert each(fast) == each(profiles.perturbed(profiles.replicated(layers, counts), ["cokey", "sim"])) and fast.count() > 100
    # As by joins and folds over repeated horizons.
    base = profiles.with_distinctness(profiles.with_variability(df)).drop("thickness_sd")
    many = base.where("cokey % 4 > 0")
    spread = profiles.thickness_spread(profiles.simulated(profiles.replicated(many, counts), ["cokey", "sim"]), ["cokey"])
    bounds = many.groupBy("cokey", "genhz").agg(F.avg("bound_sd").alias("bound_sd"))
    sds = many.select("cokey", "hz", "genhz").join(bounds, ["cokey", "genhz"]).join(spread, ["cokey", "hz"], "left").drop("genhz")
    slow = profiles.replicated(layers.drop("thickness_sd", "bound_sd").join(sds, ["cokey", "hz"], "left"), counts)
    slow = profiles.clipped(profiles.perturbed(slow, ["cokey", "sim"]), base, ["cokey", "hz"]).withColumn("bottom", F.greatest("top", "bottom"))
    found = profiles.perturbed_profiles(df, counts)
    assert each(found) == each(slow)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan


def test_map_units_without_spread_have_no_correlation(spark, tmp_path):
    """Prices of 0 give draws without spread, on which corr() is an error."""
    from loamcast.plans import registry

    lines = [(o, 1, o, o % 2, 5.0 + o, 30_000.0 + 900 * o if o % 2 else 0.0, 0.05, 0.02, "A") for o in range(12)]
    cols = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, cols).withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["mukey"]: r for r in registry.QUERIES["prior_samples"](spark, str(tmp_path)).collect()}
    assert found[0]["ae"] is None and found[0]["c"] == 0 and 0.2 < found[1]["ae"] < 0.7
    drawn = {r["mukey"]: r for r in registry.QUERIES["prior_draws"](spark, str(tmp_path)).collect()}
    assert np.isnan(drawn[0]["cd"]) and drawn[0]["n"] == 1000 and 0.2 < drawn[1]["ab"] < 0.7


def test_mixed_spread_equals_the_spread_of_simulated_layers(spark):
    """Profiles of 1 to 4 horizons, missing depths, and a horizon that stands
    twice; layers are never rows."""
    rng = np.random.default_rng(12)
    rows = [(c, h, None if (c + h) % 3 == 0 else 20.0 * h - 3, 20.0 * h, 20.0 * h + 4, None if h == 1 else 20.0 * h + 17, 20.0 * h + 20, 20.0 * h + float(rng.integers(20, 29))) for c in range(40) for h in range(1, 2 + c % 4)]
    rows += [(3, 2, 37.0, 40.0, 44.0, 55.0, 60.0, 61.0), (50, 1, None, None, None, None, None, None)]
    x = spark.createDataFrame(rows, "cokey long, hz int, hzdept_l double, hzdept_r double, hzdept_h double, hzdepb_l double, hzdepb_r double, hzdepb_h double")
    got = profiles.mixed_spread(x, ["cokey"], 20)
    want = profiles.thickness_spread(profiles.simulated(x, ["cokey"], "mixed", 20, held=True), ["cokey"])
    key = lambda r: (r["cokey"], r["hz"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_perturbed_profiles_are_summed_where_they_are_made(spark):
    rows = [(c, h, 10.0 * (h - 1), 10.0 * h, 1.5 if h % 2 else None, 2.0) for c in range(20) for h in (1, 2, 2, 3)[: 1 + c % 4]]
    layers = spark.createDataFrame(rows, "cokey long, hz int, top double, bottom double, thickness_sd double, bound_sd double")
    counts = spark.createDataFrame([(c, c % 6) for c in range(19)], "cokey long, sim_comppct long")
    figures = lambda top, bottom, first, own: (np.add.reduceat(bottom.sum(axis=1), first), profiles.sd_at(bottom, first, own))
    got = profiles.perturbed_counts(layers, counts, ["cokey"], figures=figures, kinds="total double, sd double")
    want = profiles.perturbed_counts(layers, counts, ["cokey"]).groupBy("cokey", "hz").agg(F.sum("bottom").alias("total"), F.stddev_samp("bottom").alias("sd"))
    each = lambda x: sorted(x.select("cokey", "hz", "total", F.round("sd", 9)).collect(), key=lambda r: (r[0], r[1]))
    assert each(got) == each(want) and got.count() > 20


def test_sums_of_triangular_draws(spark):
    """Also where low, mode and high are equal, crossed or missing."""
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**32, (5, 400), dtype=np.uint32)
    lo, mode, hi = np.array([[1.0, 3.0, 4.0], [2.0, 2.0, 2.0], [5.0, 4.0, 7.0], [1.0, 9.0, 7.0], [np.nan, 1.0, 2.0]]).T
    u = (words.byteswap() + 0.5) / 2.0**32
    want = np.array([[simulate.triangular_at(*(np.array([x]) for x in (lo[i], mode[i], hi[i])), np.array([v]))[0] for v in u[i]] for i in range(5)]).sum(axis=1)
    assert np.allclose(simulate._triangular_sums(words, lo, mode, hi), want, equal_nan=True, rtol=1e-12)
