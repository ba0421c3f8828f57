"""Depth models as tables, their values, and gated reordering."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamcast.functions import hashing
from loamcast.operators import depth_models, gp, grouping, simulate
from loamcast.sources.tables import load, save


def profile_rows():
    rng = np.random.default_rng(1)
    return [(g, k, float(d), 10 + 0.2 * d * (1 if g == "A" else -1) + float(rng.normal(0, 0.3))) for g in ("A", "B") for k in range(4) for d in (0, 10, 25, 50, 80, 120)] + [("C", 9, 0.0, 1.0), ("C", 9, 5.0, 2.0), ("D", 8, 0.0, 3.0), ("D", 8, 9.0, 3.0), ("D", 8, 20.0, 3.0), (None, 7, 0.0, 1.0)]


def test_models_are_written_read_and_evaluated(spark, tmp_path):
    rows = spark.createDataFrame(profile_rows(), "g string, cokey int, depth double, v double")
    save(depth_models.fitted(rows, "g", "depth", "v"), f"{tmp_path}/models.parquet")
    models = load(spark, f"{tmp_path}/models.parquet")
    held = {r["g"]: r for r in models.collect()}
    assert set(held) == {"A", "B"}
    asked = spark.createDataFrame([(g, float(d)) for g in ("A", "B", "Z") for d in (-5, 0, 17, 60, 500)] + [("A", None)], "g string, depth double")
    for r in depth_models.predicted(asked, models, "g", "depth").collect():
        if r["g"] == "Z" or r["depth"] is None:
            assert r["trend"] is None
            continue
        m = held[r["g"]]
        x = np.clip((r["depth"] - m["low"]) / m["span"], 0, 1)
        want = gp.predict({"x": np.array(m["x"]), "alpha": np.array(m["alpha"]), "mean": m["mean"], "length": m["length"], "family": m["family"]}, np.array([x]))[0]
        assert r["trend"] == pytest.approx(want)
        assert abs(r["trend"] - (10 + 0.2 * np.clip(r["depth"], 0, 120) * (1 if r["g"] == "A" else -1))) < 1.5
    assert all(m["rmse"] < 0.5 and m["scale"] > 0 for m in held.values())


def test_profiles_without_data_get_their_matched_model(spark):
    rows = spark.createDataFrame(profile_rows(), "g string, cokey int, depth double, v double")
    models = depth_models.fitted(rows, "g", "depth", "v").withColumnRenamed("g", "model")
    soils = spark.createDataFrame([(1, "A"), (2, "unknown")], "cokey int, g string")
    found = grouping.matched(soils, "cokey", models, ["g"], {})
    out = depth_models.predicted(found.withColumn("depth", F.lit(50.0)), models, "model", "depth").collect()
    assert {r["cokey"]: r["model"] for r in out} == {1: "A", 2: "A"} and all(abs(r["trend"] - 20) < 1.5 for r in out)


def test_local_models_are_of_profiles(spark):
    rows = spark.createDataFrame(profile_rows(), "g string, cokey int, depth double, v double").where("g = 'A'")
    assert depth_models.fitted(rows, "cokey", "depth", "v").count() == 4


def test_correlation_falls_to_its_scale():
    for family, distance in depth_models.FALLS.items():
        assert gp.kernel(np.array([distance]), 1.0, family)[0] == pytest.approx(np.exp(-1), abs=1e-6)


def test_reordering_is_gated_and_takes_ragged_profiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, h, float(d), s, float(a), float(b), 1.0 if h == 3 else 10.0) for k in (1, 2) for h, d in ((1, 0), (2, 10), (3, 20)) for s, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    rows += [(3, h, float(10 * h), s, float(s * h), 1.0, 5.0) for h in (1, 2) for s in range(20 - 5 * h)] + [(3, 2, 20.0, 15, None, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "cokey int, hz int, hzdept_r double, sim int, a double, b double, bound double")
    scales = spark.createDataFrame([(1, 60.0), (3, 60.0)], "cokey int, scale double")
    out = depth_models.reordered(df, ["a", "b"], [[1.0, 0.6], [0.6, 1.0]], scales, "bound").toPandas()
    first = pd.DataFrame(rows, columns=["cokey", "hz", "hzdept_r", "sim", "a", "b", "bound"])
    for (k, h), part in out.groupby(["cokey", "hz"]):
        was = first[(first.cokey == k) & (first.hz == h)]
        assert len(part) == len(was) and np.allclose(np.sort(part.a.dropna()), np.sort(was.a.dropna())) and np.allclose(np.sort(part.b), np.sort(was.b))
    wide = {k: out[out.cokey == k].pivot(index="sim", columns="hz", values="a").corr() for k in (1, 2)}
    assert wide[1].loc[1, 2] == pytest.approx(np.exp(-10 / 60), abs=0.06) and abs(wide[1].loc[2, 3]) < 0.15 and abs(wide[2].loc[1, 2]) < 0.12
    top = out[(out.cokey == 1) & (out.hz == 1)]
    assert top.a.corr(top.b) == pytest.approx(0.6, abs=0.06)
    assert out[(out.cokey == 3) & out.a.isna()].sim.tolist() == [15]


def test_models_are_evaluated_once_a_depth(spark):
    models = depth_models.fitted(spark.createDataFrame([(g, c, 10.0 * k, float(k * k + c + ord(g))) for g in "ab" for c in range(3) for k in range(6)], "g string, cokey int, d double, v double"), "g", "d", "v")
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate([("a", 5.0)] * 40 + [("b", 5.0), ("b", 99.0), ("a", None), (None, 5.0), ("c", 5.0), ("a", 0.0), ("a", -0.0)])], "k int, g string, d double")
    found = depth_models.predicted(rows, models, "g", "d")
    plain = rows.join(models, "g", "left").withColumn("trend", depth_models.trend(F.col("d"))).select("k", "g", "d", "trend")
    key = lambda r: r["k"]
    assert [tuple(r) for r in sorted(found.collect(), key=key)] == [tuple(r) for r in sorted(plain.collect(), key=key)]
    # The kernel sits above the distinct depths, not above the rows.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("aggregate(") < plan.index("RepartitionByExpression")


def test_profiles_are_reordered_a_batch_at_a_time(spark):
    rng = np.random.default_rng(5)
    rows = [(c, h, 10.0 * h, s, float(rng.normal()), float(rng.normal())) for c in range(30) for h in range(1, 2 + c % 5) for s in range(1, 21) if (c, h, s) != (7, 2, 3)]
    df = spark.createDataFrame(rows, "cokey long, hz int, hzdept_r double, sim int, a double, b double")
    matrix = [[1.0, 0.6], [0.6, 1.0]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # batches end within profiles
    try:
        out = gp.reordered(df.repartition(3), ["a", "b"], matrix)
        found = out.toPandas().sort_values(["cokey", "hz", "sim"])
        together = gp.reordered(df.coalesce(1), ["a", "b"], matrix, ordered=True).toPandas().sort_values(["cokey", "hz", "sim"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.array_equal(found[["a", "b"]], together[["a", "b"]]) and len(found) == len(rows)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    given = df.toPandas()
    for c in range(30):
        x, y = found[found.cokey == c], given[given.cokey == c].sort_values(["hz", "sim"])
        if c == 7:  # a depth lacks a draw: as it was
            assert np.array_equal(x[["a", "b"]], y[["a", "b"]])
            continue
        d = np.sort(x.hzdept_r.unique())
        z = gp.joint_normals(gp.depth_correlation(d, 50.0) + 1e-9 * np.eye(len(d)), np.array(matrix), 20, 1 + c)
        for k, name in enumerate("ab"):
            want = np.sort(y[name].to_numpy().reshape(len(d), 20), axis=1)
            assert np.array_equal(x[name].to_numpy(), np.take_along_axis(want, z[:, k, :].argsort(axis=1).argsort(axis=1), axis=1).ravel())


def test_profiles_of_a_batch_are_reordered_alike(spark):
    x = spark.range(40).selectExpr("id as cokey").crossJoin(spark.range(3).selectExpr("cast(id as int) as hz", "id * 10.0D as hzdept_r", "5.0D as bound")).crossJoin(spark.range(1, 9).selectExpr("cast(id as int) as sim"))
    x = x.selectExpr("*", "cast(hash(cokey, hz, sim) as double) as a", "if(sim = 3, null, cast(hash(sim, hz, cokey) as double)) as b").coalesce(1)
    scales = x.where("cokey % 3 != 0").selectExpr("cokey", "20.0D as scale").distinct()
    made = depth_models.reordered(x, ["a", "b"], [[1.0, 0.6], [0.6, 1.0]], scales, "bound")
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()  # no frame a profile
    got = {(r.cokey, r.hz, r.sim): (r.a, r.b) for r in made.collect()}
    alone = {(r.cokey, r.hz, r.sim): (r.a, r.b) for r in depth_models.reordered(x.where("cokey = 7"), ["a", "b"], [[1.0, 0.6], [0.6, 1.0]], scales, "bound").collect()}
    assert len(got) == 960 and len(alone) == 24 and all(got[k] == v for k, v in alone.items())
    was = {(r.cokey, r.hz, r.sim): (r.a, r.b) for r in x.collect()}
    for key in {k[:2] for k in got}:
        assert sorted(v[0] for k, v in got.items() if k[:2] == key) == sorted(v[0] for k, v in was.items() if k[:2] == key)
    assert all((v[1] is None) == (k[2] == 3) for k, v in got.items())


def test_profiles_drawn_where_they_meet_equal_reordered_rows(spark):
    """Profiles of 1 to 5 horizons, one without a scale, one without a value."""
    rng = np.random.default_rng(8)
    rows = [(c, h, 10.0 * h, float(c), None if c == 3 and h == 2 else 5.0 + c + h, float(rng.integers(1, 11)), None if c == 4 else 30.0) for c in range(1, 8) for h in range(1, 2 + c % 5)]
    x = spark.createDataFrame(rows, "cokey long, hz int, hzdept_r double, lo double, hi double, bound double, scale double").repartition(3, "cokey")
    matrix = [[1.0, 0.6], [0.6, 1.0]]
    draws = simulate.correlated_uniforms(simulate.realizations(x, 20), ["cokey", "hz", "sim"], ["a", "b"], matrix)
    draws = draws.select("cokey", "hz", "hzdept_r", "sim", "bound", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("u_a")).alias("a"), F.col("u_b").alias("b"))
    want = depth_models.reordered(draws, ["a", "b"], matrix, x.select("cokey", "scale").distinct(), "bound").toPandas().sort_values(["cokey", "hz", "sim"])
    lower = simulate.cholesky(matrix)

    def make(texts, values):
        u = simulate.mixed(hashing.uniforms(texts, [f"{s}|{n}|1".encode() for s in range(1, 21) for n in "ab"]).reshape(-1, 20, 2), lower)
        lo, hi = values[0][:, None], values[1][:, None]
        return np.stack([lo + (hi - lo) * u[:, :, 0], u[:, :, 1]])

    correlation = lambda depth, v: depth_models.gated_correlation(depth, v[2][:, 0], v[3])
    every = (x, ["lo", "hi", "scale", "bound"], ["a", "b"], make, correlation, matrix, 20)
    got = gp.drawn(*every).toPandas().sort_values(["cokey", "hz", "sim"])
    assert len(got) == 20 * len(rows)
    for c in ("cokey", "hz", "hzdept_r", "sim", "a", "b"):
        assert np.allclose(got[c], want[c], rtol=1e-12, equal_nan=True)
    means = gp.drawn(*every, figures=lambda d: [pa.array(d[1].mean(axis=1))], kinds="m double").toPandas().sort_values(["cokey", "hz"])
    assert np.allclose(means.m, want.groupby(["cokey", "hz"]).b.mean())


def test_copulas_shuffle_rows_once_and_no_draws(spark):
    from loamcast.plans import registry

    plan = lambda name: registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan("depth_copula").count("Exchange") == 1
    # Draws never are rows, and both sides' first shuffles are of the same columns, so they are one.
    gated = plan("gated_copula")
    scans = [line[line.index("[l_orderkey") : line.index("Batched")] for line in gated.splitlines() if "FileScan" in line]
    assert "Generate" not in gated and len({re.sub(r"#\d+L?", "", s) for s in scans}) == 1
