"""Realism, groups of models, updates and reshaping, on small tables."""

import pytest
from pyspark.sql import functions as F

from loamcast.operators import grouping, realism

LAYER = "k string, hzdept_r double, v double, w double"


def test_layers_transitions_and_jumps(spark):
    x = spark.createDataFrame([("a", 0.0, 1.0, 5.0), ("a", 10.0, 3.0, None), ("a", 40.0, 9.0, 50.0), ("a", None, 1.0, 1.0), ("b", 0.0, None, None)], LAYER)
    found = {r.k: r for r in realism.layers(x, ["k"], {"v": (0.0, 2.0), "w": (0.0, 10.0), "none": (0.0, 1.0)}).collect()}
    assert found["a"].surface == pytest.approx(0.75) and found["a"].subsurface == 0 and found["b"].surface is None
    assert [(r.k, r.transition) for r in realism.transitions(x, ["k"], "v").collect()] == [("a", pytest.approx(0.25))]
    assert [tuple(r) for r in realism.jumps(x, ["k"], "v", (0.0, 5.0), far=1.5).collect()] == [("a", 1, 1, False)]
    assert [tuple(r) for r in realism.steep(x, ["k"], "hzdept_r", "v", 0.19).collect()] == [("a", 2, 2)]
    for empty in (realism.layers, realism.transitions):
        assert empty(x.limit(0), ["k"], {"v": (0.0, 1.0)} if empty is realism.layers else "v").count() == 0


def test_trends_and_compliance(spark):
    x = spark.createDataFrame([("p", "a", i, float(v)) for i, v in enumerate([1, 2, 3, 9])] + [("p", "b", i, float(v)) for i, v in enumerate([1, 3, 1, 3])] + [("p", "c", 0, 1.0)], "p string, g string, i int, v double")
    found = realism.trends(x, ["p", "g"], "i", "v", (0.0, 5.0))
    assert sorted((r.g, r.violations, r.monotone, r.realistic) for r in found.collect()) == [("a", 1, True, False), ("b", 0, False, False), ("c", 0, None, True)]
    assert [(r.violations, round(r.compliance, 6)) for r in realism.compliance(found, ["p"]).collect()] == [(1, 0.333333)]


def test_relationships_and_agreement(spark):
    x = spark.createDataFrame([("a", 40.0, 60.0, 1.0, 5.0, 0.0), ("a", 50.0, None, 2.0, 4.0, 10.0), ("a", 30.0, 68.0, 3.0, 3.0, 20.0), ("b", 1.0, 1.0, 1.0, 1.0, 0.0)], "k string, s double, c double, e double, o double, hzdept_r double")
    found = {r.k: r for r in realism.relationships(x, ["k"], ["s", "c"], ("e", "hzdept_r"), ("o", "hzdept_r")).collect()}
    assert found["a"].texture == pytest.approx(2 / 3) and found["a"].chemical == pytest.approx(1) and found["a"].physical == pytest.approx(1)
    assert found["b"].chemical is None and found["b"].physical is None
    same = realism.agreement(x, x, ["k"], ["e", "o"]).collect()
    assert sorted((r.column, round(r.realism, 6), r.violated) for r in same) == [("e", 1.0, False), ("o", 1.0, False)]


def test_anomalies_integrity_and_scores(spark):
    x = spark.createDataFrame([(float(v), 1.0) for v in [1, 2, 3, 4, 5, 100]], "v double, w double")
    assert sorted((r.column, r.n, r.severity) for r in realism.anomalies(x, ["v", "w"]).collect()) == [("v", 1, "major"), ("w", 0, "none")]
    after = x.withColumn("v", F.when(F.col("v") < 50, F.col("v")))
    assert [tuple(r) for r in realism.integrity(x, after, ["v", "w"]).collect()] == [("v", 6, 6, True, 1), ("w", 6, 6, True, 0)]
    none = F.lit(None).cast("double")
    r = spark.range(1).select(
        realism.integration_score(F.lit(True), none, F.lit(True)).alias("a"), realism.integration_score(F.lit(False), F.lit(2.0), F.lit(False)).alias("b"),
        realism.simulation_score(F.lit(None).cast("boolean"), F.lit(90.0), none).alias("c"), realism.correlation_score(F.lit(0.2), F.lit(1.0)).alias("d"),
        realism.correlation_score(none, none).alias("e"), realism.issues(F.lit(0.5), {"gp": F.lit(True), "mc": F.lit(None).cast("boolean")}).alias("f"),
    ).first()
    assert r.a.score == 1 and r.a.passed and r.b.score == pytest.approx(0.4) and not r.b.passed
    assert r.c == pytest.approx(0.7) and r.d == pytest.approx(0.5) and r.e is None
    assert r.f == ["critical failure in gp", "overall quality score below critical threshold"]


ROWS = [("p%d" % (i % 4), float(i % 3 * 20), "big", "o", 1.0) for i in range(24)] + [("q", 0.0, "small", "o", 1.0), ("q", 5.0, None, None, 1.0), ("z", 0.0, "empty", "u", None)]


def test_groups_and_fallbacks(spark):
    x = spark.createDataFrame(ROWS, "cokey string, hzdept_r double, g string, t string, v double")
    found = {r.level: r for r in grouping.strategies(x, ["g", "t", "none", "absent"], 4, 10, 2).collect()}
    assert {k: (r.adequate, r.chosen) for k, r in found.items()} == {"g": (1, True), "t": (1, False), "none": (1, False)}
    assert found["g"].covered == pytest.approx(100 * 24 / 26)
    placed = grouping.with_fallbacks(x, "g", "v", {"t": "order_", "absent": "none_"}, 4, 10).groupBy("final_group").count().collect()
    assert sorted(map(tuple, placed)) == [("big", 24), ("general_pool", 2), ("order_u", 1)]
    assert [tuple(r) for r in grouping.coverage(x, "g", ["v", "t"], 4, 10).orderBy("column").collect()] == [("t", 1, 1.0, 1, False), ("v", 1, 1.0, 1, False)]
    assert grouping.strategies(x.limit(0), ["g"], 1, 1, 1).count() == 0


def test_matching(spark):
    soils = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", None), (None, "a", None), (1, "a", "x")], "cokey int, compname string, taxorder string")
    models = spark.createDataFrame([("a",), ("o_x",), ("general_pool",), (None,)], "model string")
    found = grouping.matched(soils, "cokey", models, ["compname"], {"taxorder": "o_"})
    by = {r.cokey: r.model for r in found.collect()}
    assert by[1] == "a" and by[2] == "o_x" and by[3] == "general_pool"
    last = grouping.matched(soils, "cokey", models.where("model = 'o_x'"), ["compname"], {})
    assert {r.model for r in last.collect()} == {"o_x"}
    assert {r.model for r in grouping.matched(soils, "cokey", models.limit(0), ["compname"], {}).collect()} == {None}


def test_updates_ratios_and_arrays(spark):
    x = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0), (2, 0, 7.0), (2, 0, 8.0), (3, 0, None)], "cokey int, hzdept_r int, v double")
    changes = spark.createDataFrame([(1, 0, 6.0), (1, 0, 6.5), (1, 1, None), (2, 0, 1.0), (3, 0, 2.0), (9, 9, 9.0)], "cokey int, hzdept_r int, v double")
    assert sorted(map(tuple, grouping.updated(x, changes, ["cokey", "hzdept_r"], ["v"]).collect())) == [(1, 0, 6.5), (1, 1, 5.0), (2, 0, 7.0), (2, 0, 8.0), (3, 0, 2.0)]
    t = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 100.0, 0.5, 0.0, 3.0, None])], "k string, d int, v double")
    assert [r.ratio for r in grouping.ratios(t, ["k"], "d", "v").orderBy("d").collect()] == [1.0, 2.0, 10.0, 0.1, 0.1, 1.0, 1.0]
    draws = spark.createDataFrame([(1, 0, s, float(s), None if s == 2 else 1.0) for s in (3, 1, 2)], "cokey int, hzdept_r int, sim int, v double, w double")
    packed = grouping.arrays(draws, "cokey", ["v", "w"])
    assert [(r.sims, r.v, r.w) for r in packed.collect()] == [([1, 2, 3], [1.0, 2.0, 3.0], [1.0, None, 1.0])]
    assert sorted(map(tuple, grouping.unpacked(packed, "cokey", ["v", "w"]).collect())) == sorted(map(tuple, draws.collect()))


def test_draws_that_follow_trends(spark):
    x = spark.createDataFrame([("a", 0, 10.0, 1.0), ("a", 1, 99.0, 2.0), ("a", 2, 98.0, 200.0), ("a", 3, 7.0, None), ("a", 4, 6.0, 5.0), ("a", 5, 1.0, 10.0), ("b", 0, None, 1.0), ("b", 1, 3.0, 1.0)], "k string, d int, v double, t double")
    assert [r.v if r.v is None else round(r.v, 9) for r in grouping.scaled(x, ["k"], "d", "v", "t").orderBy("k", "d").collect()] == [10.0, 20.0, 200.0, 7.0, 6.0, 12.0, None, None]
    draws = [(1, 0, s, v) for s, v in enumerate([3.0, 1.0, 2.0, 4.0])] + [(1, 5, s, v) for s, v in enumerate([10.0, 20.0, 40.0, 30.0])] + [(1, 5, 9, 50.0), (1, 5, 2, None), (2, 0, 0, None)]
    t = spark.createDataFrame([d for d in draws if d != (1, 5, 2, 40.0)], "k int, d int, s int, v double")
    found = {(r.k, r.d, r.s): r.v for r in grouping.retrofitted(t, "k", "d", "s", "v").collect()}
    values = [10.0, 20.0, 30.0, 50.0]
    at = lambda p: values[int(p * 3)] + (values[min(int(p * 3) + 1, 3)] - values[int(p * 3)]) * (p * 3 - int(p * 3))
    assert found[1, 5, 0] == pytest.approx(at(0.75)) and found[1, 5, 1] == pytest.approx(at(0.25)) and found[1, 5, 3] == pytest.approx(50.0)
    assert found[1, 5, 9] == 50.0 and found[1, 5, 2] is None and found[2, 0, 0] is None and found[1, 0, 0] == 3.0
    assert grouping.retrofitted(t.limit(0), "k", "d", "s", "v").count() == 0
