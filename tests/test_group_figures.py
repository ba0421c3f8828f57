"""Figures of few groups joined with many rows, and densities in vectors."""

import numpy as np
import pytest

from loamcast.operators import cells, checks, horizons, infill, stats


def broadcasts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")


def test_small_groups_are_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 3.0)], "g string, v double")
    assert broadcasts(rows.join(stats.small(rows.groupBy("g").count(), rows, ["g"]), "g")) == 1
    monkeypatch.setattr(stats, "FEW", 2)
    assert broadcasts(rows.join(stats.small(rows.groupBy("g").count(), rows, ["g"]), "g")) == 0


def test_normalized_rows_are_not_gathered_by_group(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 10)] + [("b", None), (None, 3.0)], "g string, v double")
    found = stats.normalized(rows, ["g"], "v")
    assert broadcasts(found) > broadcasts(stats.positions(rows, ["g"], "v")) + broadcasts(stats.quantiles_at(rows, ["g"], "v", {"md": 0.5}))
    got = sorted((r.v, r.scaled, r.robust, r.ecdf) for r in found.where("g = 'a'").collect())
    assert got == [(v, pytest.approx((v - 1) / 9), pytest.approx((v - 3) / 2), pytest.approx((i + 1) / 5)) for i, v in enumerate((1, 2, 3, 4, 10))]


def test_ladder_rows_are_not_gathered_by_name(spark):
    rows = spark.createDataFrame([(i, 1, "A", 10.0, float(i)) for i in range(5)] + [(9, 2, "A", 10.0, None), (9, 2, "B", 50.0, None)], "cokey int, mukey int, genhz string, mid double, v double")
    found = horizons.ladder_infill(rows, "v")
    assert broadcasts(found) > broadcasts(stats.quantiles_at(rows, ["genhz"], "v", {"m": 0.5}))
    assert sorted((r.genhz, r.filled, r.rung) for r in found.where("cokey = 9").collect()) == [("A", 2.0, "all"), ("B", None, None)]


def test_bounded_rows_are_not_gathered_by_name_or_zone(spark):
    rows = spark.createDataFrame([("A", 20.0, 10.0, 12.0, 16.0, True)] * 3 + [("B", 20.0, None, 30.0, None, True)], "hzname string, hzdepb_r double, v_l double, v_r double, v_h double, suitable boolean")
    found = infill.with_bounds(rows, "v", "claytotal")
    assert broadcasts(found) >= 3 + sum(broadcasts(x) for x in infill.learned_spreads(rows, "v").values())
    assert [(r.v_l, r.v_h, r.spread_from) for r in found.where("hzname = 'B'").collect()] == [(28.0, 34.0, "zone")]


def test_spread_coverage_reads_counts(spark):
    values = [*range(1, 20), 100, 100]
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("b", 5.0), ("c", None), (None, 1.0)], "g string, v double")
    found = checks.spread_coverage(rows, ["g"], "v")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "avg(" not in plan and broadcasts(found) > 0  # no second pass over rows
    got = {r.g: (r.spread, r.outliers, r.adequate) for r in found.collect()}
    a, d = np.percentile(values, [5, 95])
    assert got == {"a": (pytest.approx((d - a) / 99), pytest.approx(100 * 2 / 21), True), "b": (0.0, 0.0, True)}


def test_bandwidths_of_many_cells_are_those_of_each():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(5, 2, (20, 50)), np.zeros((1, 50)), np.full((1, 50), 7.0), np.repeat([[3.0] * 49 + [9.0]], 1, axis=0)])
    assert cells.bandwidths(x) == pytest.approx([cells.bandwidth(row) for row in x])
    a, b = x[0], x[1] + 1
    grid = np.linspace(-10, 20, 20_001)
    product = np.prod([np.exp(-0.5 * ((grid[:, None] - s) / cells.bandwidth(s)) ** 2).sum(axis=1) for s in (a, b)], axis=0)
    mean = float(grid @ product / product.sum())
    got = cells.kde_posterior(a, b, widths=(cells.bandwidth(a), cells.bandwidth(b)))
    assert got == pytest.approx(cells.kde_posterior(a, b)) and got[0] == pytest.approx(mean, rel=1e-4)
