import hashlib

import numpy as np
from pyspark.sql import functions as F

from loamcast.functions import hashing
from loamcast.functions.normal import uniform
from loamcast.operators import simulate


def test_digests():
    keys, endings = [b"", b"7|", b"123456|", b"k" * 50 + b"|", b"k" * 70, "é|".encode()], [b"1|1", b"10|1", b"1000|12"]
    words = hashing.md5_words(keys, endings)
    assert all(words[i, j].tobytes() == hashlib.md5(k + e).digest() for i, k in enumerate(keys) for j, e in enumerate(endings))
    assert hashing.md5_words([], endings).shape == (0, 3, 4)


def test_counts_are_those_of_expressions(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (22, None, 3.0, None), (333, 4.0, 4.0, 4.0), (4, 1.0, None, 2.0), (None, 1.0, 6.0, 9.0), (22, None, 3.0, None)], "cokey long, pct_l double, pct_r double, pct_h double")
    lo, hi = F.coalesce("pct_l", F.col("pct_r") - 2), F.coalesce("pct_h", F.col("pct_r") + 2)
    drawn = simulate.realizations(rows.distinct(), 200).withColumn("v", simulate.quantile_triangular(lo, F.col("pct_r"), hi, uniform(F.col("cokey"), F.col("sim"), 1)))
    plain = drawn.groupBy("cokey").agg(F.bround(F.sum("v") / 100, 0).cast("long").alias("n"))
    counted = simulate.component_counts(rows, 200)
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in plain.collect()}
    # Draws are made in vectors, not a row each.
    assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_copulas_and_priors_in_vectors(spark):
    from loamcast.functions.normal import pnorm_at, pnorm_sql, qnorm_at, qnorm_sql, uniform
    from loamcast.operators import priors, simulate

    df = spark.range(300).select((F.col("id") + 1).cast("double").alias("v"), ((F.col("id") + 0.5) / 300).alias("u"), F.col("id").alias("k"))
    got = df.select(F.expr(qnorm_sql("u")).alias("q"), F.expr(pnorm_sql("(u - 0.5) * 12")).alias("p"), "u").toPandas()
    assert np.allclose(got.q, qnorm_at(got.u.to_numpy()), rtol=1e-12) and np.allclose(got.p, pnorm_at((got.u.to_numpy() - 0.5) * 12), rtol=1e-12)
    drawn = simulate.correlated_uniforms(df, ["k"], ["a", "b"], [[1.0, 0.5], [0.5, 1.0]], 3)
    assert "lambda" not in (plan := drawn._jdf.queryExecution().executedPlan().toString()) and "md5" not in plan
    x = drawn.withColumns({"ea": uniform(F.col("k"), "a", 3), "eb": uniform(F.col("k"), "b", 3)}).toPandas()
    z = np.stack([qnorm_at(x.ea.to_numpy()), qnorm_at(x.eb.to_numpy())])
    assert np.allclose(x.u_a, pnorm_at(z[0])) and np.allclose(x.u_b, pnorm_at(0.5 * z[0] + np.sqrt(0.75) * z[1]))
    params = {"triangular": [1.0, 2.0, 4.0], "uniform": [1.0, 3.0], "normal": [5.0, 2.0], "lognormal": [1.0, 0.2], "linear_cdf": [1.0, 2.0, 5.0], "metalog": [2.0, 0.3, 0.1, 0.0], "empirical": [1.0, 2.0, 4.0, 8.0], "beta": [2.0, 3.0, 0.0, 10.0]}
    rows = spark.createDataFrame([(k, (f, p, "s")) for k, (f, p) in enumerate(params.items())] + [(99, None)], f"k int, prior_a {priors.PRIOR}")
    out = priors.simulated(rows, {"a": tuple(params)}, ["k"], 40, [[1.0]])
    want = rows.crossJoin(spark.range(1, 41).withColumnRenamed("id", "sim")).withColumn("e", uniform(F.col("k"), F.col("sim"), "a", 1))
    want = want.withColumn("z", F.expr(qnorm_sql("e"))).withColumn("u", F.expr(pnorm_sql("z")))
    want = want.withColumn("v", priors.quantile(F.col("prior_a"), "u", tuple(params))).select("k", "sim", "v")
    both = out.join(want, ["k", "sim"]).toPandas()
    assert len(both) == 360 and both[both.k == 99].a.isna().all()
    held = both[both.k != 99]
    off = {k: float((x.a / x.v - 1).abs().max()) for k, x in held.groupby("k")}
    assert len(held) == 320 and max(off.values()) < 1e-7, off
