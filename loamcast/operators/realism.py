"""Whether simulated properties are what soils can have: ranges, layers,
relationships, depth trends, and scores of all of these.

All checks are aggregates; what they return is as small as their keys. Nulls
count neither for nor against; a figure that has nothing to rest on is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

# The ranges and gradients (change a centimetre) that properties keep to.
RANGES = {
    "clay_total": (0.0, 100.0), "sand_total": (0.0, 100.0), "silt_total": (0.0, 100.0), "ph": (2.5, 11.0), "bulk_density": (0.3, 3.0),
    "water_retention_third_bar": (0.0, 70.0), "water_retention_15_bar": (0.0, 50.0), "om": (0.0, 50.0), "cec": (0.0, 200.0), "rfv": (0.0, 95.0),
}
GRADIENTS = {"clay_total": 5.0, "sand_total": 5.0, "ph": 0.5, "bulk_density": 0.2}

Ranges = dict[str, tuple[float, float]]


def _mean(parts: list[Column]) -> Column:
    """Mean of the figures that are there, null without any."""
    held = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.aggregate(held, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(held), F.lit(0))


def _in_range(column: str, bounds: tuple[float, float]) -> Column:
    return F.col(column).between(*bounds).cast("double")


def layers(rows: DataFrame, keys: list[str], ranges: Ranges, depth: str = "hzdept_r", shallow: float = 30.0) -> DataFrame:
    """(keys, surface, subsurface): the mean share of the properties' values
    within their ranges, in the layers that begin at `shallow` or above it and
    in those below. Columns that the rows lack are left out."""
    names = [c for c in ranges if c in rows.columns]
    share = lambda place: _mean([F.avg(F.when(place, _in_range(c, ranges[c]))) for c in names]) if names else F.lit(None).cast("double")
    return rows.groupBy(*keys).agg(share(F.col(depth) <= shallow).alias("surface"), share(F.col(depth) > shallow).alias("subsurface"))


def _steps(rows: DataFrame, keys: list[str], value: str, depth: str) -> DataFrame:
    """(keys, depth, v, step) of the means at each depth, and their change
    from the depth above. A window holds the depths of a group, not its rows."""
    means = rows.where(F.col(depth).isNotNull()).groupBy(*keys, depth).agg(F.avg(value).alias("v")).where("v is not null")
    return means.withColumn("step", F.col("v") - F.lag("v").over(Window.partitionBy(*keys).orderBy(depth)))


def transitions(rows: DataFrame, keys: list[str], value: str, depth: str = "hzdept_r") -> DataFrame:
    """(keys, transition): one less the largest step between the means of
    neighbouring depths, as a share of their range; groups of one depth drop
    out."""
    found = _steps(rows, keys, value, depth).groupBy(*keys).agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.max(F.abs("step")).alias("most")).where("most is not null")
    span = F.col("hi") - F.col("lo")
    return found.select(*keys, F.when(span > 0, F.greatest(1 - F.col("most") / span, F.lit(0.0))).otherwise(1.0).alias("transition"))


def jumps(rows: DataFrame, keys: list[str], value: str, bounds: tuple[float, float] | None = None, depth: str = "hzdept_r", far: float = 3.0) -> DataFrame:
    """(keys, extreme, outside, realistic) of groups of three depths and more:
    how many steps of the mean trend exceed `far` standard deviations of them
    all, and how many means are out of bounds."""
    steps = _steps(rows, keys, value, depth)
    spread = steps.groupBy(*keys).agg(F.stddev_samp("step").alias("sd"), F.count("*").alias("n")).where("n >= 3")
    outside = F.lit(False) if bounds is None else ~F.col("v").between(*bounds)
    found = steps.join(spread, keys).groupBy(*keys).agg(F.count_if(F.abs("step") > far * F.nullif("sd", F.lit(0.0))).alias("extreme"), F.count_if(outside).alias("outside"))
    return found.withColumn("realistic", (F.col("extreme") == 0) & (F.col("outside") == 0))


def steep(rows: DataFrame, keys: list[str], order: str, value: str, most: float) -> DataFrame:
    """(keys, steps, steep): steps along the order, and those whose change a
    unit of it exceeds `most`; steps of no length don't count."""
    by = Window.partitionBy(*keys).orderBy(order)
    x = rows.where(F.col(value).isNotNull() & F.col(order).isNotNull())
    x = x.select(*keys, (F.abs(F.col(value) - F.lag(value).over(by)) / F.nullif(F.col(order) - F.lag(order).over(by), F.lit(0))).alias("g")).where("g is not null")
    return x.groupBy(*keys).agg(F.count("*").alias("steps"), F.count_if(F.col("g") > most).alias("steep"))


def trends(rows: DataFrame, keys: list[str], order: str, value: str, bounds: tuple[float, float], tolerance: float = 0.3) -> DataFrame:
    """(keys, violations, monotone, realistic) of predicted trends: values out
    of bounds, whether at least 1 - tolerance of the steps go one way, and
    whether nothing speaks against the trend. Trends of one point have no
    monotone."""
    by = Window.partitionBy(*keys).orderBy(order)
    x = rows.withColumn("step", F.col(value) - F.lag(value).over(by))
    up, down = F.count_if(F.col("step") > 0), F.count_if(F.col("step") < 0)
    one_way = F.greatest(up, down) / F.nullif(F.count("step"), F.lit(0)) >= 1 - tolerance
    found = x.groupBy(*keys).agg(F.count_if(~F.col(value).between(*bounds)).alias("violations"), one_way.alias("monotone"))
    return found.withColumn("realistic", (F.col("violations") == 0) & F.coalesce("monotone", F.lit(True)))


def compliance(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, violations, compliance) of trends(): all violations, and the
    share of realistic trends."""
    return found.groupBy(*keys).agg(F.sum("violations").alias("violations"), F.avg(F.col("realistic").cast("double")).alias("compliance"))


def relationships(rows: DataFrame, keys: list[str], parts: list[str], rising: tuple[str, str], falling: tuple[str, str], total: float = 100.0, within: float = 5.0) -> DataFrame:
    """(keys, texture, chemical, physical): the share of rows whose parts add
    up to the total, and how far a pair of columns rises, another falls
    together, from 0 to 1. Pairs that don't vary, or with fewer than three
    rows, have none. A missing part counts as 0."""
    whole = reduce(lambda t, c: t + F.coalesce(F.col(c), F.lit(0.0)), parts[1:], F.coalesce(F.col(parts[0]), F.lit(0.0)))

    def r(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        value = F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))
        varies = (F.stddev_samp(F.when(both, F.col(a))) > 0) & (F.stddev_samp(F.when(both, F.col(b))) > 0)
        return F.when((F.count_if(both) >= 3) & varies, value)

    return rows.groupBy(*keys).agg(F.avg((F.abs(whole - total) <= within).cast("double")).alias("texture"), ((r(*rising) + 1) / 2).alias("chemical"), ((1 - r(*falling)) / 2).alias("physical"))


def agreement(simulated: DataFrame, observed: DataFrame, keys: list[str], columns: list[str], depth: str = "hzdept_r") -> DataFrame:
    """(keys, column, r, realism, violated): how the simulated means at the
    depths that both tables hold follow the observed ones; of three depths and
    more, where both vary."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        means = rows.where(F.col(depth).isNotNull()).groupBy(*keys, depth).agg(*[F.avg(c).alias(c) for c in columns])
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(name)) for c in columns])
        return means.select(*keys, depth, F.explode(pairs).alias("x")).select(*keys, depth, "x.*").where(f"{name} is not null")

    both = side(simulated, "s").join(side(observed, "o"), [*keys, depth, "column"])
    found = both.groupBy(*keys, "column").agg(F.count("*").alias("n"), F.stddev_samp("s").alias("sd_s"), F.stddev_samp("o").alias("sd_o"), F.corr("s", "o").alias("r"))
    found = found.where("n >= 3 and sd_s > 0 and sd_o > 0")
    return found.select(*keys, "column", "r", ((F.col("r") + 1) / 2).alias("realism"), (F.col("r") < 0.5).alias("violated"))


def anomalies(rows: DataFrame, columns: list[str], fence: float = 1.5) -> DataFrame:
    """(column, n, share, severity): values outside the quartile fences; none,
    minor for less than a twentieth of the rows, else major."""
    out = []
    for c in columns:
        x = rows.select(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
        q = stats.quantiles_at(x, ["column"], "v", {"q1": 0.25, "q3": 0.75})
        width = fence * (F.col("q3") - F.col("q1"))
        # One row of quartiles a column.
        far = (F.col("v") < F.col("q1") - width) | (F.col("v") > F.col("q3") + width)
        out.append(x.join(F.broadcast(q), "column").groupBy("column").agg(F.count_if(far).alias("n"), F.count("*").alias("rows")))
    found = reduce(DataFrame.unionByName, out)
    share = F.col("n") / F.col("rows")
    return found.select("column", "n", share.alias("share"), F.when(F.col("n") == 0, "none").when(share < 0.05, "minor").otherwise("major").alias("severity"))


def integrity(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows_before, rows_after, preserved, increase): whether the
    rows are as many as before, and how many more values are missing."""
    side = lambda rows, k: rows.select(F.lit(k).alias("__k"), *columns)
    rows = side(before, 0).unionByName(side(after, 1))
    late = F.col("__k") == 1
    more = [F.struct(F.lit(c).alias("column"), (F.count_if(late & F.col(c).isNull()) - F.count_if(~late & F.col(c).isNull())).alias("increase")) for c in columns]
    found = rows.agg(F.count_if(~late).alias("rows_before"), F.count_if(late).alias("rows_after"), F.array(*more).alias("x"))
    return found.select("rows_before", "rows_after", (F.col("rows_before") == F.col("rows_after")).alias("preserved"), F.explode("x").alias("x")).select("x.column", "rows_before", "rows_after", "preserved", "x.increase")


def integration_score(preserved: Column, gap: Column, realistic: Column) -> Column:
    """(integrity, correlation, trend, score, passed): the scores of kept
    rows, of the largest difference of correlations (null: nothing to compare,
    so 1) and of depth trends, their mean, and whether it reaches 0.8."""
    parts = [F.when(preserved, 1.0).otherwise(0.5), F.when(gap.isNull(), 1.0).otherwise(1 - F.least(gap, F.lit(1.0))), F.when(realistic, 1.0).otherwise(0.7)]
    mean = (parts[0] + parts[1] + parts[2]) / 3
    return F.struct(parts[0].alias("integrity"), parts[1].alias("correlation"), parts[2].alias("trend"), mean.alias("score"), (mean >= 0.8).alias("passed"))


def simulation_score(converged: Column, coverage: Column, fidelity: Column) -> Column:
    """Mean of: 1 for converged draws, else 0.5; the covered percentage; the
    share of faithful distributions. Null figures don't count."""
    return _mean([F.when(converged, 1.0).otherwise(0.5), coverage / 100, fidelity])


def correlation_score(rmse: Column, quality: Column) -> Column:
    """Mean of one less ten times the error, not below 0, and of the matrices'
    quality; null figures don't count."""
    return _mean([F.greatest(1 - 10 * rmse, F.when(rmse.isNotNull(), F.lit(0.0))), quality])


def issues(score: Column, failed: dict[str, Column], least: float = 0.6) -> Column:
    """Array of what is critical: steps that failed, and a score below `least`."""
    found = [F.when(F.coalesce(f, F.lit(False)), F.lit(f"critical failure in {name}")) for name, f in failed.items()]
    found.append(F.when(score < least, F.lit("overall quality score below critical threshold")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())
