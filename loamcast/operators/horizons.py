"""Horizon tables: intervals of depth, their repair, slices and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import HARD
from .stats import quantiles_at, small


def without_organic(horizons: DataFrame, name: str = "hzname") -> DataFrame:
    """Drops horizons whose name has an O and stacks the rest from 0."""
    order = Window.partitionBy("cokey").orderBy("hzdept_r", "hz").rowsBetween(Window.unboundedPreceding, 0)
    thickness = F.col("hzdepb_r") - F.col("hzdept_r")
    kept = horizons.where(~F.coalesce(F.col(name).contains("O"), F.lit(False)))
    bottom = F.sum(thickness).over(order)
    return kept.withColumns({"hzdepb_r": bottom, "hzdept_r": bottom - thickness})


def slices(horizons: DataFrame, ranges: list[tuple[int, int]], value: str) -> DataFrame:
    """Mean of the 1-cm slices of each profile in each depth range; ranges
    without slices have a null, and the bottom is cut to the data."""
    windows = F.array(*[F.struct(F.lit(t).alias("top"), F.lit(b).alias("bottom")) for t, b in ranges])
    cut = horizons.select("cokey", "hzdept_r", "hzdepb_r", value, F.explode(windows).alias("w")).select("cokey", "hzdept_r", "hzdepb_r", value, "w.*")
    # n whole centimetres [top, bottom) of the horizon lie in the window: a
    # weight instead of that many rows.
    low, high = F.greatest("hzdept_r", "top"), F.least("hzdepb_r", "bottom")
    n = F.greatest(high - low, F.lit(0))
    held = F.when((n > 0) & F.col(value).isNotNull(), n)
    return cut.groupBy("cokey", "top", "bottom").agg(
        (F.sum(F.col(value) * held) / F.sum(held)).alias("mean"),
        F.coalesce(F.max(F.when(n > 0, high)), F.col("bottom")).alias("reached"),
    )


def overlap_mean(draws: DataFrame, top: float, bottom: float, value: str, keys: list[str]) -> DataFrame:
    """Mean over a depth window, weighted by the overlap; nulls drop out with
    their weights."""
    weight = F.least("hzdepb_r", F.lit(bottom)) - F.greatest("hzdept_r", F.lit(top))
    used = draws.withColumn("w", weight).where("w > 0")
    w = F.when(F.col(value).isNotNull(), F.col("w"))
    return used.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"), F.sum("w").alias("covered"))


def summed_fragments(fragments: DataFrame, key: str, size: str, value: str) -> DataFrame:
    """One value per key and size class, then their sum; no value sums to 0."""
    first = fragments.groupBy(key, size).agg(F.min(value).alias(value))
    return first.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def modes(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column): its most frequent value in each group, the least of
    several; nulls don't count."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.v").alias(column))


def recovered(components: DataFrame, horizons: DataFrame, name: str, numbers: list[str], labels: list[str], group: str = "genhz") -> tuple[DataFrame, DataFrame]:
    """(horizons, unresolved). Components without horizons get one for each
    general horizon of the components of their name: means of `numbers`, modes
    of `labels`, in order of depth; marked as recovered, with the number of
    components used. Those without such horizons are unresolved."""
    named = horizons.join(components.select("cokey", name), "cokey")
    own = named.select("cokey", name, group, *numbers, *labels, F.lit(False).alias("recovered"), F.lit(None).cast("long").alias("siblings"))
    usable = named.where(F.col(group).isNotNull() & F.col(name).isNotNull())
    pooled = usable.groupBy(name, group).agg(*[F.avg(c).alias(c) for c in numbers])
    for label in labels:
        pooled = pooled.join(modes(usable, [name, group], label), [name, group], "left")
    used = usable.groupBy(name).agg(F.countDistinct("cokey").alias("siblings"))
    without = components.select("cokey", name).join(horizons.select("cokey").distinct(), "cokey", "left_anti")
    found = without.join(pooled.join(used, name), name).withColumn("recovered", F.lit(True)).select(*own.columns)
    return own.unionByName(found), without.join(used, name, "left_anti")


def restriction_flags(horizons: DataFrame, needed: list[str]) -> DataFrame:
    """Flags of layers that stop roots or water, and of organic ones."""
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    top = F.coalesce("resdept_l", "resdept_r")
    below = F.coalesce(F.col("hzdept_r") >= top, F.lit(False))
    has = lambda c, words: F.coalesce(F.col(c).rlike(f"(?i){words}"), F.lit(False))
    kind = has("reskind", f"lithic|paralithic|bedrock|densic|{HARD}")
    cemented = has("texcl", "cemented|indurated") | has("lieutex", "cemented|indurated|bedrock|pavement")
    plain = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    named = (F.coalesce(F.col("desgnmaster") == "R", F.lit(False))) | plain("hzname", "(^|[0-9]+)(Cr|Cd|Cx)") | has("hzname", rf"\b({HARD})\b") | (plain("hzname", "m$") & (F.length("hzname") > 1))
    organic = F.coalesce(F.col("desgnmaster") == "O", F.lit(False)) | plain("hzname", "(^|[0-9]+)O")
    flagged = horizons.withColumns({"missing_required": missing, "restriction_top": top, "below_restriction": below, "is_cemented": cemented, "named_restriction": named, "organic_horizon": organic})
    by_kind = kind & F.col("missing_required") & F.col("below_restriction")
    return flagged.withColumns({"kind_restriction": by_kind, "restrictive": by_kind | F.col("is_cemented") | F.col("named_restriction")})


def modal_class(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Share of each class in its group, for the most frequent ones; ties all
    stay."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(group), "place": F.rank().over(group.orderBy(F.desc("n")))})
    return ranked.where("place = 1").drop("place", "n")


def ladder_infill(horizons: DataFrame, value: str, order: str = "mid", band: float = 20.0) -> DataFrame:
    """Fills nulls of `value`, by the first of these that has one:

    1 same: mean of the profile's horizons of the same generalised name
    2 band: mean of the profile's horizons with a midpoint within `band`
    3 line: linear interpolation by depth within the profile, ends carried
    4 group: median of the map unit's horizons of that name
    5 all: median of the name over everything

    Each rung reads the values as they came in. Adds `filled` and `rung`.
    """
    own = Window.partitionBy("cokey", "genhz")
    profile = Window.partitionBy("cokey").orderBy(order)
    before, after = profile.rowsBetween(Window.unboundedPreceding, -1), profile.rowsBetween(1, Window.unboundedFollowing)
    near = F.expr(f"avg(`{value}`) OVER (PARTITION BY cokey ORDER BY `{order}` RANGE BETWEEN {band}D PRECEDING AND {band}D FOLLOWING)")
    v, x = F.col(value), F.col(order)
    point = F.when(v.isNotNull(), F.struct(x.alias("x"), v.alias("y")))
    ranged = horizons.withColumns({"p": F.last(point, True).over(before), "q": F.first(point, True).over(after), "same": F.avg(v).over(own), "band": near})
    line = F.when(F.col("p").isNull(), F.col("q.y")).when(F.col("q").isNull(), F.col("p.y")).when(F.col("q.x") == F.col("p.x"), (F.col("p.y") + F.col("q.y")) / 2).otherwise(F.col("p.y") + (F.col("q.y") - F.col("p.y")) * (x - F.col("p.x")) / (F.col("q.x") - F.col("p.x")))
    unit = horizons.groupBy("mukey", "genhz").agg(F.median(value).alias("unit_median"))
    every = quantiles_at(horizons, ["genhz"], value, {"all_median": 0.5})
    joined = ranged.withColumn("line", line).join(unit, ["mukey", "genhz"], "left").join(small(every, horizons, ["genhz"]), "genhz", "left")
    rungs = {"same": "same", "band": "band", "line": "line", "group": "unit_median", "all": "all_median"}
    filled, rung = F.coalesce(v, *rungs.values()), F.when(v.isNotNull(), "own")
    for label, column in rungs.items():
        rung = rung.when(F.col(column).isNotNull(), label)
    return joined.withColumns({"filled": filled, "rung": rung})
