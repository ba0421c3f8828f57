"""Groups that depth models are fitted to: which grouping holds enough of
them, what small groups fall back to, and which model a profile gets.

Each is a few aggregates and joins over groups; groups may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENERAL, POOL = "fallback_general", "general_pool"


def measured(rows: DataFrame, keys: list[str], profile: str = "cokey", depth: str = "hzdept_r") -> DataFrame:
    """(keys, profiles, observations, reach): what a group holds. Profiles are
    counted after the rows were aggregated by them, so that no task holds a
    group."""
    each = rows.groupBy(*keys, profile).agg(F.count("*").alias("n"), F.min(depth).alias("lo"), F.max(depth).alias("hi"))
    return each.groupBy(*keys).agg(F.count(profile).alias("profiles"), F.sum("n").alias("observations"), (F.max("hi") - F.min("lo")).alias("reach"))


def enough(profiles: int, observations: int, reach: float = 20.0) -> Column:
    return F.coalesce((F.col("profiles") >= profiles) & (F.col("observations") >= observations) & (F.col("reach") >= reach), F.lit(False))


def strategies(rows: DataFrame, levels: list[str], profiles: int, observations: int, groups: int) -> DataFrame:
    """(level, place, adequate, covered, meets, chosen), one row a level: its
    groups that hold enough, the percentage of the observations in them, and
    whether they are at least `groups`. The first level that meets this is
    chosen, else the one with the most such groups. Levels are columns from
    the finest on; "none" is one group of all; rows without a value are in no
    group; levels that the rows lack, or that have no group, drop out."""
    held = [c for c in levels if c == "none" or c in rows.columns]
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("level"), (F.lit("all") if c == "none" else F.col(c).cast("string")).alias("group")) for i, c in enumerate(held)])
    long = rows.select("cokey", "hzdept_r", F.explode(names).alias("x")).select("cokey", "hzdept_r", "x.*").where("group is not null")
    good = enough(profiles, observations)
    found = measured(long, ["place", "level", "group"]).groupBy("place", "level").agg(
        F.count_if(good).alias("adequate"), (100 * F.sum(F.when(good, F.col("observations")).otherwise(0)) / F.sum("observations")).alias("covered"))
    found = found.withColumn("meets", F.col("adequate") >= groups)
    # A row a level, so the array is as long as the argument.
    best = F.min_by("level", F.struct(~F.col("meets"), F.when(F.col("meets"), 0).otherwise(-F.col("adequate")), "place"))
    both = found.agg(F.collect_list(F.struct(*found.columns)).alias("x"), best.alias("best")).select(F.explode("x").alias("x"), "best")
    return both.select("x.level", "x.place", "x.adequate", "x.covered", "x.meets", (F.col("x.level") == F.col("best")).alias("chosen"))


def coverage(rows: DataFrame, group: str, columns: list[str], profiles: int = 3, observations: int = 15) -> DataFrame:
    """(column, groups, rate, well, low) over the groups that hold enough: how
    many there are, the share of values that are there, how many groups have
    half of theirs, and whether the rate is below 0.3."""
    good = measured(rows, [group]).where(enough(profiles, observations)).select(group)
    each = rows.join(good, group, "left_semi").groupBy(group).agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    long = each.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("held")) for c in columns])).alias("x")).select("n", "x.*")
    rate = F.sum("held") / F.sum("n")
    return long.groupBy("column").agg(F.count("*").alias("groups"), rate.alias("rate"), F.count_if(F.col("held") / F.col("n") >= 0.5).alias("well"), (rate < 0.3).alias("low"))


def with_fallbacks(rows: DataFrame, group: str, value: str, levels: dict[str, str], profiles: int, observations: int) -> DataFrame:
    """rows with `final_group`: their group where it holds enough values; else
    the first of the coarser levels (column: prefix) that they have; else
    GENERAL. Groups that are still too small go to POOL."""
    valued = rows.where(F.col(value).isNotNull())
    good = measured(valued, [group]).where(enough(profiles, observations)).select(F.col(group).alias("__g"))
    coarse = [F.concat(F.lit(prefix), F.col(c).cast("string")) for c, prefix in levels.items() if c in rows.columns]
    placed = rows.join(good, F.col(group) == F.col("__g"), "left").withColumn("final_group", F.coalesce(F.col("__g").cast("string"), *coarse, F.lit(GENERAL))).drop("__g")
    # A group without any value isn't small: there is nothing to fit in it.
    small = measured(placed.where(F.col(value).isNotNull()), ["final_group"]).where(~enough(profiles, observations)).select(F.col("final_group").alias("__s"))
    joined = placed.join(small, F.col("final_group") == F.col("__s"), "left")
    return joined.withColumn("final_group", F.when(F.col("__s").isNotNull(), POOL).otherwise(F.col("final_group"))).drop("__s")


def matched(soils: DataFrame, key: str, groups: DataFrame, direct: list[str], levels: dict[str, str]) -> DataFrame:
    """(key, model): the group of a fitted model that a soil gets: that of its
    first direct column, then of its first coarser level (column: prefix),
    then GENERAL, then POOL, then the least of all. groups: (model). Without
    groups the model is null. Soils are told apart by key; of rows with one
    key any may give the model."""
    names = [F.col(c).cast("string") for c in direct if c in soils.columns] + [F.concat(F.lit(p), F.col(c).cast("string")) for c, p in levels.items() if c in soils.columns]
    ranked = F.array(*[F.struct(F.lit(i).alias("place"), n.alias("model")) for i, n in enumerate([*names, F.lit(GENERAL), F.lit(POOL)])])
    asked = soils.select(F.col(key).alias("__key"), F.explode(ranked).alias("x")).select("__key", "x.*").where("model is not null")
    known = groups.select("model").where("model is not null").distinct()
    found = asked.join(known, "model", "left_semi").groupBy("__key").agg(F.min_by("model", "place").alias("model"))
    last = known.agg(F.min("model").alias("__last"), F.lit(1).alias("__one"))  # one row
    out = soils.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("__one", F.lit(1)).join(F.broadcast(last), "__one")
    return out.select(key, F.coalesce("model", "__last").alias("model"))


def ratios(trends: DataFrame, keys: list[str], depth: str, value: str) -> DataFrame:
    """trends with `ratio`: of the value to that of the depth above, from 0.1
    to 10; 1 where there is none, or nothing to divide by."""
    share = F.col(value) / F.nullif(F.lag(value).over(Window.partitionBy(*keys).orderBy(depth)), F.lit(0.0))
    return trends.withColumn("ratio", F.when(share.isNull(), 1.0).otherwise(F.least(F.greatest(share, F.lit(0.1)), F.lit(10.0))))


def updated(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows whose columns take the value of `changes` of the same key, where
    it isn't null and the key stands once in rows; other rows stay as they
    are. Of several changes the largest value holds; null keys equal none."""
    once = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    new = changes.groupBy(*keys).agg(*[F.max(c).alias(f"__new_{c}") for c in columns]).join(once, keys, "left_semi")
    out = rows.join(new, keys, "left").withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns})
    return out.select(*rows.columns)


def arrays(draws: DataFrame, key: str, columns: list[str], depth: str = "hzdept_r", sim: str = "sim") -> DataFrame:
    """(key, depth, sims, one array a column): the draws of each depth in the
    order of the realizations; a row holds the draws of one depth."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(sim).alias("s"), *[F.col(c).alias(c) for c in columns])))
    x = draws.groupBy(key, depth).agg(packed.alias("x"))
    return x.select(key, depth, F.col("x.s").alias("sims"), *[F.col(f"x.{c}").alias(c) for c in columns])


def unpacked(packed: DataFrame, key: str, columns: list[str], depth: str = "hzdept_r", sim: str = "sim") -> DataFrame:
    """The draws that arrays() packed, one row each."""
    x = packed.select(key, depth, F.explode(F.arrays_zip(F.col("sims"), *columns)).alias("x"))
    return x.select(key, depth, F.col("x.sims").alias(sim), *[F.col(f"x.{c}").alias(c) for c in columns])


def scaled(draws: DataFrame, keys: list[str], depth: str, value: str, trend: str) -> DataFrame:
    """draws whose value follows the trend down: that of the depth above times
    the ratio of the trends, from 0.1 to 10. Where there is no ratio, at the
    top, beside a missing trend and below one of 0, the value stays, and what
    is below follows it. keys: one realization of a profile."""
    by = Window.partitionBy(*keys).orderBy(depth)
    share = F.col(trend) / F.nullif(F.lag(trend).over(by), F.lit(0.0))
    x = draws.withColumn("__log", F.when(share.isNotNull(), F.log(F.least(F.greatest(share, F.lit(0.1)), F.lit(10.0)))))
    x = x.withColumn("__part", F.count_if(F.col("__log").isNull()).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "__part").orderBy(depth).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(value, F.first(value).over(inner) * F.exp(F.sum(F.coalesce("__log", F.lit(0.0))).over(inner))).drop("__log", "__part")


def retrofitted(draws: DataFrame, key: str, depth: str, sim: str, value: str) -> DataFrame:
    """draws (key, depth, sim, value) with the order of the realizations at
    the least depth kept at all others: there a value becomes the quantile of
    its depth's values at the realization's share of surface values that are
    not larger. Realizations without a surface value stay as they are; nulls
    are no values. Draws of one depth of a profile meet in a task."""
    there = draws.where(F.col(value).isNotNull())
    top = there.groupBy(key).agg(F.min(depth).alias("__top"))
    ranks = there.join(top, key).where(F.col(depth) == F.col("__top")).select(key, sim, "__top", F.cume_dist().over(Window.partitionBy(key).orderBy(value)).alias("__p"))
    by = Window.partitionBy(key, depth).orderBy(value)
    ordered = there.select(key, depth, F.col(value).alias("__v"), (F.row_number().over(by) - 1).alias("__k"), F.lead(value).over(by).alias("__next"))
    sizes = there.groupBy(key, depth).agg(F.count("*").alias("__n"))
    # A draw meets the one value at its rank, and that value's neighbour.
    asked = draws.join(ranks, [key, sim], "left").join(sizes, [key, depth], "left").withColumn("__place", F.col("__p") * (F.col("__n") - 1)).withColumn("__k", F.floor("__place").cast("int"))
    out = asked.join(ordered, [key, depth, "__k"], "left")
    drawn = F.col("__v") + F.when(F.col("__place") > F.col("__k"), (F.col("__next") - F.col("__v")) * (F.col("__place") - F.col("__k"))).otherwise(0.0)
    return out.withColumn(value, F.when(F.col("__p").isNull() | F.col(value).isNull() | (F.col(depth) == F.col("__top")), F.col(value)).otherwise(drawn)).select(*draws.columns)
