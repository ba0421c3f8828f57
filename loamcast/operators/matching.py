"""Joins by nearness: bands of depth, similar names, nearest slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: float) -> DataFrame:
    """Pairs with equal keys and abs(a - b) <= width. Each right row goes to
    its bucket of that width and both beside it, so the join is an equi-join
    and its cost follows the matches. Column names must differ but for keys."""
    step = F.lit(float(width))
    bucketed = left.withColumn("__bucket", F.floor(F.col(a) / step))
    spread = right.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col(b) / step) + k for k in (-1, 0, 1)])))
    return bucketed.join(spread, [*keys, "__bucket"]).where(F.abs(F.col(a) - F.col(b)) <= step).drop("__bucket")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], size: float = 50.0) -> DataFrame:
    """Pairs with equal keys whose intervals [top, bottom) and [top2, bottom2)
    overlap, with the length `shared`. Both are cut by buckets of `size`; a
    pair is kept in the first bucket that both reach."""
    cut = lambda df, t, b, c: df.withColumn(c, F.explode(F.sequence(F.floor(F.col(t) / size), F.ceil(F.col(b) / size) - 1)))
    both = cut(left.where("bottom > top"), "top", "bottom", "__k").join(cut(right.where("bottom2 > top2"), "top2", "bottom2", "__k"), [*keys, "__k"])
    first = F.floor(F.greatest("top", "top2") / size)
    return both.where(F.col("__k") == first).withColumn("shared", F.least("bottom", "bottom2") - F.greatest("top", "top2")).where("shared > 0").drop("__k")


def standard_name(name: Column) -> Column:
    """Upper case, without closing digits and marks other than the slash;
    empty for null."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), "[0-9]+$", ""), r"[^\w/]", ""), F.lit(""))


def name_similarity(a: Column, b: Column) -> Column:
    """Of two standard names: 1 if equal, 0.8 and up to 0.2 more by the
    characters that both have if they begin alike, else 0; empty names match
    nothing but themselves."""
    letters = lambda x: F.split(x, "")
    common = F.size(F.array_intersect(letters(a), letters(b)))
    alike = F.least(F.lit(1.0), 0.8 + 0.2 * common / F.greatest(F.length(a), F.length(b), F.lit(1)))
    return F.when(a == b, 1.0).when((a != "") & (b != "") & (F.substring(a, 1, 1) == F.substring(b, 1, 1)), alike).otherwise(0.0)


def name_infill(horizons: DataFrame, value: str, suitable: str = "suitable") -> DataFrame:
    """Nulls of suitable horizons from the profile's suitable horizons of
    similar names (above 0.5), weighted by similarity. Adds `by_name` and
    `n_names`. Values are added up by name before they are compared."""
    named = horizons.withColumn("__std", standard_name(F.col("hzname")))
    known = named.where(F.col(suitable) & F.col(value).isNotNull() & (F.col("__std") != "")).groupBy("cokey", F.col("__std").alias("__other")).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    wanted = named.where(F.col(suitable) & F.col(value).isNull() & (F.col("__std") != "")).select("cokey", "__std").distinct()
    weight = name_similarity(F.col("__std"), F.col("__other"))
    means = wanted.join(known, "cokey").withColumn("__w", weight).where("__w > 0.5").groupBy("cokey", "__std").agg((F.sum(F.col("__s") * F.col("__w")) / F.sum(F.col("__n") * F.col("__w"))).alias("by_name"), F.sum("__n").alias("n_names"))
    missing = F.col(suitable) & F.col(value).isNull()
    joined = named.join(means, ["cokey", "__std"], "left")
    return joined.withColumns({c: F.when(missing, F.col(c)) for c in ("by_name", "n_names")}).drop("__std")


def across_components(horizons: DataFrame, value: str, width: float = 15.0) -> DataFrame:
    """Nulls of `value` from the horizons of all components with a midpoint
    (mid) within `width`, weighted by nearness. Adds `near` and `n_near`.
    What is known is added up by midpoint first, so the join follows the
    distinct depths, not the horizons."""
    known = horizons.where(F.col(value).isNotNull() & F.col("mid").isNotNull()).groupBy(F.col("mid").alias("__its")).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    wanted = horizons.where(F.col(value).isNull() & F.col("mid").isNotNull()).select(F.col("mid").alias("__mid"), F.lit(0).alias("__all")).distinct()
    pairs = within(wanted, known.withColumn("__all", F.lit(0)), ["__all"], "__mid", "__its", width)
    weight = 1 / (1 + F.abs(F.col("__mid") - F.col("__its")))
    means = pairs.groupBy("__mid").agg((F.sum(F.col("__s") * weight) / F.sum(F.col("__n") * weight)).alias("near"), F.sum("__n").alias("n_near"))
    joined = horizons.join(means, F.col("mid") == F.col("__mid"), "left").drop("__mid")
    return joined.withColumns({c: F.when(F.col(value).isNull(), F.col(c)) for c in ("near", "n_near")})


def nearest(rows: DataFrame, depths: list[float], at: str) -> DataFrame:
    """The standard depth nearest to each row's; the shallower of two."""
    options = F.array(*[F.struct(F.abs(F.col(at) - d).alias("away"), F.lit(float(d)).alias("depth")) for d in depths])
    return rows.withColumn("slice", F.array_min(options)["depth"])
