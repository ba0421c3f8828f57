"""Profiles of columns: summaries, outliers, correlation, distances, fills."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BLOCK, md5_words

CROWD = 50_000  # rows beyond which a group is cut into parts
CUT = 20_000  # values of a group that its cuts are taken from
FEW = 100_000  # groups up to which a row a group is broadcast


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, spread, exact quantiles, and moments with sample sd."""
    x = F.col(value)
    mid = rows.groupBy(*keys).agg(F.median(x).alias("__m"))
    joined = rows.join(mid, keys)
    n = F.count(x)
    shrink = (n - 1) / n
    return joined.groupBy(*keys).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.var_samp(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, 0.25).alias("q1"), F.median(x).alias("median"), F.percentile(x, 0.75).alias("q3"), (1.4826 * F.median(F.abs(x - F.col("__m")))).alias("mad"),
        (F.stddev_samp(x) / F.sqrt(n)).alias("se"), (100 * F.stddev_samp(x) / F.avg(x)).alias("cv"),
        (F.skewness(x) * F.pow(shrink, F.lit(1.5))).alias("skewness"), ((F.kurtosis(x) + 3) * shrink * shrink - 3).alias("kurtosis"),
    )


def outliers(rows: DataFrame, keys: list[str], value: str, z: float = 3.0, modified: float = 3.5, fence: float = 1.5) -> DataFrame:
    """Rows with three verdicts: outside the quartile fences, far in standard
    deviations, and far in median deviations."""
    x = F.col(value)
    first = rows.groupBy(*keys).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.percentile(x, 0.25).alias("q1"), F.percentile(x, 0.75).alias("q3"), F.median(x).alias("md"))
    near = rows.join(first, keys)
    second = near.groupBy(*keys).agg(F.median(F.abs(x - F.col("md"))).alias("dev"))
    both = near.join(second, keys)
    width = fence * (F.col("q3") - F.col("q1"))
    return both.select(
        *rows.columns, ((x < F.col("q1") - width) | (x > F.col("q3") + width)).alias("by_fence"), (F.abs(x - F.col("m")) > z * F.col("s")).alias("by_z"),
        F.when(F.col("dev") > 0, F.abs(0.6745 * (x - F.col("md")) / F.col("dev")) > modified).otherwise(False).alias("by_median"),
    )


def parted(rows: DataFrame, keys: list[str], value: str, parts: int = 200) -> DataFrame:
    """rows with __part: 0 in groups of up to CROWD rows; larger ones are cut
    by value, rows of one value together, into `parts` of about one size.

    Cuts are exact quantiles of values that their hash picks, about CUT a
    group, so they are the same whenever, and from whatever order of rows,
    they are computed; approximate quantiles are not, and places that are
    counted from two such cuts don't fit together. At most one group in CROWD
    rows has cuts.
    """
    held = rows.where(F.col(value).isNotNull())
    large = F.broadcast(held.groupBy(*keys).agg(F.count("*").alias("__d")).where(F.col("__d") > CROWD))
    picked = held.select(*keys, value).join(large, keys).where(F.pmod(F.xxhash64(F.col(value).cast("double"), F.lit(7)), F.lit(2**30)) < CUT * 2**30 / F.col("__d"))
    # A value counts once, also where rows repeat it.
    picked = picked.select(*keys, value).distinct()
    cuts = picked.groupBy(*keys).agg(F.percentile(value, [k / parts for k in range(1, parts)]).alias("__cuts"))
    part = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))
    return rows.join(F.broadcast(cuts), keys, "left").withColumn("__part", F.when(F.col("__cuts").isNull(), 0).otherwise(part)).drop("__cuts")


def small(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """groups, a row a group of `rows`, for a join with them: broadcast where
    rows have at most FEW groups, which are counted first; so rows aren't
    gathered by group, of which few may hold them all."""
    many = rows.select(*keys).distinct().limit(FEW + 1).count() > FEW
    return groups if many else F.broadcast(groups)


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often a group has each value. Nulls are no
    values; null keys are in no group."""
    return rows.where(F.col(value).isNotNull()).dropna(subset=keys).groupBy(*keys, value).agg(F.count("*").alias("n"))


def positions(rows: DataFrame, keys: list[str], value: str, parts: int = 200) -> DataFrame:
    """(keys, value, n, before, total): each distinct value of a group, how
    often it occurs, how many rows are smaller, and all. For groups of any
    size: distinct values are dealt to parts, see parted(), and only counts of
    parts are added up in a group's window. Null keys are in no group."""
    counts = counted(rows, keys, value)
    return _placed(*_sized(counts, keys, value, parts), keys, value)


def _sized(counts: DataFrame, keys: list[str], value: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """Counts of distinct values with their part, and of each part how many
    rows stand before it, in it, and in the group."""
    dealt = parted(counts, keys, value, parts)
    sizes = dealt.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
    by = Window.partitionBy(*keys)
    up_to = by.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    return dealt, sizes.select(*keys, "__part", "__n", (F.sum("__n").over(up_to) - F.col("__n")).alias("__base"), F.sum("__n").over(by).alias("total"))


def _placed(dealt: DataFrame, sizes: DataFrame, keys: list[str], value: str) -> DataFrame:
    inner = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(sizes, [*keys, "__part"]).select(*keys, value, "n", (F.col("__base") + F.sum("n").over(inner) - F.col("n")).alias("before"), "total")


def quantiles_at(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """(keys, one column a probability): exact interpolated quantiles, from
    positions() in the parts that hold their ranks; others are only counted."""
    counts = counted(rows, keys, value)
    dealt, sizes = _sized(counts, keys, value, 200)
    held = F.lit(False)
    for p in probs.values():
        place = p * (F.col("total") - 1)
        for k in (F.floor(place), F.ceil(place)):
            held = held | ((F.col("__base") <= k) & (k < F.col("__base") + F.col("__n")))
    return _interpolated(_placed(dealt, sizes.where(held), keys, value), keys, value, probs)


def _interpolated(at: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    out = []
    for name, p in probs.items():
        place = p * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
        out.append((a + (b - a) * F.max(place - low)).alias(name))
    return at.groupBy(*keys).agg(*out)


SPAN = 40  # bits of a double that a span leaves out: 12 bits of the fraction tell spans apart


def spans(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(property, span, low, high, n): how many values of each column lie in
    each span of doubles, low to high; nulls are no values. A task adds up its
    values in vectors and brings a row a span."""
    ordered = lambda bits: bits ^ ((bits >> 63) & (2**63 - 1))  # noqa: E731  (its own inverse)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found, waiting, rows_held = [(none, none) for _ in columns], [[] for _ in columns], 0

        def add() -> None:
            for i, keys in enumerate(waiting):
                one, own = np.unique(np.concatenate([none, *keys]), return_counts=True)
                both, at = np.unique(np.concatenate([found[i][0], one]), return_inverse=True)
                found[i] = both, np.bincount(at, np.concatenate([found[i][1], own]), len(both)).astype(np.int64)
                keys.clear()

        for batch in batches:
            for keys, column in zip(waiting, batch.columns):
                v = column.drop_null().to_numpy(zero_copy_only=False) + 0.0  # one zero, and one NaN
                v[np.isnan(v)] = np.nan
                keys.append(ordered(v.view(np.int64)) >> SPAN)
            rows_held += batch.num_rows
            if rows_held > 1 << 19:
                add()
                rows_held = 0
        add()
        for name, (at, n) in zip(columns, found):
            ends = [ordered(x).view(np.float64) for x in (at << SPAN, (at << SPAN) | (2**SPAN - 1))]
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), *map(pa.array, ends), pa.array(n)], names=["property", "span", "low", "high", "n"])

    each = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    each = each.mapInArrow(count, "property string, span long, low double, high double, n long")
    return each.groupBy("property", "span").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.sum("n").alias("n"))


def column_quantiles(rows: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """(property, one column a probability): exact interpolated quantiles of
    whole columns. Values are counted by spans(), and only those in the spans
    that hold the quantiles' ranks are shuffled and sorted, so rows are read
    twice."""
    by = Window.partitionBy("property")
    sums = spans(rows, columns).withColumns({"__base": F.sum("n").over(by.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(by)})
    ranks = [r for p in probs.values() for r in (F.floor(p * (F.col("total") - 1)), F.ceil(p * (F.col("total") - 1)))]
    sums = sums.where(F.exists(F.array(*ranks), lambda r: (F.col("__base") <= r) & (r < F.col("__base") + F.col("n")))).drop("n")
    parts = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("v")) for c in columns])
    values = rows.select(F.explode(parts).alias("x")).select("x.*")
    # At most two spans a probability and column.
    inside = values.join(F.broadcast(sums), "property").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    counts = inside.groupBy("property", "span", "__base", "total", "v").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("property", "span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.select("property", "v", "n", "total", (F.col("__base") + F.sum("n").over(up_to) - F.col("n")).alias("before"))
    return _interpolated(at, ["property"], "v", probs)


def correlations(rows: DataFrame, keys: list[str], columns: list[str], ranks: bool = False) -> DataFrame:
    """(keys, a, b, r, n) for all pairs over complete rows; by Spearman's
    ranks, ties averaged, if asked."""
    whole = rows.dropna(subset=columns)
    if ranks:
        for c in columns:
            at = positions(whole, keys, c).select(*keys, c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"__{c}"))
            whole = whole.join(at, [*keys, c])
        whole = whole.drop(*columns).withColumnsRenamed({f"__{c}": c for c in columns})
    pairs = list(combinations(columns, 2))
    wide = whole.groupBy(*keys).agg(F.count("*").alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows_of = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return wide.select(*keys, "n", F.explode(rows_of).alias("x")).select(*keys, "x.a", "x.b", "x.r", "n")


def pooled_correlation(rows: DataFrame, group: str, a: str, b: str, more_than: int = 5) -> DataFrame:
    """Mean of the groups' correlations, weighted by their sizes; groups of
    more than so many complete rows count. One row: r, n, method. Without
    such groups it is the pooled correlation."""
    whole = rows.dropna(subset=[a, b])
    each = whole.groupBy(group).agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).where((F.col("n") > more_than) & F.col("r").isNotNull() & ~F.isnan("r"))
    mean = each.agg((F.sum(F.col("n") * F.col("r")) / F.sum("n")).alias("r"), F.sum("n").alias("n"))
    pooled = whole.agg(F.corr(a, b).alias("all_r"), F.count("*").alias("all_n"))
    # Both are one row of one aggregate each.
    return mean.join(pooled, F.lit(True)).select(F.coalesce("r", "all_r").alias("r"), F.coalesce("n", "all_n").alias("n"), F.when(F.col("r").isNotNull(), "grouped").otherwise("pooled").alias("method"))


def mahalanobis(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Squared distance of each row from its group's centre, in two
    dimensions; null where the covariance is singular."""
    m = rows.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("saa"), F.var_samp(b).alias("sbb"), F.covar_samp(a, b).alias("sab"))
    j = rows.join(m, keys)
    da, db, det = F.col(a) - F.col("ma"), F.col(b) - F.col("mb"), F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    d2 = (da * da * F.col("sbb") - 2 * da * db * F.col("sab") + db * db * F.col("saa")) / det
    return j.select(*rows.columns, F.when(det > 0, d2).alias("d2"))


def normalized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Four scalings in the group: z score, range, median and by rank."""
    x = F.col(value)
    stats = quantiles_at(rows, keys, value, {"md": 0.5, "q1": 0.25, "q3": 0.75})
    stats = stats.join(rows.groupBy(*keys).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi")), keys)
    at = positions(rows, keys, value).select(*keys, value, ((F.col("before") + F.col("n")) / F.col("total")).alias("ecdf"))
    over = lambda up, down: F.when(down > 0, up / down)
    j = rows.join(small(stats, rows, keys), keys).join(at, [*keys, value], "left")
    return j.select(*rows.columns, over(x - F.col("m"), F.col("s")).alias("z"), over(x - F.col("lo"), F.col("hi") - F.col("lo")).alias("scaled"), over(x - F.col("md"), F.col("q3") - F.col("q1")).alias("robust"), "ecdf")


def filled_forward(rows: DataFrame, keys: list[str], order: list[str], value: str) -> Column:
    """Last value that isn't null, at or before the row."""
    return F.last(value, True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, parts: int = 200) -> DataFrame:
    """rows with their place (1, 2, ...) in the group by the columns of order,
    for groups of any size: rows are dealt to parts by the first column, see
    parted(), and only counts of parts are added up in a group's window. Equal
    rows get places in any order; nulls come first; null keys are in no group.
    The first column is a number; rows of one value of it meet in a task."""
    value = order[0]
    dealt = parted(rows.dropna(subset=keys), keys, value, parts).withColumn("__part", F.when(F.col(value).isNull(), -1).otherwise(F.col("__part")))
    sizes = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    up_to = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select(*keys, "__part", (F.sum("__n").over(up_to) - F.col("__n")).alias("__base"))
    inner = Window.partitionBy(*keys, "__part").orderBy(*order)
    return dealt.join(sizes, [*keys, "__part"]).withColumn(name, F.col("__base") + F.row_number().over(inner)).drop("__part", "__base")


def quantile_mapped(rows: DataFrame, keys: list[str], source: list[str], target: str) -> DataFrame:
    """rows with `mapped`: the value of `target` of the same rank in the group
    as the row's by the columns of source, and then by target, which settle
    ties. Groups may be of any size: see ranked()."""
    place = ranked(rows.select(*keys, F.col(target).alias("mapped")), keys, ["mapped"], "__k")
    return ranked(rows, keys, [*source, target], "__k").join(place, [*keys, "__k"]).drop("__k")


def bootstrap(rows: DataFrame, keys: list[str], value: str, row_keys: list[str], n: int = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """(keys, n, estimate, low, high): the mean of each group and percentile
    limits of its n bootstrap means; for values of 0 and 1 a proportion.

    A row is in a replicate as often as a Poisson number says, hashed from
    row_keys, the replicate and the seed, so limits don't depend on
    partitions. A hash serves eight replicates. Rows meet by group, where their
    replicates are added up in vectors: a group brings one row of n sums to the
    next step for every LOT of its rows, and no row is repeated. Nulls are no
    values; a replicate without rows drops out; null keys are in no group.
    """
    held = rows.where(F.col(value).isNotNull()).dropna(subset=keys)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in row_keys], F.lit("")).cast("binary")
    held = held.select(*keys, text.alias("__text"), F.col(value).cast("double").alias("__x"))
    plain = held.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__x").alias("estimate"))
    # Groups of many rows go to several tasks; there is at most one of them for each LOT rows of all.
    large = F.broadcast(plain.where(F.col("n") > LOT).select(*keys, F.ceil(F.col("n") / LOT).alias("__lots")))
    dealt = held.join(large, keys, "left").withColumn("__lot", F.coalesce(F.pmod(F.xxhash64("__text"), F.col("__lots")), F.lit(0)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *keys, "__lot").select(*keys, "__text", "__x").sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys)
    sums = dealt.mapInArrow(_replicates(len(keys), n, seed), f"{kinds}, __w array<bigint>, __s array<double>")
    pairs = F.arrays_zip("__w", "__s")
    added = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct((x["__w"] + y["__w"]).alias("__w"), (x["__s"] + y["__s"]).alias("__s")))
    lots = sums.groupBy(*keys).agg(F.collect_list(pairs).alias("__l"))
    whole = lots.withColumn("__l", F.aggregate(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0))), F.get("__l", F.lit(0)), added))
    means = whole.select(*keys, F.array_sort(F.transform(F.filter("__l", lambda p: p["__w"] > 0), lambda p: p["__s"] / p["__w"])).alias("__m"))

    def at(share: float) -> Column:
        place = (F.size("__m") - 1) * F.lit(share)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        below, above = F.get("__m", low), F.get("__m", high)
        return F.when(low == high, below).otherwise((high - place) * below + (place - low) * above)

    return plain.join(means, keys).select(*keys, "n", "estimate", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


LOT = 200_000  # rows of a group that one task takes in bootstrap()


def _replicates(k: int, n: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (k keys, text, value), a group's rows together, to the sums of
    weights and of weighted values of each group's n replicates."""
    endings = [f"{lot}|{seed}".encode() for lot in range(-(-n // 8))]
    cuts = poisson_cuts()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.searchsorted(cuts, np.arange(65536), side="right").astype(np.int64)
        last, weights, values, fields = None, None, None, []

        def row() -> pa.RecordBatch:
            return pa.record_batch([*[pa.array([v], t) for v, t in zip(last, fields)], pa.array([weights], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float64()))], names=names)

        for batch in batches:
            fields, names = [f.type for f in batch.schema][:k], [*batch.schema.names[:k], "__w", "__s"]
            ids = list(zip(*[batch.column(i).to_pylist() for i in range(k)])) if k else [()] * batch.num_rows
            texts, x = batch.column(k).to_pylist(), batch.column(k + 1).to_numpy(zero_copy_only=False)
            step = max(1, BLOCK // len(endings))
            for at in range(0, len(ids), step):
                some = ids[at : at + step]
                words = md5_words(texts[at : at + step], endings)
                w = counts[words.view(np.uint16).byteswap().reshape(len(some), -1)[:, :n]]
                begins = [i for i in range(len(some)) if i == 0 or some[i] != some[i - 1]]
                sw, sx = np.add.reduceat(w, begins, axis=0), np.add.reduceat(w * x[at : at + step, None], begins, axis=0)
                for i, a, b in zip(begins, sw, sx):
                    if last == some[i] and weights is not None:
                        weights, values = weights + a, values + b
                        continue
                    if weights is not None:
                        yield row()
                    last, weights, values = some[i], a, b
        if weights is not None:
            yield row()

    return add


def poisson_cuts() -> list[int]:
    """Of 65 536 equal chances, those below each Poisson count of mean 1."""
    import math

    cuts, total = [], 0.0
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(round(total * 65536))
    return [c for c in cuts if c < 65536]


def poisson(chance: Column) -> Column:
    """A Poisson number of mean 1 from one of 65 536 equal chances."""
    return sum(((chance >= c).cast("int") for c in poisson_cuts()[1:]), (chance >= poisson_cuts()[0]).cast("int"))


def monotone_share(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Larger share of steps up or down along the order."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    steps = rows.withColumn("step", step).where("step is not null")
    return steps.groupBy(*keys).agg((F.greatest(F.sum((F.col("step") > 0).cast("int")), F.sum((F.col("step") < 0).cast("int"))) / F.count("*")).alias("share"), F.count("*").alias("steps"))


def ranked_fits(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, family, aic, place): normal, lognormal and exponential fits by
    maximum likelihood, from sums alone; families that need positive values
    are left out where there are others."""
    x, n = F.col(value), F.count(value)
    two_pi = 6.283185307179586
    sums = rows.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.avg(F.log(x)).alias("lm"), F.var_pop(F.log(x)).alias("lv"), F.min(x).alias("lo"))
    gauss = lambda v: 0.5 * F.col("n") * (F.log(two_pi * v) + 1)
    fits = F.array(
        F.struct(F.lit("normal").alias("family"), F.when(F.col("v") > 0, 4 + 2 * gauss(F.col("v"))).alias("aic")),
        F.struct(F.lit("lognormal").alias("family"), F.when((F.col("lo") > 0) & (F.col("lv") > 0), 4 + 2 * (gauss(F.col("lv")) + F.col("n") * F.col("lm"))).alias("aic")),
        F.struct(F.lit("exponential").alias("family"), F.when(F.col("lo") > 0, 2 + 2 * F.col("n") * (F.log("m") + 1)).alias("aic")),
    )
    long = sums.select(*keys, F.explode(fits).alias("f")).select(*keys, "f.*").where("aic is not null")
    return long.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy("aic")))


def intervals(rows: DataFrame, keys: list[str], value: str, z: float = 1.959963984540054) -> DataFrame:
    """Normal confidence interval of the mean of each group."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def missing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, share) of each column."""
    wide = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("missing")) for c in columns])
    return wide.select("n", F.explode(parts).alias("x")).select("x.column", "n", "x.missing", F.when(F.col("n") > 0, F.col("x.missing") / F.col("n")).alias("share"))


def scores(observed: DataFrame, simulated: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bias, relative error and spread ratio of simulated against observed
    groups; groups of one side alone drop out."""
    side = lambda df, s: df.groupBy(*keys).agg(F.avg(value).alias(f"{s}_m"), F.stddev_samp(value).alias(f"{s}_s"))
    both = side(observed, "o").join(side(simulated, "s"), keys)
    bias = F.col("s_m") - F.col("o_m")
    return both.select(*keys, bias.alias("bias"), F.when(F.col("o_m") != 0, F.abs(bias / F.col("o_m"))).alias("relative"), F.when(F.col("o_s") > 0, F.col("s_s") / F.col("o_s")).alias("spread"))
