"""Links between rows that share a bucket, and their connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, written

ONE_TASK = 500_000  # edges that one task may unite
SHARES = 256  # a key is frequent with more than 1 / SHARES of the rows
WIDE = 64 << 20  # bytes of binary columns that spread() may broadcast
ROOM = 8  # pairs a row of a bucket may cost before the bucket counts as crowded
STEPS = 8  # how often a crowded bucket is divided before all its open pairs are compared
PART = 2048  # rows of a bucket that one task compares with the others
SIMILAR = 0.8


def components(edges: DataFrame, scope: Scratch | None = None) -> DataFrame:
    """(u, v) of any ordered type to (node, component): the smallest node of
    its component, for every node that has an edge to another.

    The edges are written and counted first. Up to ONE_TASK of them, a bounded
    few megabytes, one executor task unites them; that spares dozens of small
    shuffles. More are solved by star steps, which are joins.
    """
    e = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), scope)
    return _united(e) if e.count() <= ONE_TASK else _by_stars(e, scope)


def _united(edges: DataFrame) -> DataFrame:
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if parent:
            yield pa.record_batch([pa.array(list(parent), kind), pa.array([find(x) for x in parent], kind)], names=["node", "component"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(unite, f"node {kind}, component {kind}")


def _by_stars(e: DataFrame, scope: Scratch | None) -> DataFrame:
    """Large-star and small-star steps in turn over a written edge table: each
    is a few joins, nothing reaches the driver but a count and a checksum, and
    the number of steps is logarithmic."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(first.withColumnRenamed("m", "v")).distinct(), scope)
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def frequent(counts: DataFrame, total: int, on: list[str]) -> DataFrame:
    """Keys with more than 1 / SHARES of all rows, so fewer than SHARES keys;
    counts: (*on, n)."""
    return counts.where(F.col("n") > max(total // SHARES, SHARES)).select(*on)


def spread(rows: DataFrame, heads: DataFrame, on: list[str], hot: DataFrame, scope: Scratch, *hints: str) -> DataFrame:
    """rows joined with heads, one row a key, where few keys may hold most
    rows. Rows of the frequent() keys meet their heads, fewer than SHARES, by
    broadcast and stay where they are; the others are shuffled, and none of
    their keys is large. Heads of more than WIDE bytes together are shuffled
    too. The others are small too at times, which Spark sees, unless a hint
    says how to join them."""
    cold = heads.hint(*hints) if hints else heads
    few = written(heads.join(F.broadcast(hot), on, "left_semi"), scope)
    size = few.agg(F.sum(sum((F.length(F.col(c)) for c, t in few.dtypes if t == "binary"), F.lit(0)))).first()[0]
    if size is None or size > WIDE:
        return rows.join(cold, on)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def shared(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in `keys`."""
    return df.join(sized(keys.select(*on).distinct()), on, "left_semi")


def link(keys: DataFrame, measures: Callable[[DataFrame], DataFrame], alike: Callable, verify: Callable[[DataFrame], DataFrame], edits: Callable[[DataFrame], DataFrame], scope: Scratch) -> DataFrame:
    """(key, node) to verified links (a, b) that join the nodes of all buckets
    into components.

    measures: of nodes (node), their (node, sketch, weight). alike: a
    mapInArrow function that drops pairs whose sketches differ. verify: of
    pairs (a, b), those that hold. edits: of (node, component, pivot),
    keys (key, node, component, short, apart) by what sets the node apart from
    the pivot, such that two nodes that hold, but don't both hold with the
    pivot, share a key that is short for the one less apart.

    Open pairs, those of different components of which the one less apart has
    a short key, are compared one by one where a bucket has at most 2 ROOM
    members, or ROOM open pairs a member (one a member in the first buckets,
    where texts may be wide apart). In a more
    crowded bucket all are compared with its pivot, the most central member:
    the one whose buckets are largest together, later the one least apart.
    Where that leaves a bucket crowded, its members go to buckets by their
    edits, and so on. Each step makes at most ROOM pairs a row; buckets of
    edits hold only members that changed the pivot alike, so they shrink from
    step to step. In buckets that are still
    crowded after STEPS of them all open pairs are compared. How a bucket is
    treated depends on that bucket alone, and none is dropped.
    """
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), scope)
    rows = spread(keys.select("key", "node"), sizes.select("key"), ["key"], frequent(sizes, keys.count(), ["key"]), scope)
    rows = written(rows.select("key", "node", F.col("node").alias("component"), F.lit(True).alias("short"), F.lit(0.0).alias("apart")), scope)
    held = written(measures(rows.select("node").distinct()), scope)
    base, links, waiting = rows.columns, None, None
    for step in range(STEPS + 1):
        few, many = _open(rows, ROOM, step == STEPS, scope)
        few = written(few.join(held, "node"), scope)
        pairs, pivots = _one_by_one(few if waiting is None else few.unionByName(waiting)), None
        if step < STEPS:
            many = written(many.join(held, "node"), scope)
            scored = many.withColumn("score", F.lit(0)) if step else many.join(many.groupBy("node").agg(F.sum("n").alias("score")), "node")
            best = F.struct((-F.col("apart")).alias("near"), "score", "node", "component", "sketch", "weight")
            tops = written(scored.groupBy("key").agg(F.count("*").alias("n"), F.max(best).alias("top")), scope)
            pivots = tops.select("key", F.col("top.node").alias("pivot"))
            heads = tops.select("key", F.col("top.node").alias("other_node"), F.col("top.component").alias("its"), F.col("top.sketch").alias("other_sketch"), F.col("top.weight").alias("other_weight"))
            hot = frequent(tops, many.count(), ["key"])
            star = spread(many, heads, ["key"], hot, scope).where("component != its")
            pairs = pairs.unionByName(star.select(*pairs.columns))
        near = pairs.where(f"least(weight, other_weight) >= {SIMILAR} * greatest(weight, other_weight)")
        near = near.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"), F.col("sketch").alias("sketch_a"), F.col("other_sketch").alias("sketch_b")).mapInArrow(alike, "a binary, b binary")
        found = written(verify(written(near.distinct(), scope)), scope)
        links = found if links is None else links.unionByName(found)
        if pivots is None or pivots.isEmpty():
            break
        labels = written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scope), scope)
        # Components of before are no longer those of labels, but every node that has a link has a label.
        named = many.drop("component", "n").join(labels, "node", "left").withColumn("component", F.coalesce(labels["component"], F.col("node")))
        waiting, many = _open(named, ROOM if step else 1, False, scope)
        together = spread(many.select(*base), pivots, ["key"], hot, scope)
        rows = written(edits(together.select("node", "component", "pivot").distinct()), scope)
    return links


def _one_by_one(few: DataFrame) -> DataFrame:
    """Open pairs of each bucket: each short row meets the rows as far apart
    or farther. Members of large buckets are dealt to parts, and each part
    meets the whole bucket."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    left = few.where("short").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    right = few.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"other_{c}") for c in ("node", "component", "short", "apart", "sketch", "weight")])
    later = "apart < other_apart or apart = other_apart and (node < other_node or not other_short)"
    open_pairs = left.join(right, ["key", "part"]).where(f"component != other_component and ({later})")
    return open_pairs.select("node", "other_node", "sketch", "other_sketch", "weight", "other_weight")


def _open(rows: DataFrame, room: int, whole: bool, scope: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of the buckets with nodes of several components and a short key,
    with n, the rows of the bucket: those of small buckets and of those with
    at most `room` open pairs a row, or of all if whole; and those of the
    others. Open pairs are those of two components, or if that is less, those
    of a short row with one of another component."""
    each = rows.groupBy("key", "component").agg(F.count("*").alias("n"), F.count_if("short").alias("s"))
    n, s = F.col("n"), F.col("s")
    total = each.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(n * n).alias("own"), F.sum(s * n).alias("short_own"), F.count("*").alias("parts")).where("parts > 1 and s > 0")
    pairs = F.least((n * n - F.col("own")) / 2, s * n - F.col("short_own"))
    total = written(total.select("key", "n", ((n <= 2 * ROOM) | (pairs <= room * n)).alias("few")), scope)
    held = written(spread(rows, total, ["key"], frequent(total, rows.count(), ["key"]), scope), scope)
    if whole:
        return held.drop("few"), held.where("false").drop("few")
    return held.where("few").drop("few"), held.where("not few").drop("few")
