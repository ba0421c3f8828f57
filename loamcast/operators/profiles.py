"""Simulated depths of profiles.

A profile is one ordered array of its horizons, so each is simulated in one
fold; draws are hashed from (cokey, sim, hz).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniforms
from ..functions.normal import qnorm_at, qnorm_sql, uniform
from ..functions.scalar import quantile_triangular
from .simulate import key_text, triangular_at

#: Boundary distinctness of general horizons, and half of a
#: boundary's width in cm.
DISTINCTNESS = {"O": "diffuse", "A": "clear", "E": "clear", "B": "gradual", "C": "gradual", "Cr": "gradual", "R": "abrupt"}
OFFSET = {"very abrupt": 0.5, "abrupt": 1.0, "clear": 2.5, "gradual": 7.5, "diffuse": 10.0}
DEPTHS = ("hzdept_l", "hzdept_r", "hzdept_h", "hzdepb_l", "hzdepb_r", "hzdepb_h")


def with_distinctness(horizons: DataFrame) -> DataFrame:
    """Missing distinctness by general horizon, else by name; `bound_sd`, the
    offset that it stands for."""
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.coalesce("distinctness", F.try_element_at(table(DISTINCTNESS), F.coalesce("genhz", F.lit(""))), F.try_element_at(table(DISTINCTNESS), F.coalesce("hzname", F.lit(""))))
    return horizons.withColumn("distinctness", found).withColumn("bound_sd", F.try_element_at(table(OFFSET), F.coalesce("distinctness", F.lit(""))))


def attach_bounds(horizons: DataFrame, series: DataFrame) -> DataFrame:
    """horizons with the mean bound_sd of their component name and general
    horizon in `series` (compname, hzname, genhz, distinctness); null without."""
    means = with_distinctness(series).groupBy(F.upper("compname").alias("__name"), F.col("genhz").alias("__genhz")).agg(F.avg("bound_sd").alias("bound_sd"))
    return horizons.join(means, (F.upper("compname") == F.col("__name")) & (F.col("genhz") == F.col("__genhz")), "left").drop("__name", "__genhz")


def with_variability(horizons: DataFrame, spread: float = 2.0) -> DataFrame:
    """Missing low and high depths lie `spread` cm off, not above the surface."""
    out = horizons
    for side in ("hzdept", "hzdepb"):
        low, high = F.greatest(F.col(f"{side}_r") - spread, F.lit(0.0)), F.greatest(F.col(f"{side}_r") + spread, F.lit(0.0))
        out = out.withColumns({f"{side}_l": F.coalesce(F.col(f"{side}_l"), low), f"{side}_h": F.coalesce(F.col(f"{side}_h"), high)})
    return out


def _profiles(rows: DataFrame, keys: list[str], n: int | str | None = None) -> DataFrame:
    """One row a profile with its horizons and their draws. With n, a number
    or the name of a column that the profile's rows share, each profile stands
    n times, in column sim: rows are repeated as whole profiles, after they
    have met, so only rows themselves are shuffled."""
    times = {"__n": F.max(n) if isinstance(n, str) else F.lit(n)} if n is not None else {}
    if n is not None:  # few rows make many: they are dealt to all tasks, by the profile
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = rows.withColumns({"__low": F.min("hzdept_l").over(Window.partitionBy(*keys, "hz")), "__high": F.max("hzdepb_h").over(Window.partitionBy(*keys, "hz"))})
    item = F.struct("hz", *[F.col(c).cast("double").alias(c) for c in DEPTHS], F.col("__low").cast("double").alias("low"), F.col("__high").cast("double").alias("high"))
    met = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), *[c.cast("int").alias(k) for k, c in times.items()])
    drawn = lambda sim: F.transform("items", lambda x: F.struct(x["hz"].alias("hz"), *[x[c].alias(c) for c in (*DEPTHS, "low", "high")], *[uniform(*[F.col(k) for k in keys], *sim, x["hz"], s).alias(f"u_{s}") for s in ("top", "bottom")]))
    if n is None:
        return met.withColumn("items", drawn([]))
    each = F.transform(F.sequence(F.lit(1), F.col("__n")), lambda sim: F.struct(sim.alias("sim"), drawn([sim]).alias("items")))
    return met.where("__n >= 1").select(*keys, F.explode(each).alias("x")).select(*keys, "x.sim", "x.items")


LAYERS = "array<struct<hz:int,top:double,bottom:double>>"


def _layer(hz: Column, top: Column, bottom: Column) -> Column:
    return F.struct(hz.cast("int").alias("hz"), top.alias("top"), bottom.alias("bottom"))


def _down(items: Column) -> Column:
    """From the surface: each bottom is drawn from a triangle that begins at
    its top, rounded, and not above it; each top is the bottom above."""

    def step(done: Column, x: Column) -> Column:
        top = F.when(F.size(done) > 0, F.get(done, F.size(done) - 1)["bottom"]).otherwise(F.lit(0.0))
        low = F.greatest(x["hzdepb_l"], top)
        high = F.greatest(low, x["hzdepb_h"])
        drawn = F.bround(quantile_triangular(low, F.least(F.greatest(x["hzdepb_r"], low), high), high, x["u_bottom"]), 0)
        return F.concat(done, F.array(_layer(x["hz"], top, F.greatest(drawn, top))))

    return F.aggregate(items, F.array().cast(LAYERS), step)


def _up(items: Column) -> Column:
    """From the last horizon, whose bottom is drawn; each other bottom is the
    top below, and each top is drawn below neither. The first top is 0."""

    def step(done: Column, x: Column) -> Column:
        drawn = F.bround(quantile_triangular(x["hzdepb_l"], x["hzdepb_r"], x["hzdepb_h"], x["u_bottom"]), 0)
        bottom = F.when(F.size(done) > 0, F.get(done, F.lit(0))["top"]).otherwise(drawn)
        low, high = x["hzdept_l"], F.least(x["hzdept_h"], bottom)
        top = F.bround(quantile_triangular(low, F.least(F.greatest(x["hzdept_r"], low), high), high, x["u_top"]), 0)
        return F.concat(F.array(_layer(x["hz"], F.least(top, bottom), bottom)), done)

    def close(done: Column) -> Column:
        first = F.get(done, F.lit(0))
        return F.concat(F.array(_layer(first["hz"], F.lit(0.0), F.greatest(first["bottom"], F.lit(0.0)))), F.slice(done, 2, F.greatest(F.size(done) - 1, F.lit(0))))

    return close(F.aggregate(F.reverse(items), F.array().cast(LAYERS), step))


def simulated(horizons: DataFrame, keys: list[str], method: str = "mixed", n: int | str | None = None, held: bool = False) -> DataFrame:
    """(keys, method, hz, top, bottom): depths of each profile, one for each
    value of keys; top_down, bottom_up, or mixed, a half of each. Horizons need
    hz and DEPTHS, which with_variability() completes.

    With n, each profile is simulated n times, and sim stands behind the keys:
    the same layers as of horizons repeated before, without shuffling the
    repeated rows. held: tops and bottoms stay within the horizon's range, as
    by clipped() with the same horizons.
    """
    rows = _profiles(with_variability(horizons), keys, n)
    keys = [*keys, "sim"] if n is not None else keys
    down = {"top_down": F.lit(True), "bottom_up": F.lit(False), "mixed": uniform(*[F.col(k) for k in keys], "way") < 0.5}[method]
    layers = F.when(down, _down(F.col("items"))).otherwise(_up(F.col("items")))
    if held:
        layers = F.zip_with(layers, "items", lambda x, i: _layer(x["hz"], F.greatest(x["top"], i["low"]), F.least(x["bottom"], i["high"])))
    named = rows.select(*keys, F.when(down, "top_down").otherwise("bottom_up").alias("method"), F.explode(layers).alias("x"))
    return named.select(*keys, "method", "x.hz", "x.top", "x.bottom")


def thickness_spread(layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hz, thickness_sd) over the simulations, to two digits."""
    return layers.groupBy(*keys, "hz").agg(F.round(F.stddev_samp(F.col("bottom") - F.col("top")), 2).alias("thickness_sd"))


def clipped(layers: DataFrame, horizons: DataFrame, on: list[str]) -> DataFrame:
    """Simulated tops and bottoms held within the horizon's range."""
    ranges = horizons.groupBy(*on).agg(F.min("hzdept_l").alias("__l"), F.max("hzdepb_h").alias("__h"))
    held = layers.join(ranges, on, "left")
    return held.withColumns({"top": F.greatest("top", "__l"), "bottom": F.least("bottom", "__h")}).drop("__l", "__h")


def out_of_range(layers: DataFrame, horizons: DataFrame, on: list[str]) -> DataFrame:
    """Simulated layers that begin above or end below the horizon's range."""
    ranges = horizons.groupBy(*on).agg(F.min("hzdept_l").alias("hzdept_l"), F.max("hzdepb_h").alias("hzdepb_h"))
    return layers.join(ranges, on).where("top < hzdept_l or bottom > hzdepb_h")


def perturbed(layers: DataFrame, keys: list[str], seed: int = 1, least: float = 1.0) -> DataFrame:
    """Layers (keys, hz, top, bottom, thickness_sd, bound_sd) with new tops and
    bottoms: (keys, hz, top, bottom).

    First each thickness gets a normal offset of thickness_sd, and layers are
    stacked from the first top; then each bottom gets one of bound_sd. Both
    are rounded to whole cm; a layer is never thinner than `least`, and each
    begins where the one above ends. Without an sd, or with 0, there is no
    offset. Offsets are hashed from keys, hz and seed.
    """
    spread = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    drawn = layers.withColumns({f"__u{s}": uniform(*[F.col(k) for k in keys], F.col("hz"), s, seed) for s in ("thickness", "bound")})
    drawn = drawn.withColumns({"__t": spread("thickness_sd") * F.expr(qnorm_sql("__uthickness")), "__b": spread("bound_sd") * F.expr(qnorm_sql("__ubound"))})
    item = F.struct("hz", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"), F.col("__t").alias("t"), F.col("__b").alias("b"))
    rows = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        first = F.size(done) == 0
        begins, top = F.when(first, x["top"]).otherwise(last["stacked"]), F.when(first, x["top"]).otherwise(last["bottom"])
        thick = F.when(x["t"] == 0, x["bottom"] - x["top"]).otherwise(F.bround(x["bottom"] - x["top"] + x["t"], 0))
        stacked = begins + F.greatest(thick, F.lit(least))
        moved = F.when(x["b"] == 0, stacked).otherwise(F.bround(stacked + x["b"], 0))
        return F.concat(done, F.array(F.struct(x["hz"].cast("int").alias("hz"), top.alias("top"), F.greatest(moved, top + least).alias("bottom"), stacked.alias("stacked"))))

    done = F.aggregate("items", F.array().cast("array<struct<hz:int,top:double,bottom:double,stacked:double>>"), step)
    return rows.select(*keys, F.explode(done).alias("x")).select(*keys, "x.hz", "x.top", "x.bottom")


LOT = 1 << 18  # layers of repeated profiles that are made at once, or those of one profile


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by profile, in as many parts as shuffles have: few rows make many
    draws, so parts are not put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def repeated(rows: DataFrame, counts: DataFrame | int, keys: list[str], fields: list[str], make: Callable, figures: Callable | None = None, kinds: str = "") -> DataFrame:
    """(keys, sim, hz, top, bottom): each profile of rows (keys, hz, fields)
    for each replication 1..sim_comppct of counts (keys, sim_comppct), or as
    often as a number says.

    Profiles meet their count as one row with an array, and are repeated in
    vectors, so repetitions are neither shuffled nor folded one by one. make:
    of (values, first, own, draw), tops and bottoms, one row a repetition and
    one column a layer; values has a matrix a field, one row a profile, null
    as NaN; repetitions of profile i begin at first[i], and own is the profile
    of each; draw gives (repetitions, layers, endings) uniforms of the
    endings, and without a layer those of (repetitions, endings).

    figures: of (tops, bottoms, first, own), one column a layer of the same
    hz, an array a figure of `kinds` with a value a profile, NaN for null;
    then the result is (keys, hz, kinds), and layers are never rows.
    """
    item = F.struct(F.col("hz").cast("int").alias("hz"), *[F.col(c).cast("double").alias(c) for c in fields])
    met = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    if isinstance(counts, int):
        met = met.withColumn("__n", F.lit(counts))
    else:
        met = met.join(counts.select(*keys, F.col("sim_comppct").cast("int").alias("__n")).where("__n >= 1"), keys)
    met = met.select(*keys, key_text(keys).cast("binary").alias("__text"), "__n", "__items")
    names = [*keys, "sim", "hz", "top", "bottom"]

    def lot(batch: pa.RecordBatch, at: np.ndarray, n: np.ndarray, hz: list, values: dict[str, np.ndarray]) -> pa.RecordBatch:
        first = np.cumsum(n) - n
        own = np.repeat(np.arange(len(at)), n)
        sims = np.arange(len(own)) - first[own] + 1
        heads = batch.column("__text").take(pa.array(at)).to_pylist()
        texts = [heads[i] + b"%d|" % sim for i, sim in zip(own.tolist(), sims.tolist())]

        def draw(endings: list[str], layers: bool = True) -> np.ndarray:
            if not layers:
                return uniforms(texts, [e.encode() for e in endings])
            each = [(f"{h}|" if h is not None else "") + e for h in hz for e in endings]
            return uniforms(texts, [e.encode() for e in each]).reshape(len(texts), len(hz), len(endings))

        with np.errstate(invalid="ignore", divide="ignore"):
            top, bottom = make(values, first, own, draw)
            if figures:
                return summed(batch, at, hz, [figures(top[:, k], bottom[:, k], first, own) for k in alike_at(hz)])
        wide = np.repeat(at[own], len(hz))
        floats = [pa.array(x.ravel(), from_pandas=True) for x in (top, bottom)]
        rest = [pa.array(np.repeat(sims, len(hz)).astype(np.int32)), pa.array(hz * len(own), pa.int32()), *floats]
        return pa.record_batch([*[batch.column(k).take(pa.array(wide)) for k in keys], *rest], names=names)

    def alike_at(hz: list) -> list[list[int]]:
        return [[i for i, h in enumerate(hz) if h == one] for one in dict.fromkeys(hz)]

    def summed(batch: pa.RecordBatch, at: np.ndarray, hz: list, found: list[list[np.ndarray]]) -> pa.RecordBatch:
        each = [k[0] for k in alike_at(hz)]
        heads = [batch.column(k).take(pa.array(np.tile(at, len(each)))) for k in keys]
        floats = [pa.array(np.concatenate(x), from_pandas=True) for x in zip(*found)]
        return pa.record_batch([*heads, pa.array([hz[k] for k in each for _ in at], pa.int32()), *floats], names=[*keys, "hz", *[k.split()[0] for k in kinds.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, n = batch.column("__items"), batch.column("__n").to_numpy()
            size = pc.list_value_length(column).to_numpy()
            begins, flat = np.cumsum(size) - size, column.flatten()
            every = flat.field("hz").to_pylist()
            table = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in fields}
            alike: dict[tuple, list[int]] = {}  # profiles whose horizons have the same numbers
            for i, (b, k) in enumerate(zip(begins.tolist(), size.tolist())):
                alike.setdefault(tuple(every[b : b + k]), []).append(i)
            for hz, members in alike.items():
                at = np.array(members)
                ends = np.cumsum(n[at].astype(np.int64)) * len(hz)
                start = 0
                while start < len(at):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOT, side="right")))
                    part = at[start:stop]
                    place = begins[part][:, None] + np.arange(len(hz))
                    yield lot(batch, part, n[part], list(hz), {c: v[place] for c, v in table.items()} | {"hz": np.array([np.nan if h is None else h for h in hz])})
                    start = stop

    heads = ", ".join(f"`{k}` {met.schema[k].dataType.simpleString()}" for k in keys)
    return met.mapInArrow(run, f"{heads}, hz int, {kinds}" if figures else f"{heads}, sim int, hz int, top double, bottom double")


def _down_at(v: dict[str, np.ndarray], u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_down() of arrays (repetitions, layers); u is that of bottoms."""
    tops, bottoms = np.zeros(u.shape), np.zeros(u.shape)
    for i in range(u.shape[1]):
        if i:
            tops[:, i] = bottoms[:, i - 1]
        low = np.fmax(v["hzdepb_l"][:, i], tops[:, i])
        high = np.fmax(low, v["hzdepb_h"][:, i])
        drawn = np.rint(triangular_at(low, np.fmin(np.fmax(v["hzdepb_r"][:, i], low), high), high, u[:, i]))
        bottoms[:, i] = np.fmax(drawn, tops[:, i])
    return tops, bottoms


def _up_at(v: dict[str, np.ndarray], u_top: np.ndarray, u_bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_up() of arrays (repetitions, layers)."""
    tops, bottoms = np.zeros(u_top.shape), np.zeros(u_top.shape)
    last = u_top.shape[1] - 1
    for i in range(last, -1, -1):
        bottoms[:, i] = tops[:, i + 1] if i < last else np.rint(triangular_at(v["hzdepb_l"][:, i], v["hzdepb_r"][:, i], v["hzdepb_h"][:, i], u_bottom[:, i]))
        low, high = v["hzdept_l"][:, i], np.fmin(v["hzdept_h"][:, i], bottoms[:, i])
        top = np.rint(triangular_at(low, np.fmin(np.fmax(v["hzdept_r"][:, i], low), high), high, u_top[:, i]))
        tops[:, i] = np.fmin(top, bottoms[:, i])
    tops[:, 0], bottoms[:, 0] = 0.0, np.fmax(bottoms[:, 0], 0.0)
    return tops, bottoms


def _moved_at(top: np.ndarray, bottom: np.ndarray, t: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The steps of perturbed() on arrays (repetitions, layers) with offsets."""
    tops, bottoms = np.empty(t.shape), np.empty(t.shape)
    stacked = tops[:, 0] = top[:, 0]
    for i in range(t.shape[1]):
        if i:
            tops[:, i] = bottoms[:, i - 1]
        plain = bottom[:, i] - top[:, i]
        stacked = stacked + np.fmax(np.where(t[:, i] == 0, plain, np.rint(plain + t[:, i])), least)
        moved = np.where(b[:, i] == 0, stacked, np.rint(stacked + b[:, i]))
        bottoms[:, i] = np.fmax(moved, tops[:, i] + least)
    return tops, bottoms


def _offsets(draw: Callable, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal draws of thicknesses and of bottoms."""
    z = qnorm_at(draw([f"thickness|{seed}", f"bound|{seed}"]))
    return z[:, :, 0], z[:, :, 1]


def _mixed_at(v: dict[str, np.ndarray], draw: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Tops and bottoms of repetitions, top down or bottom up as drawn."""
    u = draw(["top", "bottom"])
    down = draw(["way"], layers=False) < 0.5
    return tuple(np.where(down, x, y) for x, y in zip(_down_at(v, u[:, :, 1]), _up_at(v, u[:, :, 0], u[:, :, 1])))


def sd_at(x: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """stddev_samp() of each profile's repetitions; NaN for fewer than two values."""
    seen = ~np.isnan(x)
    part = np.where(seen, x, 0.0)
    n = np.add.reduceat(seen.sum(axis=1), first)
    off = np.where(seen, part - (np.add.reduceat(part.sum(axis=1), first) / n)[own, None], 0.0)
    return np.where(n > 1, np.sqrt(np.add.reduceat((off * off).sum(axis=1), first) / (n - 1)), np.nan)


def mixed_spread(horizons: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, hz, thickness_sd): thickness_spread() of simulated() profiles,
    mixed, n times and held, made in vectors where a profile's horizons meet.
    Parts are those of horizons, see dealt()."""
    by = Window.partitionBy(*keys, "hz")
    rows = with_variability(horizons).withColumns({"low": F.min("hzdept_l").over(by), "high": F.max("hzdepb_h").over(by)})

    def make(v: dict[str, np.ndarray], first: np.ndarray, own: np.ndarray, draw: Callable) -> tuple[np.ndarray, np.ndarray]:
        every = {c: v[c][own] for c in (*DEPTHS, "low", "high")}
        top, bottom = _mixed_at(every, draw)
        return np.fmax(top, every["low"]), np.fmin(bottom, every["high"])

    spread = lambda top, bottom, first, own: [sd_at(bottom - top, first, own)]
    found = repeated(rows, n, keys, [*DEPTHS, "low", "high"], make, spread, "thickness_sd double")
    return found.withColumn("thickness_sd", F.round("thickness_sd", 2))


def perturbed_counts(layers: DataFrame, counts: DataFrame, keys: list[str], seed: int = 1, least: float = 1.0, figures: Callable | None = None, kinds: str = "") -> DataFrame:
    """perturbed() of each profile of layers (keys, hz, top, bottom,
    thickness_sd, bound_sd), once for each replication 1..sim_comppct of
    counts: (keys, sim, hz, top, bottom), equal to those of perturbed() with
    keys and sim over replicated() layers. figures, kinds: see repeated(). Parts
    are those of layers, see dealt()."""

    def make(v: dict[str, np.ndarray], first: np.ndarray, own: np.ndarray, draw: Callable) -> tuple[np.ndarray, np.ndarray]:
        z_thick, z_bound = _offsets(draw, seed)
        t, b = np.nan_to_num(v["thickness_sd"])[own] * z_thick, np.nan_to_num(v["bound_sd"])[own] * z_bound
        return _moved_at(v["top"][own], v["bottom"][own], t, b, least)

    return repeated(layers, counts, keys, ["top", "bottom", "thickness_sd", "bound_sd"], make, figures, kinds)


def _spread_at(thick: np.ndarray, hz: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """thickness_spread() as (profiles, layers); 0 for fewer than two values."""
    out = np.zeros((len(first), thick.shape[1]))
    for h in np.unique(hz):
        at = np.flatnonzero((hz == h) | np.isnan(hz) & np.isnan(h))
        part, seen = np.nan_to_num(thick[:, at]), ~np.isnan(thick[:, at])
        n = np.add.reduceat(seen.sum(axis=1), first)
        mean = np.add.reduceat(part.sum(axis=1), first) / n
        off = np.where(seen, part - mean[own, None], 0.0)
        sd = np.sqrt(np.add.reduceat((off * off).sum(axis=1), first) / (n - 1))
        out[:, at] = np.where(n > 1, np.floor(sd * 100 + 0.5) / 100, 0.0)[:, None]
    return out


def replicated(horizons: DataFrame, counts: DataFrame) -> DataFrame:
    """Horizons once for each replication 1..sim_comppct of their component,
    in column sim; components without a count, or with 0, have none."""
    counted = horizons.join(counts.select("cokey", "sim_comppct"), "cokey")
    return counted.where("sim_comppct >= 1").withColumn("sim", F.explode(F.sequence(F.lit(1), F.col("sim_comppct").cast("int")))).drop("sim_comppct")


def perturbed_profiles(horizons: DataFrame, counts: DataFrame, seed: int = 1) -> DataFrame:
    """(cokey, sim, hz, top, bottom): each profile as often as its component
    counts, perturbed by the spread of its simulated thicknesses and by the
    distinctness of its boundaries, then held within its depth ranges.

    counts: (cokey, sim_comppct). Profiles of one horizon are only repeated.
    `bound_sd` is the mean of the profile's horizons of the same general name.
    No layer ends above its top.
    """
    rows = with_distinctness(with_variability(dealt(horizons, ["cokey"])))
    by = Window.partitionBy("cokey", "hz")
    rows = rows.withColumns({"bound": F.avg("bound_sd").over(Window.partitionBy("cokey", "genhz")), "low": F.min("hzdept_l").over(by), "high": F.max("hzdepb_h").over(by)})

    def make(v: dict[str, np.ndarray], first: np.ndarray, own: np.ndarray, draw: Callable) -> tuple[np.ndarray, np.ndarray]:
        every = {c: v[c][own] for c in (*DEPTHS, "low", "high")}
        t = b = np.zeros(every["low"].shape)
        if t.shape[1] > 1:
            tops, bottoms = _mixed_at(every, draw)
            z_thick, z_bound = _offsets(draw, seed)
            t, b = _spread_at(bottoms - tops, v["hz"], first, own)[own] * z_thick, np.nan_to_num(v["bound"])[own] * z_bound
        top, bottom = _moved_at(every["hzdept_r"], every["hzdepb_r"], t, b, 1.0)
        top = np.fmax(top, every["low"])
        return top, np.fmax(top, np.fmin(bottom, every["high"]))

    return repeated(rows, counts, ["cokey"], [*DEPTHS, "low", "high", "bound"], make)
