"""Infilling of properties by what is known of them: related properties,
learned spreads, rock fragments and water retention. All are row expressions
but for the learned spreads, which are medians by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import quantiles_at, small

#: Fixed values: (type, low, high, fallback spread) by property.
PROPERTIES = {
    "sandtotal": ("texture", 0.0, 100.0, 8.0), "claytotal": ("texture", 0.0, 100.0, 8.0), "silttotal": ("texture", 0.0, 100.0, 8.0), "dbovendry": ("bulk_density", 0.8, 2.2, 0.15),
    "wthirdbar": ("water_retention", 0.0, 60.0, 3.0), "wfifteenbar": ("water_retention", 0.0, 60.0, 3.0), "rfv": ("rock_fragments", 0.01, 85.0, 5.0), "cec7": ("cec", 0.0, 100.0, 5.0),
    "ph1to1h2o": ("ph", 3.0, 10.0, 0.5), "om": ("organic_matter", 0.0, 50.0, 1.5),
}
GENERIC = ("generic", None, None, 5.0)
#: Limits by type beside the range, typical texture spreads, and
#: limits beyond which a value is an error.
LIMITS = {"texture": (0.0, 100.0), "ph": (0.0, 14.0), "rock_fragments": (0.01, 95.0)}
SPREADS = {"sandtotal": 12.0, "claytotal": 8.0, "silttotal": 10.0}
ERRORS = {"sandtotal": (0.0, 100.0), "claytotal": (0.0, 100.0), "silttotal": (0.0, 100.0), "dbovendry": (0.3, 3.0), "wthirdbar": (0.0, 70.0), "wfifteenbar": (0.0, 60.0), "cec7": (0.0, 200.0), "ph1to1h2o": (2.5, 11.0), "om": (0.0, 100.0), "rfv": (0.0, 95.0)}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def constrained(x: Column, name: str) -> Column:
    """Held within the property's range and its type's limits; null stays."""
    kind, low, high, _ = PROPERTIES.get(name, GENERIC)
    held = x if low is None else clamp(x, low, high)
    held = clamp(held, *LIMITS[kind]) if kind in LIMITS else F.greatest(held, F.lit(0.0))
    return F.when(x.isNotNull(), held)


def without_errors(x: Column, name: str) -> Column:
    """Null outside the limits of what can be; of unknown properties, below 0."""
    low, high = ERRORS.get(name, (0.0, float("inf")))
    return F.when((x >= low) & (x <= high), x)


def fragment_class(rfv: Column) -> Column:
    return F.when(rfv.isNull() | (rfv <= 0), "none").when(rfv <= 5, "low").when(rfv <= 15, "moderate").when(rfv <= 35, "high").when(rfv <= 60, "very_high").otherwise("extreme")


def rock_fragments(rfv: Column, sand: Column, silt: Column, clay: Column) -> Column:
    """struct(l, r, h): missing volumes are small where the texture is whole,
    larger elsewhere; known ones get a spread of three tenths."""
    row = lambda low, mid, high: F.struct(low.alias("l"), mid.alias("r"), high.alias("h"))
    fixed = lambda *v: row(*map(F.lit, v))
    whole = F.coalesce((sand + silt + clay).between(95, 105), F.lit(False))
    held = clamp(rfv, 0.1, 85.0)
    known = row(F.greatest(F.lit(0.05), held - 0.3 * held), held, F.least(F.lit(85.0), held + 0.3 * held))
    return F.when(rfv.isNull() & whole, fixed(0.1, 0.5, 1.0)).when(rfv.isNull(), fixed(0.5, 2.0, 5.0)).when(rfv <= 0.01, fixed(0.05, 0.1, 0.5)).otherwise(known)


def water_retention(rows: DataFrame, sand: Column, silt: Column, clay: Column, density: Column, rfv: Column, om: Column) -> DataFrame:
    """rows with field, field_l, field_h, wilt, wilt_l, wilt_h and available,
    in percent, by the pedotransfer equations of Saxton and Rawls as the
    constants below state them; null where an input but rfv (0) and om (2) is.
    Built in steps, as nested expressions would repeat themselves."""
    c = F.col
    out = rows.withColumns({"__s": clamp(sand, 0.0, 100.0), "__i": clamp(silt, 0.0, 100.0), "__c": clamp(clay, 0.0, 100.0), "__o": clamp(F.coalesce(om, F.lit(2.0)), 0.1, 50.0) / 100, "__m": clamp(density, 0.6, 2.5) * (1 - clamp(F.coalesce(rfv, F.lit(0.0)), 0.0, 95.0) / 100)})
    out = out.withColumn("__t", c("__s") + c("__i") + c("__c"))
    out = out.withColumn("__k", F.when(F.abs(c("__t") - 100) > 5, 1 / F.nullif(c("__t"), F.lit(0.0))).otherwise(0.01)).withColumns({"__s": c("__s") * c("__k"), "__c": c("__c") * c("__k")})
    s, y, o = c("__s"), c("__c"), c("__o")
    theta = -0.251 * s + 0.195 * y + 0.011 * o + 0.006 * s * o - 0.027 * y * o + 0.452 * s * y + 0.299
    a = F.exp(F.log(F.lit(33.0)) + 1.54 * s + 0.95 * y + 0.025 * o - 0.351 * s * o - 0.023 * y * o - 0.427 * s * y + 0.015 * s * s * y * y)
    b = F.exp(F.log(F.lit(1500.0)) + 0.02 * y * y + 0.14 * s - 0.0002 * s * s * y - 0.002 * y * y * s - 0.0002 * y * y * o + 0.0003 * y * y * s * o)
    out = out.withColumns({"__h": theta, "__a": a, "__b": b})
    held = lambda x: c("__h") * F.pow(c(x) / (c(x) + 0.31), F.lit(0.17)) * c("__m") * 100
    out = out.withColumns({"__f": held("__a"), "__w": held("__b")}).withColumns({"__f": clamp(c("__f"), 3.0, 65.0), "__w": clamp(c("__w"), 1.0, 45.0)})
    out = out.withColumn("__w", F.when(c("__w") >= c("__f"), c("__f") * 0.6).otherwise(c("__w")))
    near = lambda x, least, most: (F.round(F.greatest(F.lit(least), c(x) * 0.85), 2), F.round(F.least(F.lit(most), c(x) * 1.15), 2))
    (fl, fh), (wl, wh) = near("__f", 2.0, 65.0), near("__w", 1.0, 45.0)
    known = c("__f").isNotNull() & c("__w").isNotNull()
    found = {"field": F.round("__f", 2), "field_l": fl, "field_h": fh, "wilt": F.round("__w", 2), "wilt_l": wl, "wilt_h": wh, "available": F.round(c("__f") - c("__w"), 2)}
    return out.withColumns({n: F.when(known, v) for n, v in found.items()}).drop(*[f"__{x}" for x in "siombtkhabfwc"])


def related(name: str, columns: dict[str, Column]) -> Column:
    """struct(value, method): an estimate from other properties of the row,
    given by name in `columns` (also hzname and depth); null where none is."""
    kind = PROPERTIES.get(name, GENERIC)[0]
    get = lambda n: columns.get(n, F.lit(None).cast("double"))
    zero = lambda x, k: F.coalesce(x * k, F.lit(0.0))
    letter = F.upper(F.substring(columns.get("hzname", F.lit(None).cast("string")), 1, 1))
    clay, sand, om, depth = get("claytotal"), get("sandtotal"), get("om"), get("depth")
    value, method, known = F.lit(None).cast("double"), "none", F.lit(True)
    if kind == "texture":
        first, second = [get(n) for n in ("sandtotal", "claytotal", "silttotal") if n != name]
        value, method = clamp(100 - first - second, 0.0, 100.0), "related_texture_sum"
    elif kind == "water_retention":
        value, method = (clamp(0.3 * clay + 10, 0.0, 60.0) if name == "wthirdbar" else clamp(0.4 * clay + 2, 0.0, 40.0)), "related_clay"
    elif kind == "cec":
        value, method, known = clamp(F.greatest(F.lit(2.0), zero(clay, 0.5) + zero(om, 20)), 0.0, 100.0), "related_clay_om", clay.isNotNull() | om.isNotNull()
    elif kind == "ph":
        shift = F.when(letter == "A", -0.3).when(letter == "C", 0.2).otherwise(0.0) + F.when(om > 5, -0.4).otherwise(0.0)
        value, method = clamp(6.2 + shift, 3.0, 10.0), "related_horizon_om"
    elif kind == "organic_matter":
        by_depth = F.when(depth.isNull(), 2.0).when(depth <= 15, 3.5).when(depth <= 30, 1.8).when(depth <= 50, 0.8).otherwise(0.3)
        by_name = F.when(letter == "A", by_depth * 1.5).when(letter == "C", 0.2).otherwise(by_depth)
        value, method = clamp(by_name * F.when(clay > 35, 1.3).when(clay < 15, 0.7).otherwise(1.0), 0.0, 50.0), "related_depth_horizon"
    elif kind == "bulk_density":
        value, method, known = clamp(1.4 - zero(clay - 20, 0.01) + zero(sand - 50, 0.005), 0.8, 2.2), "related_texture", clay.isNotNull() | sand.isNotNull()
    held = F.when(known, value)
    return F.when(held.isNotNull(), F.struct(held.alias("value"), F.lit(method).alias("method")))


ZONES = ((30.0, "surface"), (100.0, "subsurface"), (200.0, "deep"))


def zone_of(bottom: Column) -> Column:
    """Depth zone of rows that spreads are learned from; none beyond 200 cm."""
    return F.when(bottom <= 0, None).when(bottom <= 30, "surface").when(bottom <= 100, "subsurface").when(bottom <= 200, "deep")


def learned_spreads(horizons: DataFrame, value: str, least: int = 3) -> dict[str, DataFrame]:
    """Median spreads below and above of whole triplets (value_l, _r, _h) of
    suitable horizons: by name, by depth zone (groups of `least` at least) and
    over all, each (key, down, up)."""
    lo, mid, hi = (F.col(f"{value}_{s}") for s in "lrh")
    whole = horizons.where("suitable").where(lo.isNotNull() & mid.isNotNull() & hi.isNotNull()).select("hzname", zone_of(F.col("hzdepb_r")).alias("zone"), (mid - lo).alias("down"), (hi - mid).alias("up"), F.lit("all").alias("every"))

    def medians(key: str) -> DataFrame:
        held = whole.where(F.col(key).isNotNull())
        many = held.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= (least if key != "every" else 1)).select(key)
        down, up = (quantiles_at(held, [key], c, {c: 0.5}) for c in ("down", "up"))
        return many.join(down, key).join(up, key)

    return {key: medians(key) for key in ("hzname", "zone", "every")}


def with_bounds(horizons: DataFrame, value: str, name: str) -> DataFrame:
    """horizons with missing value_l and value_h of suitable rows that have a
    value_r: it less or plus the first positive spread of its name, its depth
    zone, all, or the property's own; held within the property's range, and in
    order. Adds `spread_from`."""
    kind, low, high, fallback = PROPERTIES.get(name, GENERIC)
    learned, out = learned_spreads(horizons, value), horizons.withColumns({"__zone": F.when(F.col("hzdepb_r") <= 30, "surface").when(F.col("hzdepb_r") <= 100, "subsurface").when(F.col("hzdepb_r").isNotNull(), "deep"), "__every": F.lit("all")})
    for key, frame in learned.items():
        at = "hzname" if key == "hzname" else f"__{key}"
        spreads = frame.select(F.col(key).alias("__k"), F.col("down").alias(f"__down_{key}"), F.col("up").alias(f"__up_{key}"))
        spreads = small(spreads, horizons, ["hzname"]) if key == "hzname" else F.broadcast(spreads)  # else four rows at most
        out = out.join(spreads, F.col(at) == F.col("__k"), "left").drop("__k")
    letter = F.upper(F.substring("hzname", 1, 1))
    own = F.when(letter == "A", 0.15).when(letter == "B", 0.12).when(letter == "C", 0.10).otherwise(fallback) if kind == "bulk_density" else F.lit(SPREADS.get(name, fallback))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    mid, suitable = F.col(f"{value}_r"), F.col("suitable")
    for side, sign in (("down", -1), ("up", 1)):
        column = f"{value}_{'l' if sign < 0 else 'h'}"
        spread = F.coalesce(*[positive(f"__{side}_{k}") for k in learned], own)
        edge = mid + sign * spread
        if sign < 0:
            edge = F.greatest(edge, F.lit(low if low is not None else 0.0))
        elif high is not None:
            edge = F.least(edge, F.lit(high))
        filled = F.coalesce(column, F.when(suitable, edge))
        ordered = F.least(filled if low is None else F.greatest(filled, F.lit(low)), mid) if sign < 0 else F.greatest(filled if high is None else F.least(filled, F.lit(high)), mid)
        out = out.withColumn(f"__{column}", F.when(suitable, ordered).otherwise(F.col(column)))
    source = F.when(positive("__down_hzname").isNotNull(), "name").when(positive("__down_zone").isNotNull(), "zone").when(positive("__down_every").isNotNull(), "all").otherwise("own")
    missing = F.col(f"{value}_l").isNull() & mid.isNotNull() & suitable
    out = out.withColumn("spread_from", F.when(missing, source)).withColumns({f"{value}_{s}": F.col(f"__{value}_{s}") for s in "lh"})
    return out.select(*horizons.columns, "spread_from")


def complete(horizons: DataFrame, needed: list[str], keep_unsuitable: bool = False) -> DataFrame:
    """Suitable rows that have all needed values."""
    rows = horizons if keep_unsuitable else horizons.where("suitable")
    return rows.dropna(subset=needed) if needed else rows


def filled_counts(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing_before, missing_after, filled)."""
    nulls = lambda df, n: df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias(n)) for c in columns])).alias("x")).select("x.*")
    both = nulls(before, "missing_before").join(nulls(after, "missing_after"), "column")
    return both.withColumn("filled", F.col("missing_before") - F.col("missing_after"))
