"""Cleaning of horizon and component tables, and how well it went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which properties arrive, by standard.
ALIASES = {
    "ssurgo": {
        "claytotal_r": ["clay_total", "clay_r", "clay", "claytotal"], "sandtotal_r": ["sand_total", "sand_r", "sand", "sandtotal"], "silttotal_r": ["silt_total", "silt_r", "silt", "silttotal"],
        "dbovendry_r": ["bulk_density", "db_r", "db", "bulk_density_third_bar"], "ph1to1h2o_r": ["ph", "pH", "ph_r", "pH_r"], "om_r": ["om", "organic_matter", "organic_matter_r"], "cec7_r": ["cec", "cec_r"],
    },
    "nrcs": {
        "clay_pct": ["claytotal_r", "clay_total", "clay"], "sand_pct": ["sandtotal_r", "sand_total", "sand"], "silt_pct": ["silttotal_r", "silt_total", "silt"],
        "bulk_density": ["dbovendry_r", "bulk_density_third_bar", "db"], "pH": ["ph1to1h2o_r", "ph", "pH"], "organic_matter": ["om_r", "om", "organic_matter"], "cec": ["cec7_r", "cec"],
    },
}
#: Centimetres in a unit.
UNITS = {"cm": 1.0, "m": 100.0, "in": 2.54, "ft": 30.48}


def renamed(rows: DataFrame, standard: str = "ssurgo", aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns under their standard names: the first alias that is there is
    renamed, further ones are dropped. Names count with their case."""
    out = rows
    for name, others in (aliases or ALIASES[standard]).items():
        there = [c for c in others if c in rows.columns]
        if there and name not in rows.columns:
            out = out.withColumnRenamed(there[0], name).drop(*there[1:])
    return out


def converted(depth: Column, source: str, target: str, digits: int | None = 2) -> Column:
    """A depth in another unit; unchanged in the same one."""
    if source not in UNITS or target not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")
    out = depth if source == target else depth * UNITS[source] / UNITS[target]
    return out if digits is None or source == target else F.round(out, digits)


def coalesced(rows: DataFrame, columns: list[str], kind: str = "double", default=None) -> Column:
    """The first value of those columns that exist; text that can't be read as
    the kind, and empty text, count as missing."""
    there = [c for c in columns if c in rows.columns]
    cast = [F.expr(f"try_cast(`{c}` AS {kind})") for c in there]
    held = [F.nullif(c, F.lit("")) for c in cast] if kind == "string" else cast
    return F.coalesce(*held, F.lit(default).cast(kind))


def as_number(text: Column) -> Column:
    """Digits, points and signs of a text as a number; null if they aren't one."""
    return F.regexp_replace(text.cast("string"), "[^0-9.-]", "").try_cast("double")


def valid_horizons(horizons: DataFrame, deepest: float = 250.0) -> DataFrame:
    """Rows of a component whose depths are known, rise, and aren't too deep."""
    good = (F.col("hzdept_r") >= 0) & (F.col("hzdepb_r") > F.col("hzdept_r")) & (F.col("hzdepb_r") <= deepest) & (F.col("hzdept_r") < deepest)
    return horizons.where(good & F.col("cokey").isNotNull() & (F.col("cokey").cast("string") != ""))


def valid_components(components: DataFrame) -> DataFrame:
    """Rows with a key and, where there is one, a share from 0 to 100."""
    share = F.col("comppct_r")
    return components.where(F.col("cokey").isNotNull() & (F.col("cokey").cast("string") != "") & (share.isNull() | share.between(0, 100)))


def described_components(components: DataFrame, major: float = 15.0) -> DataFrame:
    out = components.withColumn("is_major", F.coalesce(F.col("comppct_r") >= major, F.lit(False)))
    return out.withColumn("is_classified", F.col("taxclname").isNotNull()) if "taxclname" in components.columns else out


def derived(horizons: DataFrame) -> DataFrame:
    """Thickness, midpoint and, from both water contents, what is available;
    a thickness or capacity that is there already stays."""
    out = horizons.withColumn("mid", (F.col("hzdept_r") + F.col("hzdepb_r")) / 2)
    if "hzthk_r" not in horizons.columns:
        out = out.withColumn("hzthk_r", F.col("hzdepb_r") - F.col("hzdept_r"))
    if "awc_r" not in horizons.columns and {"wthirdbar_r", "wfifteenbar_r"} <= set(horizons.columns):
        out = out.withColumn("awc_r", F.col("wthirdbar_r") - F.col("wfifteenbar_r"))
    return out


def range_violations(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, n, share): values outside their range; nulls are in it."""
    out = [F.struct(F.lit(c).alias("column"), F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("n"), F.count("*").alias("rows")) for c, (lo, hi) in ranges.items()]
    found = rows.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x"))
    return found.select("x.column", "x.n", F.when(F.col("x.rows") > 0, F.col("x.n") / F.col("x.rows")).alias("share"))


def clipped(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in ranges.items()})


def rule_violations(rows: DataFrame, rules: list[tuple[list[str], float, float]]) -> DataFrame:
    """rows with `broken`: how many of the rules (columns, sum, tolerance) the
    sum of their columns fails; nulls count as 0."""
    broken = F.lit(0)
    for columns, total, tolerance in rules:
        whole = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
        broken = broken + (F.abs(whole - total) > abs(total) * tolerance).cast("int")
    return rows.withColumn("broken", broken)


def required(rows: DataFrame, columns: dict[str, str | None]) -> list[str]:
    """What is wrong with the columns: missing, or of another type."""
    types = dict(rows.dtypes)
    return [f"{c} is missing" for c in columns if c not in types] + [f"{c} is {types[c]}, not {t}" for c, t in columns.items() if t and types.get(c, t) != t]


def grade(score: Column) -> Column:
    return F.when(score.isNull(), "Unknown").when(score >= 0.9, "Excellent").when(score >= 0.8, "Good").when(score >= 0.7, "Acceptable").when(score >= 0.6, "Needs Improvement").otherwise("Poor")


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are there, by weight; null without any."""
    held = [F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in parts]
    total = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in parts), F.lit(0.0))
    return total / F.nullif(sum(held, F.lit(0.0)), F.lit(0.0))


def processing_report(before: DataFrame, after: DataFrame, columns: list[str], validation: float | None = None) -> DataFrame:
    """One row: rows_before, rows_after, retention, completeness (mean share of
    values that are there), score and its grade."""
    names = [f"`{c}`" for c in columns]
    rows = before.select(F.lit(0).alias("__side"), *names).unionByName(after.select(F.lit(1).alias("__side"), *names))
    late = F.col("__side") == 1
    share = lambda c: F.avg(F.when(late, F.col(c).isNotNull().cast("double")))
    filled = sum((share(c) for c in names[1:]), share(names[0])) / len(names)
    both = rows.agg(F.count_if(~late).alias("rows_before"), F.count_if(late).alias("rows_after"), filled.alias("completeness"))
    out = both.withColumn("retention", F.when(F.col("rows_before") > 0, F.col("rows_after") / F.col("rows_before")))
    score = weighted_score([(F.lit(validation).cast("double"), 0.4), (F.least("retention", F.lit(1.0)), 0.25), (F.col("completeness"), 0.25)])
    return out.withColumn("score", score).withColumn("grade", grade(F.col("score")))
