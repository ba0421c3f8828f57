"""Fusion of two gridded sources, end to end: the prior's cells are brought
onto the likelihood's grid, and each cell is fused by family, or a group of
parts jointly. Sources are tables of cells; nothing is fetched."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Z95
from . import fusion


@dataclass(frozen=True)
class Grid:
    """A regular grid: where its first cell begins, and its step."""

    x0: float
    y0: float
    step: float


def onto(cells: DataFrame, grid: Grid, targets: DataFrame, target: Grid, columns: list[str]) -> DataFrame:
    """targets (x, y: cell numbers of `target`, ...) with bilinear values of
    `columns` from cells (x, y: cell numbers of `grid`, ...).

    Each target asks for the four cells around its middle, by their numbers:
    one equi-join, whatever the steps. Cells that are missing, and null
    values, drop out with their weights, each column by itself; a target with
    none around it has nulls. Names of columns that targets have too are
    refused.
    """
    taken = set(columns) & set(targets.columns)
    if taken:
        raise ValueError(f"both sides have {sorted(taken)}")
    place = lambda c, a, b: (F.lit(b) + (F.col(c) + 0.5) * target.step - a) / grid.step - 0.5
    at = targets.select("x", "y").distinct().withColumns({"__px": place("x", grid.x0, target.x0), "__py": place("y", grid.y0, target.y0)})
    at = at.withColumns({"__fx": F.floor("__px"), "__fy": F.floor("__py")})
    share = lambda side, k: (F.col(f"__p{side}") - F.col(f"__f{side}")) if k else 1 - (F.col(f"__p{side}") - F.col(f"__f{side}"))
    corners = F.array(*[F.struct((F.col("__fx") + i).alias("cx"), (F.col("__fy") + j).alias("cy"), (share("x", i) * share("y", j)).alias("w")) for i in (0, 1) for j in (0, 1)])
    asked = at.select("x", "y", F.explode(corners).alias("c")).select("x", "y", "c.*").where("w > 0")
    source = cells.select(F.col("x").cast("long").alias("cx"), F.col("y").cast("long").alias("cy"), *columns)
    met = asked.join(source, ["cx", "cy"])
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("w")), F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c)
    return targets.join(met.groupBy("x", "y").agg(*map(mean, columns)), ["x", "y"], "left")


def fused(prior: DataFrame, prior_grid: Grid, likelihood: DataFrame, grid: Grid, prior_columns: dict[float, str], columns: dict[float, str], family: str = "auto", bounds: tuple[float, float] | None = None) -> DataFrame:
    """Cells of the likelihood with the aligned prior, `posterior` (mu, sigma),
    `route` and `family`.

    auto is normal or lognormal by the skew of the aligned prior's medians.
    Cells that lack the prior keep the likelihood's normal moments ("likelihood"),
    those that lack the likelihood the prior's ("prior"), and those without
    either are null ("none").
    """
    rows = onto(prior, prior_grid, likelihood, grid, list(prior_columns.values()))
    if family == "auto":
        found = fusion.family_of_cells(rows, prior_columns).first()
        family = found["family"] if found and found["skew"] is not None else "normal"
    there = lambda c: [F.col(x).isNotNull() for x in fusion.interior(c).values()]
    every = lambda c: reduce(lambda a, b: a & b, there(c))
    both = fusion.fuse_cells(rows, prior_columns, columns, family, bounds)
    moments = lambda c: F.struct(F.col(c[0.5]).alias("mu"), ((F.col(c[fusion.outer(c)[1]]) - F.col(c[fusion.outer(c)[0]])) / (2 * Z95)).alias("sigma"))
    a, b = every(prior_columns), every(columns)
    posterior = F.when(a & b, F.struct(F.col("posterior.mu").alias("mu"), F.col("posterior.sigma").alias("sigma"))).when(b, moments(columns)).when(a, moments(prior_columns))
    route = F.when(a & b, F.col("route")).when(b, "likelihood").when(a, "prior").otherwise("none")
    return both.withColumns({"posterior": posterior, "route": route, "family": F.lit(family)})


def fused_group(prior: DataFrame, prior_grid: Grid, likelihood: DataFrame, grid: Grid, parts: dict[str, tuple[tuple[str, str, str], tuple[str, str, str]]], n: int = 200) -> DataFrame:
    """(cell_x, cell_y, one column a part, and the log-ratio posterior x, y,
    xx, xy, yy): three parts that sum to 100, fused jointly. parts: of each the columns of its low,
    representative and high on both sides. Cells that lack any drop out."""
    names = [c for a, _ in parts.values() for c in a]
    rows = onto(prior, prior_grid, likelihood, grid, names).dropna(subset=[*names, *[c for _, b in parts.values() for c in b]])
    rows = rows.withColumnsRenamed({"x": "cell_x", "y": "cell_y"})
    return fusion.fuse_composition(rows, ["cell_x", "cell_y"], {p: a for p, (a, _) in parts.items()}, {p: b for p, (_, b) in parts.items()}, n, Z95, Z95)
