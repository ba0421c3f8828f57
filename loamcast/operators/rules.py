"""Validation rules as data: compiled into one pass over the rows, with the
reasons of each row and a report of each rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = "array<struct<rule: string, severity: string>>"


@dataclass(frozen=True)
class Rule:
    """A name, a severity ("error" or "warning"), the columns it needs, and
    two conditions on a row: whether it applies, and whether it holds."""

    name: str
    severity: str
    columns: tuple[str, ...]
    applies: Callable[[], Column]
    holds: Callable[[], Column]


def _there(columns: tuple[str, ...]) -> Callable[[], Column]:
    return lambda: reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def between(column: str, low: float | None = None, high: float | None = None, severity: str = "error") -> Rule:
    """A value that is there lies in low..high, ends included; NaN doesn't."""

    def holds() -> Column:
        x = F.col(column).cast("double")
        return ~F.isnan(x) & (x >= (low if low is not None else float("-inf"))) & (x <= (high if high is not None else float("inf")))

    return Rule(f"{column} in range", severity, (column,), _there((column,)), holds)


def sums_to(columns: tuple[str, ...], total: float, tolerance: float = 0.1, severity: str = "error") -> Rule:
    """Columns that are all there add up to the total."""
    return Rule(f"{' + '.join(columns)} = {total:g}", severity, tuple(columns), _there(tuple(columns)), lambda: F.abs(reduce(Column.__add__, [F.col(c) for c in columns]) - total) <= tolerance)


def ordered(low: str, high: str, severity: str = "error") -> Rule:
    """The first column isn't above the second, where both are there."""
    return Rule(f"{low} <= {high}", severity, (low, high), _there((low, high)), lambda: F.col(low) <= F.col(high))


def conditional(name: str, columns: tuple[str, ...], when: Callable[[], Column], then: Callable[[], Column], severity: str = "warning") -> Rule:
    """Rows for which `when` is true also meet `then`."""
    return Rule(name, severity, tuple(columns), when, then)


def custom(name: str, columns: tuple[str, ...], condition: str, severity: str = "error") -> Rule:
    """A condition in SQL, of all rows with the columns; null doesn't hold."""
    return Rule(name, severity, tuple(columns), _there(tuple(columns)), lambda: F.expr(condition))


def usable(rules: list[Rule], rows: DataFrame) -> list[Rule]:
    """The rules whose columns the rows have."""
    names = set(rows.columns)
    return [r for r in rules if set(r.columns) <= names]


def judged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with `reasons`, the rules that each breaks, in the order of the
    rules, and `accepted`: whether none of them is an error. Rules whose
    columns are missing are left out; a rule that doesn't apply, or applies to
    null, isn't broken. One narrow pass."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    parts = [F.when(flag(r.applies()) & ~flag(r.holds()), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in usable(rules, rows)]
    reasons = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array()
    out = rows.withColumn("reasons", reasons.cast(REASONS))
    return out.withColumn("accepted", ~F.exists("reasons", lambda x: x["severity"] == "error"))


def report(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, applied, broken, share) of each rule, also of those
    that no row meets; skipped rules have nulls. One aggregate over the rows."""
    held = usable(rules, rows)
    flag = lambda c: F.coalesce(c, F.lit(False))
    counts = [c for i, r in enumerate(held) for c in (F.count_if(flag(r.applies())).alias(f"a{i}"), F.count_if(flag(r.applies()) & ~flag(r.holds())).alias(f"b{i}"))]
    wide = rows.agg(F.count("*").alias("rows"), *counts)
    known = {id(r): i for i, r in enumerate(held)}
    one = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), *[(F.col(f"{c}{known[id(r)]}") if id(r) in known else F.lit(None).cast("long")).alias(n) for c, n in (("a", "applied"), ("b", "broken"))])
    long = wide.select(F.explode(F.array(*map(one, rules))).alias("x")).select("x.*")
    return long.withColumn("share", F.when(F.col("applied") > 0, F.col("broken") / F.col("applied")))


def unsuitable_summary(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """(name, n, share) of the horizons that are set aside, by their name."""
    total = rows.agg(F.count("*").alias("__all")).withColumn("__one", F.lit(1))  # one row
    found = rows.where(F.col(flag)).groupBy(name).agg(F.count("*").alias("n")).withColumn("__one", F.lit(1))
    return found.join(F.broadcast(total), "__one").select(name, "n", (F.col("n") / F.col("__all")).alias("share"))
