"""The driver's tables seen as horizons, components, cells and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def horizons(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Line items as horizons of their order: stacked by quantity, with the
    price as a triplet by discount and tax. dealt: in as many parts as
    shuffles have, a profile's rows together, so that what makes many draws of
    few rows, by cokey, needs no shuffle of its own."""
    by = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    bottom = F.sum("l_quantity").over(by.rowsBetween(Window.unboundedPreceding, 0))
    lines = read(spark, sf_dir, "lineitem")
    if dealt:
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return lines.select(
        F.col("l_suppkey").alias("mukey"), F.col("l_orderkey").alias("cokey"), F.col("l_partkey").alias("cell"), F.row_number().over(by).alias("hz"), F.col("l_returnflag").alias("genhz"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("hzname"), (bottom - F.col("l_quantity")).alias("hzdept_r"), bottom.alias("hzdepb_r"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l"), F.col("l_extendedprice").alias("r"), (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("h"),
        F.col("l_quantity").alias("p1"), (50 * F.col("l_discount") + 1).alias("p2"), (50 * F.col("l_tax") + 1).alias("p3"), (F.col("l_linenumber") + F.col("l_orderkey")).alias("mark"),
    )


HORIZONS = """hz AS (SELECT l_suppkey AS mukey, l_orderkey AS cokey, l_partkey AS cell, row_number() OVER w AS hz, l_returnflag AS genhz,
  l_returnflag || CAST(l_linenumber AS VARCHAR) AS hzname, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) - l_quantity AS hzdept_r,
  sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS hzdepb_r, l_extendedprice * (1 - l_discount) AS l, l_extendedprice AS r,
  l_extendedprice * (1 + l_tax) AS h, l_quantity AS p1, 50 * l_discount + 1 AS p2, 50 * l_tax + 1 AS p3, l_linenumber + l_orderkey AS mark
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice))"""


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by the ending of its path: parquet, orc, json, csv, tsv, txt.
    Text formats need a schema, so nothing is read twice to guess one."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("parquet", "orc"):
        return spark.read.format(ending).load(path)
    if ending not in ("json", "csv", "tsv", "txt"):
        raise ValueError(f"no reader for .{ending}")
    if schema is None:
        raise ValueError(f".{ending} needs a schema")
    if ending == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).csv(path, header=True, sep="," if ending == "csv" else "\t")


def save(df: DataFrame, path: str) -> None:
    """Overwrites; the format is the ending of the path."""
    ending = path.rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite")
    if ending in ("parquet", "orc", "json"):
        writer.format(ending).save(path)
    elif ending in ("csv", "tsv"):
        writer.csv(path, header=True, sep="," if ending == "csv" else "\t")
    else:
        raise ValueError(f"no writer for .{ending}")
