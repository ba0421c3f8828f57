"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; only Spark opens the path."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent, as in a local test session, is a
    temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loamcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, scope: "Scratch | None" = None) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so a lost
    executor costs a reread and nothing upstream is computed twice. It is
    deleted with its scope, or at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loamcast-{uuid.uuid4().hex}"
    schema = df.schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    if scope is not None:
        scope.paths.append(path)
    return spark.read.schema(schema).parquet(path)


def sized(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df for the small side of a join: counted first, and broadcast only up
    to that many rows; beyond it Spark shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


class Scratch:
    """Tables written for one run, so that they can be dropped when read."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession, keep: int = 0) -> None:
        """Deletes all but the last `keep` tables, by Spark's file system."""
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, A_TO_Z, A_TO_Z.lower())


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    digest = F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(digest, F.lit(modulus)) == remainder


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, under one name for the plan."""
    return df.mapInArrow(function, schema)


def freed() -> None:
    """Gives memory that this worker no longer uses back to the system: Spark
    keeps workers from stage to stage, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about `limit` text bytes, one row at least;
    before and after, unused memory is freed()."""
    import numpy as np

    freed()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    freed()
