"""The corpus pipeline: five stages over documents, each written as Parquet
and read again as the next one's input.

language          rows that are in no learned language go
near_duplicates   one row of each class of near copies stays
passages          repeats of passages of over 50 words are cut out of texts
decontamination   rows that overlap the benchmark go
packing           what is left, as token sequences

All but the last keep the columns of documents. Null and empty texts go with
the first stage; tables without rows stay without rows. Tables that a stage
wrote in the shared folder are dropped when the next one of the same run
begins, and its output when the next one is written.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from loamcast.llm import decontamination, langid, neardup, packing, passages
from loamcast.llm.common import Scratch, table, written

_run: ContextVar[Scratch | None] = ContextVar("run", default=None)


def _scope(spark: SparkSession) -> Scratch:
    """The scratch tables of this run, without those of the stage before; a
    stage that is called by itself has its own."""
    scope = _run.get() or Scratch()
    scope.drop(spark)
    return scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a learned language; learned from the rows that have one."""
    _scope(spark)
    return langid.identified(docs, langid.train(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest id."""
    return neardup.deduplicated(docs, _scope(spark))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; texts without passages that stand in an earlier document."""
    return passages.cleaned(docs, _scope(spark))


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't contaminated by the benchmark."""
    _scope(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; an empty text is its closing token."""
    return packing.pack(docs, scope=_scope(spark))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", repeated_passages),
    ("decontamination", benchmark_overlap),
    ("packing", pack),
]

ORACLE_SQL = None  # models, samples and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scope, before = table(spark, sf_dir, "documents"), Scratch(), Scratch()
    token = _run.set(scope)
    try:
        for _, stage in STAGES:
            output = Scratch()
            docs = written(stage(spark, docs, sf_dir), output)
            before.drop(spark)
            before = output
        scope.drop(spark)
    finally:
        _run.reset(token)
    return docs
