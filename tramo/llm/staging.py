"""Staged tables, size-checked broadcasts and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo import tables
from tramo.tables import drop_folder, new_folder

__all__ = ["drop_folder", "drop_staged", "lower_ascii", "new_folder", "quoted", "small", "small_batches", "stage", "unused"]

#: Rows of a side that may be broadcast after they were counted; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


@contextmanager
def small_batches(spark: SparkSession, size: str = "2m") -> Iterator[None]:
    """While an action runs, Arrow batches of whole texts hold about so many bytes; then the session is as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df, in small Arrow batches where Python makes its rows, and return what reads it back."""
    with small_batches(df.sparkSession):
        return tables.stage(df, name, small_methods=False)


def drop_staged(df: DataFrame) -> None:
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else as it is. df should be cheap to count (staged)."""
    return F.broadcast(df) if df.count() <= limit else df


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """The column of just that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
