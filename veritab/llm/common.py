"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.shared import discard, new_path, shared_dir, stored  # noqa: F401
from veritab.functions.workers import importable

#: ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
NON_SPACE = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"

BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't fill a Python worker, which must find this package."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows of a few numbers each that a join may send to every executor: some 40 MB in memory.
FEW = 1 << 20


def few_or_many(df: DataFrame, most: int = FEW) -> DataFrame:
    """A stored table of a few numbers a row, for the smaller side of a join: broadcast if it has at most `most` rows, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(batches: Iterator, *names: str):
    """Arrow batches as lists of Python values, a tuple of columns at a time."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones of the caller can't interfere."""
    return df.select(*[df[n].alias(n) for n in names])


def file_system(path: str):
    """A pyarrow file system and the path in it, for file:, hdfs: and other URIs or plain paths."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)
