"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (where or _own_dir(spark.sparkContext.applicationId)).rstrip("/")


@functools.cache
def _own_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='veritab-')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back with the same schema.

    Readers find every file there whichever executors are lost later. What no later result reads
    may be given to `discard`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*frames: DataFrame) -> None:
    """Delete stored frames that nothing reads any more; others are left alone."""
    for df in frames:
        path = df.__dict__.pop("_stored_at", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def file_system(path: str):
    """A pyarrow file system and the path in it, for file:, hdfs: and other URIs or plain paths; as in Spark, nothing in them is escaped."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")
    return fs.LocalFileSystem(), os.path.abspath(path)
