"""Folders imported again and again against an append-only registry of what came before.

A path that the registry knows keeps its id and isn't read again. The bytes of other files are hashed where they lie, a piece at
a time; a digest that the registry has, or that an earlier path of the same folder has, makes a file a copy of
the earliest file with it. Each import is a Parquet table of its own and a record with its number. The record is what
makes it count, and only one import gets each number: whoever comes second links its rows to what the first one brought
and takes the next.
"""

from __future__ import annotations

import hashlib
import os
import stat
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.shared import discard, file_system, stored
from veritab.functions.workers import importable
from veritab.sources.files import EXTENSIONS, MAX_BYTES
from veritab.sources.store import Store, now

#: Bytes hashed at a time.
PIECE = 1 << 20
ROWS = "id string, path string, name string, bytes long, created timestamp, digest string, status string, duplicate_of string, error string"
ORIGINAL, COPY, REFUSED = "imported", "duplicate", "refused"


def listed(spark, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, bytes, created) of the files below a folder by their extensions, in any case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    return files.where(ext.isin(*extensions)).select("path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("created"))


def is_linked(path: str, folder: str) -> bool:
    """Whether a local file, or a folder between it and the imported one, is a symbolic link."""
    inner = os.path.relpath(path, folder)
    at = folder
    for part in inner.split(os.sep):
        at = os.path.join(at, part)
        if stat.S_ISLNK(os.lstat(at).st_mode):
            return True
    return False


def hashed(files: DataFrame, folder: str, most: int = MAX_BYTES) -> DataFrame:
    """files with digest and error; symbolic links are left out. A file that is too large isn't read, one that can't be read says why."""
    importable(files.sparkSession)

    def digests(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            kept, found, errors = [], [], []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                digest = error = None
                try:
                    system, inner = file_system(path)
                    if isinstance(system, fs.LocalFileSystem) and is_linked(inner, file_system(folder)[1]):
                        kept.append(False)
                        continue
                    if size > most:
                        error = f"more than {most} bytes"
                    else:
                        digest = hashlib.sha256()
                        with system.open_input_stream(inner, compression=None) as f:
                            while piece := f.read(PIECE):
                                digest.update(piece)
                        digest = digest.hexdigest()
                except OSError as problem:
                    digest, error = None, f"not readable: {problem}"
                kept.append(True)
                found.append(digest)
                errors.append(error)
            rows = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string()), pa.array(errors, pa.string())], names=[*rows.schema.names, "digest", "error"])

    return files.select("path", "name", "bytes", "created").mapInArrow(digests, "path string, name string, bytes long, created timestamp, digest string, error string")


def linked(new: DataFrame, registry: DataFrame) -> DataFrame:
    """new files with id, status and duplicate_of: the earliest file with their digest, in the registry or by path among themselves.

    Only originals of the registry are looked up, one for each digest, and each side is aggregated before it is joined, so a
    content that very many files share is one row on the other side.
    """
    ident = lambda c: F.sha2(c, 256)
    first = new.where("digest is not null").groupBy("digest").agg(F.min("path").alias("_first")).withColumnRenamed("digest", "_new")
    before = registry.where(F.col("status") == ORIGINAL).groupBy("digest").agg(F.min_by("id", F.struct("number", "path")).alias("_before")).withColumnRenamed("digest", "_old")
    known = first.join(before, F.col("_new") == F.col("_old"), "left").select("_new", F.coalesce("_before", ident(F.col("_first"))).alias("_original"))
    rows = new.join(known, new["digest"] == known["_new"], "left").withColumn("id", ident(F.col("path")))
    copy = F.col("_original") != F.col("id")
    status = F.when(F.col("error").isNotNull(), REFUSED).when(copy, COPY).otherwise(ORIGINAL)
    return rows.select("id", "path", "name", "bytes", "created", "digest", status.alias("status"), F.when(copy, F.col("_original")).alias("duplicate_of"), "error")


@dataclass(frozen=True)
class Registry:
    """What was imported so far, in a store."""

    store: Store

    def last(self) -> int:
        found = self.store.records.latest("imports", "number long", F.lit(True), "number")
        return found["number"] if found else 0

    def documents(self) -> DataFrame:
        """All files ever imported, with the number of their import; files of imports that don't count are left out."""
        spark = self.store.records.spark
        paths = [r["table"] for r in self.store.records.listed("imports", "created string, id string")]
        if not paths:
            return spark.createDataFrame([], f"{ROWS}, number int")
        return spark.read.schema(f"{ROWS}, number int").parquet(*paths)

    def add(self, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> dict:
        """Import what is new below a folder; the record of the import: its number, table and how many files were added, copies, refused or known.

        A file whose reading failed is refused and recorded as such; it isn't tried again under the same path.
        """
        spark = self.store.records.spark
        seen = listed(spark, folder, extensions)
        digests = None
        while True:
            number, registry = self.last() + 1, self.documents()
            if digests is None:
                new = seen.join(registry.select("path"), "path", "left_anti")
                digests = stored(hashed(new, folder), "digests")  # read once, however often it is linked
            rows = linked(digests.join(registry.select("path"), "path", "left_anti"), registry)
            table = self.store.new_table("imports", str(number))
            rows.withColumn("number", F.lit(number)).write.parquet(table)
            count = {r["status"]: r["n"] for r in spark.read.schema(ROWS).parquet(table).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
            record = {"id": f"{number:09d}", "number": number, "folder": folder, "table": table, "created": now(), "added": count.get(ORIGINAL, 0), "duplicates": count.get(COPY, 0), "refused": count.get(REFUSED, 0)}
            record["known"] = seen.count() - sum(count.values())  # links are known to be skipped
            if self.store.append("imports", record["id"], record):
                discard(digests)
                return record
