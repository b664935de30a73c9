"""Append-only JSON records on any file system that Spark reaches.

A record is a file of its own, below a folder for its kind. It is written under a name that nobody looks for and then
moved to its final one, which must not exist yet: of two writers of one record one wins, and nothing is ever
overwritten. HDFS moves a file only to a free name, atomically. A local or mounted folder would let a move replace a file, so there the
draft is linked to its name instead, which fails if that is taken. Other file systems are refused, because
not all of them can promise either.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes whose moves never replace a file.
SAFE_MOVES = ("hdfs", "webhdfs", "swebhdfs", "ofs", "o3fs")


class StoreError(RuntimeError):
    """A record that isn't there, or may not be written."""


def _is(error: Py4JJavaError, *names: str) -> bool:
    return error.java_exception.getClass().getSimpleName() in names


@dataclass(frozen=True)
class Records:
    """The records below a folder: a URI, or a path of the default file system."""

    root: str
    spark: SparkSession

    @property
    def _jvm(self):
        return self.spark.sparkContext._jvm

    def _system(self, path):
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # checksums beside files would outlive the drafts that they belong to
        return system.getRawFileSystem() if system.getUri().getScheme() == "file" else system

    def path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _of(self, kind: str, ident: str):
        if not isinstance(ident, str) or not ident or ident[0] in "._" or any(c in ident for c in "/\\\0:*?{}[]"):
            raise StoreError(f"not an id: {ident!r}")
        return self.path(kind, f"{ident}.json")

    def exists(self, kind: str, ident: str) -> bool:
        path = self._of(kind, ident)
        return self._system(path).exists(path)

    def append(self, kind: str, ident: str, record: dict) -> bool:
        """Write a record that isn't there yet; false if it is, which leaves the old one as it was."""
        target, draft = self._of(kind, ident), self.path(kind, f".{uuid.uuid4().hex}")
        system = self._system(target)
        if system.exists(target):
            return False
        system.mkdirs(target.getParent())
        out = system.create(draft, False)
        try:
            out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
            out.close()
            return self._claimed(system, draft, target)
        finally:
            out.close()
            system.delete(draft, False)

    def _claimed(self, system, draft, target) -> bool:
        scheme = system.getUri().getScheme()
        if scheme == "file":
            local = lambda p: self._jvm.java.nio.file.Path.of(system.makeQualified(p).toUri())
            try:
                self._jvm.java.nio.file.Files.createLink(local(target), local(draft))
            except Py4JJavaError as error:
                if _is(error, "FileAlreadyExistsException"):
                    return False
                raise
            return True
        if scheme not in SAFE_MOVES:
            raise StoreError(f"{scheme}: can't promise that nothing is overwritten")
        return system.rename(draft, target)

    def get(self, kind: str, ident: str) -> dict:
        path = self._of(kind, ident)
        try:
            stream = self._system(path).open(path)
        except Py4JJavaError as error:
            if _is(error, "FileNotFoundException"):
                raise StoreError(f"no such {kind}: {ident}") from error
            raise
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def table(self, kind: str, schema: str) -> DataFrame:
        """The records of a kind as rows: members named by a schema, and the whole as `value`."""
        where = self.path(kind)
        if not self._system(where).exists(where):
            return self.spark.createDataFrame([], f"{schema}, value string")
        text = self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(where.toString())
        return text.select(F.from_json("value", schema).alias("r"), "value").select("r.*", "value")

    def latest(self, kind: str, schema: str, where: Column, number: str) -> dict | None:
        """The record with the greatest number, of those that meet a condition: one aggregation, one row to the driver."""
        found = self.table(kind, schema).where(where).agg(F.max_by("value", number)).first()[0]
        return None if found is None else json.loads(found)

    def listed(self, kind: str, schema: str, where: Column | None = None, newest: int | None = None) -> list[dict]:
        """Records with `created` and `id`, the newest first; as many as asked for."""
        rows = self.table(kind, schema)
        rows = (rows if where is None else rows.where(where)).orderBy(F.desc("created"), F.desc("id"))
        return [json.loads(r["value"]) for r in (rows if newest is None else rows.limit(newest)).select("value").collect()]
