"""WARC archives as a PySpark Python data source.

Reading plans a partition for each file. Each record's headers are parsed first; predicates on
them are pushed into the source, and a record that they exclude, or whose payload nobody asked
for, is skipped without being decoded: a member of our own .warc.gz says in its gzip header how
long it is, a plain .warc record says so in its WARC header, and a foreign .warc.gz member is
passed over in small chunks.

Spark keeps what was pushed into a loaded frame, so `archive` loads one for each condition.

Writing gives each task a file of its own name. Only the files that the driver's commit lists in
a manifest belong to the archive, so what failed or repeated tasks leave behind isn't read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from veritab.functions.workers import importable
from veritab.llm.common import file_system, new_path, own_columns, stored

SCHEMA = "page_id long, record_id string, record_type string, uri string, date string, payload_digest string, payload_bytes long, refers_to long, payload binary"
#: Columns that are known from the headers alone; only predicates on these are pushed down.
HEADER_COLUMNS = {"page_id", "record_id", "record_type", "uri", "date", "payload_digest", "payload_bytes", "refers_to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
URN = "urn:page:"
LEVEL = 4
CHUNK = 1 << 16
#: Headers longer than this are not headers.
MAX_HEADER = 1 << 20
#: Payloads of at least so many bytes are stored once; records with equal ones revisit it.
MIN_REVISIT_BYTES = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE, known_digest: str | None = None) -> bytes:
    """A response record, or, if refers_to is given, a revisit without the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", uri))
    head.append(f"WARC-Payload-Digest: sha1:{known_digest or digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field `sl` holds the lengths of the member and of what is in it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return struct.pack("<4BIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continuation lines are unfolded."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines) if _}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<?{URN}(-?[0-9]+)>?", urn or "")
    return int(m[1]) if m else None


class _Member:
    """What a gzip member holds, decoded as far as is asked for."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        head = file.read(24)
        own = len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\0"
        self.size = struct.unpack_from("<I", head, 16)[0] if own else None
        file.seek(at)
        self.unpacker, self.data, self.rest = zlib.decompressobj(31), b"", b""

    def more(self, limit: int) -> bool:
        """Decode until there are so many bytes; false at the member's end."""
        out = [self.data]
        n = len(self.data)
        while n < limit and not self.unpacker.eof:
            raw = self.rest or self.file.read(CHUNK if self.size is None or n else min(self.size, 4096))
            if not raw:
                raise ValueError("gzip member cut short")
            part = self.unpacker.decompress(raw, min(limit - n, 1 << 20))
            self.rest = self.unpacker.unconsumed_tail
            n += len(part)
            out.append(part)
        self.data = b"".join(out)
        return len(self.data) >= limit

    def skip(self) -> int:
        """Where the next member starts."""
        if self.size is not None:
            return self.at + self.size
        while not self.unpacker.eof:
            raw = self.rest or self.file.read(CHUNK)
            if not raw:
                raise ValueError("gzip member cut short")
            self.unpacker.decompress(raw, CHUNK)
            self.rest = self.unpacker.unconsumed_tail
        return self.file.tell() - len(self.unpacker.unused_data)


class _Plain:
    """The rest of an uncompressed archive, read as far as is asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.size = file, at, b"", None

    def more(self, limit: int) -> bool:
        while len(self.data) < limit and (raw := self.file.read(limit - len(self.data))):
            self.data += raw
        return len(self.data) >= limit

    def skip(self) -> int:
        return self.at + self.size


def records(file, accept=lambda row: True, want_payload: bool = True) -> Iterator[dict]:
    """The accepted records of an open, seekable archive, as dictionaries by column of SCHEMA.

    Other record types than response and revisit are passed on too, without a payload digest unless
    they carry one. Cut-off or malformed archives raise ValueError.
    """
    at = 0
    while True:
        file.seek(at)
        first = file.read(2)
        if not first:
            return
        file.seek(at)
        part = (_Member if first == b"\x1f\x8b" else _Plain)(file, at)
        end, limit = -1, 2048
        while end < 0:
            full = part.more(limit)
            end = part.data.find(b"\r\n\r\n")
            if end < 0 and (not full or limit > MAX_HEADER):
                if not part.data.strip():
                    return
                raise ValueError(f"no record header at {at}")
            limit *= 2
        if not part.data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = _fields(part.data[:end])
        block, length = end + 4, int(fields["content-length"])
        if isinstance(part, _Plain):
            part.size = block + length + 4
        is_http = fields.get("content-type", "").startswith("application/http")
        row = {
            "page_id": _page(fields.get("warc-record-id")), "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": length, "payload": None,
        }
        start = block
        if is_http:
            stop, limit = -1, block + 1024
            while stop < 0:
                full = part.more(min(limit, block + length))
                stop = part.data.find(b"\r\n\r\n", block, block + length)
                if stop < 0 and (not full or limit >= block + length or limit > block + MAX_HEADER):
                    break
                limit *= 2
            if stop >= 0:
                http = _fields(part.data[block:stop])
                start = stop + 4
                row["payload_bytes"] = int(http.get("content-length", block + length - start)) if row["record_type"] == "revisit" else block + length - start
        if accept(row):
            if want_payload and row["record_type"] != "revisit":
                if not part.more(block + length):
                    raise ValueError(f"record cut short at {at}")
                row["payload"] = part.data[start : block + length]
            yield row
        at = part.skip()


def _in(v, values):
    return None if v is None else True if v in values else None if None in values else False


def _known(compare):
    """A comparison that is unknown for a null."""
    return lambda v, w: None if v is None or w is None else compare(v, w)


#: By kind of filter, what it says of a value: true, false, or None where that is unknown.
_SAYS = {
    D.EqualTo: _known(operator.eq), D.GreaterThan: _known(operator.gt), D.GreaterThanOrEqual: _known(operator.ge), D.LessThan: _known(operator.lt), D.LessThanOrEqual: _known(operator.le),
    D.StringStartsWith: _known(str.startswith), D.StringEndsWith: _known(str.endswith), D.StringContains: _known(operator.contains),
    D.In: _in, D.EqualNullSafe: operator.eq, D.IsNull: lambda v, _: v is None, D.IsNotNull: lambda v, _: v is not None,
}


def _test(f: D.Filter):
    """What a filter that headers can answer says of a record's row (true, false or None: unknown); None for other filters."""
    if isinstance(f, D.Not):
        inner = _test(f.child)
        return inner and (lambda row: None if (said := inner(row)) is None else not said)
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in HEADER_COLUMNS or type(f) not in _SAYS:
        return None
    says, name, value = _SAYS[type(f)], column[0], getattr(f, "value", None)
    return lambda row: says(row[name], value)


class WarcReader(D.DataSourceReader):
    """A partition for each file."""

    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], list(schema.names)
        self.verify = options.get("verify", "false").lower() == "true"
        self.pushdown = options.get("pushdown", "false").lower() == "true"
        self.filters: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            if self.pushdown and _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        return [D.InputPartition(f) for f in archive_files(self.path)]

    def read(self, partition):
        if partition is None:  # an archive without files
            return
        system, path = file_system(partition.value)
        tests = [_test(f) for f in self.filters]
        want = "payload" in self.names or self.verify
        with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as file:
            for row in records(file, lambda r: all(t(r) for t in tests), want):
                if self.verify and row["payload"] is not None and (len(row["payload"]), digest(row["payload"])) != (row["payload_bytes"], row["payload_digest"]):
                    raise ValueError(f"payload of {row['record_id']} doesn't match its digest")
                yield tuple(row[n] for n in self.names)


def archive_files(path: str) -> list[str]:
    """A single archive, or those of a folder: the ones its manifests list, or without any all .warc and .warc.gz.

    A manifest that another one replaces doesn't count, even while it is still there.
    """
    from pyarrow import fs

    system, inner = file_system(path)
    prefix = path[: path.index(inner)] if inner in path else ""
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = [x.path for x in system.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True)) if x.type == fs.FileType.File]
    manifests = [x for x in found if re.search(r"/manifest-[^/]*\.json$", x)]
    if manifests:
        lists = {m.rsplit("/", 1)[1]: _listed(system, m) for m in manifests}
        replaced = {x for own in lists.values() for x in own.get("replaces", ())}
        return [f"{path.rstrip('/')}/{n}" for n in sorted(n for m, own in lists.items() if m not in replaced for n in own["files"])]
    return sorted(prefix + x for x in found if x.endswith((".warc", ".warc.gz")))


def _listed(system, manifest: str) -> dict:
    with system.open_input_stream(manifest) as f:
        return json.loads(f.read())


@dataclass
class Written(D.WriterCommitMessage):
    name: str | None


class WarcWriter(D.DataSourceArrowWriter):
    """Takes page_id, uri, payload, payload_digest (hexadecimal SHA-1 or null) and refers_to (null for responses)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.level, self.date = options["path"].rstrip("/"), overwrite, int(options.get("level", LEVEL)), options.get("date", DATE)

    def write(self, iterator):
        name, out, system = None, None, None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        system, inner = file_system(self.path)
                        system.create_dir(inner, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{inner}/{name}", compression=None)
                    known = row.get("payload_digest")
                    known = base64.b32encode(bytes.fromhex(known)).decode() if known else None
                    out.write(member(record(row["page_id"], row["uri"], row["payload"] or b"", row["refers_to"], self.date, known), self.level))
        finally:
            if out is not None:
                out.close()
        return Written(name)

    def commit(self, messages):
        """One manifest, moved to its place when it is whole, adds all files at once, or puts them in place of what was there."""
        from pyarrow import fs

        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        before = [x.path for x in system.get_file_info(fs.FileSelector(inner)) if re.search(r"/(manifest-[^/]*\.json|[^/]*\.warc(\.gz)?)$", x.path)] if self.overwrite else []
        own = {f"{inner}/{m.name}" for m in messages if m and m.name}
        old = [x for x in before if x not in own]
        name = f"manifest-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{inner}/{name}.new", compression=None) as f:
            f.write(json.dumps({"files": sorted(x.rsplit("/", 1)[1] for x in own), "replaces": sorted(x.rsplit("/", 1)[1] for x in old if x.endswith(".json"))}).encode())
        system.move(f"{inner}/{name}.new", f"{inner}/{name}")
        for x in sorted(old, key=lambda x: x.endswith(".json")):
            system.delete_file(x)

    def abort(self, messages):
        system, inner = file_system(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{inner}/{m.name}")


class WarcDataSource(D.DataSource):
    """format("warc"): options path, verify (recompute payload digests), pushdown (see `archive`), level and date (writing).

    A loaded frame may be used again and again. It leaves conditions to Spark: these are pushed down in frames of `archive` alone.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive(spark: SparkSession, path: str, columns: str | None = None, where: str | Column | None = None, **options: str) -> DataFrame:
    """The records of an archive that meet a condition, which is pushed down; columns are some of SCHEMA, with types.

    Record type and headers are judged where they are read, and payloads of other records are skipped undecoded.
    Spark doesn't tell Python sources which columns a query needs, so leave payload out where it isn't wanted.

    Spark (4.1) keeps the predicates pushed into a loaded frame for the frame's later uses. So they are pushed only with a
    condition given here, into a frame of its own, and the result takes no further ones: what is put on top of it is judged by
    Spark on rows that meet this one.
    """
    register(spark)
    rows = spark.read.format("warc").schema(columns or SCHEMA).options(**options, pushdown=str(where is not None).lower()).load(path)
    # the last condition always holds, but no other one may be moved below it
    return rows if where is None else rows.where(where).where(F.monotonically_increasing_id() >= 0)


def deduplicated(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, uri, payload, payload_digest, refers_to): rows to write; of equal payloads the smallest page_id is the response.

    A null html is an empty payload. Rows that share the smallest page_id are all responses, and so are
    those of a payload that no row with a page_id has. An empty table gives no rows. Columns other than
    page_id, url and html are ignored.

    Only digests are shuffled to find those that repeat. Their table is written, so that its size is known
    before the join: while it is below the session's broadcast threshold payloads aren't moved, beyond that
    the join shuffles them.
    """
    rows = own_columns(pages, "page_id", "url", "html").select("page_id", F.col("url").alias("uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    # pages with a payload of their own need no partner, so only the first of repeated ones are joined
    firsts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    joined = rows.join(stored(firsts, "repeated-payloads"), "payload_digest", "left")
    return joined.select("page_id", "uri", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def op7_warc(spark, sf_dir):
    register(spark)
    path = new_path(spark, "warc")
    deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    return archive(spark, path, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", F.col("record_type").isin("response", "revisit"), verify="true")

