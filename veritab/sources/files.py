"""Files as documents: folders, digests, exact copies, pages, extracted fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.workers import importable
from veritab.plans.specs import SpecError
from veritab.sources.isolated import DEADLINE, MEMORY, CallError, Isolated

#: What can be imported, and how large.
EXTENSIONS = ("pdf", "heic", "jpeg", "jpg", "png")
MAX_BYTES = 25 * 1024 * 1024
MAX_PAGES, MAX_CHARS, LEAST_CHARS = 20, 35_000, 25


def imported(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, bytes, created, digest, status, duplicate_of, error) of the files below a folder.

    A folder is imported in the order of its paths, so copies point at the first path of their content. Files
    that are too large are refused, with an error and without a digest. Digests are taken where the files are
    read; contents aren't kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    names = ["path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("created")]
    # sizes are known before contents are read: the two scans read either one or none of them
    rows = files.where(ext.isin(*extensions) & (F.col("length") <= MAX_BYTES)).select(*names, F.sha2("content", 256).alias("digest"))
    large = files.where(ext.isin(*extensions) & (F.col("length") > MAX_BYTES)).select(*names)
    first = rows.groupBy(F.col("digest").alias("_d")).agg(F.min("path").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(first, rows["digest"] == first["_d"], "left")
    copy = F.coalesce(F.col("path") != F.col("_first"), F.lit(False))
    rows = rows.withColumns({"status": F.when(copy, "duplicate").otherwise("imported"), "duplicate_of": F.when(copy, F.col("_first")), "error": F.lit(None).cast("string")}).drop("_d", "_first", "_n")
    refused = large.withColumns({"digest": F.lit(None).cast("string"), "status": F.lit("refused"), "duplicate_of": F.lit(None).cast("string"), "error": F.lit("more than 25 MiB")})
    return rows.unionByName(refused)


def _beside(documents: DataFrame, column: str, added: str, judged: Callable, f: Callable, deadline: float, memory: int) -> DataFrame:
    """documents with a column made by f from another one in isolated processes, and what went wrong; judged checks and shapes a result."""
    from pyspark import cloudpickle

    importable(documents.sparkSession)
    function = cloudpickle.dumps(f)
    name, kind, error = added.split(" ", 1)[0], added.split(" ", 1)[1], "error" if column == "path" else "extraction_error"
    schema = documents.select("*", F.lit(None).cast(kind).alias(name), F.lit(None).cast("string").alias(error)).schema

    def rows(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        with Isolated(function, deadline, memory) as call:
            for batch in batches:
                found, errors = [], []
                for value in batch.column(batch.schema.get_field_index(column)).to_pylist():
                    try:
                        found.append(judged(value, call))
                        errors.append(None)
                    except (CallError, SpecError) as problem:
                        found.append(None)
                        errors.append(str(problem))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, to_arrow_type(schema[name].dataType)), pa.array(errors, pa.string())], names=[*batch.schema.names, name, error])

    return documents.mapInArrow(rows, schema)


def with_text(documents: DataFrame, read: Callable[[str], list[str]], deadline: float = DEADLINE, memory: int = MEMORY) -> DataFrame:
    """documents with `pages` and `raw` by a reader of paths, and `error` where there are none.

    A reader of PDF files or images is passed in: none is part of this package. It runs in child processes of the
    executors' workers: one that hangs beyond the deadline, ends its process or takes more memory than it may gives
    an error for its document, and the other documents go on.
    """

    def pages(path, call):
        of = call(path)
        if not isinstance(of, list) or not all(isinstance(p, str) for p in of):
            raise SpecError("a reader gives a list of texts")
        if not 1 <= len(of) <= MAX_PAGES:
            raise SpecError(f"documents have 1 to {MAX_PAGES} pages")
        if sum(map(len, of)) > MAX_CHARS:
            raise SpecError(f"documents have at most {MAX_CHARS} characters")
        return of

    out = _beside(documents, "path", "pages array<string>", pages, read, deadline, memory)
    return out.withColumn("raw", F.array_join(F.transform("pages", lambda p, i: F.concat(F.lit("[Page "), (i + 1).cast("string"), F.lit("]\n"), p)), "\n\n"))


def extracted(documents: DataFrame, extract: Callable[[str], dict], deadline: float = DEADLINE, memory: int = MEMORY) -> DataFrame:
    """documents with `fields` (map of text) by an extractor of raw texts, isolated as readers are, and `extraction_error` where there are none.

    Texts too short for it are errors.
    """

    def fields(raw, call):
        if raw is None or len(raw.strip()) < LEAST_CHARS:
            raise SpecError("not enough readable text")
        result = call(raw)
        if not isinstance(result, dict):
            raise SpecError("extraction gives an object of fields")
        return [(str(k), None if v is None else str(v)) for k, v in result.items()]

    return _beside(documents, "raw", "fields map<string,string>", fields, extract, deadline, memory)
