"""Structural profile and white-space cleaning of tables of text cells (record, cells)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.text import blank, padded, trimmed
from veritab.plans.specs import SpecError

LISTED = 200
KINDS = ("header", "row_width", "duplicate", "missing", "whitespace")


def header_findings(headers: list[str]) -> list[int]:
    """1-based places of names that are blank or repeat an earlier one, case and outer white space aside."""
    folded = [h.strip().casefold() for h in headers]
    return [i + 1 for i, name in enumerate(folded) if name == "" or folded.index(name) != i]


def structure_errors(df: DataFrame, headers: list[str]) -> list[str]:
    """What keeps (record, cells) from being a table: unclear names, or rows of another width. One count comes to the driver."""
    wrong = df.where(F.size("cells") != len(headers)).limit(1).count()
    return ["unclear column names"] * bool(header_findings(headers)) + ["rows of different widths"] * bool(wrong)


def require_structure(df: DataFrame, headers: list[str]) -> DataFrame:
    """df itself if it is a table; cleaning and comparing are refused otherwise."""
    errors = structure_errors(df, headers)
    if errors:
        raise SpecError("not a table: " + ", ".join(errors))
    return df


def _cell(i: Column) -> Column:
    return F.coalesce(F.get(F.col("cells"), i), F.lit(""))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(record, first_record) of rows whose cells an earlier row has too."""
    first = df.groupBy(F.col("cells").alias("_cells")).agg(F.min("record").alias("first_record"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return df.join(first, df["cells"] == first["_cells"]).where("record > first_record").select("record", "first_record")


def findings(df: DataFrame, headers: list[str]) -> DataFrame:
    """(kind, record, column) of every finding; column is 1-based and null for whole rows.

    Cells beyond the header aren't looked at; those a short row lacks are missing.
    """
    n = len(headers)
    spark = df.sparkSession
    top = spark.createDataFrame([("header", 1, p) for p in header_findings(headers)], "kind string, record long, column int")
    width = df.where(F.size("cells") != n).select(F.lit("row_width").alias("kind"), "record", F.lit(None).cast("int").alias("column"))
    repeated = duplicate_rows(df).select(F.lit("duplicate").alias("kind"), "record", F.lit(None).cast("int").alias("column"))
    each = df.select("record", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _cell)).alias("_at", "_v"))
    cells = each.select(F.when(blank(F.col("_v")), "missing").when(padded(F.col("_v")), "whitespace").alias("kind"), "record", (F.col("_at") + 1).alias("column")).where("kind is not null")
    return top.unionByName(width).unionByName(repeated).unionByName(cells)


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def missing_by_column(df: DataFrame, headers: list[str]) -> DataFrame:
    """(position, name, missing): one pass, a counter for each column."""
    sums = df.agg(*[F.count_if(blank(_cell(F.lit(i)))).alias(f"_{i}") for i in range(len(headers))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(h).alias("name"), F.col(f"_{i}").alias("missing")) for i, h in enumerate(headers)])).alias("_x")).select("_x.*")


def first_findings(found: DataFrame, limit: int = LISTED) -> DataFrame:
    """The first findings: by record, then row width, duplicates, and cells from left to right."""
    rank = F.when(F.col("kind") == "header", 0).when(F.col("kind") == "row_width", 1).when(F.col("kind") == "duplicate", 2).otherwise(3)
    return found.withColumn("_rank", rank).orderBy("record", "_rank", "column").limit(limit).drop("_rank")


def trim_changes(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """(record, column, before, after) of each cell that trimming would change; with headers, only of a sound table."""
    df = df if headers is None else require_structure(df, headers)
    each = df.select("record", F.posexplode("cells").alias("_at", "before")).withColumn("after", trimmed(F.col("before")))
    return each.where(F.col("before") != F.col("after")).select("record", (F.col("_at") + 1).alias("column"), "before", "after")


def trimmed_cells(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """df with every cell trimmed; with headers, only of a sound table."""
    df = df if headers is None else require_structure(df, headers)
    return df.withColumn("cells", F.transform("cells", trimmed))


def profile(df: DataFrame, headers: list[str]) -> dict[str, DataFrame]:
    found = findings(df, headers)
    return {"columns": missing_by_column(df, headers), "counts": issue_counts(found), "issues": first_findings(found)}


def gaps(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Segments of consecutive days of each series: df with `segment`, which grows at each missing day."""
    w = Window.partitionBy(*keys).orderBy(date)
    step = F.when(F.datediff(F.col(date), F.lag(date).over(w)) > 1, 1).otherwise(0)
    return df.withColumn("_step", step).withColumn("segment", F.sum("_step").over(w).cast("long")).drop("_step")
