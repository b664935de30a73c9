"""Exact comparison of two tables, and of a table with approved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import blank, fold, matches, trimmed
from veritab.operators.keys import two_sided, with_repeats
from veritab.operators.quality import require_structure
from veritab.operators.ranks import placed
from veritab.plans.specs import SpecError
from veritab.sources.csv_text import named

STATUSES = ("matched", "conflict", "left_only", "right_only", "ambiguous", "invalid")
DOCUMENT_STATUSES = ("matched", "conflict", "unmatched", "ambiguous", "invalid")


def compared(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_value: str, right_value: str) -> DataFrame:
    """(key, status, n_left, n_right, left_value, right_value) for each key of either side; values only where a side has one row."""
    if left_key == left_value or right_key == right_value:
        raise SpecError("key and value are different columns")
    pick = lambda df, k, v: df.select(F.col(k).alias("key"), F.col(v).alias("value"))
    both = two_sided(pick(left, left_key, left_value), pick(right, right_key, right_value), ["key"], ["value"])
    a, b = F.col("left.value"), F.col("right.value")
    status = (
        F.when(blank(F.col("key")), "invalid")
        .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "ambiguous")
        .when(F.col("n_left") == 0, "right_only")
        .when(F.col("n_right") == 0, "left_only")
        .when(blank(a) | blank(b), "invalid")
        .when(a == b, "matched")
        .otherwise("conflict")
    )
    return both.select("key", status.alias("status"), "n_left", "n_right", F.when(F.col("n_left") == 1, a).alias("left_value"), F.when(F.col("n_right") == 1, b).alias("right_value"))


def compared_tables(left: DataFrame, right: DataFrame, left_headers: list[str], right_headers: list[str], left_key: str, right_key: str, left_value: str, right_value: str) -> DataFrame:
    """`compared` of two tables of (record, cells), once their structure is found to be sound; a table that isn't one is refused."""
    sides = [named(require_structure(cells, headers), headers) for cells, headers in ((left, left_headers), (right, right_headers))]
    return compared(*sides, left_key, right_key, left_value, right_value)


def in_order(df: DataFrame) -> DataFrame:
    """Compared keys with `place`, from 1: ascending by code points, as Spark compares texts."""
    return placed(df, ["key"])


def status_counts(df: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """One row with a column for each status, zeros included."""
    return df.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def evidence(df: DataFrame, keys: list[str], values: list[str], of: DataFrame) -> DataFrame:
    """The rows behind the keys of `of`, gathered by key in record order: only for keys that need showing."""
    picked = df.join(of.select(*keys).distinct(), keys, "left_semi")
    return picked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("record", *values))).alias("evidence"))


def documents_reconciled(table: DataFrame, approved: DataFrame) -> DataFrame:
    """(record, merchant, receipt_number, currency, total, status) of each table row against approved documents.

    table has record and the four roles as text; approved has merchant, receipt_number, currency, total
    (text). Merchant and number are compared trimmed and without case, currency and total exactly.
    """
    rows = table.select("record", *[trimmed(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("merchant", "receipt_number", "currency", "total")])
    rows = rows.withColumns({"_m": fold(F.col("merchant")), "_r": fold(F.col("receipt_number")), "currency": F.upper("currency")})
    rows = with_repeats(rows, ["_m", "_r"])
    known = approved.select(fold(F.col("merchant")).alias("_dm"), fold(F.col("receipt_number")).alias("_dr"), F.struct("currency", "total").alias("_d"))
    known = known.groupBy("_dm", "_dr").agg(F.count(F.lit(1)).alias("_n"), F.max("_d").alias("_d"))
    found = rows.join(known, (rows["_m"] == known["_dm"]) & (rows["_r"] == known["_dr"]), "left")
    amount = lambda c: F.when(matches(c, r"[0-9]+(?:\.[0-9]{1,2})?"), c.try_cast("decimal(38,2)"))
    empty = F.lit(False)
    for c in ("merchant", "receipt_number", "currency", "total"):
        empty |= F.col(c) == ""
    status = (
        F.when(empty | ~matches(F.col("total"), r"[0-9]+(?:\.[0-9]{1,2})?") | ~matches(F.col("currency"), "[A-Z]{3}"), "invalid")
        .when(F.col("_repeated") | (F.coalesce("_n", F.lit(0)) > 1), "ambiguous")
        .when(F.col("_n").isNull(), "unmatched")
        .when((F.col("currency") == F.col("_d.currency")) & F.coalesce(amount(F.col("total")) == amount(F.col("_d.total")), F.lit(False)), "matched")
        .otherwise("conflict")
    )
    return found.select("record", "merchant", "receipt_number", "currency", "total", status.alias("status"))
