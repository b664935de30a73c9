"""Scores of extracted fields against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import fold, matches, trimmed
from veritab.operators.receipts import AMOUNTS

_NUMBER = r"[+-]?(?:[0-9]{1,20}(?:\.[0-9]{0,9})?|\.[0-9]{1,9})"


def _number(c: Column) -> Column:
    t = trimmed(c)
    return F.when(matches(t, _NUMBER), F.regexp_replace(t, r"\A\+", "").try_cast("decimal(38,9)"))


def field_scores(df: DataFrame) -> DataFrame:
    """(..., correct, unsupported_unknown) of rows (field, present, actual, expected).

    Nothing expected is right if nothing is given; amounts are equal as exact numbers, other fields as
    trimmed text without case. A field that isn't present is never correct.
    """
    none = lambda c: c.isNull() | (c == "")
    a, e = F.col("actual"), F.col("expected")
    same = F.when(F.col("field").isin(*AMOUNTS), F.coalesce(_number(a) == _number(e), F.lit(False))).otherwise(F.coalesce(fold(trimmed(a)) == fold(trimmed(e)), F.lit(False)))
    return df.withColumns({"correct": F.col("present") & F.when(none(e), none(a)).otherwise(same), "unsupported_unknown": none(e) & F.col("present") & ~none(a)})


def model_summary(runs: DataFrame) -> DataFrame:
    """By model: fields right and in all, failures, unsupported values, median seconds, tokens. runs has a row for each case."""
    return runs.groupBy("model").agg(
        F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum("unsupported_unknowns").alias("unsupported_unknowns"),
        F.expr("median(elapsed_seconds)").alias("median_elapsed_seconds"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )


def extraction_runs(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each model and case with its counts; cases has model, case, status, elapsed_seconds and tokens."""
    each = scores.groupBy("model", "case").agg(F.count_if(F.col("correct")).alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("unsupported_unknown")).alias("unsupported_unknowns"))
    return cases.join(each, ["model", "case"], "left").fillna(0, ["correct", "total", "unsupported_unknowns"])
