"""Evaluation of detectors on labelled stock: robust profiles, a global baseline, alerts, confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators.inventory import FLOOR, MAD_TO_SIGMA


def profiles(training: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median, scale) over all training rows of each series: exact medians in two aggregations."""
    median = training.groupBy(*keys).agg(F.expr("median(sold)").alias("median"))
    away = training.join(median, keys).withColumn("_d", F.abs(F.col("sold") - F.col("median")))
    return away.groupBy(*keys, "median").agg(F.expr("median(_d)").alias("_mad")).select(*keys, "median", F.greatest(F.lit(1.0), F.lit(MAD_TO_SIGMA) * F.col("_mad")).alias("scale"))


def global_threshold(training: DataFrame) -> DataFrame:
    """One row: mean plus three population standard deviations of all sales."""
    return training.agg((F.avg("sold") + 3 * F.stddev_pop("sold")).alias("threshold"))


def scored(rows: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    expected = F.col("opening") + F.col("received") - F.col("sold")
    out = rows.join(fitted, keys).withColumn("score", (F.col("sold") - F.col("median")) / F.col("scale"))
    return out.withColumns({"expected_closing": expected, "delta": F.col("closing") - expected})


def calibrated_threshold(calibration: DataFrame) -> float:
    """Nearest-rank 99th percentile of scores rounded to three decimals, FLOOR at least; one number comes to the driver."""
    found = calibration.agg(F.expr("percentile_disc(0.99) within group (order by bround(score, 3))").alias("p")).first()[0]
    return max(FLOOR, found) if found is not None else FLOOR


def detected(rows: DataFrame, threshold: float, baseline: float) -> DataFrame:
    """Flags of each detector; rows is scored. Labels play no part."""
    return rows.withColumns(
        {
            "reconciliation": F.col("delta") != 0,
            "sales_anomaly": F.col("score") > threshold,
            "global_baseline": F.col("sold") > baseline,
            "review_value_cents": F.abs("delta") * F.col("unit_value_cents"),
        }
    ).withColumn("explanation", explanation())


def explanation() -> Column:
    stock = F.when(F.col("delta") != 0, F.format_string("Closing stock is %d units off opening + received - sold.", F.col("delta"))).otherwise("Stock arithmetic balances.")
    return F.concat(stock, F.when(F.col("sales_anomaly"), " Sales are beyond the series' usual range.").otherwise(""))


def alerts(found: DataFrame) -> DataFrame:
    """Rows that either check flags, the most valuable first."""
    return found.where("reconciliation or sales_anomaly").orderBy(F.desc("review_value_cents"), F.desc("score"), "id")


def confusion(found: DataFrame, truth: DataFrame, prediction: str, target: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, false alerts per 1000; null where a denominator is 0."""
    both = found.select("id", F.col(prediction).alias("_p")).join(truth.select("id", F.col(target).alias("_t")), "id")
    p, t = F.col("_p"), F.col("_t")
    one = both.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return one.withColumns(
        {
            "precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 3),
            "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 3),
            "false_alerts_per_1000": F.round(F.try_divide(1000 * F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 2),
        }
    )


def evaluated(rows: DataFrame, truth: DataFrame, keys: list[str], train: Column, calibration: Column, test: Column) -> dict[str, DataFrame]:
    """The whole evaluation: fit on training rows, threshold from calibration rows, detect on test rows."""
    fitted = profiles(rows.where(train), keys)
    baseline = global_threshold(rows.where(train)).first()[0] or 0.0
    threshold = calibrated_threshold(scored(rows.where(calibration), fitted, keys))
    found = detected(scored(rows.where(test), fitted, keys), threshold, baseline)
    pairs = {"reconciliation": ("reconciliation", "reconciliation"), "global_baseline": ("global_baseline", "sales_anomaly"), "per_product_robust": ("sales_anomaly", "sales_anomaly")}
    return {"found": found, "alerts": alerts(found), **{f"metrics_{k}": confusion(found, truth, *v) for k, v in pairs.items()}}
