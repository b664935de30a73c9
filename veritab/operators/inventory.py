"""Daily inventory investigation: complete histories, robust profiles, flags without looking ahead."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.text import date_of, iso_date, matches, padded, reasons
from veritab.operators.keys import with_repeats
from veritab.operators.ranks import placed
from veritab.plans.specs import Cutoffs, iso

ROLES = ("date", "product", "warehouse", "opening", "received", "sold", "closing")
IDENTITY = ["date", "product", "warehouse"]
UNITS = "[0-9]{1,9}"
HISTORY = 30
LEAST_CALIBRATION = 14
FLOOR = 3.5
MAD_TO_SIGMA = 1.4826
NO_TRAINING = "incomplete training history"
NO_CALIBRATION = "incomplete calibration history"
READY = "Ready"


def checked(df: DataFrame) -> DataFrame:
    """Rows with `reasons`; df has record and the roles as text, and width_ok where rows may have the wrong width.

    Repeats of an identity count over the raw cells of all rows, so a bad repeat excludes its good partner;
    rows with other reasons keep only those.
    """
    wide = F.col("width_ok") if "width_ok" in df.columns else F.lit(True)
    present = F.lit(True)
    for c in IDENTITY:
        present &= F.col(c).isNotNull()
    df = with_repeats(df, IDENTITY, "_repeated", present)
    found = []
    for r in ROLES:
        cell = F.coalesce(F.col(r), F.lit(""))
        dirty = (cell == "") | padded(cell)
        found.append((wide & dirty, f"{r}: blank or padded"))
        if r == "date":
            found.append((wide & ~dirty & ~iso_date(cell), "date: not a date"))
        elif r not in IDENTITY:
            found.append((wide & ~dirty & ~matches(cell, UNITS), f"{r}: not whole units"))
    first = F.when(~wide, F.array(F.lit("row width"))).otherwise(reasons(*found))
    rows = df.withColumn("_first", first)
    return rows.withColumn("reasons", F.when((F.size("_first") == 0) & F.col("_repeated"), F.array(F.lit("repeated identity"))).otherwise(F.col("_first"))).drop("_first", "_repeated")


def valid(rows: DataFrame) -> DataFrame:
    """Typed rows: day is a date, quantities whole numbers."""
    units = {r: F.col(r).try_cast("bigint") for r in ROLES if r not in IDENTITY}
    return rows.where(F.size("reasons") == 0).select("record", date_of(F.col("date")).alias("day"), "product", "warehouse", *[c.alias(r) for r, c in units.items()])


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") > 0)


class Investigation:
    """Lazy results over valid rows; only days up to a cutoff fit what is used after it."""

    def __init__(self, rows: DataFrame, cutoffs: Cutoffs):
        self.rows = rows
        self.a, self.b, self.c = map(iso, (cutoffs.train_end, cutoffs.calibration_end, cutoffs.test_end))
        self.first = self.a - dt.timedelta(days=HISTORY - 1)

    def _in(self, low: dt.date | None, high: dt.date) -> Column:
        day = F.col("day") <= F.lit(high)
        return day if low is None else (F.col("day") > F.lit(low)) & day

    @property
    def series(self) -> DataFrame:
        """(product, warehouse, status, missing_test_days, training, calibration, investigation)."""
        one = self.rows.groupBy("product", "warehouse").agg(
            F.count_if(self._in(None, self.a)).alias("training"),
            F.count_if(self._in(self.a, self.b)).alias("calibration"),
            F.count_if(self._in(self.b, self.c)).alias("investigation"),
            F.count_if(self._in(self.first - dt.timedelta(days=1), self.a)).alias("_recent"),
        )
        days = (self.b - self.a).days
        status = F.when(F.col("_recent") < HISTORY, NO_TRAINING).when(F.lit(days < LEAST_CALIBRATION) | (F.col("calibration") != days), NO_CALIBRATION).otherwise(READY)
        return one.select("product", "warehouse", status.alias("status"), ((self.c - self.b).days - F.col("investigation")).alias("missing_test_days"), "training", "calibration", "investigation")

    @property
    def profiles(self) -> DataFrame:
        """(product, warehouse, median, scale, threshold) of the series that are ready.

        Exact medians; each aggregation sees one series' history of at most 30 days, or its calibration days.
        """
        ready = self.series.where(F.col("status") == READY).select("product", "warehouse")
        keys = ["product", "warehouse"]
        recent = self.rows.where(self._in(self.first - dt.timedelta(days=1), self.a)).join(ready, keys, "left_semi")
        # deviations go over the series' own gathered values: 30 at most
        fit = recent.groupBy(*keys).agg(F.expr("median(sold)").alias("median"), F.collect_list("sold").alias("_v"))
        mad = F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("median"))))
        n = F.size("_v")
        middle = (F.get(mad, ((n - 1) / 2).cast("int")) + F.get(mad, (n / 2).cast("int"))) / 2
        fit = fit.select(*keys, "median", F.greatest(F.lit(1.0), F.lit(MAD_TO_SIGMA) * middle).alias("scale"))
        scored = self.rows.where(self._in(self.a, self.b)).join(fit, keys).withColumn("_score", (F.col("sold") - F.col("median")) / F.col("scale"))
        return scored.groupBy(*keys, "median", "scale").agg(F.expr("percentile_disc(0.99) within group (order by _score)").alias("_p")).select(*keys, "median", "scale", F.greatest(F.lit(FLOOR), F.col("_p")).alias("threshold"))

    @property
    def results(self) -> DataFrame:
        """Investigated rows with expected stock, differences, score and flags."""
        keys = ["product", "warehouse"]
        before = Window.partitionBy(*keys).orderBy("day")
        near = F.lag("day").over(before) == F.date_sub("day", 1)
        # a day's prior one is the last calibration day at the earliest, so no more history is sorted
        rows = self.rows.where(self._in(self.b - dt.timedelta(days=1), self.c)).withColumns({"_closing": F.when(near, F.lag("closing").over(before)), "prior_record": F.when(near, F.lag("record").over(before))})
        rows = rows.where(self._in(self.b, self.c)).join(self.profiles, keys, "left").join(self.series.select(*keys, "status"), keys, "left")
        expected = F.col("opening") + F.col("received") - F.col("sold")
        rows = rows.withColumns({"expected_closing": expected, "delta": F.col("closing") - expected, "continuity_delta": F.col("opening") - F.col("_closing"), "score": (F.col("sold") - F.col("median")) / F.col("scale")})
        flags = reasons((F.col("delta") != 0, "stock arithmetic"), (F.col("continuity_delta") != 0, "opening differs from prior closing"), (F.col("score") > F.col("threshold"), "unusual sales"))
        return rows.withColumns({"flags": flags, "skip_reason": F.when(F.col("status") != READY, F.col("status"))}).drop("_closing", "median", "scale", "threshold", "status")

    @property
    def timeline(self) -> DataFrame:
        """(record, day, product, warehouse, sold, period) up to the end of the investigation."""
        period = F.when(F.col("day") < F.lit(self.first), "earlier history").when(F.col("day") <= F.lit(self.a), "training").when(F.col("day") <= F.lit(self.b), "calibration").otherwise("investigation")
        return self.rows.where(self._in(None, self.c)).select("record", "day", "product", "warehouse", "sold", period.alias("period"))

    @property
    def counts(self) -> DataFrame:
        after = self.rows.agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("day") > F.lit(self.c)).alias("outside_window"))
        found = self.results.agg(F.count(F.lit(1)).alias("investigated"), F.count_if(F.size("flags") > 0).alias("flagged"), F.count_if(F.col("score").isNull()).alias("statistical_skipped"))
        return after.join(found)  # two single rows


def flag_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def result_places(results: DataFrame) -> DataFrame:
    """Investigated rows with `place`, from 1: series after series, each by day."""
    return placed(results, ["product", "warehouse", "day", "record"])


def quarantine_places(rows: DataFrame) -> DataFrame:
    """Quarantined rows with `place`, from 1, in the order of their records."""
    return placed(quarantined(rows), ["record"])
