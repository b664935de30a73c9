"""Committed-order delivery checks by calendar day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import bits, date_of, padded, reasons, reasons_of
from veritab.operators.keys import with_repeats
from veritab.operators.ranks import placed

ROLES = ("order_id", "team", "ordered_on", "due_on", "delivered_on")
STATUSES = ("open overdue", "due today", "upcoming", "delivered late", "delivered on time")


def checked(df: DataFrame, as_of: str) -> DataFrame:
    """Rows with `reasons` for quarantine, and for valid ones status, late_days, lead_days, age_days and flagged.

    df has record and the roles as text. A column `width_ok`, if there is one, marks rows of the right width: the
    others have that as their only reason. Repeated order ids count over all rows, malformed ones too. Dates
    are compared only where nothing else is wrong.
    """
    wide = F.col("width_ok") if "width_ok" in df.columns else F.lit(True)
    # parsed once, however many rules ask
    df = df.withColumns({f"_day_{r}": date_of(F.col(r)) for r in ROLES if r.endswith("_on")})
    cell = lambda r: F.coalesce(F.col(r), F.lit(""))
    dirty = lambda r: padded(cell(r)) | ((cell(r) == "") if r != "delivered_on" else F.lit(False))
    found = []
    for r in ROLES:
        found.append((wide & dirty(r), f"{r}: blank or padded"))
        if r.endswith("_on"):
            found.append((wide & ~dirty(r) & (cell(r) != "") & F.col(f"_day_{r}").isNull(), f"{r}: not a date"))
    ordered, due, delivered, today = F.col("_day_ordered_on"), F.col("_day_due_on"), F.col("_day_delivered_on"), F.lit(as_of).cast("date")
    late = [
        (due < ordered, "due before ordered"),
        (delivered < ordered, "delivered before ordered"),
        ((ordered > today) | F.coalesce(delivered > today, F.lit(False)), "after snapshot"),
    ]
    # all rules that a row decides alone come before the shuffles of the repeats: no filter on reasons can pull them up and ask them again
    df = df.withColumns({"_first": bits(*[cond for cond, _ in found]), "_late": bits(*[cond for cond, _ in late])})
    rows = with_repeats(df, ["order_id"], "_repeated", F.col("order_id").isNotNull())
    repeated = wide & F.col("_repeated")
    first = reasons(*reasons_of(F.col("_first"), *[text for _, text in found]), (repeated, "repeated order id"))
    alone = (F.col("_first") == 0) & ~F.coalesce(repeated, F.lit(False))
    why = F.when(~wide, F.array(F.lit("row width"))).when(alone, reasons(*reasons_of(F.col("_late"), *[text for _, text in late]))).otherwise(first)
    rows = rows.withColumn("reasons", why).drop("_first", "_late", "_repeated")
    valid = F.size("reasons") == 0
    late_days = F.greatest(F.lit(0), F.datediff(F.coalesce(delivered, today), due))
    status = F.when(delivered.isNotNull(), F.when(late_days > 0, "delivered late").otherwise("delivered on time")).when(due < today, "open overdue").when(due == today, "due today").otherwise("upcoming")
    return rows.withColumns(
        {
            "status": F.when(valid, status),
            "late_days": F.when(valid, late_days),
            "lead_days": F.when(valid, F.datediff(delivered, ordered)),
            "age_days": F.when(valid, F.datediff(F.coalesce(delivered, today), ordered)),
            "flagged": F.when(valid, late_days > 0),
        }
    ).drop("_day_ordered_on", "_day_due_on", "_day_delivered_on")


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") == 0).drop("reasons")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("reasons") > 0)


def _summary() -> list[Column]:
    is_ = lambda *s: F.col("status").isin(*s)
    delivered = is_("delivered late", "delivered on time")
    return [
        F.count(F.lit(1)).alias("records"),
        F.count_if(delivered).alias("delivered"),
        F.count_if(is_("delivered on time")).alias("delivered_on_time"),
        F.count_if(is_("delivered late")).alias("delivered_late"),
        F.count_if(is_("open overdue")).alias("open_overdue"),
        F.count_if(is_("due today")).alias("due_today"),
        F.count_if(is_("upcoming")).alias("upcoming"),
        F.try_divide(F.count_if(is_("delivered on time")), F.count_if(delivered)).alias("on_time_rate"),
        F.expr("median(lead_days)").alias("median_lead_days"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    """One row over the valid orders; rate and median are null without deliveries."""
    return valid(rows).agg(*_summary())


def team_summary(rows: DataFrame) -> DataFrame:
    return valid(rows).groupBy("team").agg(*_summary())


def counts(rows: DataFrame) -> DataFrame:
    ok = F.size("reasons") == 0
    return rows.agg(F.count(F.lit(1)).alias("source"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("quarantined"), F.count_if(F.col("flagged")).alias("flagged"))


def queue(rows: DataFrame) -> DataFrame:
    """Valid orders, the latest first, then by due date and id."""
    return valid(rows).orderBy(F.desc("late_days"), "due_on", "order_id")


def queue_places(rows: DataFrame) -> DataFrame:
    """Valid orders with `place`, from 1, in the order of the queue."""
    return placed(valid(rows), [F.desc("late_days"), "due_on", "order_id", "record"])


def quarantine_places(rows: DataFrame) -> DataFrame:
    """Quarantined rows with `place`, from 1, in the order of their records."""
    return placed(quarantined(rows), ["record"])
