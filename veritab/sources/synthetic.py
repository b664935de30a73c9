"""Small seeded fixtures: a labelled inventory, a payment ledger with faults, and starter tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.operators.snapshots import FAULTS
from veritab.plans.specs import SpecError, distinct_choices

LEDGER = ("payment_id", "order_id", "region", "currency", "amount_cents")
REFUNDS = ("refund_id", "payment_id", "currency", "amount_cents")


def inventory_frames(spark: SparkSession, seed: int = 42, days: int = 120, products: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, truth) of labelled daily stock, made by the executors from hashes of seed and key.

    Each product sells around a level of its own and is restocked every tenth day. In the last 30 days some
    days are promotions, some carry injected sales, and some closing counts are off; truth names the last two.
    """
    share = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "n", "p", "warehouse"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    base = spark.range(days * products).select((F.col("id") % days).cast("int").alias("n"), F.floor(F.col("id") / days).cast("int").alias("p")).withColumn("warehouse", F.explode(F.array(F.lit("North"), F.lit("South"))))
    level, late = 8 + 2 * F.col("p"), F.col("n") >= days - 30
    # the sum of four uniform shares is bell-shaped enough
    spread = (share("a") + share("b") + share("c") + share("d") - 2) * (3 + F.col("p") / 4) * 1.7
    base = base.withColumns({"promotion": late & (share("promotion") < 0.025), "sales_anomaly": late & (share("odd") < 0.04), "reconciliation": late & (share("count") < 0.03)})
    usual = F.greatest(F.lit(0), F.round(level + spread)).cast("long")
    extra = F.element_at(F.array(F.lit(8), F.lit(25), F.lit(80)), (F.floor(share("extra") * 3) + 1).cast("int"))
    rows = base.withColumns({"sold": usual * F.when(F.col("promotion"), 2).otherwise(1) + F.when(F.col("sales_anomaly"), extra).otherwise(0), "received": F.when(F.col("n") % 10 == 9, 10 * level).otherwise(0).cast("long")})
    so_far = Window.partitionBy("p", "warehouse").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stock = 5000 + F.sum(F.col("received") - F.col("sold")).over(so_far)
    off = F.element_at(F.array(F.lit(-15), F.lit(-1), F.lit(1), F.lit(25)), (F.floor(share("off") * 4) + 1).cast("int"))
    rows = rows.withColumn("stock", stock).withColumns(
        {
            "id": F.format_string("%03d-%02d-%s", "n", "p", "warehouse"),
            "day": F.date_add(F.lit("2026-01-01").cast("date"), F.col("n")),
            "product": F.format_string("SKU-%03d", "p"),
            "opening": F.col("stock") - F.col("received") + F.col("sold"),
            "closing": F.col("stock") + F.when(F.col("reconciliation"), off).otherwise(0),
            "unit_value_cents": (250 + 125 * F.col("p")).cast("long"),
        }
    )
    return rows.select("id", "n", "day", "product", "warehouse", "opening", "received", "sold", "closing", "promotion", "unit_value_cents"), rows.select("id", "reconciliation", "sales_anomaly")


def ledger(seed: int = 17) -> tuple[list[tuple], list[tuple]]:
    """Twelve payments in three regions, and two refunds; record 1 would be a header."""
    if type(seed) is not int or not 0 <= seed <= 999_999:
        raise SpecError("a seed is a whole number from 0 to 999999")
    draw = random.Random(seed)
    payments = [(n + 1, f"PAY-{n:03d}", f"ORD-{n:03d}", ("East", "West", "North")[(n - 1) // 4], "USD", str(100 * draw.randint(60, 180))) for n in range(1, 13)]
    return payments, [(2, "REF-001", "PAY-002", "USD", "1500"), (3, "REF-002", "PAY-008", "USD", "2500")]


def delivered(payments: list[tuple], faults: list[str]) -> list[tuple]:
    """Payments as a faulty delivery brings them: a region missing, the last amount a hundredfold, the one before it twice."""
    distinct_choices(faults, FAULTS, "faults")
    rows = [r for r in payments if "missing_region" not in faults or r[3] != "East"]
    if "amount_unit" in faults:
        rows[-1] = (*rows[-1][:5], str(100 * int(rows[-1][5])))
    if "duplicate_retry" in faults:
        rows.append(rows[-2])
    return [(n, *r[1:]) for n, r in enumerate(rows, 2)]


def ledger_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "record long, " + ", ".join(f"{c} string" for c in LEDGER))


def refund_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "record long, " + ", ".join(f"{c} string" for c in REFUNDS))
