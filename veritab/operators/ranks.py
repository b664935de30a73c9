"""Places in a total order, worked out without a task that sees all rows or all rows of one value.

Rows are cut into ranges of the whole sort key (Spark samples the keys for the bounds) and sorted within them;
the rows of each range are counted, and a row's place is what lies before its range plus its place within.
A range holds about as many rows as any other however often a leading value occurs, because the whole key,
with a hash of the row behind it, decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.shared import discard, stored
from veritab.operators.keys import row_hash

#: monotonically_increasing_id has the partition above these bits and the row within it below.
ROW_BITS = 33


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def placed(df: DataFrame, by: list[Column | str], name: str = "place", within: list[str] | None = None, size: str | None = None) -> DataFrame:
    """df with each row's place, from 1, in the order `by`; `within` numbers each group of these columns on its own.

    size adds how many rows the group (without groups: the table) has. Nulls come first where a column ascends. Rows equal
    in all of `by` are ordered by a hash of all their columns, so only rows equal throughout are interchangeable. An empty
    table gives none. The sorted rows are written to the shared folder once: ranges must not change between counting and
    numbering, whichever executors are lost. Sorting reads its input twice, the first time for the bounds, so df is written before,
    unless it is a stored frame, and worked out once.
    """
    within = within or []
    order = [*[F.col(f"`{c}`") for c in within], *by, row_hash(df)]
    given = df if "_stored_at" in df.__dict__ else stored(df, "unplaced")
    rows = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at := _free("_at", df.columns), F.monotonically_increasing_id())
    rows = stored(rows, "placed")
    if given is not df:
        discard(given)
    group = [F.col(f"`{c}`").alias(f"_g{k}") for k, c in enumerate(within)]
    names = [f"_g{k}" for k in range(len(within))]
    held = rows.groupBy(F.shiftright(at, ROW_BITS).alias("_part"), *group).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    # a row for each range that a group reaches into
    of_group = Window.partitionBy(*names)
    before = F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("_part", *names, (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(of_group).alias("_size"))
    if not within:  # at most a row for each shuffle partition, 24 bytes
        held = F.broadcast(held)
    on = F.shiftright(rows[at], ROW_BITS) == held["_part"]
    for c, g in zip(within, names, strict=True):
        on &= rows[f"`{c}`"].eqNullSafe(held[g])
    found = rows.join(held, on)
    more = [held["_size"].alias(size)] if size else []
    return found.select(*[rows[f"`{c}`"] for c in df.columns], (rows[at] + held["_shift"]).alias(name), *more)
