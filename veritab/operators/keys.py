"""Key primitives: repeats and two-sided comparison, without a task that sees all rows of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


#: Parts that the rows of one key are dealt into.
PARTS = 64


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps: rows that are equal throughout have equal ones."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, MapType | VariantType)])


def with_repeats(df: DataFrame, keys: list[str], name: str = "_repeated", valid: Column | None = None) -> DataFrame:
    """df with a flag: whether another row has the same key. Rows whose key isn't valid aren't counted, nor flagged.

    The input is read once, and no task sees all rows of a key. Rows are dealt by key and a part of PARTS, which a hash of the
    row decides, and counted there; then only the first row of each part meets those of the key's other parts. A row is
    repeated if its part has another one, or if it is the first of its part and there are other parts.
    """
    key = [F.col(f"`{k}`") for k in keys]
    rows = df.withColumns({"_valid": F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)), "_hash": row_hash(df)})
    # the order is that of the hash, so a task that runs again picks the same first row; one sort serves both columns
    part = Window.partitionBy(*key, "_valid", F.pmod("_hash", F.lit(PARTS))).orderBy("_hash")
    rows = rows.withColumns({"_place": F.row_number().over(part), "_more": F.lead("_hash").over(part).isNotNull()})
    firsts = Window.partitionBy(*key, "_valid", F.when(F.col("_place") == 1, -1).otherwise(F.pmod("_hash", F.lit(PARTS))))
    rows = rows.withColumn("_parts", F.count(F.lit(1)).over(firsts))
    again = F.col("_valid") & ((F.col("_place") > 1) | F.col("_more") | (F.col("_parts") > 1))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], again.alias(name))


def two_sided(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row for each key of either side: how many rows each side has, and, where that is one, its values.

    Both sides go through one aggregation by key, with partial sums, instead of a join; keys and values are
    compared exactly and nulls are keys like others. n_left, n_right, left and right (structs) are added.
    """
    side = lambda df, n: df.select(*keys, F.struct(*values).alias("_v"), F.lit(n).alias("_side"))
    both = side(left, 0).unionByName(side(right, 1))
    mine = lambda n: F.col("_side") == n
    return both.groupBy(*keys).agg(
        F.count_if(mine(0)).alias("n_left"), F.count_if(mine(1)).alias("n_right"),
        F.max(F.when(mine(0), F.col("_v"))).alias("left"), F.max(F.when(mine(1), F.col("_v"))).alias("right"),
    )

