"""Places against plain sorting."""

from pyspark.sql import functions as F

from veritab.functions.shared import new_path
from veritab.operators.keys import with_repeats
from veritab.operators.ranks import placed


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_places_of_ties_and_nulls(spark):
    data = [(k, None if k % 7 == 0 else k % 3, str(k % 11)) for k in range(500)]
    df = spark.createDataFrame(data, "id int, a int, b string").repartition(7)
    found = sorted(rows_of(placed(df, [F.desc_nulls_last("a"), "b", "id"]), "place", "id"))
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert found == [(n, r[0]) for n, r in enumerate(order, 1)]


def test_places_within_groups_and_their_sizes(spark):
    data = [(k, None if k % 5 == 0 else "hot" if k % 5 < 4 else f"g{k % 10}", k * 7 % 100) for k in range(1000)]
    df = spark.createDataFrame(data, "id int, g string, v int")
    found = {r["id"]: (r["place"], r["n"]) for r in placed(df, ["v", "id"], within=["g"], size="n").collect()}
    for g in {r[1] for r in data}:
        of = sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [found[r[0]] for r in of] == [(n, len(of)) for n in range(1, len(of) + 1)]


def test_rows_equal_throughout_and_odd_columns(spark):
    df = spark.createDataFrame([(1, "x", {"k": 1}, [1])] * 5 + [(0, "y", None, None)], "`a.b` int, _at string, m map<string,int>, l array<int>")
    found = placed(df, [F.col("`a.b`")])
    assert found.columns == ["a.b", "_at", "m", "l", "place"]
    assert sorted(rows_of(found, "place", "a.b")) == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)]
    assert {(r["_at"], str(r["m"]), str(r["l"])) for r in found.collect()} == {("x", "{'k': 1}", "[1]"), ("y", "None", "None")}
    assert placed(df.where("false"), [F.col("`a.b`")]).collect() == []


def test_one_leading_value_fills_even_ranges(spark):
    df = spark.range(0, 200_000, numPartitions=8).select(F.lit("same").alias("lead"), F.xxhash64("id").alias("v"), "id")
    path = new_path(spark, "even")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed(df, ["lead", "v", "id"]).withColumn("task", F.spark_partition_id()).write.parquet(path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("task").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 200_000 / 4
    found = spark.read.parquet(path)
    assert found.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()[:] == (1, 200_000, 200_000)


def test_repeats_are_flagged_in_one_pass(spark):
    data = [(k, "hot" if k % 3 == 0 else None if k % 50 == 1 else f"k{k // 4}", k % 7 != 0) for k in range(3000)] + [(5, "twin", True)] * 2
    path = new_path(spark, "rows")
    spark.createDataFrame(data, "id int, k string, ok boolean").write.parquet(path)
    found = with_repeats(spark.read.parquet(path), ["k"], "again", F.col("ok"))
    n = {}
    for _, k, ok in data:
        n[k] = n.get(k, 0) + ok
    assert sorted(rows_of(found, "id", "again")) == sorted((i, ok and n[k] > 1) for i, k, ok in data)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_a_hot_key_fills_even_tasks(spark):
    df = spark.range(0, 100_000, numPartitions=8).select(F.when(F.col("id") % 10 < 3, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = with_repeats(df, ["k"]).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("count"), F.count_if("_repeated").alias("again")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) == 16 and sum(r["again"] for r in tasks) == 30_000 and max(r["count"] for r in tasks) < 2 * 100_000 / 16


def test_the_input_of_places_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return k % 10

    df = spark.range(0, 1000, numPartitions=4).select("id", F.udf(counted, "long")("id").alias("v"))
    found = sorted(rows_of(placed(df, ["v", "id"]), "place", "id"))
    assert found == [(n, k) for n, k in enumerate(sorted(range(1000), key=lambda k: (k % 10, k)), 1)]
    assert seen.value == 1000
