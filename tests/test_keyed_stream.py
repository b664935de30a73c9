"""Keys that repeat across batches give what one batch of everything gives."""

import random
import time

import pytest

from veritab.operators.contracts import validated
from veritab.plans.specs import Contract, Field, SpecError
from veritab.streaming.keyed import validated_keyed_stream

CONTRACT = Contract((Field("id", "integer"), Field("day", "date"), Field("note", "text", False)), ("id", "day"), 100, 1)
SCHEMA = "record long, width int, id string, day string, note string"


class Sink:
    """What the callbacks got: the last entry of each record, as replaying a batch leaves it."""

    def __init__(self):
        self.accepted, self.quarantined, self.recalled, self.batches = {}, {}, set(), set()

    def accept(self, df, number):
        self.accepted |= {r["record"]: number for r in df.collect()}

    def quarantine(self, df, number):
        self.quarantined |= {r["record"]: sorted(map(str, r["reasons"])) for r in df.collect()}

    def recall(self, df, number):
        self.recalled |= {r["record"] for r in df.collect()}
        self.batches.add(number)

    @property
    def good(self):
        return set(self.accepted) - self.recalled


def run(spark, tmp_path, sink, name="a", **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = validated_keyed_stream(stream, CONTRACT, sink.accept, sink.quarantine, sink.recall, **options)
    writer = writer.option("checkpointLocation", f"{tmp_path}/checkpoint-{name}")
    if not options:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    try:
        until = time.monotonic() + 120
        while query.isActive and len(sink.batches) < 3 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        query.stop()


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def random_rows(seed, first, n):
    draw = random.Random(seed)
    return [(first + k, 3 if draw.random() < 0.9 else 2, draw.choice(["1", "2", "3", "4", "x", "", "5 "]) + draw.choice(["", str(draw.randrange(9))]), draw.choice(["2026-01-01", "2026-01-02", "2026-13-01"]), draw.choice(["", "n", " n"])) for k in range(n)]


def test_batches_say_what_one_batch_says(spark, tmp_path):
    parts = [random_rows(k, 100 * k, 40) for k in range(4)]
    sink = Sink()
    for part in parts[:2]:
        put(spark, tmp_path, part)
    run(spark, tmp_path, sink)
    for part in parts[2:]:  # the query starts again, from its checkpoint
        put(spark, tmp_path, part)
    run(spark, tmp_path, sink)
    assert len(sink.batches) == 4
    whole = validated(spark.createDataFrame([r for part in parts for r in part], SCHEMA), CONTRACT)
    assert sink.quarantined == {r["record"]: sorted(map(str, r["reasons"])) for r in whole.quarantined.collect()}
    assert sink.good == {r["record"] for r in whole.accepted.collect()} and sink.recalled


def test_a_first_row_is_recalled_once_and_a_time_limit_is_taken(spark, tmp_path):
    sink = Sink()
    for k in range(3):
        put(spark, tmp_path, [(k, 3, "7", "2026-01-01", "")])
    run(spark, tmp_path, sink, keep_ms=30 * 24 * 3_600_000)
    assert len(sink.batches) >= 3
    assert set(sink.accepted) == {min(sink.accepted)} == sink.recalled and set(sink.quarantined) == {0, 1, 2} and sink.good == set()


def test_other_columns_are_refused(spark, tmp_path):
    put(spark, tmp_path, [(1, 3, "1", "2026-01-01", "")])
    stream = spark.readStream.schema(SCHEMA + ", more string").parquet(f"{tmp_path}/in")
    with pytest.raises(SpecError, match="more"):
        validated_keyed_stream(stream, CONTRACT, None, None, None)
