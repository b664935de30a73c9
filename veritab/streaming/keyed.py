"""Contracts over a stream whose keys are unique in all of it, not in each batch alone.

The first row of each key is kept as state. A later row with the same key is quarantined, and so is the first one: if its batch
was accepted, it is recalled. So however a stream is cut into batches, the last word on each record is what one batch of
everything would have said. State lives in the checkpoint, a row for each key, and is forgotten after a time, if one is given; a
key that comes again later than that counts as new. For very many keys set the session's state store to RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from veritab.functions.workers import importable
from veritab.operators.contracts import Validated, validated, whole_key, with_values
from veritab.plans.specs import Contract, SpecError

#: Rows of one key that are handed on at a time.
ROWS = 10_000


def marked(stream: DataFrame, contract: Contract, keep_ms: int | None = None) -> DataFrame:
    """stream (record, width if there is one, the contract's columns) with _repeated and _recalled; for append mode.

    keep_ms: how long the first row of a key is remembered after the last one came; without it, for good. A query with such
    a limit always has another batch to look forward to, so start it with a trigger at intervals: availableNow wouldn't end.
    """
    headers = [c for c in stream.columns if c not in ("record", "width")]
    if errors := contract.schema_errors(headers):
        raise SpecError("; ".join(errors))
    importable(stream.sparkSession)
    own = [f for f in stream.schema.fields if f.name in ("record", "width", *headers)]
    names = [f.name for f in own]
    rows = with_values(stream, contract)
    whole = whole_key(contract)
    # an incomplete key repeats nothing: a group of its own for each record, without state
    key = F.when(whole, F.to_json(F.array(*[F.col(f"v_{k}").cast("string") for k in contract.key]))).otherwise(F.col("record").cast("string"))
    rows = rows.select(whole.alias("_whole"), key.alias("_key"), *[F.col(n).cast("string").alias(n) for n in names])

    def judge(key, parts, state):
        import pandas as pd

        table = lambda of: pd.DataFrame(of, columns=[*names, "_repeated", "_recalled"], dtype=object)
        if state.hasTimedOut:
            state.remove()
            return
        cells = (tuple(None if pd.isna(c) else c for c in row) for part in parts for row in part[names].itertuples(index=False, name=None))
        if not key[0]:
            yield table([(*c, False, False) for c in cells])
            return
        first, twice, out = None, False, []
        if state.exists:
            *first, twice = state.get
        for c in cells:
            if first is None:
                first = c
                continue
            if not twice:  # the first row of this key, of this batch or an earlier one
                out.append((*first, True, state.exists))
                twice = True
            out.append((*c, True, False))
            if len(out) >= ROWS:
                yield table(out)
                out = []
        if not twice:
            out.append((*first, False, False))
        state.update((*first, twice))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield table(out)

    text = ", ".join(f"`{n}` string" for n in names)
    found = rows.groupBy("_whole", "_key").applyInPandasWithState(
        judge, f"{text}, _repeated boolean, _recalled boolean", f"{text}, _twice boolean", "append", GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own], "_repeated", "_recalled")


def validated_keyed_stream(
    stream: DataFrame, contract: Contract, accept: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None], recall: Callable[[DataFrame, int], None], keep_ms: int | None = None
) -> DataStreamWriter:
    """A writer that hands each batch's accepted and quarantined rows on, and the earlier records that it recalls.

    The gate judges a batch by the rows that came with it; if it is blocked, nothing of the batch is accepted. `quarantine` gets
    recalled rows too, with all their reasons: a record's last entry holds. `recall` gets the numbers of records that may have been accepted
    before. All three get the batch's number, so that writing again after a failure can replace what was written before.
    """
    rows = marked(stream, contract, keep_ms)

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            own = validated(batch.where("not _recalled").drop("_recalled"), contract, repeated="_repeated")
            if own.gate.first()["passed"]:
                accept(own.accepted, number)
            every: Validated = validated(batch.drop("_recalled"), contract, repeated="_repeated")
            quarantine(every.quarantined, number)
            recall(batch.where("_recalled").select("record"), number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(each)
