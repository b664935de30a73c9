"""Contracts over arriving snapshots: each micro-batch is validated as a batch of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from veritab.operators.contracts import Validated, validated
from veritab.plans.specs import Contract


def validated_stream(stream: DataFrame, contract: Contract, accept: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each batch's accepted and quarantined rows on; a blocked gate accepts nothing.

    Keys are unique within a batch, as in the batch contract. Both callbacks get the batch's number, so that
    writing again after a failure can replace what was written before.
    """

    def each(batch: DataFrame, number: int) -> None:
        result: Validated = validated(batch, contract)
        rows = result.rows.persist()
        result = Validated(contract, result.schema_errors, rows, result.headers)
        try:
            if result.gate.first()["passed"]:
                accept(result.accepted, number)
            quarantine(result.quarantined, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each)
