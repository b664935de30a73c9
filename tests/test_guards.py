"""Raw tables are compared only if they are tables."""

import pytest

from veritab.operators import compare, snapshots
from veritab.plans.specs import SnapshotRules, SpecError

RULES = SnapshotRules(("id",), "ledger", "all", "2026-01-01", "2026-01-01", "2026-01-02", 7, True)


def cells(spark, *rows):
    return spark.createDataFrame([(k, list(r)) for k, r in enumerate(rows, 2)], "record long, cells array<string>")


def test_sound_tables_are_compared(spark):
    left, right = cells(spark, ("a", "1"), ("b", "2")), cells(spark, ("a", "1"), ("b", "3"))
    found = compare.compared_tables(left, right, ["sku", "n"], ["code", "m"], "sku", "code", "n", "m")
    assert {r["key"]: r["status"] for r in found.collect()} == {"a": "matched", "b": "conflict"}
    one = snapshots.assessed_tables(left, right, ["id", "n"], ["id", "n"], RULES)
    assert [(r["id"], r["kind"]) for r in one.issues.collect()] == [("b", "changed")]


@pytest.mark.parametrize("rows, headers", [([("a",)], ["id", "n"]), ([("a", "1", "x")], ["id", "n"]), ([("a", "1")], ["id", " id"]), ([("a", "1")], ["id", ""])])
def test_others_are_refused(spark, rows, headers):
    sound, odd = cells(spark, ("a", "1")), cells(spark, *rows)
    with pytest.raises(SpecError):
        compare.compared_tables(sound, odd, ["id", "n"], headers, "id", "id", "n", "n")
    with pytest.raises(SpecError):
        snapshots.assessed_tables(odd, sound, headers, ["id", "n"], RULES)
