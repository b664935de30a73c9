"""Small tables with known results, boundaries, and rejected declarations."""

import datetime as dt
import decimal
import json
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab import cli
from veritab.functions import text as T
from veritab.operators import compare, contracts, incidents, inventory, lab, orders, quality, receipts, scoring, snapshots
from veritab.operators.keys import with_repeats
from veritab.plans.specs import Contract, Cutoffs, Field, QuestionPlan, SnapshotRules, SpecError, canonical_id, distinct_choices, review_note, role_mapping
from veritab.sources import csv_text, files, synthetic
from veritab.sources.store import Store, StoreError
from veritab.streaming.batches import validated_stream


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=str)


def one(df):
    return df.first().asDict()


# ---- text ------------------------------------------------------------------------------------------


def test_white_space_and_folding(spark):
    ws = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"
    df = spark.createDataFrame([(f"{c}a b{c}",) for c in ws] + [("​a",), (None,), ("",)], "v string")
    got = df.select("v", T.trimmed(F.col("v")).alias("t"), T.blank(F.col("v")).alias("b"), T.padded(F.col("v")).alias("p")).collect()
    assert all(r["t"] == (r["v"].strip() if r["v"] is not None else None) for r in got)
    assert all(r["p"] == (r["v"] is not None and r["v"] != r["v"].strip()) and r["b"] == (not r["v"] or not r["v"].strip()) for r in got)
    pairs = spark.createDataFrame([("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("É", "é"), ("abc", "ABC")], "a string, b string")
    assert pairs.where(T.fold(F.col("a")) == T.fold(F.col("b"))).count() == 4


def test_folding_at_every_code_point(spark):
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    letters = spark.createDataFrame(pa.table({"id": points, "c": [chr(k) for k in points]}))
    found = letters.select("id", T.fold(F.concat(F.lit("a"), "c", F.lit("B"))).alias("f")).toArrow().to_pydict()
    assert [hex(k) for k, f in zip(found["id"], found["f"], strict=True) if f != f"a{chr(k)}B".casefold()] == [] and len(found["id"]) == len(points)
    words = ["Straße ŉ ﬃ ΟΔΟΣ İstanbul", "", None, "Ꮳꭰ ẞ"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fold(F.col("w")).alias("f")).collect()
    assert all(r["f"] == (r["w"].casefold() if r["w"] is not None else None) for r in rows)


def test_amounts_agree_with_exact_decimals(spark):
    draw = random.Random(4)
    some = lambda n: "".join(draw.choice("0012345678900") for _ in range(draw.randrange(n)))
    texts = [draw.choice(["", "", "+", "-", " "]) + some(14) + draw.choice(["", ".", ","]) + some(8) + draw.choice(["", "", "e", "E-", "e+", "E"]) + some(3) + draw.choice(["", " ", "x"] if draw.random() < 0.3 else [""]) for _ in range(4000)]

    def plainly(text):
        if not text.strip():
            return None
        try:
            n = decimal.Decimal(text.replace(",", "").strip())
            return int(n * 100) if n.is_finite() and n >= 0 and n == n.quantize(decimal.Decimal(".01")) and n <= 10**12 else None
        except decimal.InvalidOperation:
            return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.cents_of(F.col("t")).alias("c")).collect()
    assert [(r["t"], r["c"], plainly(r["t"])) for r in rows if r["c"] != plainly(r["t"])] == []
    assert sum(r["c"] is not None for r in rows) > 500


def test_dates_are_exact(spark):
    good = ["2024-02-29", "0001-01-01", "9999-12-31"]
    bad = ["2023-02-29", "2026-2-3", " 2026-02-03", "2026-02-03T10", "0000-01-01", "20260203", "2026-02-03\n", "", "２０２６-02-03"]
    df = spark.createDataFrame([(v, v in good) for v in good + bad], "v string, ok boolean")
    assert df.where(T.iso_date(F.col("v")) != F.col("ok")).count() == 0


def test_formulas_are_guarded(spark):
    df = spark.createDataFrame([(v,) for v in ["=1", " +1", "-1", "\t@x", "\rx", "a=1", "", "\xa0=1"]], "v string")
    got = [r[0] for r in df.select(T.formula_safe(F.col("v"))).collect()]
    assert got == ["'=1", "' +1", "'-1", "'\t@x", "'\rx", "a=1", "", "'\xa0=1"]
    assert [r[0] for r in df.select(T.formula_safe_strict(F.col("v"))).collect()] == ["'=1", " +1", "'-1", "'\t@x", "'\rx", "a=1", "", "\xa0=1"]


def test_amounts_are_read_once(spark):
    cases = {"": None, "0": 0, "7": 700, "7.": 700, "7.5": 750, "007.50": 750, "7.500": 750, "7.505": None, ".5": 50, " 7.5 ": 750, "1,234.5": 123450, "1_0": 1000, "+7": 700, "-7": None, "-0": 0, "7e1": 7000, "75E-1": 750, "7e-3": None}
    cases |= {"999999999999.99": 99_999_999_999_999, "1000000000000": 100_000_000_000_000, "1000000000000.01": None, "0000000000000000007": 700, "7\n": 700, "7 5": None, "\u0667.\u0665": 750, None: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("c", T.cents_of(F.col("t")))
    assert {r["t"]: r["c"] for r in df.collect()} == cases
    # the plain form and the general one, each once
    assert df._jdf.queryExecution().optimizedPlan().toString().upper().count("RLIKE") == 2


def test_amounts_in_cents(spark):
    cases = {"115": 11500, "1,234.50": 123450, " 7.1 ": 710, "1.230": 123, "0": 0, "1.234": None, "-1": None, "NaN": None, "1e3": 100_000, "1E-2": 1, "1e-3": None, "+.5e1": 500, "-0": 0, "1_0": 1000, "٣": 300, "1000e-3": 100, "0e99": 0, "1e99999999999": None, "1e13": None, ".": None, "e5": None, "1.e2": 10000, "": None, "1000000000000": 100_000_000_000_000, "1000000000001": None}
    df = spark.createDataFrame(list(cases), "string").toDF("v")
    assert {r["v"]: r["c"] for r in df.select("v", T.cents_of(F.col("v")).alias("c")).collect()} == cases


# ---- csv and structure ------------------------------------------------------------------------------


def test_csv_records():
    assert csv_text.parse('﻿name,note\r\nA,"hello,\nworld"\r\n') == [["name", "note"], ["A", "hello,\nworld"]]
    assert csv_text.parse("a,b\n\nx\n") == [["a", "b"], [], ["x"]]
    for bad in ["", "\0", 'a\n"open', 5, "a\n" + "x" * 2_000_001, ",".join("x" * 101), "a\n" * 10_003]:
        with pytest.raises(csv_text.CsvError):
            csv_text.parse(bad)


def test_broken_texts_dont_stop_the_others(spark):
    texts = [("a", "x,y\n1,2\n"), ("b", 'x\n"open'), ("c", None), ("d", "\0"), ("e", ""), ("f", "\ufeffz\n\n")]
    found = csv_text.parsed(spark.createDataFrame(texts, "id string, content string"))
    assert rows(found.where("error is null"), "id", "record", "cells") == [("a", 1, ["x", "y"]), ("a", 2, ["1", "2"]), ("f", 1, ["z"]), ("f", 2, [])]
    assert {r["id"] for r in found.where("error is not null and record is null and cells is null").collect()} == {"b", "c", "d", "e"} and found.count() == 8


def test_only_sound_tables_are_cleaned(spark):
    good, headers = csv_text.table(spark, "a,b\n x ,y\n")
    assert quality.trimmed_cells(good, headers).count() == quality.trim_changes(good, headers).count() == 1
    for content in ("a,b\nx\n", "a,A \nx,y\n", ",b\nx,y\n", "a,b\nx,y,z\n"):
        with pytest.raises(SpecError, match="not a table"):
            quality.trimmed_cells(*csv_text.table(spark, content))


def test_structural_mix(spark):
    df, headers = csv_text.table(spark, 'name,amount\n" Alice ",10\nBob,\nBob,\nOnlyName\n')
    assert dict(rows(quality.issue_counts(quality.findings(df, headers)), "kind", "n")) == {"whitespace": 1, "missing": 3, "duplicate": 1, "row_width": 1}
    assert rows(quality.duplicate_rows(df), "record", "first_record") == [(4, 3)]
    assert rows(quality.missing_by_column(df, headers), "name", "missing") == [("amount", 3), ("name", 0)]


def test_headers_and_bounded_findings(spark):
    assert quality.header_findings(["Name", " name ", ""]) == [2, 3]
    df, headers = csv_text.table(spark, "a,b\n" + ",\n" * 150)
    found = quality.findings(df, headers)
    assert quality.first_findings(found).count() == 200 and found.where("kind = 'missing'").count() == 300
    first = quality.first_findings(found).collect()
    assert [r["record"] for r in first] == sorted(r["record"] for r in first)


def test_trimming_leaves_the_source(spark):
    df, _ = csv_text.table(spark, "a,b\n x ,y\n")
    assert rows(quality.trim_changes(df), "record", "column", "before", "after") == [(2, 1, " x ", "x")]
    assert quality.trimmed_cells(df).first()["cells"] == ["x", "y"] and df.first()["cells"] == [" x ", "y"]


# ---- comparison -------------------------------------------------------------------------------------

LEFT = "sku,quantity\nW-100,12\nW-200,8\nW-300,4\nW-300,4\n W-400 ,7\nW-500,3\n"
RIGHT = "product_code,on_hand\nW-100,12\nW-200,6\nW-300,4\nW-400,7\nW-600,2\n"


def table(spark, content, clean=False):
    cells, headers = csv_text.table(spark, content)
    return csv_text.named(quality.trimmed_cells(cells) if clean else cells, headers)


@pytest.mark.parametrize("clean", [False, True])
def test_compared_counts(spark, clean):
    found = compare.compared(table(spark, LEFT, clean), table(spark, RIGHT, clean), "sku", "product_code", "quantity", "on_hand")
    expected = {"matched": 2, "conflict": 1, "left_only": 1, "right_only": 1, "ambiguous": 1, "invalid": 0} if clean else {"matched": 1, "conflict": 1, "left_only": 2, "right_only": 2, "ambiguous": 1, "invalid": 0}
    assert one(compare.status_counts(found)) == expected


def test_compared_text_is_exact(spark):
    left, right = table(spark, "id,v\nA,1\nB,\n,3\n"), table(spark, "id,v\nA,1.0\nB,\n,3\n")
    assert one(compare.status_counts(compare.compared(left, right, "id", "id", "v", "v"))) == {"matched": 0, "conflict": 1, "left_only": 0, "right_only": 0, "ambiguous": 0, "invalid": 2}
    with pytest.raises(SpecError):
        compare.compared(left, right, "id", "id", "id", "v")
    shown = compare.evidence(left, ["id"], ["v"], compare.compared(left, right, "id", "id", "v", "v").where("status = 'conflict'").select(F.col("key").alias("id")))
    assert [(e["record"], e["v"]) for e in shown.first()["evidence"]] == [(2, "1")]


def test_documents_reconciled(spark):
    content = "merchant,receipt_number,currency,total\n example ,a1,usd,10.00\nExample,A2,EUR,10\nOther,A1,USD,10\nExample,A3,USD,NaN\nExample,A4,USD,1.234\nExample,A5,USD,1\nexample,a5,USD,1\n"
    approved = spark.createDataFrame([("Example", f"A{k}", "USD", "10") for k in (1, 2, 5)], "merchant string, receipt_number string, currency string, total string")
    found = compare.documents_reconciled(table(spark, content), approved)
    assert rows(found, "record", "status") == [(2, "matched"), (3, "conflict"), (4, "unmatched"), (5, "invalid"), (6, "invalid"), (7, "ambiguous"), (8, "ambiguous")]


# ---- contracts --------------------------------------------------------------------------------------

DEMO = Contract(tuple(Field(n, t) for n, t in (("id", "text"), ("date", "date"), ("amount", "decimal"), ("active", "boolean"))), ("id",), 0, 1)
AMOUNTS = Contract((Field("id", "text", False), Field("amount", "decimal")), ("amount",), 100, 1)


def run(spark, content, contract):
    df = table(spark, content)
    return contracts.validated(df, contract, [c for c in df.columns if c not in ("record", "width")])


def test_passing_and_failing(spark):
    good = run(spark, "id,date,amount,active\nA1,2026-09-18,12.50,true\nA2,2026-09-19,18.00,false\n", DEMO)
    assert one(good.gate) | {"gate_reasons": 0} == {"source": 2, "accepted": 2, "quarantined": 0, "gate_reasons": 0, "passed": True}
    assert rows(good.accepted, "id", "amount", "active") == [("A1", "12.50", True), ("A2", "18.00", False)]
    bad = run(spark, "id,date,amount,active\nA1,2026-09-18,12.50,true\nA1,2026-09-19,18.00,false\nA3,2026-02-30,unknown,true\n", DEMO)
    assert (one(bad.gate)["quarantined"], one(bad.gate)["passed"]) == (3, False)
    assert dict(rows(bad.error_counts, "code", "n")) == {"duplicate_key": 2, "invalid_value": 2}


def test_keys_are_typed(spark):
    found = run(spark, "id,amount\nA,1.00\n,1.0\nB,2\nC,2,extra\n", AMOUNTS)
    assert one(found.gate)["quarantined"] == 4 and dict(rows(found.error_counts, "code", "n")) == {"duplicate_key": 4, "row_width": 1}


@pytest.mark.parametrize(("bad", "good", "passes"), [(1, 3, True), (1, 2, False), (0, 0, False), (0, 1, True)])
def test_gate_boundary(spark, bad, good, passes):
    contract = Contract(AMOUNTS.fields, ("amount",), 25, 1)
    content = "id,amount\n" + "".join(f"G,{k}\n" for k in range(good)) + "B,x\n" * bad
    assert one(run(spark, content, contract).gate)["passed"] is passes


def test_strict_types(spark):
    contract = Contract((Field("id", "integer"), Field("date", "date"), Field("amount", "decimal"), Field("active", "boolean"), Field("memo", "text", False)), ("id",), 100, 1)
    content = "id,date,amount,active,memo\n1,2024-02-29,123456789012345678.123456789,false,\n01,2024-2-9,1e3,True, x\n-0,2023-02-29,1.1234567890,,\n"
    found = run(spark, content, contract)
    assert rows(found.accepted, "id", "amount", "memo") == [(1, "123456789012345678.123456789", None)]
    why = {r["record"]: [x["detail"] for x in r["reasons"]] for r in found.quarantined.collect()}
    assert why == {3: ["integer", "date_format", "decimal", "boolean", "whitespace"], 4: ["date_value", "decimal", "required"]}


def test_schema_drift_and_column_order(spark):
    drift = run(spark, "id,amount,unapproved\nA,1,x\n", AMOUNTS)
    assert one(drift.gate)["gate_reasons"] == ["unexpected columns: unapproved", "below_minimum"] and rows(drift.error_counts, "code", "n") == [("schema", 1)]
    swapped = run(spark, "amount,id\n1.2300,A\n", AMOUNTS)
    assert rows(swapped.accepted, "id", "amount") == [("A", "1.2300")]


def test_short_rows_give_no_field_reason(spark):
    found = run(spark, "id,amount\nA\n", AMOUNTS)
    assert [x["code"] for x in found.quarantined.first()["reasons"]] == ["row_width"]


@pytest.mark.parametrize(
    "change",
    [
        {"fields": []}, {"key": []}, {"key": ["nope"]}, {"key": ["id", "id"]}, {"max_quarantine_percent": 101}, {"max_quarantine_percent": True}, {"min_accepted_rows": 0}, {"extra": 1},
        {"fields": [{"name": "id", "type": "text", "required": False}]}, {"fields": [{"name": "id", "type": "uuid", "required": True}]}, {"fields": [{"name": " id", "type": "text", "required": True}]},
        {"fields": [{"name": "id", "type": "text", "required": True}, {"name": "ID", "type": "text", "required": True}]}, {"fields": [{"name": "id", "type": "text"}]},
    ],
)
def test_rejected_contracts(change):
    spec = {"fields": [{"name": "id", "type": "text", "required": True}], "key": ["id"], "max_quarantine_percent": 0, "min_accepted_rows": 1}
    Contract.from_json(spec)
    with pytest.raises(SpecError):
        Contract.from_json(spec | change)


def test_row_order_and_partitions_do_not_matter(spark):
    content = "id,amount\n" + "".join(f"{k},{k % 40}.{k % 3}0\n" for k in range(200))
    df = table(spark, content)
    a = contracts.validated(df, AMOUNTS, ["id", "amount"])
    b = contracts.validated(df.orderBy(F.desc("record")).repartition(7), AMOUNTS, ["id", "amount"])
    assert rows(a.accepted, "record", "amount") == rows(b.accepted, "record", "amount") and one(a.gate) == one(b.gate)
    assert one(a.gate)["source"] == one(a.gate)["accepted"] + one(a.gate)["quarantined"]


# ---- snapshots --------------------------------------------------------------------------------------

REFERENCE = "id,region,plan\nA,East,pro\nA,West,basic\nB,North,pro\nC,West,basic\n"
DELIVERY = "plan,region,id\nbasic,East,A\nbasic,West,A\nbasic,West,A\npro,South,X\npro,South,X\n"


def rules(**change):
    return SnapshotRules(**({"keys": ("id", "region"), "authority": "ledger", "scope": "all", "reference_date": "2026-09-21", "delivery_date": "2026-09-21", "as_of": "2026-09-22", "max_age_days": 1, "confirmed": True} | change))


def snapshot(spark, content):
    return table(spark, content).drop("width")


def assessed(spark, reference=REFERENCE, delivery=DELIVERY, **change):
    return snapshots.assessed(snapshot(spark, reference), snapshot(spark, delivery), rules(**change))


def test_snapshot_kinds_and_repairs(spark):
    a = assessed(spark)
    assert rows(a.issues, "id", "region", "kind") == [("A", "East", "changed"), ("A", "West", "duplicate"), ("B", "North", "missing"), ("C", "West", "missing"), ("X", "South", "unexpected")]
    assert rows(a.issues.where("kind = 'changed'"), "changed_fields") == [["plan"]]
    fixed = a.repaired(a.issues, "take the reference")
    assert one(fixed.summary)["matched"] and fixed.delivery.count() == 4
    part = a.repaired(a.issues.where("id = 'X'"), "drop what isn't known")
    assert one(part.summary)["discrepancies"] == 4 and not one(part.summary)["matched"]
    assert dict(rows(snapshots.repair_changes(a, a.issues), "id", "action"))["X"] == "remove_unexpected"
    with pytest.raises(SpecError):
        fixed.repaired(a.issues, "again")
    with pytest.raises(SpecError):
        a.repaired(a.issues, " ")


def test_identities_are_tuples(spark):
    a = assessed(spark, "id,region,plan\na|b,c,1.00\na,b|c, basic \n", "region,plan,id\nb|c, basic ,a\nc,1,a|b\n")
    assert rows(a.issues, "id", "region", "kind") == [("a|b", "c", "changed")] and one(a.summary)["matched_keys"] == 1


@pytest.mark.parametrize(
    ("reference", "delivery", "change", "blocker"),
    [
        (REFERENCE + "A,East,pro\n", DELIVERY, {}, "reference_not_unique"), (REFERENCE + " A,East,pro\n", DELIVERY, {}, "reference_invalid_identity"), (REFERENCE, DELIVERY + "pro,,Z\n", {}, "delivery_invalid_identity"),
        ("id,region,plan\n", DELIVERY, {}, "empty_reference"), (REFERENCE, REFERENCE, {"as_of": "2026-09-23"}, "reference_too_old"), (REFERENCE, REFERENCE, {"as_of": "2026-09-20"}, "reference_after_assessment"),
        (REFERENCE, REFERENCE, {"delivery_date": "2026-09-22"}, "dates_differ"),
    ],
)
def test_blockers(spark, reference, delivery, change, blocker):
    a = assessed(spark, reference, delivery, **change)
    assert blocker in one(a.summary)["blockers"] and not one(a.summary)["matched"]
    with pytest.raises(SpecError):
        a.repaired(a.issues, "no")


def test_many_missing(spark):
    reference = "id,region,plan\n" + "".join(f"{k},x,pro\n" for k in range(120))
    a = assessed(spark, reference, "id,region,plan\n")
    assert a.issues.count() == 120 and one(a.repaired(a.issues, "all").summary)["matched"]


@pytest.mark.parametrize("change", [{"keys": ()}, {"keys": ("a", "a")}, {"authority": ""}, {"scope": "x" * 1001}, {"as_of": "2026-9-1"}, {"max_age_days": 3651}, {"max_age_days": 1.0}, {"confirmed": 1}])
def test_rejected_snapshot_rules(change):
    with pytest.raises(SpecError):
        rules(**change)


def test_snapshot_columns_must_agree(spark):
    with pytest.raises(SpecError):
        snapshots.assessed(snapshot(spark, "id,region\n"), snapshot(spark, DELIVERY), rules())
    with pytest.raises(SpecError):
        assessed(spark, keys=("nope",))


# ---- incidents --------------------------------------------------------------------------------------


def replay(spark, seed, faults):
    payments, refunds = synthetic.ledger(seed)
    return incidents.Replay(synthetic.ledger_frame(spark, payments), synthetic.ledger_frame(spark, synthetic.delivered(payments, faults)), synthetic.refund_frame(spark, refunds))


@pytest.mark.parametrize("mask", range(8))
def test_every_set_of_faults_is_found_and_repaired(spark, mask):
    faults = [f for i, f in enumerate(snapshots.FAULTS) if mask & (1 << i)]
    expected = {f"PAY-{k:03d}" for k in range(1, 5)} if "missing_region" in faults else set()
    expected |= {"PAY-011"} if "duplicate_retry" in faults else set()
    expected |= {"PAY-012"} if "amount_unit" in faults else set()
    r = replay(spark, (3, 17, 91)[mask % 3], faults)
    assert {x["payment_id"] for x in r.issues.collect()} == expected
    assert one(r.summary)["verified"] is (not faults) and one(r.summary)["gate_passed"] is ("duplicate_retry" not in faults)
    if faults:
        fixed = one(r.repaired().summary)
        assert fixed["verified"] and fixed["delta_cents"] == 0
    assert one(r.summary)["expected_refunds_cents"] == 4000


def test_partial_repair_and_choices(spark):
    r = replay(spark, 17, ["missing_region"])
    assert one(r.repaired(["PAY-001"]).summary)["issues"] == 3
    for bad in ([], ["PAY-001", "PAY-001"], ["PAY-009"]):
        with pytest.raises(SpecError):
            r.repaired(bad)
    with pytest.raises(SpecError):
        synthetic.delivered(synthetic.ledger(1)[0], ["unknown"])
    with pytest.raises(SpecError):
        synthetic.ledger(1_000_000)


def test_equal_totals_are_not_equal_records(spark):
    payments, refunds = synthetic.ledger(5)
    swapped = [(*p[:5], payments[(i + 1) % 12][5]) for i, p in enumerate(payments)]
    r = incidents.Replay(synthetic.ledger_frame(spark, payments), synthetic.ledger_frame(spark, swapped), synthetic.refund_frame(spark, refunds))
    assert one(r.summary)["delta_cents"] == 0 and one(r.summary)["issues"] > 0 and not one(r.summary)["verified"]


def test_unknown_identities_and_currencies_are_errors(spark):
    r = replay(spark, 3, [])
    more = r.delivered.unionByName(r.delivered.limit(1).withColumn("payment_id", F.lit("PAY-999")))
    with pytest.raises(Exception, match="exactly once"):
        snapshots.ledger_issues(r.reference, more, "payment_id").collect()
    with pytest.raises(Exception, match="USD"):
        snapshots.ledger_metric(r.delivered.withColumn("currency", F.lit("EUR")), r.refunds).collect()


# ---- orders -----------------------------------------------------------------------------------------

ORDERS = """order_id,team,ordered_on,due_on,delivered_on
O-1,East,2026-09-01,2026-09-10,2026-09-09
O-2,East,2026-09-03,2026-09-12,2026-09-15
O-3,West,2026-09-04,2026-09-14,
O-4,West,2026-09-10,2026-09-20,
O-5,East,2026-09-12,2026-09-25,
O-6,West,2026-09-02,2026-09-11,2026-09-11
O-7,East,2026-09-02,2026-09-08,
O-8,West,2026-09-01,2026-09-03,2026-09-05
D-1,East,2026-09-01,2026-09-10,
D-1,East,2026-09-01,2026-09-10,
B-1,West,2026-09-31,2026-10-02,
"""


def checked(spark, content, as_of="2026-09-20"):
    df = table(spark, content)
    return orders.checked(df.withColumn("width_ok", F.col("width") == 5).drop("width"), as_of)


def test_orders_starter(spark):
    found = checked(spark, ORDERS)
    assert one(orders.counts(found)) == {"source": 11, "valid": 8, "quarantined": 3, "flagged": 4}
    assert one(orders.summary(found)) == {"records": 8, "delivered": 4, "delivered_on_time": 2, "delivered_late": 2, "open_overdue": 2, "due_today": 1, "upcoming": 1, "on_time_rate": 0.5, "median_lead_days": 8.5}
    assert [r["order_id"] for r in orders.queue(found).collect()][:2] == ["O-7", "O-3"]


def test_order_boundaries(spark):
    found = checked(spark, "order_id,team,ordered_on,due_on,delivered_on\nA,t,2024-02-01,2024-02-29,\nB,t,2024-02-28,2024-02-29,2024-02-29\nC,t,2024-02-01,2024-03-01,\n", "2024-03-01")
    assert rows(found, "order_id", "late_days", "status", "lead_days") == [("A", 1, "open overdue", None), ("B", 0, "delivered on time", 1), ("C", 0, "due today", None)]


def test_order_quarantine(spark):
    head = "order_id,team,ordered_on,due_on,delivered_on\n"
    bad = head + "A,t,2024-02-02,2024-02-01,\nB,t,2024-02-02,2024-02-03,2024-02-01\nC,t,2024-03-02,2024-03-03,\nD, t,2024-02-02,2024-02-03,\nE,t,,2024-02-03,\nF,t,2024-02-30,2024-03-03,\n"
    found = checked(spark, bad, "2024-03-01")
    assert orders.quarantined(found).count() == 6 and one(orders.summary(found))["on_time_rate"] is None and one(orders.summary(found))["median_lead_days"] is None
    pairs = checked(spark, head + "A,t,2024-02-02,2024-02-30,\nA,t,2024-02-02,2024-02-03,\nB,t,2024-02-02,2024-02-03,,x\nB,t,2024-02-02,2024-02-03,\n", "2024-03-01")
    assert orders.quarantined(pairs).count() == 4


def test_quarantine_asks_each_rule_once(spark):
    cells = "record long, order_id string, team string, ordered_on string, due_on string, delivered_on string"
    df = spark.createDataFrame([(1, "A", " t", "2024-02-30", "", " "), (2, "B", "t", "2024-02-03", "2024-02-02", "2024-02-01"), (3, "B", None, "2024-02-01", "2024-02-02", None), (4, "C", "t", "2024-02-03", "2024-02-02", "2024-03-02")], cells)
    found = orders.quarantined(orders.checked(df, "2024-03-01")).select("record", "reasons")
    assert rows(found, "record", "reasons") == [
        (1, ["team: blank or padded", "ordered_on: not a date", "due_on: blank or padded", "delivered_on: blank or padded"]),
        (2, ["repeated order id"]),
        (3, ["team: blank or padded", "repeated order id"]),
        (4, ["due before ordered", "after snapshot"]),
    ]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.upper().count("RLIKE") == 3 and "lambda" not in plan


# ---- inventory --------------------------------------------------------------------------------------


def stock(change=None, drop=(), more=()):
    start = dt.date(2026, 1, 1)
    cells = [[str(start + dt.timedelta(days=k)), "P1", "North", "100", "5", "5", "100"] for k in range(65)]
    cells = [c for k, c in enumerate(cells) if k not in drop]
    if change:
        change(cells)
    return [(n, *c) for n, c in enumerate([*cells, *more], 2)]


def investigated(spark, data, cut=("2026-01-30", "2026-02-13", "2026-03-06")):
    df = spark.createDataFrame(data, "record long, " + ", ".join(f"{r} string" for r in inventory.ROLES))
    found = inventory.checked(df)
    return found, inventory.Investigation(inventory.valid(found), Cutoffs(*cut))


def test_quiet_stock(spark):
    _, i = investigated(spark, stock())
    assert one(i.counts) == {"valid": 65, "outside_window": 0, "investigated": 21, "flagged": 0, "statistical_skipped": 0}
    assert rows(i.profiles, "median", "scale", "threshold") == [(5.0, 1.0, 3.5)] and i.results.where("prior_record is null").count() == 0


def test_bad_rows_take_their_partners_along(spark):
    more = [["2026-03-01", "P1", "North", "x", "5", "5", "100"], ["2026-02-30", "P", "N", "1", "1", "1", "1"], ["2026-03-07", "P", "N", "", "1", "1", "1"], ["2026-03-08", "P", "N", "1", "1", " 1", "1"], ["2026-03-09", "P", "N", "1", "1", "1", "1234567890"]]
    found, i = investigated(spark, stock(more=more))
    assert inventory.quarantined(found).count() == 6 and one(i.counts)["investigated"] == 20


@pytest.mark.parametrize(("missing", "status"), [(4, inventory.NO_TRAINING), (36, inventory.NO_CALIBRATION)])
def test_gaps_in_history_switch_scores_off(spark, missing, status):
    _, i = investigated(spark, stock(drop=(missing,)))
    assert rows(i.series, "status") == [status] and i.profiles.count() == 0 and i.results.where("score is not null").count() == 0
    assert i.results.where("skip_reason is null").count() == 0


def test_the_future_teaches_nothing(spark):
    def late(cells):
        cells[-1][5] = "800"

    _, before = investigated(spark, stock())
    _, after = investigated(spark, stock(late, more=[["2027-01-01", "P1", "North", "1", "1", "900", "1"]]))
    assert rows(before.profiles, "median", "scale", "threshold") == rows(after.profiles, "median", "scale", "threshold")
    assert one(after.counts)["outside_window"] == 1 and one(after.counts)["flagged"] > 0


def test_promotion_is_unusual_but_balanced(spark):
    def promotion(cells):
        cells[-1][5:] = ["30", "75"]

    _, i = investigated(spark, stock(promotion))
    assert rows(i.results.where("size(flags) > 0"), "flags", "delta") == [(["unusual sales"], 0)]


def test_timeline_and_gaps(spark):
    found, i = investigated(spark, stock(drop=(50,), more=[["2027-01-01", "P1", "North", "1", "1", "1", "1"]]))
    assert i.timeline.count() == 64 and len(rows(i.timeline.select("period").distinct(), "period")) == 3
    assert quality.gaps(inventory.valid(found), ["product"], "day").agg(F.max("segment")).first()[0] == 2


@pytest.mark.parametrize("cut", [("2026-01-30", "2026-01-30", "2026-03-01"), ("0001-01-29", "2026-01-30", "2026-03-01"), ("2026-1-30", "2026-02-13", "2026-03-06"), ("2026-01-30", "2026-03-13", "2026-03-06")])
def test_rejected_cutoffs(cut):
    with pytest.raises(SpecError):
        Cutoffs(*cut)


# ---- lab --------------------------------------------------------------------------------------------


def test_lab_evaluation(spark):
    data, truth = synthetic.inventory_frames(spark, 42)
    assert data.count() == 4800 and data.exceptAll(synthetic.inventory_frames(spark, 42)[0]).count() == 0
    assert data.exceptAll(synthetic.inventory_frames(spark, 7)[0]).count() > 0
    found = lab.evaluated(data, truth, ["product", "warehouse"], F.col("n") < 60, F.col("n").between(60, 89), F.col("n") >= 90)
    stock_check = one(found["metrics_reconciliation"])
    assert (stock_check["precision"], stock_check["recall"]) == (1.0, 1.0) and stock_check["tp"] > 10
    robust, plain = one(found["metrics_per_product_robust"]), one(found["metrics_global_baseline"])
    assert robust["recall"] > 0.5 and robust["recall"] > plain["recall"]
    alerts = found["alerts"].collect()
    assert [r["review_value_cents"] for r in alerts] == sorted((r["review_value_cents"] for r in alerts), reverse=True)
    swapped = truth.withColumns({"reconciliation": ~F.col("reconciliation"), "sales_anomaly": ~F.col("sales_anomaly")})
    again = lab.evaluated(data, swapped, ["product", "warehouse"], F.col("n") < 60, F.col("n").between(60, 89), F.col("n") >= 90)
    assert rows(again["alerts"], "id", "score") == rows(found["alerts"], "id", "score")


def test_confusion_without_denominators(spark):
    none = spark.createDataFrame([("a", False)], "id string, p boolean")
    assert one(lab.confusion(none, none.withColumnRenamed("p", "t"), "p", "t")) == {"tp": 0, "fp": 0, "fn": 0, "tn": 1, "precision": None, "recall": None, "false_alerts_per_1000": 0.0}


# ---- receipts ---------------------------------------------------------------------------------------

GOOD = {"merchant": "Example", "receipt_number": "A1", "date": "2026-08-17", "calendar": "gregorian", "currency": "ETB", "total": "115.00", "subtotal": "100", "tax": "15", "service_charge": "0", "document_type": "receipt"}


def receipt_table(spark, *changes):
    data = [(k, "review", None, *[(GOOD | c).get(f) for f in GOOD]) for k, c in enumerate(changes, 1)]
    df = spark.createDataFrame(data, "id long, status string, duplicate_of long, " + ", ".join(f"{f} string" for f in GOOD))
    return receipts.validated(receipts.normalised(df))


def test_receipt_rules(spark):
    cases = [
        ({}, []), ({"receipt_number": "A2", "total": "115.02"}, []), ({"receipt_number": "A3", "total": "115.03"}, ["arithmetic"]), ({"receipt_number": "A4", "calendar": "Ethiopian"}, ["calendar"]), ({"receipt_number": "A5", "currency": "birr"}, []),
        ({"receipt_number": "A6", "currency": "XXX"}, ["currency"]), ({"receipt_number": "A7", "document_type": "Credit note"}, ["document type"]), ({"receipt_number": "A8", "date": "2026-13-01"}, ["date"]), ({"receipt_number": "A9", "merchant": " "}, ["missing merchant"]),
        ({"receipt_number": "B1", "total": None}, ["missing total"]), ({"receipt_number": "B2", "total": "300", "tax": None}, []), ({"receipt_number": "C1"}, ["possible duplicate"]), ({"receipt_number": "c1", "merchant": "EXAMPLE"}, ["possible duplicate"]), ({"receipt_number": ""}, []),
    ]
    found = {r["id"]: r for r in receipt_table(spark, *[c for c, _ in cases]).collect()}
    assert [found[k]["issues"] for k in range(1, len(cases) + 1)] == [e for _, e in cases]
    assert found[5]["currency"] == "ETB" and found[1]["subtotal"] == "100.00"


def test_receipt_review_and_totals(spark):
    df = receipt_table(spark, {}, {"receipt_number": "U1", "currency": "USD"}, {"receipt_number": "Z", "total": "1"}, {"receipt_number": "X"})
    state = receipts.reviewed(df, F.col("id") <= 3, F.col("id") == 4)
    assert rows(state, "id", "status") == [(1, "approved"), (2, "approved"), (3, "review"), (4, "excluded")]
    assert rows(receipts.totals(state, QuestionPlan("total")), "currency", "total_cents") == [("ETB", 11500), ("USD", 11500)]
    assert receipts.answer(state, QuestionPlan("total")).first()[0] == "2 approved documents match. Document totals: ETB 115.00; USD 115.00"
    assert receipts.answer(state, QuestionPlan("merchants", merchant="EXAM", currency="usd")).first()[0].endswith("Example · USD 115.00")
    assert "zero" in receipts.answer(state, QuestionPlan("total", start="2027-01-01")).first()[0]
    assert "beyond" in receipts.answer(state, QuestionPlan("unsupported")).first()[0]
    for bad in ({"action": "delete"}, {"action": "total", "start": "soon"}, {"action": "total", "start": "2026-02-01", "end": "2026-01-01"}, {"action": "list", "merchant": 5}):
        with pytest.raises(SpecError):
            QuestionPlan(**bad)


def test_pages_of_bundles(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, pages array<string>")
    assert rows(receipts.split_pages(df), "parent", "page", "text", "error") == [(1, 1, "a", None), (1, 2, "b", None), (2, None, None, "no pages")]
    more = spark.createDataFrame([(1, ["x"] * 201), (2, ["y"] * 200), (3, None)], "id long, pages array<string>")
    found = receipts.split_pages(more).collect()
    assert len(found) == 202 and {(r["parent"], r["error"]) for r in found if r["error"]} == {(1, "more than 200 pages: 201"), (3, "no pages")}
    turns = spark.createDataFrame([(1, k, f"t{k}") for k in range(5)] + [(2, 2, "b"), (2, 1, "a")], "id long, turn int, text string")
    bundles = receipts.bundles_of(turns, "turn", 4)
    assert rows(bundles, "id", "n", "pages") == [(1, 5, None), (2, 2, ["a", "b"])]
    documents = spark.createDataFrame([(1, "review", None), (2, "review", None), (3, "review", None)], "id long, status string, duplicate_of long")
    children, after, audit = receipts.split_bundles(documents, bundles, 4)
    assert rows(children, "parent", "page", "error") == [(1, None, "more than 4 pages: 5"), (2, 1, None), (2, 2, None)]
    assert rows(after, "id", "status") == [(1, "review"), (2, "excluded"), (3, "review")]
    assert rows(audit, "document", "action", "children") == [(1, "split refused", 0), (2, "split into pages", 2)]


def test_folders_readers_and_extractors(spark, tmp_path, monkeypatch):
    for name, content in {"a.pdf": b"one page of text that is long enough", "b/c.PNG": b"one page of text that is long enough", "d.txt": b"no", "e.jpg": b"other"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.imported(spark, str(tmp_path))
    assert rows(found, "name", "status") == [("a.pdf", "imported"), ("c.PNG", "duplicate"), ("e.jpg", "imported")]

    def read(path):
        with open(path.removeprefix("file:")) as f:
            return [f.read()]

    monkeypatch.setattr(files, "MAX_BYTES", 10)
    assert rows(files.imported(spark, str(tmp_path)), "name", "status", "error", "digest")[:2] == [("a.pdf", "refused", "more than 25 MiB", None), ("c.PNG", "refused", "more than 25 MiB", None)]
    read_ = files.with_text(found.where("duplicate_of is null").drop("error"), read)
    out = {r["name"]: r for r in files.extracted(read_, lambda raw: {"merchant": raw[9:17], "total": 5}).collect()}
    assert out["a.pdf"]["fields"] == {"merchant": "one page", "total": "5"} and out["e.jpg"]["extraction_error"]


def test_unreadable_amounts_stand_against_approval(spark):
    fields = {"merchant": "M", "receipt_number": "1", "date": "2026-01-02", "calendar": "gregorian", "currency": "USD", "total": "5", "subtotal": "", "tax": "", "service_charge": "", "document_type": "receipt", "status": "review"}
    cases = [{}, {"tax": "abc"}, {"total": "x"}, {"subtotal": "-1", "service_charge": "1.234"}, {"total": ""}]
    df = spark.createDataFrame([(k, *(fields | {"receipt_number": str(k)} | c).values(), None) for k, c in enumerate(cases)], "id long, " + ", ".join(f"{f} string" for f in fields) + ", duplicate_of long")
    found = receipts.reviewed(receipts.validated(receipts.normalised(df)), F.lit(True), F.lit(False))
    assert rows(found, "id", "status", "issues") == [(0, "approved", []), (1, "review", ["unreadable tax"]), (2, "review", ["unreadable total"]), (3, "review", ["unreadable subtotal", "unreadable service_charge"]), (4, "review", ["missing total"])]


def test_listings_hide_paths_and_raw_texts(spark):
    df = spark.createDataFrame([(1, "b", "/x", "raw", 1), (2, "a", "/y", "raw", 2), (3, "a", "/z", "raw", 1)], "id long, name string, path string, raw string, created long")
    assert [r["id"] for r in receipts.listed(df).collect()] == [2, 3, 1] and receipts.listed(df).columns == ["id", "name", "created"]
    assert receipts.listed(df, detail=True).columns == ["id", "name", "raw", "created"]


def test_places_of_the_queue(spark):
    late = [(k, f"o{k % 7}-{k}", "t", "2026-01-01", f"2026-01-{5 + k % 4:02}", "" if k % 3 else "2026-01-20") for k in range(60)]
    df = spark.createDataFrame(late, "record long, order_id string, team string, ordered_on string, due_on string, delivered_on string")
    checked = orders.checked(df, "2026-01-25")
    expected = [r["order_id"] for r in orders.queue(checked).collect()]
    assert [r["order_id"] for r in orders.queue_places(checked).orderBy("place").collect()] == expected
    assert sorted(r["place"] for r in orders.queue_places(checked).collect()) == list(range(1, 61))


def test_field_scores(spark):
    cases = [("total", True, "10.00", "10", True), ("total", True, "NaN", "10", False), ("merchant", True, " ACME ", "acme", True), ("merchant", False, None, "", False), ("merchant", True, None, "", True), ("merchant", True, "x", None, False), ("tax", True, None, "5", False)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, field string, present boolean, actual string, expected string, ok boolean")
    found = scoring.field_scores(df)
    assert found.where("correct <> ok").count() == 0 and found.where("unsupported_unknown").count() == 1


# ---- store, cli, streams -----------------------------------------------------------------------------

SPEC = DEMO.to_json()
PASSING = "id,date,amount,active\nA1,2026-09-18,12.50,true\nA2,2026-09-19,18.00,false\n"


def test_store_appends_only(spark, tmp_path):
    store = Store.at(tmp_path, spark)
    assert store.append("runs", "x", {"a": 1}) and not store.append("runs", "x", {"a": 2}) and store.get("runs", "x") == {"a": 1}
    with pytest.raises(StoreError):
        store.get("runs", "../x")
    with pytest.raises(StoreError):
        store.get("runs", "y")
    assert not [p.name for p in (tmp_path / "runs").iterdir() if p.name != "x.json"]  # no drafts, no checksums
    store.append("runs", "y", {"id": "y", "created": "2"})
    store.append("runs", "z", {"id": "z", "created": "1"})
    assert [r.get("id") for r in store.listing("runs", 2)] == ["y", "z"] and store.listing("nothing") == []
    a, b = store.save_dataset("n", PASSING), store.save_dataset("other", PASSING)
    assert a == b and len(store.history(a["id"])) == 1
    store.map_roles(a["id"], ("x", "y"), {"x": 0, "y": 1})
    assert store.mapping(a["id"]) == {"x": 0, "y": 1}
    with pytest.raises(SpecError):
        role_mapping(("x", "y"), {"x": 0, "y": 0}, 3)
    for note in (("maybe", "note"), (["confirmed issue"], "note"), ("confirmed issue", " "), ("confirmed issue", "x" * 2001), ("confirmed issue", None)):
        with pytest.raises(SpecError):
            review_note(*note)
    assert review_note("expected event", f" {'x' * 2000} ")[1] == "x" * 2000
    for faults in (["amount_unit", "amount_unit"], ["none"], "amount_unit", None, [["amount_unit"]]):
        with pytest.raises(SpecError):
            distinct_choices(faults, snapshots.FAULTS, "faults")
    assert distinct_choices(["missing_region", "amount_unit"], snapshots.FAULTS, "faults") == ["amount_unit", "missing_region"] and distinct_choices([], snapshots.FAULTS, "faults") == []
    for key in ([["id"]], [{}], [], ["id", "id"], "id"):
        with pytest.raises(SpecError):
            Contract.from_json({**SPEC, "key": key})


def test_contract_versions(spark, tmp_path):
    store = Store.at(tmp_path, spark)
    one_, again = store.save_contract("p", DEMO), store.save_contract(" p ", DEMO)
    two = store.save_contract("p", AMOUNTS)
    assert one_ == again and (one_["version"], two["version"]) == (1, 2) and [v["version"] for v in store.versions(one_["pipeline"])] == [2, 1]
    assert canonical_id({"b": 1, "a": [2]}) == canonical_id({"a": [2], "b": 1})


def test_publication_is_guarded(spark, tmp_path):
    store = Store.at(f"file://{tmp_path}/a store", spark)
    first = cli.check(spark, store, "p", SPEC, "good.csv", PASSING)
    assert cli.check(spark, store, "p", SPEC, "good.csv", PASSING) == first
    assert not store.publish(first["id"], None)["reused"] and store.publish(first["id"], None)["reused"]
    second = cli.check(spark, store, "p", SPEC, "more.csv", PASSING + "A3,2026-09-20,1,true\n")
    with pytest.raises(StoreError):
        store.publish(second["id"], None)
    wins = []
    threads = [threading.Thread(target=lambda: wins.append(_try(lambda: store.publish(second["id"], first["id"])))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(bool(w and not w["reused"]) for w in wins) == 1 and store.current(first["pipeline"])["run"] == second["id"]
    assert rows(store.tables(spark, "runs", second["id"])["accepted"], "id") == ["A1", "A2", "A3"]
    third = cli.check(spark, store, "p", SPEC, "third.csv", PASSING.replace("18.00", "19"))
    store.save_contract("p", AMOUNTS)
    with pytest.raises(StoreError, match="newer"):
        store.publish(third["id"], second["id"])
    blocked = cli.check(spark, store, "q", SPEC, "bad.csv", PASSING + "A1,2026-09-20,1,true\n")
    with pytest.raises(StoreError, match="gate"):
        store.publish(blocked["id"], None)
    store.review("runs", blocked["id"], 2, "confirmed issue", "seen")
    store.review("runs", blocked["id"], 2, "expected event", "on second thought")
    assert [r["decision"] for r in store.reviews(blocked["id"])] == ["confirmed issue", "expected event"]
    assert store.bundle(spark, "runs", blocked["id"])["tables"]["quarantine"].count() == 2


def _try(f):
    try:
        return f()
    except StoreError:
        return None


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "contract.json").write_text(json.dumps(SPEC))
    (tmp_path / "good.csv").write_text(PASSING)
    (tmp_path / "bad.csv").write_text(PASSING + "A1,x,1,true\n")
    (tmp_path / "drift.csv").write_text("id,other\nA,1\n")
    (tmp_path / "orders.csv").write_text(ORDERS)
    (tmp_path / "odd.json").write_text(json.dumps({**SPEC, "key": [["id"]]}))
    assert cli.main(["--store", str(tmp_path / "s"), "check", "--name", "p", "--contract", str(tmp_path / "odd.json"), "--csv", str(tmp_path / "good.csv")]) == 1
    base = ["--store", str(tmp_path / "s"), "check", "--name", "p", "--contract", str(tmp_path / "contract.json"), "--csv"]
    assert cli.main([*base, str(tmp_path / "good.csv"), "--publish"]) == 0
    assert cli.main([*base, str(tmp_path / "bad.csv")]) == 2
    assert cli.main([*base, str(tmp_path / "drift.csv")]) == 2
    assert cli.main([*base, str(tmp_path / "absent.csv")]) == 1
    assert cli.main(["profile", "--csv", str(tmp_path / "bad.csv")]) == 0
    assert cli.main(["orders", "--csv", str(tmp_path / "orders.csv"), "--as-of", "2026-09-20"]) == 0
    assert cli.main(["orders", "--csv", str(tmp_path / "bad.csv"), "--as-of", "2026-09-20"]) == 1
    assert '"on_time_rate": 0.5' in capsys.readouterr().out


def test_streams_of_batches(spark, tmp_path):
    schema = "record long, id string, amount string"
    spark.createDataFrame([(1, "A", "1"), (2, "B", "x")], schema).write.parquet(f"{tmp_path}/in")
    got = {"ok": [], "no": []}
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = validated_stream(stream, Contract(AMOUNTS.fields, ("amount",), 50, 1), lambda df, n: got["ok"].extend(rows(df, "id")), lambda df, n: got["no"].extend(rows(df, "record")))
    q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert got == {"ok": ["A"], "no": [2]}


def test_repeats_of_null_and_hot_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, F.col("id").cast("string")).alias("k"))
    found = with_repeats(df, ["k"]).groupBy("k").agg(F.max("_repeated").alias("r")).collect()
    assert {r["k"]: r["r"] for r in found}["hot"] and {r["k"]: r["r"] for r in found}[None] and sum(r["r"] for r in found) == 2


def test_replay_evaluation(spark):
    found = incidents.evaluated(spark)
    expected = {"total": 24, "passed": 24, "broken_deliveries": 21, "schema_detected": 12, "reconciliation_detected": 21, "healthy_deliveries": 3, "healthy_flagged": 0}
    assert one(incidents.evaluation_summary(found)) == expected


def test_command_line_incident_lab_and_scores(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    said = lambda: json.loads(capsys.readouterr().out)
    assert cli.main(["incident", "--fault", "missing_region"]) == 2
    found = said()
    assert (found["delivery"]["expected_net_cents"], found["delivery"]["observed_net_cents"], len(found["issues"])) == (found["repaired"]["observed_net_cents"], found["delivery"]["expected_net_cents"] + found["delivery"]["delta_cents"], 4) and found["repaired"]["verified"]
    assert cli.main(["incident"]) == 0 and said()["issues"] == []
    assert cli.main(["incident", "--fault", "nonsense"]) == 1
    capsys.readouterr()
    assert cli.main(["lab"]) == 0
    found = said()
    assert found["reconciliation"]["precision"] == found["reconciliation"]["recall"] == 1.0 and found["alerts"] > 0
    one = {"model": "m", "case": "1", "status": "ok", "elapsed_seconds": 1.5, "prompt_tokens": 3, "completion_tokens": 4}
    lines = [one | {"field": "total", "present": True, "actual": "10.00", "expected": "10"}, one | {"field": "merchant", "present": True, "actual": "x", "expected": ""}]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert cli.main(["score", "--fields", str(tmp_path / "f.jsonl")]) == 0
    assert said() == [{"model": "m", "correct": 1, "total": 2, "failures": 0, "unsupported_unknowns": 1, "median_elapsed_seconds": 1.5, "prompt_tokens": 3, "completion_tokens": 4}]
