"""Command line: python -m veritab.cli check|profile|orders|incident|lab|score ... ; exit 0 fine, 1 invalid input, 2 gate blocked."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veritab.operators import contracts, incidents, lab, orders, quality, scoring
from veritab.plans.specs import Contract, SpecError, canonical_id, iso
from veritab.sources import csv_text, synthetic
from veritab.sources.store import Store, StoreError

ENGINE = "veritab-1"


def session() -> SparkSession:
    return SparkSession.builder.appName("veritab").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def check(spark: SparkSession, store: Store, name: str, spec: dict, source: str, content: str) -> dict:
    """Run a contract over CSV text and keep the report; the same contract and text give the first report again."""
    contract = store.save_contract(name, Contract.from_json(spec))
    dataset = store.save_dataset(source, content)
    ident = canonical_id({"engine": ENGINE, "contract": contract["id"], "source": dataset["id"]})
    cells, headers = store.table(spark, dataset["id"])
    ambiguous = bool(quality.header_findings(headers))
    rules = Contract.from_json(contract["spec"])
    drifted = rules.schema_errors(headers, ambiguous)
    table = csv_text.named(cells, headers) if not drifted else cells.select("record", F.size("cells").alias("width"), F.to_json("cells").alias("cells"))
    result = contracts.validated(table, rules, headers if not drifted else None, ambiguous) if not drifted else contracts.Validated(rules, drifted, table.withColumn("reasons", F.array(contracts._why(None, "schema", None))), ["cells"])
    gate = result.gate.first().asDict()
    report = {
        "pipeline": contract["pipeline"], "contract": contract["id"], "contract_version": contract["version"], "dataset": dataset["id"], "headers": headers, "schema_errors": result.schema_errors,
        "counts": {k: gate[k] for k in ("source", "accepted", "quarantined")}, "gate": {"passed": gate["passed"], "reasons": gate["gate_reasons"]}, "error_counts": {r["code"]: r["n"] for r in result.error_counts.collect()},
    }
    tables = {"quarantine": result.quarantine_export()} | ({} if drifted else {"accepted": result.accepted_export(safe=False), "accepted_export": result.accepted_export()})
    return store.save_run("runs", report, tables, ident)


def incident(spark: SparkSession, seed: int, faults: list[str]) -> dict:
    """The seeded ledger against its delivery with faults, and what is left after its repair."""
    payments, refunds = synthetic.ledger(seed)
    frame = lambda rows: synthetic.ledger_frame(spark, rows)
    replay = incidents.Replay(frame(payments), frame(synthetic.delivered(payments, faults)), synthetic.refund_frame(spark, refunds))
    found = {"issues": [r.asDict() for r in replay.issues.select("payment_id", "kind", "changed_fields").orderBy("payment_id").collect()], "delivery": replay.summary.first().asDict()}
    return found | {"repaired": replay.repaired().summary.first().asDict()}


def evaluation(spark: SparkSession, seed: int) -> dict:
    """How the detectors do on the seeded inventory: 60 days of training, 30 of calibration, 30 of test."""
    rows, truth = synthetic.inventory_frames(spark, seed)
    n = F.col("n")
    found = lab.evaluated(rows, truth, ["product", "warehouse"], n < 60, n.between(60, 89), n >= 90)
    return {k.removeprefix("metrics_"): v.first().asDict() for k, v in found.items() if k.startswith("metrics_")} | {"alerts": found["alerts"].count()}


def scores(spark: SparkSession, path: Path) -> list[dict]:
    """By model, from JSON lines of fields (model, case, field, present, actual, expected) with status, seconds and tokens of their case."""
    schema = "model string, case string, field string, present boolean, actual string, expected string, status string, elapsed_seconds double, prompt_tokens long, completion_tokens long"
    rows = spark.read.schema(schema).json(path.absolute().as_uri())
    cases = rows.select("model", "case", "status", "elapsed_seconds", "prompt_tokens", "completion_tokens").distinct()
    return [r.asDict() for r in scoring.model_summary(scoring.extraction_runs(cases, scoring.field_scores(rows))).orderBy("model").collect()]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veritab")
    parser.add_argument("--store", default=".veritab", help="a folder, or the URI of one on a file system that Spark reaches")
    sub = parser.add_subparsers(dest="command", required=True)
    one = sub.add_parser("check", help="run a contract over a CSV file")
    one.add_argument("--name", required=True)
    one.add_argument("--contract", type=Path, required=True)
    one.add_argument("--csv", type=Path, required=True)
    one.add_argument("--publish", action="store_true")
    one.add_argument("--expected", help="the run that is published now")
    two = sub.add_parser("profile", help="structural findings of a CSV file")
    two.add_argument("--csv", type=Path, required=True)
    three = sub.add_parser("orders", help="delivery checks of a CSV file with the order columns")
    three.add_argument("--csv", type=Path, required=True)
    three.add_argument("--as-of", required=True)
    four = sub.add_parser("incident", help="replay of a seeded ledger with faults; exit 2 if the delivery isn't verified")
    four.add_argument("--seed", type=int, default=17)
    four.add_argument("--fault", action="append", default=[], help="missing_region, duplicate_retry, amount_unit; may be given more than once")
    five = sub.add_parser("lab", help="evaluation of the detectors on a seeded inventory")
    five.add_argument("--seed", type=int, default=42)
    six = sub.add_parser("score", help="scores of extracted fields by model")
    six.add_argument("--fields", type=Path, required=True)
    asked = parser.parse_args(args)
    spark = session()
    try:
        if asked.command == "incident":
            found = incident(spark, asked.seed, asked.fault)
            print(json.dumps(found, sort_keys=True))
            return 0 if found["delivery"]["verified"] else 2
        if asked.command in ("lab", "score"):
            print(json.dumps(evaluation(spark, asked.seed) if asked.command == "lab" else scores(spark, asked.fields), sort_keys=True))
            return 0
        content = asked.csv.read_text(encoding="utf-8")
        if asked.command == "check":
            store = Store.at(asked.store, spark)
            report = check(spark, store, asked.name, json.loads(asked.contract.read_text()), asked.csv.name, content)
            print(json.dumps({k: report[k] for k in ("id", "contract_version", "counts", "gate", "error_counts")}, sort_keys=True))
            if not report["gate"]["passed"]:
                return 2
            if asked.publish:
                print(json.dumps(store.publish(report["id"], asked.expected), sort_keys=True))
            return 0
        cells, headers = csv_text.table(spark, content)
        if asked.command == "profile":
            found = quality.findings(cells, headers)
            print(json.dumps({"records": cells.count(), "counts": {r["kind"]: r["n"] for r in quality.issue_counts(found).collect()}, "issues": [r.asDict() for r in quality.first_findings(found).collect()]}))
            return 0
        iso(asked.as_of)
        if quality.header_findings(headers) or set(headers) != set(orders.ROLES):
            raise SpecError(f"the columns are {', '.join(orders.ROLES)}")
        rows = orders.checked(csv_text.named(cells, headers).withColumn("width_ok", F.col("width") == len(headers)).drop("width"), asked.as_of)
        print(json.dumps({"counts": orders.counts(rows).first().asDict(), "summary": orders.summary(rows).first().asDict()}))
        return 0
    except (SpecError, StoreError, csv_text.CsvError, OSError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
