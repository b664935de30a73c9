"""An append-only store: datasets by content, runs, reviews, imports, and guarded publications.

What is kept, records and Parquet tables alike, lies below one folder of one file system (see `records`). The newest
version, publication or import is found by an aggregation over the records of its kind.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.plans.specs import Contract, SpecError, canonical_id, review_note, role_mapping
from veritab.sources import csv_text
from veritab.sources.records import Records, StoreError

__all__ = ["Store", "StoreError", "now"]


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


@dataclass(frozen=True)
class Store:
    records: Records

    @staticmethod
    def at(path: str | Path, spark: SparkSession | None = None) -> Store:
        """The store below a folder: a URI, or a path, which is taken as a local one."""
        root = str(path)
        if "://" not in root and not root.startswith("file:"):
            root = f"file://{Path(root).absolute()}"
        return Store(Records(root, spark or SparkSession.builder.getOrCreate()))

    def append(self, kind: str, ident: str, record: dict) -> bool:
        return self.records.append(kind, ident, record)

    def get(self, kind: str, ident: str) -> dict:
        return self.records.get(kind, ident)

    def listing(self, kind: str, newest: int | None = None) -> list[dict]:
        """Records, the newest first."""
        return self.records.listed(kind, "created string, id string", newest=newest)

    def new_table(self, *names: str) -> str:
        """The path of a table that isn't there yet."""
        return self.records.path("tables", *names[:-1], f"{names[-1]}-{uuid.uuid4().hex}").toString()

    # ---- datasets ----

    def save_dataset(self, name: str, content: str) -> dict:
        """Register CSV text under the hash of its bytes; the same text is the same dataset."""
        csv_text.parse(content)
        if not isinstance(name, str) or not name.strip() or len(name) > 250:
            raise SpecError("a dataset has a name of up to 250 characters")
        ident = hashlib.sha256(content.encode()).hexdigest()
        if self.append("datasets", ident, {"id": ident, "name": name, "content": content, "created": now()}):
            self.audit(ident, "import", {"name": name, "sha256": ident})
        return self.get("datasets", ident)

    def audit(self, ident: str, action: str, value: dict) -> None:
        self.append("audit", f"{ident[:16]}-{dt.datetime.now(dt.timezone.utc).strftime('%Y%m%d%H%M%S%f')}-{uuid.uuid4().hex[:8]}", {"dataset": ident, "action": action, "value": value, "created": now()})

    def history(self, ident: str) -> list[dict]:
        """What happened to a dataset, in order."""
        return self.records.listed("audit", "created string, id string, dataset string", F.col("dataset") == ident)[::-1]

    def table(self, spark: SparkSession, ident: str) -> tuple[DataFrame, list[str]]:
        """A dataset as (record, cells), with its header."""
        return csv_text.table(spark, self.get("datasets", ident)["content"])

    def map_roles(self, ident: str, roles: tuple[str, ...], mapping: dict[str, int]) -> dict[str, int]:
        header = csv_text.parse(self.get("datasets", ident)["content"])[0]
        role_mapping(roles, mapping, len(header))
        self.audit(ident, "confirmed mapping", mapping)
        return mapping

    def mapping(self, ident: str) -> dict[str, int] | None:
        """The mapping confirmed last."""
        found = self.records.latest("audit", "dataset string, action string, created string", (F.col("dataset") == ident) & (F.col("action") == "confirmed mapping"), "created")
        return found["value"] if found else None

    # ---- contracts ----

    def save_contract(self, name: str, contract: Contract) -> dict:
        """A new version, or the old record if the rules are the same."""
        if not isinstance(name, str) or not name.strip() or len(name) > 120:
            raise SpecError("a pipeline has a name of up to 120 characters")
        pipeline = canonical_id({"name": name.strip()})
        ident = canonical_id({"pipeline": pipeline, "spec": contract.id})
        while not self.records.exists("contracts", ident):
            last = self.latest_version(pipeline)
            version = last["version"] + 1 if last else 1
            # the version's own record decides which of two writers gets it
            if self.append("versions", f"{pipeline}-{version:06d}", {"pipeline": pipeline, "version": version, "contract": ident, "created": now()}):
                self.append("contracts", ident, {"id": ident, "pipeline": pipeline, "name": name.strip(), "version": version, "spec": contract.to_json(), "created": now()})
        return self.get("contracts", ident)

    def versions(self, pipeline: str) -> list[dict]:
        found = self.records.listed("versions", "created string, id string, pipeline string", F.col("pipeline") == pipeline)
        return sorted(found, key=lambda r: -r["version"])

    def latest_version(self, pipeline: str) -> dict | None:
        return self.records.latest("versions", "pipeline string, version long", F.col("pipeline") == pipeline, "version")

    # ---- runs ----

    def save_run(self, kind: str, report: dict, tables: dict[str, DataFrame] | None = None, ident: str | None = None) -> dict:
        """Keep a report under the hash of what it says, with its tables; a replay gives back the first one."""
        ident = ident or canonical_id(report)
        if self.records.exists(kind, ident):
            return self.get(kind, ident)
        paths = {}
        for name, df in (tables or {}).items():
            paths[name] = self.new_table(ident[:16], name)
            df.write.parquet(paths[name])
        self.append(kind, ident, {**report, "id": ident, "tables": paths, "created": now()})
        return self.get(kind, ident)

    def tables(self, spark: SparkSession, kind: str, ident: str) -> dict[str, DataFrame]:
        return {name: spark.read.parquet(path) for name, path in self.get(kind, ident)["tables"].items()}

    def bundle(self, spark: SparkSession, kind: str, ident: str) -> dict:
        """A report with its parent, its tables, and its sources with their hashes."""
        report = self.get(kind, ident)
        parent = self.get(kind, report["parent"]) if report.get("parent") else None
        sources = dict(report.get("sources", {})) | ({"original_delivery": parent["sources"]["delivery"]} if parent else {})
        return {"report": report, "parent": parent, "tables": self.tables(spark, kind, ident), "files": {role: {"sha256": s, "csv": self.get("datasets", s)["content"]} for role, s in sources.items()}}

    def review(self, kind: str, ident: str, record: int, decision: str, note: str) -> None:
        """Append a decision on a flagged record; earlier ones stay."""
        self.get(kind, ident)
        decision, note = review_note(decision, note)
        self.append("reviews", f"{ident[:16]}-{record}-{uuid.uuid4().hex}", {"run": ident, "record": record, "decision": decision, "note": note, "created": now()})

    def reviews(self, ident: str) -> list[dict]:
        """Decisions on a run's records, in order."""
        return self.records.listed("reviews", "created string, id string, run string", F.col("run") == ident)[::-1]

    # ---- publications ----

    def current(self, pipeline: str) -> dict | None:
        """What a pipeline publishes now."""
        return self.records.latest("publications", "pipeline string, number long", F.col("pipeline") == pipeline, "number")

    def publish(self, run: str, expected: str | None) -> dict:
        """Point a pipeline at a run whose gate passed, if what is published is what the caller expects.

        The same run again changes nothing. A contract with a newer version can't publish. Of two
        publications at once, the record of the next number decides.
        """
        report = self.get("runs", run)
        if not report["gate"]["passed"]:
            raise StoreError("the gate is blocked")
        before = self.current(report["pipeline"])
        if before and before["run"] == run:
            return {**before, "reused": True}
        if (before["run"] if before else None) != expected:
            raise StoreError("what is published has changed")
        if self.latest_version(report["pipeline"])["contract"] != report["contract"]:
            raise StoreError("the contract has a newer version")
        number = before["number"] + 1 if before else 1
        record = {"id": f"{report['pipeline']}-{number:06d}", "pipeline": report["pipeline"], "number": number, "run": run, "previous": expected, "table": report["tables"].get("accepted"), "created": now()}
        if not self.append("publications", record["id"], record):
            raise StoreError("what is published has changed")
        self.audit(report.get("dataset", run), "publication", {"run": run, "contract": report["contract"]})
        return {**record, "reused": False}
