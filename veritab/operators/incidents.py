"""Replay of a delivery against a trusted ledger: gate, issues, effect on a metric, repair."""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import contracts, snapshots
from veritab.plans.specs import Contract, Field, SpecError
from veritab.sources.synthetic import LEDGER

CONTRACT = Contract(tuple(Field(c, "integer" if c == "amount_cents" else "text") for c in LEDGER), ("payment_id",), 0, 1)
#: Which of the three faults concern a row: every combination.
_WHICH = list(itertools.product((False, True), repeat=len(snapshots.FAULTS)))
METRIC = ("gross_cents", "refunds_cents", "net_cents", "payment_count", "refund_count")


@dataclass
class Replay:
    """Lazy results; the tables are ledgers of text (record and the columns of LEDGER)."""

    reference: DataFrame
    delivered: DataFrame
    refunds: DataFrame
    stage: str = "delivery"

    @property
    def issues(self) -> DataFrame:
        return snapshots.ledger_issues(self.reference, self.delivered, "payment_id")

    @property
    def gate(self) -> DataFrame:
        return contracts.validated(self.delivered, CONTRACT).gate

    @property
    def summary(self) -> DataFrame:
        """One row: the metric as expected and as observed, its difference, the gate, and whether all is verified."""
        expected = snapshots.ledger_metric(self.reference, self.refunds).select(*[F.col(c).alias(f"expected_{c}") for c in METRIC])
        observed = snapshots.ledger_metric(self.delivered, self.refunds).select(*[F.col(c).alias(f"observed_{c}") for c in METRIC])
        gate = self.gate.select(F.col("passed").alias("gate_passed"))
        count = self.issues.agg(F.count(F.lit(1)).alias("issues"))
        one = expected.join(observed).join(gate).join(count)  # single rows
        return one.withColumns({"delta_cents": F.col("observed_net_cents") - F.col("expected_net_cents"), "verified": F.col("gate_passed") & (F.col("issues") == 0)})

    def repaired(self, selected: list[str] | None = None) -> Replay:
        """All rows of the selected payments (all that have issues, if none are named) replaced from the reference."""
        if self.stage != "delivery":
            raise SpecError("candidates are built from the original delivery")
        chosen = self.issues.select("payment_id")
        if selected is not None:
            if not selected or len(set(selected)) != len(selected):
                raise SpecError("select distinct payments")
            found = chosen.where(F.col("payment_id").isin(selected)).count()
            if found != len(selected):
                raise SpecError("select payments that have issues")
            chosen = chosen.where(F.col("payment_id").isin(selected))
        return Replay(self.reference, snapshots.replaced(self.reference, self.delivered, chosen, ["payment_id"], list(LEDGER)), self.refunds, "candidate")


def evaluated(spark, seeds: tuple[int, ...] = (3, 17, 91)) -> DataFrame:
    """A row for each seed and set of faults: what was planted, what reconciliation found, what the contract's gate blocked.

    All cases go through one plan, keyed by case and payment. `repaired` says that replacing what was found
    leaves no issue and no difference in money.
    """
    from veritab.sources import synthetic

    reference, delivered, truth = [], [], []
    for seed in seeds:
        payments, _ = synthetic.ledger(seed)
        for mask in range(1 << len(snapshots.FAULTS)):
            faults = [f for i, f in enumerate(snapshots.FAULTS) if mask & (1 << i)]
            case = f"{seed}:{';'.join(faults)}"
            planted = [f"PAY-{k:03d}" for k in range(1, 5)] * ("missing_region" in faults) + ["PAY-011"] * ("duplicate_retry" in faults) + ["PAY-012"] * ("amount_unit" in faults)
            truth.append((case, seed, ";".join(faults), planted))
            reference += [(case, *p) for p in payments]
            delivered += [(case, *p) for p in synthetic.delivered(payments, faults)]
    schema = "case string, record long, " + ", ".join(f"{c} string" for c in LEDGER)
    left, right = spark.createDataFrame(reference, schema), spark.createDataFrame(delivered, schema)
    keys, columns = ["case", "payment_id"], list(LEDGER)
    found = snapshots.two_sided(left, right, keys, columns).withColumn("kind", snapshots._kind()).where("kind <> 'matched'")
    checked = contracts.validated(right.select("record", "case", *columns), Contract((Field("case", "text"), *CONTRACT.fields), ("case", "payment_id"), 0, 1))
    blocked = checked.rows.groupBy("case").agg(F.bool_or(F.size("reasons") > 0).alias("schema_blocked"))
    fixed = snapshots.replaced(left.select("record", "case", *columns), right.select("record", "case", *columns), found.select(*keys), keys, ["case", *columns])
    again = snapshots.two_sided(left, fixed, keys, columns).withColumn("kind", snapshots._kind()).groupBy("case").agg(F.count_if(F.col("kind") != "matched").alias("left_over"))
    money = lambda df, n: df.groupBy("case").agg(F.sum(F.col("amount_cents").cast("bigint")).alias(n))
    delta = money(left, "a").join(money(fixed, "b"), "case").select("case", (F.col("a") - F.col("b")).alias("delta_cents"))
    issues = found.groupBy("case").agg(F.sort_array(F.collect_list("payment_id")).alias("detected"))  # at most twelve payments a case
    cases = spark.createDataFrame(truth, "case string, seed int, faults string, planted array<string>")
    rows = cases.join(issues, "case", "left").join(blocked, "case", "left").join(again, "case").join(delta, "case")
    rows = rows.withColumns({"detected": F.coalesce("detected", F.array().cast("array<string>")), "schema_blocked": F.coalesce("schema_blocked", F.lit(False))})
    rows = rows.withColumns({"reconciliation_blocked": (F.size("detected") > 0) | F.col("schema_blocked"), "repaired": (F.col("left_over") == 0) & (F.col("delta_cents") == 0)})
    return rows.withColumn("passed", (F.col("detected") == F.sort_array("planted")) & F.col("repaired"))


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """One row: cases passed, broken deliveries that the gate alone and reconciliation caught, healthy ones that were flagged."""
    broken = F.col("faults") != ""
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(broken).alias("broken_deliveries"), F.count_if(broken & F.col("schema_blocked")).alias("schema_detected"),
        F.count_if(broken & F.col("reconciliation_blocked")).alias("reconciliation_detected"), F.count_if(~broken).alias("healthy_deliveries"), F.count_if(~broken & F.col("reconciliation_blocked")).alias("healthy_flagged"),
    )


def scenario_summary(ledger: DataFrame, seeds: dict[int, tuple]) -> DataFrame:
    """A row for each seed and scenario over a ledger of any size: what was planted, found, missed and found wrongly, and what blocks it.

    seeds: by number, which rows are of the missing region, retried and scaled (conditions). A row is planted where its
    region is missing, where it is sent twice, or where its amount is scaled and it is still there. A contract sees repeated payments
    only; reconciliation sees all issues. The ledger is read once for all cases.
    """
    keys, columns = ["seed", "payment_id"], list(LEDGER)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("seed"), *[F.coalesce(c, F.lit(False)).alias(f"_{k}") for k, c in zip(("region", "retried", "scaled"), of, strict=True)]) for n, of in seeds.items()]))
    rows = ledger.select("record", *columns, each.alias("_s")).select("record", *columns, "_s.*")
    flags = ["_region", "_retried", "_scaled"]
    versions = snapshots.scenario_versions(rows, *[F.col(f) for f in flags])
    # what is planted is known from the reference's own rows, and travels with them through the same aggregation
    found = snapshots.scenario_issues(versions.drop("record"), [*keys, *flags], columns)
    has = lambda fault: F.col("scenario").bitwiseAND(F.lit(1 << snapshots.FAULTS.index(fault))) != 0
    gone = has("missing_region") & F.col("_region")
    planted = gone | (has("duplicate_retry") & F.col("_retried")) | (has("amount_unit") & F.col("_scaled"))
    count = lambda c, name: F.count_if(c).alias(name)
    seen = found.groupBy("seed", "scenario").agg(count(planted, "detected"), count(~planted, "false_findings"), count(F.col("n_right") > 1, "repeated"))
    sizes = rows.groupBy("seed").agg(*[count(functools.reduce(lambda a, b: a & b, [F.col(f) if want else ~F.col(f) for f, want in zip(flags, which, strict=True)]), f"n_{k}") for k, which in enumerate(_WHICH)])
    cases = []
    for s in range(snapshots.SCENARIOS):
        on = [f in snapshots.scenario_faults(s) for f in snapshots.FAULTS]
        # FAULTS and flags are in one order: missing, retried, scaled
        n = [F.col(f"n_{k}") for k, which in enumerate(_WHICH) if any(a and b for a, b in zip(on, which, strict=True))]
        cases.append(F.struct(F.lit(s).alias("scenario"), F.lit(";".join(snapshots.scenario_faults(s))).alias("faults"), (functools.reduce(lambda a, b: a + b, n) if n else F.lit(0)).cast("bigint").alias("planted")))
    truth = sizes.select("seed", F.inline(F.array(*cases)))
    one = truth.join(seen, ["seed", "scenario"], "left").fillna(0, ["detected", "false_findings", "repeated"])
    blocked = F.col("detected") + F.col("false_findings") > 0
    return one.select("seed", "faults", "planted", "detected", (F.col("planted") - F.col("detected")).alias("missed"), "false_findings", (F.col("repeated") > 0).alias("schema_blocked"), blocked.alias("reconciliation_blocked"))
