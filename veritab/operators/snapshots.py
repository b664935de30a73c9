"""Full-snapshot reconciliation, candidate repairs, and ledgers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import blank, matches, padded
from veritab.operators.keys import two_sided
from veritab.operators.quality import require_structure
from veritab.operators.ranks import placed
from veritab.plans.specs import SnapshotRules, SpecError, iso
from veritab.sources.csv_text import named

#: Replaced rows keep their number in the reference above this bound.
REPLACED = 1 << 60
KINDS = ("ambiguous_reference", "unexpected", "missing", "duplicate", "changed")


def _invalid(keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out |= blank(F.col(k)) | padded(F.col(k))
    return out


def _kind() -> Column:
    return (
        F.when(F.col("n_left") > 1, "ambiguous_reference")
        .when(F.col("n_left") == 0, "unexpected")
        .when(F.col("n_right") == 0, "missing")
        .when(F.col("n_right") > 1, "duplicate")
        .when(~F.col("left").eqNullSafe(F.col("right")), "changed")
        .otherwise("matched")
    )


@dataclass
class Assessment:
    """Lazy results of comparing a delivery with a reference; both have `record` and the same text columns."""

    reference: DataFrame
    delivery: DataFrame
    rules: SnapshotRules
    columns: list[str]
    stage: str = "comparison"

    @property
    def keyed(self) -> DataFrame:
        """A row for each valid identity, with its kind ('matched' where nothing is wrong) and changed fields."""
        ok = ~_invalid(self.rules.keys)
        both = two_sided(self.reference.where(ok), self.delivery.where(ok), list(self.rules.keys), self.columns)
        differs = F.array_compact(F.array(*[F.when(~F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")), F.lit(c)) for c in self.columns]))
        both = both.withColumn("kind", _kind())
        return both.withColumn("changed_fields", F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), differs).otherwise(F.array().cast("array<string>")))

    @property
    def issues(self) -> DataFrame:
        return self.keyed.where("kind <> 'matched'")

    @property
    def invalid(self) -> DataFrame:
        """Rows of either role whose identity is blank or padded."""
        bad = _invalid(self.rules.keys)
        return self.reference.where(bad).select(F.lit("reference").alias("role"), "record", *self.columns).unionByName(self.delivery.where(bad).select(F.lit("delivery").alias("role"), "record", *self.columns))

    @property
    def summary(self) -> DataFrame:
        """One row: counts, blockers, whether all matches. Blockers are codes in a fixed order."""
        bad = _invalid(self.rules.keys)
        rows = lambda df, n: df.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.count_if(bad).alias(f"_{n}_invalid"))
        keyed = self.keyed.agg(F.count_if(F.col("kind") == "matched").alias("matched_keys"), F.count_if(F.col("kind") != "matched").alias("discrepancies"), F.count_if(F.col("n_left") > 1).alias("_ambiguous"))
        one = rows(self.reference, "reference").join(rows(self.delivery, "delivery")).join(keyed)  # three rows of one
        why = [F.when(F.col("reference_rows") == 0, "empty_reference")]
        if self.rules.reference_date != self.rules.delivery_date:
            why.append(F.lit("dates_differ"))
        for role in ("reference", "delivery"):
            age = (iso(self.rules.as_of) - iso(getattr(self.rules, f"{role}_date"))).days
            why += [F.lit(f"{role}_after_assessment")] * (age < 0) + [F.lit(f"{role}_too_old")] * (age > self.rules.max_age_days)
        why += [F.when(F.col(f"_{role}_invalid") > 0, f"{role}_invalid_identity") for role in ("reference", "delivery")]
        why.append(F.when(F.col("_ambiguous") > 0, "reference_not_unique"))
        one = one.withColumn("blockers", F.array_compact(F.array(*why)))
        return one.withColumn("matched", (F.size("blockers") == 0) & (F.col("discrepancies") == 0)).select("reference_rows", "delivery_rows", "matched_keys", "discrepancies", "blockers", "matched")

    def repaired(self, selected: DataFrame, note: str) -> Assessment:
        """A candidate: delivery rows without the selected identities, then their reference rows in the order of their keys.

        selected holds identities of issues. Only a comparison without blockers can be repaired, and the
        candidate is assessed anew; it is never repaired again.
        """
        if self.stage != "comparison":
            raise SpecError("candidates are built from the original comparison")
        if not note.strip() or len(note) > 1000:
            raise SpecError("explain the repair in a note of up to 1000 characters")
        if self.summary.select("blockers").first()[0]:
            raise SpecError("blockers come before repairs")
        keys = list(self.rules.keys)
        chosen = self.issues.select(*keys).join(selected.select(*keys).distinct(), keys, "left_semi")
        return replace(self, delivery=replaced(self.reference, self.delivery, chosen, keys, self.columns), stage="candidate")


def assessed(reference: DataFrame, delivery: DataFrame, rules: SnapshotRules) -> Assessment:
    columns = [c for c in reference.columns if c != "record"]
    if set(columns) != {c for c in delivery.columns if c != "record"}:
        raise SpecError("both snapshots have the same columns, in any order")
    if any(k not in columns for k in rules.keys):
        raise SpecError("every identity column is in both snapshots")
    return Assessment(reference.select("record", *columns), delivery.select("record", *columns), rules, columns)


def assessed_tables(reference: DataFrame, delivery: DataFrame, reference_headers: list[str], delivery_headers: list[str], rules: SnapshotRules) -> Assessment:
    """`assessed` of two tables of (record, cells), once their structure is found to be sound; a table that isn't one is refused."""
    sides = [named(require_structure(cells, headers), headers).drop("width") for cells, headers in ((reference, reference_headers), (delivery, delivery_headers))]
    return assessed(*sides, rules)


def replaced(reference: DataFrame, delivery: DataFrame, chosen: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Delivery rows of other identities, and reference rows of the chosen ones; record keeps the order: replacements come last."""
    kept = delivery.join(chosen, keys, "left_anti").select(F.lit(0).alias("part"), "record", *columns)
    new = reference.join(chosen, keys, "left_semi").select(F.lit(1).alias("part"), "record", *columns)
    return kept.unionByName(new).select((F.col("record") + F.col("part") * F.lit(REPLACED)).alias("record"), *columns)


def in_order(candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a candidate with `place`, from 1: what was delivered as it came, then the replacements by identity."""
    replacement = F.col("record") >= REPLACED
    return placed(candidate, [replacement, F.when(~replacement, F.col("record")), *keys, "record"])


def repair_changes(assessment: Assessment, selected: DataFrame) -> DataFrame:
    """What a repair does to each selected identity."""
    keys = list(assessment.rules.keys)
    return assessment.issues.join(selected.select(*keys).distinct(), keys, "left_semi").select(*keys, F.when(F.col("n_left") == 0, "remove_unexpected").otherwise("replace_from_reference").alias("action"))


def ledger_issues(reference: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """Issues of a delivered ledger; an identity that the reference hasn't exactly once is an error when it is met."""
    columns = [c for c in reference.columns if c != "record"]
    both = two_sided(reference, delivered, [key], columns)
    once = F.when(F.col("n_left") == 1, True).otherwise(F.raise_error(F.concat(F.lit("reference must hold exactly once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    both = both.where(once).withColumn("kind", _kind())
    differs = F.array_compact(F.array(*[F.when(~F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")), F.lit(c)) for c in columns]))
    return both.where("kind <> 'matched'").select(key, "kind", "n_right", F.when(F.col("n_right") == 1, differs).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def ledger_metric(payments: DataFrame, refunds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Gross, refunds and net in whole cents, exactly; amounts that aren't USD cents raise an error.

    by groups payments; refunds are then left out unless they carry the same columns.
    """
    by = by or []

    def cents(df: DataFrame, sign: str) -> DataFrame:
        ok = (F.col("currency") == "USD") & matches(F.col("amount_cents").cast("string"), "[0-9]+")
        value = F.when(ok, F.col("amount_cents").cast("bigint")).otherwise(F.raise_error(F.lit("amounts are whole USD cents")).cast("bigint"))
        return df.select(*by, value.alias("_c"), F.lit(sign).alias("_s"))

    both = cents(payments, "p").unionByName(cents(refunds, "r")) if all(b in refunds.columns for b in by) else cents(payments, "p")
    total = lambda s: F.coalesce(F.sum(F.when(F.col("_s") == s, F.col("_c"))), F.lit(0).cast("bigint"))
    rows = (both.groupBy(*by) if by else both).agg(total("p").alias("gross_cents"), total("r").alias("refunds_cents"), F.count_if(F.col("_s") == "p").alias("payment_count"), F.count_if(F.col("_s") == "r").alias("refund_count"))
    return rows.withColumn("net_cents", F.col("gross_cents") - F.col("refunds_cents"))


FAULTS = ("missing_region", "duplicate_retry", "amount_unit")


def faulty(ledger: DataFrame, faults: list[str], region: Column, retried: Column, scaled: Column) -> DataFrame:
    """A delivery with faults: a region missing, amounts in another unit (x 100), rows sent twice, in this order."""
    if any(f not in FAULTS for f in faults):
        raise SpecError(f"faults are {', '.join(FAULTS)}")
    out = ledger
    if "missing_region" in faults:
        out = out.where(~region)
    if "amount_unit" in faults:
        out = out.withColumn("amount_cents", F.when(scaled, (F.col("amount_cents").cast("bigint") * 100).cast("string")).otherwise(F.col("amount_cents")))
    if "duplicate_retry" in faults:
        out = out.unionByName(out.where(retried))
    return out


#: Every subset of FAULTS is a scenario: its number has a bit for each fault.
SCENARIOS = 1 << len(FAULTS)


def scenario_faults(scenario: int) -> list[str]:
    return [f for k, f in enumerate(FAULTS) if scenario >> k & 1]


def _scenarios_with(fault: str) -> int:
    """The set of scenarios that have a fault, as bits."""
    return sum(1 << s for s in range(SCENARIOS) if fault in scenario_faults(s))


def scenario_versions(ledger: DataFrame, region: Column, retried: Column, scaled: Column) -> DataFrame:
    """Each ledger row as every delivery has it: (_side 0) itself, and (_side 1) its versions with the set of scenarios they occur in.

    What `faulty` makes of a ledger for one set of faults, for all sets at once: a row is read once and becomes at most five.
    """
    every, no = (1 << SCENARIOS) - 1, F.lit(0)
    bits = lambda fault: F.lit(_scenarios_with(fault))
    when = lambda c, a, b: F.when(F.coalesce(c, F.lit(False)), a).otherwise(b)
    present = when(region, F.bitwise_not(bits("missing_region")).bitwiseAND(F.lit(every)), F.lit(every))
    large = present.bitwiseAND(when(scaled, bits("amount_unit"), no))
    plain = present.bitwiseAND(F.bitwise_not(large))
    again = when(retried, bits("duplicate_retry"), no)
    hundredfold = (F.col("amount_cents").cast("bigint") * 100).cast("string")
    version = lambda side, of, cents: F.struct(F.lit(side).alias("_side"), of.cast("int").alias("_scenarios"), cents.alias("_cents"))
    own = F.col("amount_cents")
    rows = ledger.withColumn("_v", F.explode(F.array(version(0, F.lit(every), own), version(1, plain, own), version(1, large, hundredfold), version(1, plain.bitwiseAND(again), own), version(1, large.bitwiseAND(again), hundredfold))))
    rows = rows.where("_v._scenarios <> 0")
    return rows.select(*[F.col("_v._cents").alias(c) if c == "amount_cents" else F.col(c) for c in ledger.columns], "_v._side", "_v._scenarios")


def scenario_issues(versions: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, scenario, kind, n_right) of what reconciliation finds in each scenario: one aggregation by key for all of them."""
    value = F.struct(*columns)
    mine = lambda s: (F.col("_side") == 1) & (F.shiftright("_scenarios", s).bitwiseAND(F.lit(1)) == 1)
    found = [F.count_if(F.col("_side") == 0).alias("n_left"), F.max(F.when(F.col("_side") == 0, value)).alias("left")]
    for s in range(SCENARIOS):
        found += [F.count_if(mine(s)).alias(f"n_{s}"), F.max(F.when(mine(s), value)).alias(f"v_{s}")]
    by = versions.groupBy(*keys).agg(*found)
    cases = [F.struct(F.lit(s).alias("scenario"), F.col(f"n_{s}").alias("n_right"), (~F.col("left").eqNullSafe(F.col(f"v_{s}"))).alias("differs")) for s in range(SCENARIOS)]
    rows = by.select(*keys, "n_left", F.inline(F.array(*cases)))
    kind = (
        F.when(F.col("n_left") > 1, "ambiguous_reference").when((F.col("n_left") == 0) & (F.col("n_right") > 0), "unexpected")
        .when((F.col("n_left") == 1) & (F.col("n_right") == 0), "missing").when(F.col("n_right") > 1, "duplicate").when((F.col("n_left") == 1) & F.col("differs"), "changed")
    )
    return rows.withColumn("kind", kind).where("kind is not null").select(*keys, "scenario", "kind", "n_right")
