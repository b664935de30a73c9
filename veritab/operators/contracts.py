"""Typed contracts: validation with reasons, quarantine, gate and exports.

Input is a table of text columns beside `record`; a column `width` (how many cells a row had) is
optional. A contract compiles to one expression for each field's value and one for its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import date_of, formula_safe, matches, padded
from veritab.operators.keys import with_repeats
from veritab.plans.specs import Contract, Field

#: What integers and decimals look like.
INTEGER = r"-?(?:0|[1-9][0-9]{0,14})"
DECIMAL = r"-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]{1,9})?"
SPARK_TYPES = {"text": "string", "integer": "bigint", "decimal": "decimal(27,9)", "date": "date", "boolean": "boolean"}


def typed(c: Column, field: Field) -> Column:
    """The value of a valid cell, else null."""
    if field.type == "integer":
        return F.when(matches(c, INTEGER), c.try_cast("bigint"))
    if field.type == "decimal":
        return F.when(matches(c, DECIMAL), c.try_cast("decimal(27,9)"))
    if field.type == "date":
        return date_of(c)
    if field.type == "boolean":
        return F.when(c == "true", True).when(c == "false", False)
    return F.when((c != "") & ~padded(c), c)


def reason(c: Column, field: Field) -> Column:
    """Why a cell is invalid, else null. An empty optional cell is a valid null; a null cell was cut off and gives no reason."""
    bad = {
        "integer": F.when(~matches(c, INTEGER), "integer"),
        "decimal": F.when(~matches(c, DECIMAL), "decimal"),
        "date": F.when(~matches(c, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date_format").when(date_of(c).isNull(), "date_value"),
        "boolean": F.when(~c.isin("true", "false"), "boolean"),
    }.get(field.type, F.lit(None).cast("string"))
    return F.when(c.isNull(), None).when(c == "", F.lit("required") if field.required else F.lit(None)).when(padded(c), "whitespace").otherwise(bad)


@dataclass
class Validated:
    """Lazy results of one run."""

    contract: Contract
    schema_errors: list[str]
    rows: DataFrame  # record, raw text columns, typed values as v_<name>, reasons
    headers: list[str]

    @property
    def accepted(self) -> DataFrame:
        """record and the typed values; decimals keep the spelling they came with."""
        ok = self.rows.where(F.size("reasons") == 0)
        return ok.select("record", *[(F.when(F.col(f"v_{f.name}").isNotNull(), F.col(f.name)) if f.type == "decimal" else F.col(f"v_{f.name}")).alias(f.name) for f in self.contract.fields])

    @property
    def quarantined(self) -> DataFrame:
        """record, reasons (structs of field, code, detail) and the raw cells."""
        return self.rows.where(F.size("reasons") > 0).select("record", "reasons", F.array(*self.headers).alias("raw"))

    @property
    def error_counts(self) -> DataFrame:
        """How many reasons, not rows, each code gave."""
        return self.rows.select(F.explode("reasons").alias("r")).groupBy("r.code").agg(F.count(F.lit(1)).alias("n"))

    @property
    def gate(self) -> DataFrame:
        """One row: counts, whether the gate passes, and why not."""
        ok = F.size("reasons") == 0
        one = self.rows.agg(F.count(F.lit(1)).alias("source"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("quarantined"))
        why = [F.lit(e) for e in self.schema_errors]
        why += [F.when(F.col("accepted") < self.contract.min_accepted_rows, "below_minimum"), F.when((F.col("source") > 0) & (F.col("quarantined") * 100 > self.contract.max_quarantine_percent * F.col("source")), "quarantine_exceeded")]
        return one.withColumn("gate_reasons", F.array_compact(F.array(*why))).withColumn("passed", F.size("gate_reasons") == 0)

    def accepted_export(self, safe: bool = True) -> DataFrame:
        """Accepted rows as they were spelled, in contract order; with formulas guarded for spreadsheets."""
        ok = self.rows.where(F.size("reasons") == 0)
        return ok.select("record", *[(formula_safe(F.col(f.name)) if safe else F.col(f.name)).alias(f.name) for f in self.contract.fields])

    def quarantine_export(self) -> DataFrame:
        return self.quarantined.select(F.col("record").alias("source_record"), F.to_json("reasons").alias("reasons_json"), F.to_json("raw").alias("raw_cells_json"))


def _why(field: str | None, code: str, detail: Column | str | None) -> Column:
    return F.struct(F.lit(field).cast("string").alias("field"), F.lit(code).alias("code"), (detail if isinstance(detail, Column) else F.lit(detail)).cast("string").alias("detail"))


def with_values(df: DataFrame, contract: Contract) -> DataFrame:
    """df with the typed values as v_<name>."""
    return df.withColumns({f"v_{f.name}": typed(F.col(f.name), f) for f in contract.fields})


def whole_key(contract: Contract) -> Column:
    """Whether all parts of a typed row's key are valid."""
    whole = F.lit(True)
    for k in contract.key:
        whole &= F.col(f"v_{k}").isNotNull()
    return whole


def validated(df: DataFrame, contract: Contract, headers: list[str] | None = None, ambiguous: bool = False, repeated: str | None = None) -> Validated:
    """Check every row. If the columns differ from the contract, all rows are quarantined for that alone.

    A key counts where all its parts are valid, even if other cells aren't; all rows of a repeated key are quarantined.
    A column that says so already may be named as `repeated`; it is then no column of the contract's.
    """
    headers = headers or [c for c in df.columns if c not in ("record", "width", repeated)]
    errors = contract.schema_errors(headers, ambiguous)
    if errors:
        return Validated(contract, errors, df.withColumn("reasons", F.array(_why(None, "schema", None))), headers)
    fields = {f.name: f for f in contract.fields}
    rows = with_values(df, contract)
    if repeated is None:
        rows = with_repeats(rows, [f"v_{k}" for k in contract.key], "_repeated", whole_key(contract))
    else:
        rows = rows.withColumnRenamed(repeated, "_repeated")
    found = []
    if "width" in df.columns:
        found.append(F.when(F.col("width") != len(headers), _why(None, "row_width", None)))
    for n, f in fields.items():
        why = reason(F.col(n), f)
        found.append(F.when(why.isNotNull(), _why(n, "invalid_value", why)))
    found.append(F.when(F.col("_repeated"), _why(None, "duplicate_key", None)))
    return Validated(contract, [], rows.withColumn("reasons", F.array_compact(F.array(*found))).drop("_repeated"), headers)
