"""All queries of the record engine by name, with equivalent SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions.text import formula_safe, formula_safe_strict
from veritab.operators import compare, contracts, incidents, inventory, lab, orders, quality, receipts, scoring, snapshots
from veritab.operators.ranks import placed
from veritab.plans.specs import Contract, Cutoffs, Field, QuestionPlan, SnapshotRules
from veritab.plans.views import AS_OF, plain_sql, view
from veritab.sources import csv_text

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain_sql(sql)
        return f

    return register


def _joined(c: str):
    return F.array_join(c, ";")


# ---- structural quality -------------------------------------------------------------------------

HEADERS = ["a", "b", "c"]


def _cells(spark, sf_dir) -> DataFrame:
    cells = F.when(F.col("is_short"), F.array("a", "b")).otherwise(F.array("a", "b", "c"))
    return view(spark, sf_dir, "cells_view").select("record", cells.alias("cells"))


CELLS = "select record, a, b, case when is_short then '' else c end as c, is_short from ({cells_view}) v"
#: The tables hold only space as outer white space, so plain trim says the same.
FINDINGS = f"""
    select 'row_width' as kind, record, cast(null as int) as col from ({CELLS}) x where is_short
    union all select 'duplicate', record, null from (select record, min(record) over (partition by a, b, c, is_short) as f from ({CELLS}) x) y where record > f
    union all select case when trim(v) = '' then 'missing' else 'whitespace' end, record, col from (
        select record, 1 as col, a as v from ({CELLS}) x union all select record, 2, b from ({CELLS}) x union all select record, 3, c from ({CELLS}) x) z where trim(v) = '' or v <> trim(v)"""


@query("""select p as position, n as name, cast(m as bigint) as missing from (
    select 1 as p, 'a' as n, count(*) filter (where trim(a) = '') as m from (""" + CELLS + """) x
    union all select 2, 'b', count(*) filter (where trim(b) = '') from (""" + CELLS + """) x union all select 3, 'c', count(*) filter (where trim(c) = '') from (""" + CELLS + """) x) y""")  # fmt: skip
def quality_missing_by_column(spark, sf_dir):
    return quality.missing_by_column(_cells(spark, sf_dir), HEADERS)


@query(f"select kind, count(*) as n from ({FINDINGS}) f group by kind")
def quality_issue_counts(spark, sf_dir):
    return quality.issue_counts(quality.findings(_cells(spark, sf_dir), HEADERS))


@query(f"select record, f as first_record from (select record, min(record) over (partition by a, b, c, is_short) as f from ({CELLS}) x) y where record > f")
def quality_duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(_cells(spark, sf_dir))


@query(f"select record, cast(col as int) as place from ({FINDINGS}) f where kind = 'whitespace'")
def quality_whitespace_cells(spark, sf_dir):
    return quality.findings(_cells(spark, sf_dir), HEADERS).where("kind = 'whitespace'").select("record", F.col("column").alias("place"))


@query("select record from ({cells_view}) v where is_short")
def quality_row_width(spark, sf_dir):
    return quality.findings(_cells(spark, sf_dir), HEADERS).where("kind = 'row_width'").select("record")


@query(f"select kind, record, cast(col as int) as place from ({FINDINGS}) f order by record, case kind when 'row_width' then 1 when 'duplicate' then 2 else 3 end, col limit 200")
def quality_first_findings(spark, sf_dir):
    return quality.first_findings(quality.findings(_cells(spark, sf_dir), HEADERS)).withColumnRenamed("column", "place")


@query("select record, cast(col as int) as place, v as before, trim(v) as after from (select record, 1 as col, a as v from ({cells_view}) x union all select record, 2, b from ({cells_view}) x union all select record, 3, c from ({cells_view}) x where not is_short) z where v <> trim(v)")
def trim_preview(spark, sf_dir):
    return quality.trim_changes(_cells(spark, sf_dir)).withColumnRenamed("column", "place")


@query("select record, trim(a) as a, trim(b) as b, case when is_short then null else trim(c) end as c from ({cells_view}) v")
def trim_applied(spark, sf_dir):
    cells = quality.trimmed_cells(_cells(spark, sf_dir))
    return cells.select("record", *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(HEADERS)])


_NAMES = "select n_nationkey * 2 as k, n_name as name from nation union all select n_nationkey * 2 + 1, case when n_nationkey % 5 = 0 then ' ' else concat(' ', lower(n_name), '  ') end from nation where n_nationkey % 3 = 0"


@query(f"select cast(place as int) as place from (select place, f, row_number() over (partition by f order by place) as r from (select row_number() over (order by k) as place, lower(trim(name)) as f from ({_NAMES}) x) y) z where f = '' or r > 1")
def quality_header_names(spark, sf_dir):
    # the names of one header: a few, whatever the table's size
    rows = spark.sql(_NAMES.replace("from nation", "from {nation}"), nation=spark.read.parquet(f"{sf_dir}/nation.parquet")).orderBy("k").collect()
    return spark.createDataFrame([(p,) for p in quality.header_findings([r["name"] for r in rows])], "place int")


@query(f"select count(*) filter (where is_short) > 0 as refused, count(*) filter (where not is_short)::bigint as sound_rows from ({CELLS}) x")
def quality_structure_guard(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    refused = bool(quality.structure_errors(cells, HEADERS))
    sound = quality.require_structure(cells.where(F.size("cells") == len(HEADERS)), HEADERS)
    return sound.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("sound_rows"))


# ---- comparison ---------------------------------------------------------------------------------

COMPARED = """
    with l as (select sku as k, count(*) as n, max(quantity) as v from ({left}) x group by sku), r as (select code as k, count(*) as n, max(on_hand) as v from ({right}) x group by code)
    select coalesce(l.k, r.k) as key, coalesce(l.n, 0) as n_left, coalesce(r.n, 0) as n_right,
        case when trim(coalesce(l.k, r.k)) = '' then 'invalid' when coalesce(l.n, 0) > 1 or coalesce(r.n, 0) > 1 then 'ambiguous' when l.k is null then 'right_only' when r.k is null then 'left_only'
             when trim(l.v) = '' or trim(r.v) = '' then 'invalid' when l.v = r.v then 'matched' else 'conflict' end as status
    from l full join r on l.k = r.k"""
_PLAIN = COMPARED.replace("{left}", "{compare_left}").replace("{right}", "{compare_right}")
_TRIMMED = COMPARED.replace("({left}) x group by sku", "(select trim(sku) as sku, trim(quantity) as quantity from ({compare_left}) t) x group by sku").replace("({right}) x group by code", "(select trim(code) as code, trim(on_hand) as on_hand from ({compare_right}) t) x group by code")
_COUNTS = ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in compare.STATUSES)


def _compared(spark, sf_dir, clean=False) -> DataFrame:
    from veritab.functions.text import trimmed

    left, right = view(spark, sf_dir, "compare_left"), view(spark, sf_dir, "compare_right")
    if clean:
        left, right = (df.select("record", *[trimmed(F.col(c)).alias(c) for c in df.columns[1:]]) for df in (left, right))
    return compare.compared(left, right, "sku", "code", "quantity", "on_hand").select("key", "n_left", "n_right", "status")


@query(f"select *, row_number() over (order by key) as place from ({_PLAIN}) c")
def compare_status(spark, sf_dir):
    return compare.in_order(_compared(spark, sf_dir))


@query(f"select {_COUNTS} from ({_PLAIN}) c")
def compare_counts(spark, sf_dir):
    return compare.status_counts(_compared(spark, sf_dir))


@query(f"select {_COUNTS} from ({_TRIMMED}) c")
def compare_after_trim(spark, sf_dir):
    return compare.status_counts(_compared(spark, sf_dir, clean=True))


@query(f"select sku, string_agg(record || ':' || quantity, ';' order by record) as evidence from ({{compare_left}}) x where sku in (select key from ({_PLAIN}) c where status = 'ambiguous') group by sku")
def compare_evidence(spark, sf_dir):
    of = _compared(spark, sf_dir).where("status = 'ambiguous'").select(F.col("key").alias("sku"))
    found = compare.evidence(view(spark, sf_dir, "compare_left"), ["sku"], ["quantity"], of)
    return found.select("sku", F.array_join(F.transform("evidence", lambda x: F.concat(x["record"].cast("string"), F.lit(":"), x["quantity"])), ";").alias("evidence"))


DOCUMENTS = """
    with t as (select record, trim(merchant) as merchant, trim(receipt_number) as receipt_number, upper(trim(currency)) as currency, trim(total) as total from ({receipt_rows}) x),
    f as (select lower(merchant) as m, lower(receipt_number) as r, count(*) as n from t group by 1, 2),
    d as (select lower(merchant) as m, lower(receipt_number) as r, count(*) as n, max(currency) as currency, max(total) as total from ({approved_receipts}) y group by 1, 2)
    select t.record, case when t.merchant = '' or t.receipt_number = '' or t.currency = '' or t.total = '' or not regexp_full_match(t.total, '[0-9]+([.][0-9][0-9]?)?') or not regexp_full_match(t.currency, '[A-Z][A-Z][A-Z]') then 'invalid'
        when f.n > 1 or coalesce(d.n, 0) > 1 then 'ambiguous' when d.n is null then 'unmatched' when t.currency = d.currency and try_cast(t.total as decimal(20, 2)) = try_cast(d.total as decimal(20, 2)) then 'matched' else 'conflict' end as status
    from t join f on lower(t.merchant) = f.m and lower(t.receipt_number) = f.r left join d on f.m = d.m and f.r = d.r"""


def _reconciled(spark, sf_dir) -> DataFrame:
    return compare.documents_reconciled(view(spark, sf_dir, "receipt_rows"), view(spark, sf_dir, "approved_receipts"))


@query(DOCUMENTS)
def document_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).select("record", "status")


@query("select " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in compare.DOCUMENT_STATUSES) + f" from ({DOCUMENTS}) d")
def document_reconcile_counts(spark, sf_dir):
    return compare.status_counts(_reconciled(spark, sf_dir), compare.DOCUMENT_STATUSES)


# ---- contracts ----------------------------------------------------------------------------------

CONTRACT = Contract((Field("id", "integer"), Field("day", "date"), Field("user_id", "integer"), Field("amount", "decimal"), Field("active", "boolean"), Field("note", "text", False)), ("id",), 25, 1)
TYPED_KEY = Contract((Field("id", "integer"), Field("amount", "decimal")), ("id", "amount"), 100, 1)


def _events(spark, sf_dir, contract=CONTRACT) -> contracts.Validated:
    return contracts.validated(view(spark, sf_dir, "events_view").select("record", *[f.name for f in contract.fields]), contract)


_INT = "-?(0|[1-9][0-9]*)"
CHECKED = f"""
    with e as (select * from ({{events_view}}) v),
    k as (select id from e where regexp_full_match(id, '{_INT}') group by id having count(*) > 1)
    select e.*, case when e.id = '' then 'required' when e.id <> trim(e.id) then 'whitespace' when not regexp_full_match(e.id, '{_INT}') then 'integer' end as w_id,
        case when day = '' then 'required' when day <> trim(day) then 'whitespace' when not regexp_full_match(day, '[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]') then 'date_format' when try_cast(day as date) is null then 'date_value' end as w_day,
        case when user_id = '' then 'required' when user_id <> trim(user_id) then 'whitespace' when not regexp_full_match(user_id, '{_INT}') then 'integer' end as w_user,
        case when amount = '' then 'required' when not regexp_full_match(amount, '{_INT}([.][0-9]+)?') then 'decimal' end as w_amount,
        case when active not in ('true', 'false') then 'boolean' end as w_active, case when note <> trim(note) then 'whitespace' end as w_note, k.id is not null as repeated
    from e left join k on e.id = k.id"""
_OK = "w_id is null and w_day is null and w_user is null and w_amount is null and w_active is null and w_note is null and not repeated"
_REASONS = " union all ".join(
    f"select record, '{c}' as field, 'invalid_value' as code, w_{w} as detail from ({CHECKED}) x where w_{w} is not null" for c, w in (("id", "id"), ("day", "day"), ("user_id", "user"), ("amount", "amount"), ("active", "active"), ("note", "note"))
) + f" union all select record, null, 'duplicate_key', null from ({CHECKED}) x where repeated"


@query(f"select record, cast(id as bigint) as id, cast(cast(day as date) as string) as day, cast(user_id as bigint) as user_id, amount, active = 'true' as active, nullif(note, '') as note from ({CHECKED}) x where {_OK}")
def contract_typed_accepted(spark, sf_dir):
    return _events(spark, sf_dir).accepted.withColumn("day", F.col("day").cast("string"))


def _json_reason(code: str, field: str | None = None, detail: str | None = None) -> str:
    """SQL of one reason as JSON; braces would be taken for views."""
    members = ([f"'\"field\":\"{field}\"'"] if field else []) + [f"'\"code\":\"{code}\"'"] + ([f"'\"detail\":\"' || {detail} || '\"'"] if detail else [])
    return f"chr(123) || {" || ',' || ".join(members)} || chr(125)"


_JSON_REASONS = ", ".join([f"case when w_{w} is not null then {_json_reason('invalid_value', c, 'w_' + w)} end" for c, w in (("id", "id"), ("day", "day"), ("user_id", "user"), ("amount", "amount"), ("active", "active"), ("note", "note"))] + [f"case when repeated then {_json_reason('duplicate_key')} end"])


@query(f"""select record as source_record, '[' || array_to_string(list_filter([{_JSON_REASONS}], lambda r: r is not null), ',') || ']' as reasons_json, to_json([id, day, user_id, amount, active, note])::varchar as raw_cells_json,
    row_number() over (order by record) as place from ({CHECKED}) x where not ({_OK})""")
def contract_quarantine_export(spark, sf_dir):
    return placed(_events(spark, sf_dir).quarantine_export(), ["source_record"])


@query(_REASONS)
def contract_quarantine_reasons(spark, sf_dir):
    return _events(spark, sf_dir).quarantined.select("record", F.inline("reasons"))


@query(f"select code, count(*) as n from ({_REASONS}) r group by code")
def contract_error_counts(spark, sf_dir):
    return _events(spark, sf_dir).error_counts


@query(f"select record, id from ({CHECKED}) x where repeated")
def contract_duplicate_keys(spark, sf_dir):
    rows = _events(spark, sf_dir).rows
    return rows.where(F.exists("reasons", lambda r: r["code"] == "duplicate_key")).select("record", "id")


_GATE = f"select count(*) as source, count(*) filter (where {_OK}) as accepted, count(*) filter (where not ({_OK})) as quarantined from ({CHECKED}) x"


@query(f"select *, accepted >= 1 and not (source > 0 and quarantined * 100 > 25 * source) as passed, case when accepted < 1 then 'below_minimum' else '' end || case when quarantined * 100 > 25 * source then 'quarantine_exceeded' else '' end as why from ({_GATE}) g")
def contract_gate(spark, sf_dir):
    return _events(spark, sf_dir).gate.select("source", "accepted", "quarantined", "passed", _joined("gate_reasons").alias("why"))


@query(f"""with v as (select * from ({{events_view}}) e), has as (select unnest(list_filter(json_keys(to_json(r)), lambda c: c not in ('record', 'width'))) as c from (select v as r from v limit 1) x), wants as (select unnest({[f.name for f in TYPED_KEY.fields]}) as c),
    missing as (select string_agg(c, ', ' order by c) as m from wants where c not in (select c from has)), extra as (select string_agg(c, ', ' order by c) as m from has where c not in (select c from wants))
    select count(*) as source, cast(0 as bigint) as accepted, count(*) as quarantined, false as passed,
        array_to_string(list_filter(['missing columns: ' || (select m from missing), 'unexpected columns: ' || (select m from extra), case when 0 < {TYPED_KEY.min_accepted_rows} then 'below_minimum' end, case when count(*) > 0 and count(*) * 100 > {TYPED_KEY.max_quarantine_percent} * count(*) then 'quarantine_exceeded' end], lambda w: w is not null), ';') as why from v""")
def contract_schema_drift(spark, sf_dir):
    return contracts.validated(view(spark, sf_dir, "events_view"), TYPED_KEY).gate.select("source", "accepted", "quarantined", "passed", _joined("gate_reasons").alias("why"))


_SAFE = "case when regexp_matches(ltrim({c}), '^[=+@-]') then concat('''', {c}) else {c} end"


@query("select record, " + ", ".join(f"{_SAFE.replace('{c}', c)} as {c}" for c in ("id", "day", "user_id", "amount", "active", "note")) + f" from ({CHECKED}) x where {_OK}")
def contract_accepted_export(spark, sf_dir):
    return _events(spark, sf_dir).accepted_export()


@query("select record, " + _SAFE.replace("{c}", "note") + " as safe, case when regexp_matches(note, '^[=+@-]') then concat('''', note) else note end as strict from ({events_view}) v")
def formula_safe_export(spark, sf_dir):
    return view(spark, sf_dir, "events_view").select("record", formula_safe(F.col("note")).alias("safe"), formula_safe_strict(F.col("note")).alias("strict"))


# ---- snapshots ----------------------------------------------------------------------------------

RULES = SnapshotRules(("id",), "orders ledger", "all orders", "1998-08-01", "1998-08-01", "1998-08-02", 7, True)
STALE = SnapshotRules(("id",), "orders ledger", "all orders", "1998-08-01", "1998-07-30", "1998-08-10", 7, True)
SNAPSHOT_COLUMNS = ["id", "customer", "status", "cents", "day"]


def _keyed_sql(reference: str, delivery: str, columns: list[str], keys: list[str] | None = None) -> str:
    """Classified identities, by one full join of both sides' groups."""
    keys = keys or ["id"]
    ok = " and ".join(f"trim({k}) <> '' and {k} = trim({k})" for k in keys)
    k = ", ".join(keys)
    side = lambda t: f"select {k}, count(*) as n, " + ", ".join(f"max({c}) as x_{c}" for c in columns) + f" from ({t}) t where {ok} group by {k}"
    same = " and ".join(f"l.x_{c} = r.x_{c}" for c in columns)
    changed = " || ".join(f"case when l.n = 1 and r.n = 1 and l.x_{c} <> r.x_{c} then '{c};' else '' end" for c in columns)
    return f"""select {", ".join(f"coalesce(l.{x}, r.{x}) as {x}" for x in keys)}, coalesce(l.n, 0) as n_left, coalesce(r.n, 0) as n_right,
        case when l.n > 1 then 'ambiguous_reference' when l.n is null then 'unexpected' when r.n is null then 'missing' when r.n > 1 then 'duplicate' when not ({same}) then 'changed' else 'matched' end as kind, rtrim({changed}, ';') as changed
        from ({side(reference)}) l full join ({side(delivery)}) r on {" and ".join(f"l.{x} = r.{x}" for x in keys)}"""


_KEYED = _keyed_sql("{reference_view}", "{delivery_view}", SNAPSHOT_COLUMNS)
_PADDED = _keyed_sql("{reference_view}", "{padded_delivery_view}", SNAPSHOT_COLUMNS)
_AMBIGUOUS = _keyed_sql("{ambiguous_view}", "{ambiguous_delivery_view}", ["id", "line", "flag"], ["id", "line"])


def _assessed(spark, sf_dir, delivery="delivery_view", rules=RULES) -> snapshots.Assessment:
    return snapshots.assessed(view(spark, sf_dir, "reference_view"), view(spark, sf_dir, delivery), rules)


@query(f"select id, kind, n_left, n_right, row_number() over (order by id) as place from ({_KEYED}) k where kind <> 'matched'")
def snapshot_issues(spark, sf_dir):
    return placed(_assessed(spark, sf_dir).issues.select("id", "kind", "n_left", "n_right"), ["id"])


@query(f"select kind, count(*) as n from ({_KEYED}) k group by kind")
def snapshot_issue_counts(spark, sf_dir):
    return _assessed(spark, sf_dir).keyed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"select id, changed from ({_KEYED}) k where kind = 'changed'")
def snapshot_changed_fields(spark, sf_dir):
    return _assessed(spark, sf_dir).issues.where("kind = 'changed'").select("id", _joined("changed_fields").alias("changed"))


@query("select 'delivery' as role, record, id from ({padded_delivery_view}) d where trim(id) = '' or id <> trim(id)")
def snapshot_invalid_identities(spark, sf_dir):
    return _assessed(spark, sf_dir, "padded_delivery_view").invalid.select("role", "record", "id")


_INVALID = "exists (select 1 from ({view}) v where trim(id) = '' or id <> trim(id))"
_BLOCKERS = " || ".join(
    f"case when {condition} then '{name};' else '' end"
    for condition, name in (
        (f"date '{STALE.reference_date}' <> date '{STALE.delivery_date}'", "dates_differ"),
        (f"date '{STALE.as_of}' - date '{STALE.reference_date}' > {STALE.max_age_days}", "reference_too_old"),
        (f"date '{STALE.as_of}' - date '{STALE.delivery_date}' > {STALE.max_age_days}", "delivery_too_old"),
        (_INVALID.replace("{view}", "{reference_view}"), "reference_invalid_identity"),
        (_INVALID.replace("{view}", "{padded_delivery_view}"), "delivery_invalid_identity"),
    )
)


@query(f"""select (select count(*) from ({{reference_view}}) r) as reference_rows, (select count(*) from ({{padded_delivery_view}}) d) as delivery_rows, count(*) filter (where kind = 'matched') as matched_keys, count(*) filter (where kind <> 'matched') as discrepancies,
    rtrim({_BLOCKERS}, ';') as blockers, {_BLOCKERS} = '' and count(*) filter (where kind <> 'matched') = 0 as matched from ({_PADDED}) k""")  # fmt: skip
def snapshot_blockers(spark, sf_dir):
    return _assessed(spark, sf_dir, "padded_delivery_view", STALE).summary.withColumn("blockers", _joined("blockers"))


@query(f"select kind, count(*) as n, sum(n_left)::bigint as reference_rows, sum(n_right)::bigint as delivery_rows from ({_AMBIGUOUS}) k group by kind")
def snapshot_ambiguous_reference(spark, sf_dir):
    rules = SnapshotRules(("id", "line"), "lines", "all lines", "1998-08-01", "1998-08-01", "1998-08-02", 7, True)
    keyed = snapshots.assessed(view(spark, sf_dir, "ambiguous_view"), view(spark, sf_dir, "ambiguous_delivery_view"), rules).keyed
    return keyed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_left").alias("reference_rows"), F.sum("n_right").alias("delivery_rows"))


_CHOSEN = f"select id from ({_KEYED}) k where kind in ('missing', 'unexpected', 'duplicate')"


def _repaired(spark, sf_dir) -> snapshots.Assessment:
    one = _assessed(spark, sf_dir)
    return one.repaired(one.issues.where(F.col("kind").isin("missing", "unexpected", "duplicate")), "restore rows that went missing or came twice")


@query(f"""select {", ".join(SNAPSHOT_COLUMNS)}, row_number() over (order by part, case when part = 0 then record end, id, record) as place from (
    select 0 as part, * from ({{delivery_view}}) d where id not in ({_CHOSEN}) union all by name select 1 as part, * from ({{reference_view}}) r where id in ({_CHOSEN})) c""")
def snapshot_repair_candidate(spark, sf_dir):
    return snapshots.in_order(_repaired(spark, sf_dir).delivery, ["id"]).select(*SNAPSHOT_COLUMNS, "place")


@query(f"select kind, count(*) as n from ({_KEYED}) k where kind = 'changed' group by kind")
def snapshot_repair_recheck(spark, sf_dir):
    return _repaired(spark, sf_dir).issues.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- ledgers ------------------------------------------------------------------------------------

LEDGER_COLUMNS = ["payment_id", "order_id", "region", "currency", "amount_cents"]


def _faulty_sql(faults: list[str]) -> str:
    scaled = "case when cast(payment_id as bigint) % 1000 = 7 then cast(cast(amount_cents as bigint) * 100 as string) else amount_cents end" if "amount_unit" in faults else "amount_cents"
    rows = f"select record, payment_id, order_id, region, currency, {scaled} as amount_cents from ({{ledger_view}}) v" + (" where region <> '1'" if "missing_region" in faults else "")
    return rows + (f" union all select * from ({rows}) r where cast(payment_id as bigint) % 500 = 3" if "duplicate_retry" in faults else "")


def _faulty(spark, sf_dir, faults: list[str]) -> DataFrame:
    number = F.col("payment_id").cast("bigint")
    return snapshots.faulty(view(spark, sf_dir, "ledger_view"), faults, F.col("region") == "1", number % 500 == 3, number % 1000 == 7)


_ALL = _faulty_sql(list(snapshots.FAULTS))
_LEDGER = _keyed_sql("{ledger_view}", _ALL, LEDGER_COLUMNS, ["payment_id"])
_METRIC = "select gross as gross_cents, refunds as refunds_cents, n as payment_count, m as refund_count, gross - refunds as net_cents from (select coalesce(sum(cast(amount_cents as bigint)), 0)::bigint as gross, count(*) as n from ({rows}) p) a, (select coalesce(sum(cast(amount_cents as bigint)), 0)::bigint as refunds, count(*) as m from ({refunds_view}) r) b"
_CASES = [(mask, [f for i, f in enumerate(snapshots.FAULTS) if mask & (1 << i)]) for mask in range(8)]


@query(f"select payment_id, kind, n_right, changed from ({_LEDGER}) k where kind <> 'matched'")
def ledger_issues(spark, sf_dir):
    found = snapshots.ledger_issues(view(spark, sf_dir, "ledger_view"), _faulty(spark, sf_dir, list(snapshots.FAULTS)), "payment_id")
    return found.select("payment_id", "kind", "n_right", _joined("changed_fields").alias("changed"))


@query("select 'delivered' as side, * from (" + _METRIC.replace("{rows}", _ALL) + ") d union all select 'expected', * from (" + _METRIC.replace("{rows}", "{ledger_view}") + ") e")
def ledger_metric(spark, sf_dir):
    refunds, out = view(spark, sf_dir, "refunds_view"), None
    for side, rows in (("delivered", _faulty(spark, sf_dir, list(snapshots.FAULTS))), ("expected", view(spark, sf_dir, "ledger_view"))):
        one = snapshots.ledger_metric(rows, refunds).select(F.lit(side).alias("side"), "gross_cents", "refunds_cents", "payment_count", "refund_count", "net_cents")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"select region, coalesce(sum(cents) filter (where side = 'e'), 0)::bigint as expected_cents, coalesce(sum(cents) filter (where side = 'd'), 0)::bigint as delivered_cents from (select 'e' as side, region, cast(amount_cents as bigint) as cents from ({{ledger_view}}) e union all select 'd', region, cast(amount_cents as bigint) from ({_ALL}) d) x group by region")
def ledger_impact_by_group(spark, sf_dir):
    refunds = view(spark, sf_dir, "refunds_view")
    of = lambda rows, name: snapshots.ledger_metric(rows, refunds, ["region"]).select("region", F.col("gross_cents").alias(name))
    both = of(view(spark, sf_dir, "ledger_view"), "expected_cents").join(of(_faulty(spark, sf_dir, list(snapshots.FAULTS)), "delivered_cents"), "region", "full")
    return both.fillna(0)


@query(_METRIC.replace("{rows}", "{ledger_view}"))
def ledger_repair_metric(spark, sf_dir):
    reference, delivered = view(spark, sf_dir, "ledger_view"), _faulty(spark, sf_dir, list(snapshots.FAULTS))
    chosen = snapshots.ledger_issues(reference, delivered, "payment_id").select("payment_id")
    fixed = snapshots.replaced(reference, delivered, chosen, ["payment_id"], LEDGER_COLUMNS)
    return snapshots.ledger_metric(fixed, view(spark, sf_dir, "refunds_view")).select("gross_cents", "refunds_cents", "payment_count", "refund_count", "net_cents")


@query(" union all ".join(f"select '{';'.join(faults)}' as faults, count(*) filter (where kind = 'missing') as missing, count(*) filter (where kind = 'duplicate') as duplicates, count(*) filter (where kind = 'changed') as changed from ({_keyed_sql('{ledger_view}', _faulty_sql(faults), LEDGER_COLUMNS, ['payment_id'])}) k{mask}" for mask, faults in _CASES))
def fault_evaluation(spark, sf_dir):
    number = F.col("payment_id").cast("bigint")
    versions = snapshots.scenario_versions(view(spark, sf_dir, "ledger_view"), F.col("region") == "1", number % 500 == 3, number % 1000 == 7)
    found = snapshots.scenario_issues(versions.drop("record"), ["payment_id"], LEDGER_COLUMNS).groupBy("scenario").agg(*[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("missing", "missing"), ("duplicate", "duplicates"), ("changed", "changed"))])
    cases = spark.createDataFrame([(mask, ";".join(faults)) for mask, faults in _CASES], "scenario int, faults string")
    return cases.join(found, "scenario", "left").fillna(0).drop("scenario")


_SEEDS = {3: ("1", 500), 17: ("0", 400), 91: ("4", 300)}
_SUMMARY = " union all ".join(
    f"""select {seed} as seed, '{";".join(faults)}' as faults, count(*) filter (where p) as planted, count(*) filter (where p and found) as detected, count(*) filter (where p and not found) as missed, count(*) filter (where found and not p) as false_findings,
        coalesce(bool_or(n_right > 1), false) as schema_blocked, coalesce(bool_or(found), false) as reconciliation_blocked
    from (select k.n_right, k.kind <> 'matched' as found, {" or ".join([f"region = '{region}'"] * ("missing_region" in faults) + [f"cast(v.payment_id as bigint) % {step} = 3"] * ("duplicate_retry" in faults) + [f"cast(v.payment_id as bigint) % {2 * step} = 7"] * ("amount_unit" in faults)) or "false"} as p
        from ({{ledger_view}}) v join ({_keyed_sql("{ledger_view}", _faulty_sql(faults).replace("region <> '1'", f"region <> '{region}'").replace("% 1000 = 7", f"% {2 * step} = 7").replace("% 500 = 3", f"% {step} = 3"), LEDGER_COLUMNS, ["payment_id"])}) k using (payment_id)) c{seed}_{mask}"""
    for seed, (region, step) in _SEEDS.items()
    for mask, faults in _CASES
)


@query(_SUMMARY)
def fault_summary(spark, sf_dir):
    number = F.col("payment_id").cast("bigint")
    seeds = {seed: (F.col("region") == region, number % step == 3, number % (2 * step) == 7) for seed, (region, step) in _SEEDS.items()}
    return incidents.scenario_summary(view(spark, sf_dir, "ledger_view"), seeds)


# ---- orders -------------------------------------------------------------------------------------

_DATE = "regexp_full_match({c}, '[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]') and try_cast({c} as date) is not null"
_BAD_DATE = lambda c: f"{c} <> '' and {c} = trim({c}) and not ({_DATE.replace('{c}', c)})"
ORDERS = f"""
    with v as (select *, count(*) over (partition by order_id) as copies from ({{orders_view}}) o),
    w as (select *, case when order_id = '' or order_id <> trim(order_id) then 'order_id: blank or padded;' else '' end || case when team = '' or team <> trim(team) then 'team: blank or padded;' else '' end
        || case when ordered_on = '' or ordered_on <> trim(ordered_on) then 'ordered_on: blank or padded;' else '' end || case when {_BAD_DATE("ordered_on")} then 'ordered_on: not a date;' else '' end
        || case when {_BAD_DATE("due_on")} then 'due_on: not a date;' else '' end || case when {_BAD_DATE("delivered_on")} then 'delivered_on: not a date;' else '' end || case when copies > 1 then 'repeated order id;' else '' end as first from v),
    x as (select *, case when first <> '' then rtrim(first, ';') else rtrim(case when due_on < ordered_on then 'due before ordered;' else '' end || case when delivered_on <> '' and delivered_on < ordered_on then 'delivered before ordered;' else '' end
        || case when ordered_on > '{AS_OF}' or delivered_on > '{AS_OF}' then 'after snapshot;' else '' end, ';') end as reasons from w),
    y as (select *, try_cast(ordered_on as date) as o, try_cast(due_on as date) as d, try_cast(coalesce(nullif(delivered_on, ''), '{AS_OF}') as date) as e from x)
    select record, order_id, team, reasons, due_on, case when reasons = '' then greatest(0, datediff('day', d, e)) end as late_days, case when reasons = '' and delivered_on <> '' then datediff('day', o, e) end as lead_days,
        case when reasons = '' then datediff('day', o, e) end as age_days,
        case when reasons <> '' then null when delivered_on <> '' then case when e > d then 'delivered late' else 'delivered on time' end when due_on < '{AS_OF}' then 'open overdue' when due_on = '{AS_OF}' then 'due today' else 'upcoming' end as status
    from y"""
_ORDER_SUMMARY = """count(*) as records, count(*) filter (where status like 'delivered%') as delivered, count(*) filter (where status = 'delivered on time') as delivered_on_time, count(*) filter (where status = 'delivered late') as delivered_late,
    count(*) filter (where status = 'open overdue') as open_overdue, count(*) filter (where status = 'due today') as due_today, count(*) filter (where status = 'upcoming') as upcoming,
    round(count(*) filter (where status = 'delivered on time')::double / nullif(count(*) filter (where status like 'delivered%'), 0), 6) as on_time_rate, median(lead_days)::double as median_lead_days"""


def _orders(spark, sf_dir) -> DataFrame:
    return orders.checked(view(spark, sf_dir, "orders_view"), AS_OF)


@query(f"select record, order_id, team, status, cast(late_days as int) as late_days, cast(lead_days as int) as lead_days, cast(age_days as int) as age_days, late_days > 0 as flagged from ({ORDERS}) z where reasons = ''")
def order_results(spark, sf_dir):
    return orders.valid(_orders(spark, sf_dir)).select("record", "order_id", "team", "status", "late_days", "lead_days", "age_days", "flagged")


@query(f"select record, order_id, reasons, row_number() over (order by record) as place from ({ORDERS}) z where reasons <> ''")
def order_quarantine(spark, sf_dir):
    return orders.quarantine_places(_orders(spark, sf_dir).select("record", "order_id", "reasons")).select("record", "order_id", _joined("reasons").alias("reasons"), "place")


@query(f"select {_ORDER_SUMMARY} from ({ORDERS}) z where reasons = ''")
def order_summary(spark, sf_dir):
    return orders.summary(_orders(spark, sf_dir)).withColumn("on_time_rate", F.round("on_time_rate", 6))


@query(f"select team, {_ORDER_SUMMARY} from ({ORDERS}) z where reasons = '' group by team")
def order_team_summary(spark, sf_dir):
    return orders.team_summary(_orders(spark, sf_dir)).withColumn("on_time_rate", F.round("on_time_rate", 6))


@query(f"select count(*) as source, count(*) filter (where reasons = '') as valid, count(*) filter (where reasons <> '') as quarantined, count(*) filter (where late_days > 0) as flagged from ({ORDERS}) z")
def order_counts(spark, sf_dir):
    return orders.counts(_orders(spark, sf_dir))


@query(f"select place, order_id, team, status, due_on, cast(late_days as int) as late_days from (select *, row_number() over (order by late_days desc, due_on, order_id, record) as place from ({ORDERS}) z where reasons = '') q")
def order_overdue_queue(spark, sf_dir):
    return orders.queue_places(_orders(spark, sf_dir).select("record", "order_id", "team", "status", "due_on", "late_days", "reasons")).select("place", "order_id", "team", "status", "due_on", "late_days")


# ---- inventory ----------------------------------------------------------------------------------

CUTOFFS = Cutoffs("1998-01-31", "1998-02-28", "1998-03-31")
_UNITS = "regexp_full_match({c}, '[0-9]+') and length({c}) <= 9"
STOCK = (
    "with v as (select *, count(*) over (partition by date, product, warehouse) as copies from ({stock_view}) s), w as (select *, "
    + " || ".join(f"case when {c} = '' or {c} <> trim({c}) then '{c}: blank or padded;' when not ({_UNITS.replace('{c}', c)}) then '{c}: not whole units;' else '' end" for c in ("opening", "received", "sold", "closing"))
    + " as first from v) select *, case when first <> '' then rtrim(first, ';') when copies > 1 then 'repeated identity' else '' end as reasons from w"
)
_ROWS = f"select record, cast(date as date) as day, product, warehouse, cast(opening as bigint) as opening, cast(received as bigint) as received, cast(sold as bigint) as sold, cast(closing as bigint) as closing from ({STOCK}) q where reasons = ''"
_SERIES = f"""select product, warehouse, count(*) filter (where day <= date '1998-01-31') as training, count(*) filter (where day > date '1998-01-31' and day <= date '1998-02-28') as calibration,
    count(*) filter (where day > date '1998-02-28' and day <= date '1998-03-31') as investigation, count(*) filter (where day between date '1998-01-02' and date '1998-01-31') as recent from ({_ROWS}) r group by 1, 2"""
_STATUS = f"select *, case when recent < 30 then '{inventory.NO_TRAINING}' when calibration <> 28 then '{inventory.NO_CALIBRATION}' else 'Ready' end as status from ({_SERIES}) s"
_PROFILES = f"""select product, warehouse, m as median, scale, greatest(3.5, quantile_disc((sold - m) / scale, 0.99)) as threshold from ({_ROWS}) r join (
    select product, warehouse, m, greatest(1.0::double, 1.4826::double * median(abs(sold - m))) as scale from ({_ROWS}) r join (select product, warehouse, median(sold)::double as m from ({_ROWS}) r join (select product, warehouse from ({_STATUS}) s where status = 'Ready') t using (product, warehouse) where day between date '1998-01-02' and date '1998-01-31' group by 1, 2) f using (product, warehouse)
    where day between date '1998-01-02' and date '1998-01-31' group by 1, 2, 3) p using (product, warehouse) where day > date '1998-01-31' and day <= date '1998-02-28' group by 1, 2, 3, 4"""
_RESULTS = f"""select r.record, r.day, r.product, r.warehouse, r.opening + r.received - r.sold as expected_closing, r.closing - (r.opening + r.received - r.sold) as delta, r.opening - b.closing as continuity_delta, b.record as prior_record,
    (r.sold - p.median) / p.scale as score, p.threshold, s.status from ({_ROWS}) r left join ({_ROWS}) b on r.product = b.product and r.warehouse = b.warehouse and b.day = r.day - 1
    join ({_STATUS}) s on r.product = s.product and r.warehouse = s.warehouse left join ({_PROFILES}) p on r.product = p.product and r.warehouse = p.warehouse where r.day > date '1998-02-28' and r.day <= date '1998-03-31'"""
_FLAGS = f"select *, rtrim(case when delta <> 0 then 'stock arithmetic;' else '' end || case when continuity_delta is not null and continuity_delta <> 0 then 'opening differs from prior closing;' else '' end || case when score > threshold then 'unusual sales;' else '' end, ';') as flags from ({_RESULTS}) x"


def _investigation(spark, sf_dir) -> inventory.Investigation:
    return inventory.Investigation(inventory.valid(inventory.checked(view(spark, sf_dir, "stock_view"))), CUTOFFS)


@query(f"select record, date, product, warehouse, reasons, row_number() over (order by record) as place from ({STOCK}) q where reasons <> ''")
def inventory_quarantine(spark, sf_dir):
    rows = inventory.quarantine_places(inventory.checked(view(spark, sf_dir, "stock_view")))
    return rows.select("record", "date", "product", "warehouse", _joined("reasons").alias("reasons"), "place")


@query(f"select product, warehouse, status, 31 - investigation as missing_test_days, training, calibration, investigation from ({_STATUS}) s")
def inventory_series_status(spark, sf_dir):
    return _investigation(spark, sf_dir).series


@query(f"select product, warehouse, round(median, 6) as median, round(scale, 6) as scale, round(threshold, 6) as threshold from ({_PROFILES}) p")
def inventory_profiles(spark, sf_dir):
    return _investigation(spark, sf_dir).profiles.select("product", "warehouse", *[F.round(c, 6).alias(c) for c in ("median", "scale", "threshold")])


@query(f"select record, cast(day as string) as day, product, warehouse, expected_closing, delta, continuity_delta, prior_record, round(score, 6) as score, flags, case when status <> 'Ready' then status end as skip_reason, row_number() over (order by product, warehouse, day, record) as place from ({_FLAGS}) f")
def inventory_results(spark, sf_dir):
    rows = inventory.result_places(_investigation(spark, sf_dir).results)
    return rows.select("record", F.col("day").cast("string").alias("day"), "product", "warehouse", "expected_closing", "delta", "continuity_delta", "prior_record", F.round("score", 6).alias("score"), _joined("flags").alias("flags"), "skip_reason", "place")


@query(f"select flag, count(*) as n from (select unnest(string_split(flags, ';')) as flag from ({_FLAGS}) f where flags <> '') g group by flag")
def inventory_flag_counts(spark, sf_dir):
    return inventory.flag_counts(_investigation(spark, sf_dir).results)


@query(f"select record, cast(day as string) as day, product, warehouse, sold, case when day < date '1998-01-02' then 'earlier history' when day <= date '1998-01-31' then 'training' when day <= date '1998-02-28' then 'calibration' else 'investigation' end as period from ({_ROWS}) r where day <= date '1998-03-31'")
def inventory_timeline(spark, sf_dir):
    return _investigation(spark, sf_dir).timeline.withColumn("day", F.col("day").cast("string"))


@query(f"select record, cast(day as string) as day, sum(step) over (partition by product, warehouse order by day)::bigint as segment from (select *, case when datediff('day', lag(day) over (partition by product, warehouse order by day), day) > 1 then 1 else 0 end as step from ({_ROWS}) r) x")
def inventory_gaps(spark, sf_dir):
    rows = inventory.valid(inventory.checked(view(spark, sf_dir, "stock_view")))
    return quality.gaps(rows, ["product", "warehouse"], "day").select("record", F.col("day").cast("string").alias("day"), "segment")


# ---- lab ----------------------------------------------------------------------------------------

_KEYS = ["product", "warehouse"]
_LAB_PROFILES = "select product, warehouse, m as median, greatest(1.0::double, 1.4826::double * median(abs(sold - m))) as scale from ({lab_view}) v join (select product, warehouse, median(sold)::double as m from ({lab_view}) v where n < 40 group by 1, 2) f using (product, warehouse) where n < 40 group by 1, 2, 3"
_LAB_SCORED = f"select v.*, (sold - p.median) / p.scale as score, closing - (opening + received - sold) as delta from ({{lab_view}}) v join ({_LAB_PROFILES}) p using (product, warehouse)"
_LAB_THRESHOLD = f"(select greatest(3.5, quantile_disc(round_even(score, 3), 0.99)) from ({_LAB_SCORED}) s where n between 40 and 59)"
_LAB_FOUND = f"select *, delta <> 0 as reconciliation, score > {_LAB_THRESHOLD} as sales_anomaly, sold > (select avg(sold) + 3 * stddev_pop(sold) from ({{lab_view}}) v where n < 40) as global_baseline, abs(delta) * unit_value_cents as review_value_cents from ({_LAB_SCORED}) s where n > 59"


def _lab(spark, sf_dir) -> dict[str, DataFrame]:
    rows = view(spark, sf_dir, "lab_view")
    truth = rows.select("id", F.col("is_mismatch").alias("reconciliation"), F.col("is_sales").alias("sales_anomaly"))
    return lab.evaluated(rows.drop("is_mismatch", "is_sales"), truth, _KEYS, F.col("n") < 40, F.col("n").between(40, 59), F.col("n") > 59)


@query(f"select product, warehouse, round(median, 6) as median, round(scale, 6) as scale from ({_LAB_PROFILES}) p")
def lab_profiles(spark, sf_dir):
    found = lab.profiles(view(spark, sf_dir, "lab_view").where("n < 40"), _KEYS)
    return found.select(*_KEYS, F.round("median", 6).alias("median"), F.round("scale", 6).alias("scale"))


@query("select round(avg(sold) + 3 * stddev_pop(sold), 4) as threshold from ({lab_view}) v where n < 40")
def lab_global_baseline(spark, sf_dir):
    return lab.global_threshold(view(spark, sf_dir, "lab_view").where("n < 40")).select(F.round("threshold", 4).alias("threshold"))


_LAB_TEXT = "case when delta <> 0 then 'Closing stock is ' || delta || ' units off opening + received - sold.' else 'Stock arithmetic balances.' end || case when sales_anomaly then ' Sales are beyond the series'' usual range.' else '' end"


@query(f"select row_number() over (order by review_value_cents desc, score desc, id) as place, id, reconciliation, sales_anomaly, global_baseline, review_value_cents::bigint as review_value_cents, delta::bigint as delta, {_LAB_TEXT} as explanation from ({_LAB_FOUND}) f where reconciliation or sales_anomaly")
def lab_alerts(spark, sf_dir):
    rows = placed(_lab(spark, sf_dir)["alerts"], [F.desc("review_value_cents"), F.desc("score"), "id"])
    return rows.select("place", "id", "reconciliation", "sales_anomaly", "global_baseline", F.col("review_value_cents").cast("bigint").alias("review_value_cents"), "delta", "explanation")


def _confusion_sql(name: str, p: str, t: str) -> str:
    return f"""select '{name}' as detector, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 3)::double as "precision", round(tp / nullif(tp + fn, 0), 3)::double as recall, round(1000.0 * fp / nullif(tp + fp + fn + tn, 0), 2)::double as false_alerts_per_1000
        from (select count(*) filter (where {p} and {t}) as tp, count(*) filter (where {p} and not {t}) as fp, count(*) filter (where not {p} and {t}) as fn, count(*) filter (where not {p} and not {t}) as tn from ({_LAB_FOUND}) f) c"""


@query(" union all ".join(_confusion_sql(*x) for x in (("reconciliation", "reconciliation", "is_mismatch"), ("global_baseline", "global_baseline", "is_sales"), ("per_product_robust", "sales_anomaly", "is_sales"))))
def lab_confusion(spark, sf_dir):
    found, out = _lab(spark, sf_dir), None
    for name in ("reconciliation", "global_baseline", "per_product_robust"):
        one = found[f"metrics_{name}"].select(F.lit(name).alias("detector"), "*")
        out = one if out is None else out.unionByName(one)
    return out


# ---- receipts -----------------------------------------------------------------------------------

_AMOUNT = "regexp_full_match({c}, '[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') and try_cast({c} as decimal(20, 6)) = round(try_cast({c} as decimal(20, 6)), 2)"
_CENTS = lambda c: f"case when {_AMOUNT.replace('{c}', c)} then cast(try_cast({c} as decimal(20, 2)) * 100 as bigint) end"
_BAD_AMOUNTS = " || ".join(f"case when {c} <> '' and not coalesce({_AMOUNT.replace('{c}', c)}, false) then '{c};' else '' end" for c in receipts.AMOUNTS)
NORMAL = f"""select id, trim(merchant) as merchant, trim(receipt_number) as receipt_number, date, lower(calendar) as calendar, case when upper(currency) in ('BIRR', 'BR') then 'ETB' else upper(currency) end as currency, {_CENTS("total")} as total_cents, {_CENTS("subtotal")} as subtotal_cents,
    {_CENTS("tax")} as tax_cents, {_CENTS("service_charge")} as service_charge_cents, rtrim({_BAD_AMOUNTS}, ';') as bad_amounts, lower(document_type) as document_type, status from ({{receipts_raw}}) r"""
_UNREAD = " || ".join(f"case when list_contains(string_split(bad_amounts, ';'), '{c}') then 'unreadable {c};' else '' end" for c in receipts.AMOUNTS)
ISSUES = f"""with n as ({NORMAL}), k as (select lower(merchant) as m, lower(receipt_number) as r, count(*) filter (where status in ('review', 'approved')) as n from n where merchant <> '' and receipt_number <> '' group by 1, 2),
    p as (select n.*, coalesce(k.n - case when status in ('review', 'approved') then 1 else 0 end > 0, false) as possible_duplicate from n left join k on lower(n.merchant) = k.m and lower(n.receipt_number) = k.r)
    select *, rtrim({_UNREAD} || case when merchant = '' then 'missing merchant;' else '' end || case when date = '' then 'missing date;' else '' end || case when currency = '' then 'missing currency;' else '' end || case when total_cents is null and not list_contains(string_split(bad_amounts, ';'), 'total') then 'missing total;' else '' end
        || case when document_type = '' then 'missing document_type;' else '' end || case when not ({_DATE.replace("{c}", "date")}) then 'date;' else '' end || case when calendar <> 'gregorian' then 'calendar;' else '' end
        || case when currency not in {receipts.CURRENCIES} then 'currency;' else '' end || case when document_type not in ('receipt', 'invoice') then 'document type;' else '' end
        || case when abs(total_cents - (subtotal_cents + tax_cents + service_charge_cents)) > 2 then 'arithmetic;' else '' end || case when possible_duplicate then 'possible duplicate;' else '' end, ';') as issues from p"""
_ELIGIBLE = f"select * from ({ISSUES}) i where status = 'approved' and issues = ''"


def _receipts(spark, sf_dir) -> DataFrame:
    return receipts.normalised(view(spark, sf_dir, "receipts_raw"))


def _validated(spark, sf_dir) -> DataFrame:
    return receipts.validated(_receipts(spark, sf_dir)).withColumn("duplicate_of", F.lit(None).cast("bigint"))


@query(f"select id, merchant, receipt_number, calendar, currency, total_cents, subtotal_cents, bad_amounts, document_type, case when total_cents is null then null else printf('%d.%02d', total_cents // 100, total_cents % 100) end as total from ({NORMAL}) n")
def receipt_normalized(spark, sf_dir):
    return _receipts(spark, sf_dir).select("id", "merchant", "receipt_number", "calendar", "currency", "total_cents", "subtotal_cents", _joined("bad_amounts").alias("bad_amounts"), "document_type", "total")


@query(f"select id, issues from ({ISSUES}) i")
def receipt_issues(spark, sf_dir):
    return _validated(spark, sf_dir).select("id", _joined("issues").alias("issues"))


@query(f"select id from ({ISSUES}) i where possible_duplicate")
def receipt_possible_duplicates(spark, sf_dir):
    return receipts.possible_duplicates(_receipts(spark, sf_dir)).where("possible_duplicate").select("id")


@query("select doc_id, sha256(coalesce(text, '')) as digest, f as duplicate_of from (select doc_id, text, min(doc_id) over (partition by coalesce(text, '')) as f from documents) x where doc_id <> f")
def exact_content_duplicates(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return receipts.content_duplicates(df, "text", "doc_id", "doc_id").where("duplicate_of is not null").select("doc_id", "digest", "duplicate_of")


@query(f"select currency, sum(total_cents)::bigint as total_cents, count(*) as documents from ({_ELIGIBLE}) e group by currency")
def receipt_totals_by_currency(spark, sf_dir):
    return receipts.totals(_validated(spark, sf_dir), QuestionPlan("total"))


@query(f"select merchant, currency, sum(total_cents)::bigint as total_cents, count(*) as documents from ({_ELIGIBLE}) e where date >= '1996-01-01' and date <= '1997-12-31' and contains(lower(merchant), '#0000') group by merchant, currency")
def receipt_totals_by_merchant(spark, sf_dir):
    return receipts.totals(_validated(spark, sf_dir), QuestionPlan("merchants", start="1996-01-01", end="1997-12-31", merchant="#0000"))


@query(f"select id, merchant, date, currency, total_cents, row_number() over (order by date desc, merchant, id) as place from ({_ELIGIBLE}) e where currency = 'USD'")
def receipt_list(spark, sf_dir):
    rows = receipts.matching(_validated(spark, sf_dir), QuestionPlan("list", currency="usd")).select("id", "merchant", "date", "currency", "total_cents")
    return receipts.listing_places(rows.withColumns({"created": F.col("date"), "name": F.col("merchant")})).drop("created", "name")


@query(f"select cast(n as string) || ' approved documents match. Document totals: ' || t as answer from (select sum(n)::bigint as n, string_agg(currency || ' ' || printf('%,.2f', c / 100.0), '; ' order by currency) as t from (select currency, count(*) as n, sum(total_cents)::bigint as c from ({_ELIGIBLE}) e group by currency) g) h")
def receipt_answer(spark, sf_dir):
    return receipts.answer(_validated(spark, sf_dir), QuestionPlan("total"))


_MONEY = lambda c: f"case when {c} is null then '' else printf('%d.%02d', {c} // 100, {c} % 100) end"


@query(f"""select id as source_id, case when id % 9 = 0 then chr(39) || '=' else 'r' end || id as filename, merchant, receipt_number, date, calendar, currency, {_MONEY("total_cents")} as total, {_MONEY("subtotal_cents")} as subtotal, {_MONEY("tax_cents")} as tax,
    {_MONEY("service_charge_cents")} as service_charge, document_type from ({_ELIGIBLE}) e""")
def receipt_approved_export(spark, sf_dir):
    rows = _validated(spark, sf_dir).withColumn("name", F.concat(F.when(F.col("id") % 9 == 0, "=").otherwise("r"), F.col("id").cast("string")))
    return receipts.approved_export(rows)


@query(f"select id, case when id % 20 = 3 then 'excluded' when id % 2 = 0 and issues = '' then 'approved' else 'review' end as status, case when id % 2 = 0 and issues <> '' then 'issues' else '' end as blocked from ({ISSUES}) i")
def receipt_review(spark, sf_dir):
    rows = receipts.reviewed(_validated(spark, sf_dir), F.col("id") % 2 == 0, F.col("id") % 20 == 3)
    return rows.select("id", "status", _joined("blocked").alias("blocked"))


# ---- scoring ------------------------------------------------------------------------------------

_SAME = "case when field = 'total' then coalesce(try_cast(actual as decimal(20, 3)) = try_cast(expected as decimal(20, 3)), false) else lower(trim(actual)) = lower(trim(expected)) end"
_SCORES = f"select *, present and case when expected = '' then actual = '' else {_SAME} end as correct, expected = '' and present and actual <> '' as unsupported_unknown from ({{extraction_fields}}) f"


def _scores(spark, sf_dir) -> DataFrame:
    return scoring.field_scores(view(spark, sf_dir, "extraction_fields"))


@query(f"select case_id, model, field, correct, unsupported_unknown from ({_SCORES}) s")
def extraction_field_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("case_id", "model", "field", "correct", "unsupported_unknown")


@query(f"""select model, sum(correct)::bigint as correct, sum(total)::bigint as total, count(*) filter (where status = 'failed') as failures, sum(unknowns)::bigint as unsupported_unknowns, median(elapsed_seconds) as median_elapsed_seconds, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens
    from ({{extraction_cases}}) c join (select case_id, model, count(*) filter (where correct) as correct, count(*) as total, count(*) filter (where unsupported_unknown) as unknowns from ({_SCORES}) s group by 1, 2) x using (case_id, model) group by model""")  # fmt: skip
def extraction_model_summary(spark, sf_dir):
    named = lambda df: df.withColumnRenamed("case_id", "case")
    return scoring.model_summary(scoring.extraction_runs(named(view(spark, sf_dir, "extraction_cases")), named(_scores(spark, sf_dir))))


# ---- sources ------------------------------------------------------------------------------------


_CSV = "select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages"


def _csv_texts(spark, sf_dir, broken: bool) -> DataFrame:
    """A text of each page: a header, a record of two cells and, of some, a short one and a blank line; some with a byte order mark, some broken."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    k = F.col("page_id")
    text = F.concat(F.when(k % 5 == 0, "\ufeff").otherwise(""), F.lit("url,html\r\n"), quoted("url"), F.lit(","), quoted("html"), F.lit("\r\n"), F.when(k % 3 == 0, "short\r\n\r\n").otherwise(""))
    if broken:
        text = F.when(k % 7 == 0, F.concat(text, F.lit('"open'))).when(k % 7 == 1, F.concat(text, F.lit("\0"))).when(k % 7 == 2, F.concat(text, F.lit('"a"b'))).when(k % 7 == 3, F.concat(F.lit("\r\n"), text)).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(k.cast("string").alias("id"), text.alias("content"))


@query(f"""select page_id, 1 as record, 2 as width, 'url' as first, 'html' as second from ({_CSV}) x union all select page_id, 2, 2, url, html from ({_CSV}) x
    union all select page_id, 3, 1, 'short', null from ({_CSV}) x where page_id % 3 = 0 union all select page_id, 4, 0, null, null from ({_CSV}) x where page_id % 3 = 0""")
def csv_parse_records(spark, sf_dir):
    rows = csv_text.parsed(_csv_texts(spark, sf_dir, False), limits=False)
    return rows.select(F.col("id").cast("bigint").alias("page_id"), "record", F.size("cells").alias("width"), F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"))


@query(f"""select page_id, case page_id % 7 when 0 then 'not CSV: unexpected end of data' when 1 then 'binary content' when 2 then 'not CSV: '','' expected after ''"''' when 3 then 'no header record' end as error,
    case when page_id % 7 > 3 then case when page_id % 3 = 0 then 4 else 2 end else 0 end::bigint as records from ({_CSV}) x""")
def csv_rejected_texts(spark, sf_dir):
    rows = csv_text.parsed(_csv_texts(spark, sf_dir, True), limits=False)
    return rows.groupBy(F.col("id").cast("bigint").alias("page_id")).agg(F.max("error").alias("error"), F.count("record").alias("records"))


#: Bundles of these tables are short, and so is the limit that some of them pass.
MOST_PAGES = 6


def _bundles(spark, sf_dir) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return receipts.bundles_of(turns.select(F.col("conv_id").alias("id"), "turn", "text"), "turn", MOST_PAGES)


@query(f"""with t as (select *, count(*) over (partition by conv_id) as n from conversations)
    select conv_id as parent, cast(row_number() over (partition by conv_id order by turn) as int) as page, text, null as error from t where n <= {MOST_PAGES}
    union all select distinct conv_id, null, null, 'more than {MOST_PAGES} pages: ' || n from t where n > {MOST_PAGES}""")
def document_segments(spark, sf_dir):
    return receipts.split_pages(_bundles(spark, sf_dir), MOST_PAGES)


@query(f"""select id, case when n between 2 and {MOST_PAGES} and id % 4 <> 0 then 'excluded' else 'review' end as status, case when n between 2 and {MOST_PAGES} and id % 4 <> 0 then n else 0 end::bigint as children,
    case when id % 4 <> 0 and n > 1 then case when n <= {MOST_PAGES} then 'split into pages' else 'split refused' end end as action from (select conv_id as id, count(*) as n from conversations group by conv_id) c""")
def document_split_parents(spark, sf_dir):
    bundles = _bundles(spark, sf_dir)
    documents = bundles.select("id", F.lit("review").alias("status"), F.when(F.col("id") % 4 == 0, F.col("id") - 1).alias("duplicate_of"))
    _, found, audit = receipts.split_bundles(documents, bundles.where(F.col("n") > 1), MOST_PAGES)
    return found.join(audit.select(F.col("document").alias("id"), F.col("children").cast("bigint").alias("children"), "action"), "id", "left").select("id", "status", F.coalesce("children", F.lit(0)).alias("children"), "action")


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return QUERIES[name](spark, sf_dir)
