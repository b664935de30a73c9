"""Tables of text in the roles that the checks need, derived from sales tables.

Each view is SQL that Spark and other engines read alike: `{orders}` and so on stand for the tables.
Faults are planted by remainders of keys, so that every rule has rows that break it.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-30"

VIEWS = {
    "orders_view": """
        select l.l_orderkey * 10 + l.l_linenumber as record,
               concat(cast(l.l_orderkey as string), '-', cast(l.l_linenumber as string)) as order_id,
               case when l.l_orderkey % 97 = 0 then concat(' ', o.o_orderpriority) when l.l_orderkey % 101 = 0 then '' else o.o_orderpriority end as team,
               case when l.l_orderkey % 89 = 0 then '1997-02-30' else cast(cast(o.o_orderdate as date) as string) end as ordered_on,
               cast(cast(o.o_orderdate as date) + 60 as string) as due_on,
               case when cast(l.l_shipdate as date) <= cast('1998-06-30' as date) then cast(cast(l.l_shipdate as date) as string) else '' end as delivered_on
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    # n is 1 on the first of January 1998, and grows by a day each day of a year
    "stock_days": """
        select cast(l_shipdate as date) as day, l_returnflag as product, l_linestatus as warehouse,
               cast(sum(cast(l_quantity as bigint)) as bigint) as sold, cast(dayofyear(cast(l_shipdate as date)) + (year(cast(l_shipdate as date)) - 1998) * 366 as bigint) as n
        from {lineitem} where l_shipdate is not null
        group by cast(l_shipdate as date), l_returnflag, l_linestatus""",
    "stock_view": """
        select (n * 100 + ascii(product)) * 100 + ascii(warehouse) as record, cast(day as string) as date, product, warehouse,
               cast(100000 + n * 13 as string) as opening, cast(sold + 13 as string) as received,
               case when n % 41 = 0 and product = 'R' then concat(cast(sold as string), ' ') when n % 47 = 31 then cast(sold * 9 as string) else cast(sold as string) end as sold,
               case when n % 43 = 0 and product = 'R' then 'x' when n % 17 = 0 then cast(100000 + n * 13 + 14 as string) else cast(100000 + n * 13 + 13 as string) end as closing
        from ({stock_days}) s
        union all
        select (n * 100 + ascii(product)) * 100 + ascii(warehouse) + 5 as record, cast(day as string) as date, product, warehouse, '1', '1', '1', '1'
        from ({stock_days}) s where n % 71 = 0""",
    "reference_view": """
        select o_orderkey as record, cast(o_orderkey as string) as id, cast(o_custkey as string) as customer, o_orderstatus as status,
               cast(cast(round(o_totalprice * 100) as bigint) as string) as cents, cast(cast(o_orderdate as date) as string) as day
        from {orders}""",
    "delivery_view": """
        select o_orderkey as record, cast(o_orderkey as string) as id, cast(o_custkey as string) as customer,
               case when o_orderkey % 29 = 0 then concat(o_orderstatus, '?') else o_orderstatus end as status,
               cast(cast(round(o_totalprice * 100) as bigint) as string) as cents,
               case when o_orderkey % 29 = 0 and o_orderkey % 2 = 0 then '' else cast(cast(o_orderdate as date) as string) end as day
        from {orders} where o_orderkey % 17 <> 0
        union all
        select o_orderkey + 100000000 as record, cast(o_orderkey as string), cast(o_custkey as string), o_orderstatus, cast(cast(round(o_totalprice * 100) as bigint) as string), cast(cast(o_orderdate as date) as string)
        from {orders} where o_orderkey % 23 = 0 and o_orderkey % 17 <> 0
        union all
        select o_orderkey + 200000000 as record, cast(-o_orderkey as string), cast(o_custkey as string), o_orderstatus, '0', cast(cast(o_orderdate as date) as string)
        from {orders} where o_orderkey % 31 = 0""",
    "padded_delivery_view": """
        select record, case when record % 37 = 0 then concat(id, ' ') when record % 53 = 0 then '' else id end as id, customer, status, cents, day from ({delivery_view}) d""",
    "ambiguous_view": """
        select l_orderkey * 10 + l_linenumber as record, cast(l_orderkey as string) as id, cast(l_linenumber as string) as line, l_returnflag as flag from {lineitem}""",
    "ambiguous_delivery_view": """
        select l_orderkey * 10 + l_linenumber as record, cast(l_orderkey as string) as id, cast(l_linenumber as string) as line, case when l_orderkey % 5 = 0 then 'Z' else l_returnflag end as flag from {lineitem} where l_orderkey % 7 <> 0""",
    "events_view": """
        select event_id as record,
               case when event_id % 61 = 0 then cast(event_id - 1 as string) when event_id % 67 = 0 then '' else cast(event_id as string) end as id,
               case when event_id % 31 = 0 then cast('1999-02-30' as string) when event_id % 37 = 0 then '1999-2-3' else cast(cast(ts as date) as string) end as day,
               case when event_id % 29 = 0 then concat('0', cast(user_id as string)) when event_id % 41 = 0 then concat(' ', cast(user_id as string)) else cast(user_id as string) end as user_id,
               case when event_id % 43 = 0 then '1e3' else concat(cast(cast(floor(value) as bigint) as string), '.50') end as amount,
               case when event_id % 47 = 0 then 'True' when event_id % 2 = 0 then 'true' else 'false' end as active,
               case when event_id % 5 = 0 then '' when event_id % 53 = 0 then concat('=', event_type) when event_id % 59 = 0 then concat(' @', event_type) else event_type end as note
        from {events}""",
    "cells_view": """
        select doc_id + 2 as record, case when doc_id % 19 = 0 then '' when doc_id % 23 = 0 then concat(' ', lang) else lang end as a,
               case when doc_id % 11 = 0 then concat(source, '  ') when doc_id % 13 = 0 then '   ' else source end as b,
               cast(n_chars % 50 as string) as c, doc_id % 29 = 0 as is_short
        from {documents}""",
    "compare_left": """
        select o_orderkey as record, case when o_orderkey % 101 = 0 then ' ' else cast(o_orderkey as string) end as sku, case when o_orderkey % 103 = 0 then '' else cast(o_custkey as string) end as quantity from {orders}
        union all select o_orderkey + 100000000, cast(o_orderkey as string), cast(o_custkey as string) from {orders} where o_orderkey % 19 = 0""",
    "compare_right": """
        select o_orderkey as record, case when o_orderkey % 41 = 0 then concat(' ', cast(o_orderkey as string)) else cast(o_orderkey as string) end as code,
               case when o_orderkey % 13 = 0 then cast(o_custkey + 1 as string) else cast(o_custkey as string) end as on_hand from {orders} where o_orderkey % 11 <> 0
        union all select o_orderkey + 200000000, concat('X', cast(o_orderkey as string)), '1' from {orders} where o_orderkey % 43 = 0""",
    "receipts_raw": """
        select o.o_orderkey as id,
               concat(case when o.o_orderkey % 7 = 0 then '  ' else '' end, case when o.o_orderkey % 5 = 0 then upper(c.c_name) else c.c_name end) as merchant,
               case when o.o_orderkey % 53 = 0 then '' else concat('R', cast(case when o.o_orderkey % 47 = 0 then o.o_orderkey - 1 else o.o_orderkey end as string)) end as receipt_number,
               case when o.o_orderkey % 59 = 0 then '1998-13-01' when o.o_orderkey % 61 = 0 then '' else cast(cast(o.o_orderdate as date) as string) end as date,
               case when o.o_orderkey % 67 = 0 then 'Ethiopian' else 'Gregorian' end as calendar,
               case c.c_nationkey % 17 when 0 then 'birr' when 1 then 'usd' when 2 then 'EUR' when 3 then 'KES' when 4 then 'XXX' when 5 then 'gbp' when 6 then 'AED' when 7 then 'SAR' when 8 then 'CNY' when 9 then 'INR'
                   when 10 then 'JPY' when 11 then 'CAD' when 12 then 'AUD' when 13 then 'ZAR' when 14 then 'UGX' when 15 then 'TZS' else 'BR' end as currency,
               case when o.o_orderkey % 71 = 0 then '' when o.o_orderkey % 73 = 0 then '1.234' when o.o_orderkey % 113 = 0 then '12E2' when o.o_orderkey % 127 = 0 then '150.0e-1' when o.o_orderkey % 131 = 0 then '1e-3' else concat(cast(o.o_custkey * 3 + 1000 as string), '.50') end as total,
               case when o.o_orderkey % 3 = 0 then cast(o.o_custkey * 3 + case when o.o_orderkey % 79 = 0 then 500 else 900 end as string) else '' end as subtotal,
               case when o.o_orderkey % 107 = 0 then 'abc' else '100.50' end as tax, case when o.o_orderkey % 109 = 0 then '-1' else '0' end as service_charge,
               case when o.o_orderkey % 83 = 0 then 'credit note' else 'Receipt' end as document_type,
               case when o.o_orderkey % 4 = 0 then 'review' when o.o_orderkey % 37 = 0 then 'imported' else 'approved' end as status
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey
        union all
        select o.o_orderkey + 100000000, c.c_name, concat('R', cast(o.o_orderkey as string)), cast(cast(o.o_orderdate as date) as string), 'gregorian', 'USD', '5', '', '', '', 'invoice', 'approved'
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderkey % 43 = 0""",
    "receipt_rows": """
        select o.o_orderkey as record, concat(c.c_name, case when o.o_orderkey % 7 = 0 then ' ' else '' end) as merchant,
               case when o.o_orderkey % 89 = 0 then '' else concat('r', cast(o.o_orderkey as string)) end as receipt_number,
               case when o.o_orderkey % 11 = 0 then 'usd' else 'EUR' end as currency,
               case when o.o_orderkey % 97 = 0 then 'NaN' else concat(cast(o.o_custkey as string), '.0') end as total
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderkey % 2 = 0
        union all
        select o.o_orderkey + 100000000, c.c_name, concat('R', cast(o.o_orderkey as string)), 'EUR', '1' from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderkey % 38 = 0""",
    "approved_receipts": """
        select c.c_name as merchant, concat('R', cast(o.o_orderkey as string)) as receipt_number, case when o.o_orderkey % 11 = 0 then 'USD' else 'EUR' end as currency,
               case when o.o_orderkey % 13 = 0 then '7.00' else concat(cast(o.o_custkey as string), '.00') end as total
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderkey % 5 <> 0
        union all
        select c.c_name, concat('R', cast(o.o_orderkey as string)), 'EUR', '1.00' from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderkey % 46 = 0""",
    "ledger_view": """
        select o_orderkey as record, cast(o_orderkey as string) as payment_id, cast(o_custkey as string) as order_id, substr(o_orderpriority, 1, 1) as region, 'USD' as currency, cast(cast(round(o_totalprice * 100) as bigint) as string) as amount_cents
        from {orders}""",
    "refunds_view": """
        select o_orderkey as record, concat('F', cast(o_orderkey as string)) as refund_id, cast(o_orderkey as string) as payment_id, 'USD' as currency, '150' as amount_cents from {orders} where o_orderkey % 9 = 0""",
    "lab_view": """
        select concat(cast(s.day as string), s.product, s.warehouse) as id, s.n, s.product, s.warehouse, 100000 + s.n * 13 as opening, s.sold + 13 as received,
               case when s.n > 59 and s.n % 7 = 3 then s.sold * 3 else s.sold end as sold,
               100000 + s.n * 13 + 13 - case when s.n > 59 and s.n % 7 = 3 then s.sold * 2 else 0 end + case when s.n > 59 and s.n % 11 = 5 then 25 else 0 end as closing,
               cast(250 as bigint) as unit_value_cents, s.n > 59 and s.n % 11 = 5 as is_mismatch, s.n > 59 and s.n % 7 = 3 as is_sales
        from ({stock_days}) s""",
    "extraction_cases": """
        select concat('case-', cast(doc_id % 6 as string), '-', cast(doc_id as string)) as case_id, concat('model-', cast(doc_id % 3 as string)) as model,
               case when doc_id % 17 = 0 then 'failed' else 'ok' end as status, cast(doc_id % 40 as double) / 8 as elapsed_seconds, doc_id * 3 % 500 as prompt_tokens, doc_id * 7 % 900 as completion_tokens
        from {labels}""",
    "extraction_fields": """
        select concat('case-', cast(doc_id % 6 as string), '-', cast(doc_id as string)) as case_id, concat('model-', cast(doc_id % 3 as string)) as model, 'total' as field, doc_id % 19 <> 0 as present,
               case when doc_id % 5 = 0 then concat(cast(doc_id as string), '.00') when doc_id % 7 = 0 then 'about ten' else cast(doc_id as string) end as actual,
               case when doc_id % 11 = 0 then '' when doc_id % 4 = 0 then cast(doc_id + quality - 1 as string) else cast(doc_id as string) end as expected from {labels}
        union all
        select concat('case-', cast(doc_id % 6 as string), '-', cast(doc_id as string)), concat('model-', cast(doc_id % 3 as string)), 'merchant', true,
               case when doc_id % 13 = 0 then '' when quality = 1 then ' ACME Ltd ' else 'Acme' end, case when toxic = 1 then '' else 'acme ltd' end from {labels}""",
    "bundles_view": """
        select conv_id, count(*) as n from {conversations} group by conv_id""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _names(sql: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(sql) if name}


def expanded(sql: str) -> str:
    """SQL with views filled in; only tables are left to fill."""
    names = _names(sql)
    return sql.format(**{n: expanded(VIEWS[n]) if n in VIEWS else "{" + n + "}" for n in names})


def plain_sql(sql: str) -> str:
    """For engines where the tables have their own names."""
    filled = expanded(sql)
    return filled.format(**{n: n for n in _names(filled)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    filled = expanded(VIEWS[name])
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _names(filled)}
    return spark.sql(filled, **tables)
