"""Receipt fields: normalisation, validation, review states, and grounded totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.text import blank, cents_of, fold, formula_safe_strict, iso_date, money, reasons, trimmed, unreadable
from veritab.operators.ranks import placed
from veritab.plans.specs import QuestionPlan

AMOUNTS = ("total", "subtotal", "tax", "service_charge")
TEXTS = ("merchant", "receipt_number", "date", "calendar", "currency", "document_type")
# Other names of a currency, the currencies and document types that can be approved.
CURRENCY_NAMES = {"BR": "ETB", "BIRR": "ETB", "ETHIOPIAN BIRR": "ETB"}
CURRENCIES = ("ETB", "USD", "EUR", "GBP", "KES", "AED", "SAR", "CNY", "INR", "JPY", "CAD", "AUD", "ZAR", "UGX", "TZS")
DOCUMENT_TYPES = ("receipt", "invoice")
LONGEST = 300
#: Pages of a bundle that is split.
MOST_PAGES = 200
#: Total and its parts may differ by so many cents.
TOLERANCE = 2
STATUSES = ("imported", "duplicate", "review", "approved", "excluded")
REQUIRED = ("merchant", "date", "currency", "total", "document_type")


def normalised(df: DataFrame) -> DataFrame:
    """Trimmed and cut texts, upper or lower case where it doesn't matter, amounts with two decimals or null.

    Amounts that can't be read give a row in `bad_amounts`, by name; their value is null.
    """
    texts = {c: F.substring(trimmed(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, LONGEST) for c in TEXTS}
    amounts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in AMOUNTS}
    names = F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv])
    currency = F.upper(texts["currency"])
    out = df.withColumns(
        {
            **texts,
            "currency": F.coalesce(F.try_element_at(names, currency), currency),
            "calendar": F.lower(texts["calendar"]),
            "document_type": F.lower(texts["document_type"]),
            **{f"{c}_cents": cents_of(v) for c, v in amounts.items()},  # read once, used by name from here on
        }
    )
    bad = reasons(*[(unreadable(v, F.col(f"{c}_cents")), c) for c, v in amounts.items()])
    return out.withColumns({"bad_amounts": bad, **{c: F.when(F.col(f"{c}_cents").isNotNull(), money(F.col(f"{c}_cents"))) for c in AMOUNTS}})


def _identity() -> tuple[Column, Column]:
    return fold(F.col("merchant")), fold(F.col("receipt_number"))


def possible_duplicates(df: DataFrame) -> DataFrame:
    """df with `possible_duplicate`: another document under review or approved has the same merchant and number.

    Counts by key are joined back, so a key of very many documents is split, not gathered.
    """
    m, r = _identity()
    rows = df.withColumns({"_m": m, "_r": r, "_open": F.col("status").isin("review", "approved").cast("int")})
    n = rows.where((F.col("merchant") != "") & (F.col("receipt_number") != "")).groupBy(F.col("_m").alias("_km"), F.col("_r").alias("_kr")).agg(F.sum("_open").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    n = n.where("_rows > 1").drop("_rows")
    found = rows.join(n, (rows["_m"] == n["_km"]) & (rows["_r"] == n["_kr"]) & (rows["merchant"] != "") & (rows["receipt_number"] != ""), "left")
    return found.select(*[rows[c] for c in df.columns], F.coalesce(F.col("_n") - F.col("_open") > 0, F.lit(False)).alias("possible_duplicate"))


def validated(df: DataFrame) -> DataFrame:
    """Normalised documents (id, status, ...) with `issues`, in a fixed order.

    An amount that can't be read is an issue, so such a document is never approved; it isn't missing.
    """
    rows = possible_duplicates(df)
    parts = F.col("subtotal_cents") + F.col("tax_cents") + F.col("service_charge_cents")
    unread = lambda c: F.array_contains("bad_amounts", c)
    issues = reasons(
        *[(unread(c), f"unreadable {c}") for c in AMOUNTS],
        *[((F.col("total_cents").isNull() & ~unread("total") if c == "total" else blank(F.col(c))), f"missing {c}") for c in REQUIRED],
        (~iso_date(F.col("date")), "date"),
        (F.col("calendar") != "gregorian", "calendar"),
        (~F.col("currency").isin(*CURRENCIES), "currency"),
        (~F.col("document_type").isin(*DOCUMENT_TYPES), "document type"),
        (F.abs(F.col("total_cents") - parts) > TOLERANCE, "arithmetic"),
        (F.col("possible_duplicate"), "possible duplicate"),
    )
    return rows.withColumn("issues", issues)


def reviewed(rows: DataFrame, approve: Column, exclude: Column, split: Column | None = None) -> DataFrame:
    """The next state of validated documents: excluded, approved if nothing stands against it, else under review.

    `blocked` says why an approval was refused: an exact duplicate, a bundle split into pages, or issues.
    """
    split = F.lit(False) if split is None else split
    why = reasons((approve & F.col("duplicate_of").isNotNull(), "exact duplicate"), (approve & split, "split into pages"), (approve & (F.size("issues") > 0), "issues"))
    status = F.when(F.col("duplicate_of").isNotNull(), F.lit("duplicate")).when(exclude, "excluded").when(approve & (F.size(why) == 0), "approved").otherwise("review")
    return rows.withColumns({"blocked": why, "status": status})


def content_duplicates(df: DataFrame, content: str, order: str, ident: str) -> DataFrame:
    """df with digest and duplicate_of: the earliest row of the same content, null on that row itself."""
    rows = df.withColumn("digest", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))
    first = rows.groupBy(F.col("digest").alias("_d")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(ident).alias("i")))["i"].alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(first, rows["digest"] == first["_d"], "left").select(*[rows[c] for c in rows.columns], F.when(F.col("_first") != F.col(ident), F.col("_first")).alias("duplicate_of"))


def _pages(df: DataFrame) -> Column:
    return F.col("n") if "n" in df.columns else F.when(F.col("pages").isNull(), 0).otherwise(F.size("pages"))


def split_pages(df: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """A child for each page of each bundle (id, pages): (parent, page from 1, text, error).

    A bundle without pages, or of over `most`, is refused: it gives one row that says why, and the others go on. A
    column n, if there is one, says how many pages there are.
    """
    n = _pages(df)
    error = F.when(n > most, F.concat(F.lit(f"more than {most} pages: "), n.cast("string"))).when(n <= 0, "no pages")
    # what is refused is no longer carried along
    rows = df.select(F.col("id").alias("parent"), error.alias("error"), F.when(error.isNull(), F.col("pages")).alias("pages"))
    return rows.select("parent", "error", F.posexplode_outer("pages").alias("_at", "text")).select("parent", (F.col("_at") + 1).alias("page"), "text", "error")


def bundles_of(pages: DataFrame, order: str, most: int = MOST_PAGES) -> DataFrame:
    """(id, n, pages) of bundles whose pages are rows (id, text): texts in the order of a column; null where there are over `most`.

    Pages of such bundles aren't gathered, so no row and no task holds more than `most` of one bundle.
    """
    counts = pages.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    fit = pages.join(counts.where(F.col("n") > most).select("id"), "id", "left_anti")
    gathered = fit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias("pages"))
    return counts.join(gathered, "id", "left")


def split_bundles(documents: DataFrame, pages: DataFrame, most: int = MOST_PAGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(children, documents, audit) of splitting the bundles of `pages` (id, pages).

    A bundle is excluded from totals, and an event names its children. A copy isn't split, its original is. A bundle
    that `split_pages` refuses stays as it is, and its event says why.
    """
    originals = documents.where(F.col("duplicate_of").isNull()).select("id")
    own = pages.join(originals, "id", "left_semi")
    n = _pages(own)
    fits = n.between(1, most)
    ids = own.where(fits).select(F.col("id").alias("_split"))
    found = documents.join(ids, documents["id"] == ids["_split"], "left")
    status = F.when(F.col("_split").isNotNull(), F.lit("excluded")).otherwise(F.col("status"))
    audit = own.select(F.col("id").alias("document"), F.when(fits, "split into pages").otherwise("split refused").alias("action"), F.when(fits, n).otherwise(0).alias("children"))
    return split_pages(own, most), found.select(*[status.alias(c) if c == "status" else found[c] for c in documents.columns]), audit


def listed(documents: DataFrame, detail: bool = False) -> DataFrame:
    """What may be shown of documents, the newest first, then by name: no paths, and raw texts only in detail."""
    hidden = ["path"] if detail else ["path", "raw"]
    return documents.drop(*hidden).orderBy(F.desc("created"), "name")


def listing_places(documents: DataFrame) -> DataFrame:
    """Documents with `place`, from 1: the newest first, then by name, then id."""
    return placed(documents, [F.desc("created"), "name", "id"])


def approved_export(rows: DataFrame, name: str = "name") -> DataFrame:
    """(source_id, filename, the fields) of approved documents without issues, guarded against formulas."""
    open_ = rows.where((F.col("status") == "approved") & (F.size("issues") == 0))
    fields = ["merchant", "receipt_number", "date", "calendar", "currency", "total", "subtotal", "tax", "service_charge", "document_type"]
    return open_.select(F.col("id").alias("source_id"), formula_safe_strict(F.col(name)).alias("filename"), *[formula_safe_strict(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in fields])


def eligible(rows: DataFrame) -> DataFrame:
    """Approved documents that are still valid and no copies: what totals may count."""
    return rows.where((F.col("status") == "approved") & F.col("duplicate_of").isNull() & (F.size("issues") == 0))


def matching(rows: DataFrame, plan: QuestionPlan) -> DataFrame:
    """The documents a question is about."""
    out = eligible(rows)
    if plan.currency:
        out = out.where(F.col("currency") == plan.currency.upper())
    if plan.start:
        out = out.where(F.col("date") >= plan.start)
    if plan.end:
        out = out.where(F.col("date") <= plan.end)
    if plan.merchant:
        out = out.where(F.contains(fold(F.col("merchant")), F.lit(plan.merchant.casefold())))
    return out


def totals(rows: DataFrame, plan: QuestionPlan) -> DataFrame:
    """Whole cents and counts by currency, and by merchant if the plan asks for merchants."""
    by = ["merchant", "currency"] if plan.action == "merchants" else ["currency"]
    return matching(rows, plan).groupBy(*by).agg(F.sum("total_cents").alias("total_cents"), F.count(F.lit(1)).alias("documents"))


def answer(rows: DataFrame, plan: QuestionPlan) -> DataFrame:
    """One row: the answer as text. No match is never reported as a total of zero."""
    if plan.action == "unsupported":
        return rows.sparkSession.createDataFrame([(plan.message or "This goes beyond totals of reviewed documents.",)], "answer string")
    by = F.concat_ws(" · ", "merchant", "currency") if plan.action == "merchants" else F.col("currency")
    text = F.concat(by, F.lit(" "), F.format_number(F.col("total_cents") / F.lit(100).cast("decimal(3,0)"), 2))
    # one line for each currency or merchant: the answer is for a person to read
    parts = totals(rows, plan).select(by.alias("g"), text.alias("t"), "documents")
    one = parts.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("g", "t"))).alias("ts"))
    found = F.concat(F.col("n").cast("string"), F.lit(" approved documents match. "), F.lit("They are listed as sources.") if plan.action == "list" else F.concat(F.lit("Document totals: "), F.array_join(F.transform("ts", lambda x: x["t"]), "; ")))
    return one.select(F.when(F.col("n") > 0, found).otherwise("No approved documents match; that doesn't make the total zero.").alias("answer"))
