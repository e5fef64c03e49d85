"""Checks of parsed invoices, reconciliation with expected totals, run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.operators.allocate import adaptive_total, money
from costloom.operators.keyed import join_on_key

REQUIRED_KEYS = ["vendor", "customer", "order_items", "totals", "metadata"]


def run_report(checked: DataFrame, counters: list[Column], item_order: list[str]) -> DataFrame:
    """Report lines per invoice: counts first, then every rejected line.

    One row per line instead of one text per run, so a run with very many
    rejected lines stays spread out; sort by (invoice_id, section, order) to print.
    """
    c = checked.groupBy("invoice_id").agg(*counters)

    def line(section: int, text: str, value: str | None = None):
        parts = [F.lit(text)] if value is None else [F.lit(text), F.col(value).cast("string")]
        if text.endswith("("):
            parts.append(F.lit("):"))
        return F.struct(F.lit(section).alias("section"), F.concat(*parts).alias("text"))

    head = c.select("invoice_id", F.inline(F.array(
        line(1, "=== Invoice Processing Report ==="), line(2, "Total items: ", "processed"),
        line(3, "Processed: ", "processed"), line(4, "Updated: ", "updated"),
        line(5, "Skipped: ", "skipped"), line(6, ""), line(7, "Not found SKUs (", "not_found"),
        line(9, ""), line(10, "Ambiguous SKUs (", "ambiguous"), line(12, ""),
        line(13, "Errors (", "errors"))))
    section = F.when(F.col("outcome") == "not_found", 8).when(F.col("outcome") == "ambiguous", 11).otherwise(14)
    body = checked.filter("outcome <> 'ok'").select(
        "invoice_id", section.alias("section"),
        F.concat(F.lit("  - "), F.coalesce("error", "sku")).alias("text"),
        F.struct(*item_order).alias("order"))
    return head.unionByName(body, allowMissingColumns=True)


def line_issues(quantity: Column, price: Column, total: Column, tolerance: float = 0.05) -> Column:
    """Findings of one extracted line: unreadable numbers, total off by more than
    the tolerance.  Numbers arrive as text, as in parsed records."""
    q, p, t = (c.try_cast("double") for c in (quantity, price, total))

    def unreadable(raw, value, label):
        return F.when(raw.isNotNull() & value.isNull(),
                      F.concat(F.lit(label + " '"), raw, F.lit("' is not a valid number")))

    missing = F.lit(0.0)
    off = F.abs(F.coalesce(q, missing) * F.coalesce(p, missing) - F.coalesce(t, missing)) > tolerance
    readable = ~((quantity.isNotNull() & q.isNull()) | (price.isNotNull() & p.isNull())
                 | (total.isNotNull() & t.isNull()))
    return F.array_compact(F.array(
        unreadable(quantity, q, "Quantity"), unreadable(price, p, "Unit price"),
        unreadable(total, t, "Total"),
        F.when(readable & off, F.lit("Calculated total differs from declared"))))


def missing_keys(record: Column) -> Column:
    """Required top-level keys a parsed JSON record lacks."""
    have = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), have)


def required_fields(vendor: Column, number: Column, date: Column) -> Column:
    """Errors for the missing vendor name, invoice number and invoice date."""

    def absent(c, text):
        return F.when(c.isNull() | (c == ""), F.lit(text))

    return F.array_compact(F.array(
        absent(vendor, "Vendor name is missing"), absent(number, "Invoice number is missing"),
        absent(date, "Invoice date is missing")))


def item_warnings(n_items: Column) -> Column:
    """Warnings about the lines of a record as a whole."""
    return F.array_compact(F.array(F.when(F.coalesce(n_items, F.lit(0)) == 0, F.lit("No order items found"))))


def subtotal_mismatch(items_sum: Column, shipping: Column, subtotal: Column, total: Column,
                      tolerance: float = 0.5) -> Column:
    """Neither the lines nor lines and shipping meet the declared subtotal (or,
    without one, the declared total)."""
    declared = F.coalesce(F.nullif(subtotal, F.lit(0).cast("double")), total)
    return F.coalesce((F.abs(items_sum - declared) > tolerance)
                      & (F.abs(items_sum + shipping - declared) > tolerance), F.lit(False))


def reconcile(invoices: DataFrame) -> DataFrame:
    """Passed / failed / passed with warning against an optional expected total.

    Needs items_total, n_items, shipping_fee, discount, tax, declared, expected and
    the vendor rule's ``relaxed_above``: with more items than that an invoice may be
    0.1 off instead of 0.05 (null: never).
    """
    total = adaptive_total(*[F.col(c) for c in (
        "items_total", "shipping_fee", "discount", "tax", "declared", "expected")])
    tolerance = F.when(F.col("n_items") > F.col("relaxed_above"), 0.1).otherwise(0.05)
    out = invoices.withColumn("total", total)
    failed = F.col("expected").isNotNull() & (F.abs(F.col("total") - F.col("expected")) > tolerance)
    return out.withColumn("status", F.when(failed, "failed").when(F.col("n_items") == 0, "warning")
                          .otherwise("passed"))


def vendor_line_checks(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Strict per-vendor checks: each vendor brings a tolerance and the checks it
    wants.  ``rules``: vendor, line_tolerance, needs_sku, needs_description."""
    priced = join_on_key(items, rules, ["vendor"], "inner")
    off = F.abs(F.col("quantity") * F.col("unit_price") - F.col("total")) > F.col("line_tolerance")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return priced.withColumn("issues", F.array_compact(F.array(
        F.when(F.col("needs_sku") & blank("sku"), F.lit("missing sku")),
        F.when(F.col("needs_description") & blank("description"), F.lit("missing description")),
        F.when(F.col("quantity") <= 0, F.lit("quantity not positive")),
        F.when(F.col("total") <= 0, F.lit("total not positive")),
        F.when(off, F.lit("line total mismatch")))))


def corrected_totals(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Declared totals replaced: subtotal from the lines, total with shipping and tax."""
    sums = items.groupBy("invoice_id").agg(F.sum(money(F.col("total"))).alias("subtotal"))
    return sums.join(invoices, "invoice_id").withColumn(
        "total", F.round(F.col("subtotal") + money(F.col("shipping_fee")) + money(F.col("tax")), 2))
