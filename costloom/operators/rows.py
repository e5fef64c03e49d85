"""Reducing a document's extracted rows: repeats, shipping, rates, first and last values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions import numbers
from costloom.functions.falsy import let, round_half_up
from costloom.operators.allocate import money
from costloom.operators.keyed import join_on_key

# Words of a shipping cell, several languages.
SHIPPING_CELL = "shipping|spedizione|envío|livraison|transport|fracht|frais"


def merged_references(items: DataFrame, reference: str, order: Sequence[str], document: str = "invoice_id") -> DataFrame:
    """Repeated references of a document as one line: quantities and totals add up,
    the first line's price stays."""
    return items.groupBy(document, reference).agg(
        F.sum("quantity").alias("quantity"), F.sum(money(F.col("total"))).cast("double").alias("total"),
        F.min_by("unit_price", F.struct(*order)).alias("unit_price"))


def first_of_equal(items: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, whole, of those equal in ``key`` (nulls are equal to each other)."""
    # As keys of a grouping, where 0.0 and -0.0 are one value.
    floats = {c: F.col(c) + F.lit(0.0).cast(t) for c, t in items.dtypes if c in key and t in ("double", "float")}
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return items.withColumns({**floats, "_nth": nth}).filter("_nth = 1").drop("_nth")


def shipping_fees(rows: DataFrame, footers: DataFrame, document: str = "invoice_id") -> DataFrame:
    """Shipping fee of every document: the footer's amount where there is one, else
    the sum of the positive totals of its shipping rows.

    ``rows``: the document's rows with ``is_shipping`` and total.  ``footers``: one row
    per document with ``footer_fee``.
    """
    total = money(F.col("total"))
    summed = rows.groupBy(document).agg(F.sum(F.when(F.col("is_shipping") & (total > 0), total)).cast("double").alias("_rows"))
    return summed.join(footers, document, "left").select(document, F.coalesce("footer_fee", "_rows").alias("shipping_fee"))


def first_rate(items: DataFrame, order: Sequence[str], default: float, document: str = "invoice_id") -> DataFrame:
    """Per document the first rate that is set (else ``default``) and how many differ."""
    place = F.when(F.col("rate").isNotNull(), F.struct(*order))
    return items.groupBy(document).agg(
        F.coalesce(F.min_by("rate", place), F.lit(default)).alias("vat_rate"), F.count_distinct("rate").alias("rates"))


def shipping_amounts(cells: DataFrame, document: str = "invoice_id", words: str = SHIPPING_CELL) -> DataFrame:
    """Amounts in a document's shipping cells: the largest and the last one in order.

    ``cells``: document, ``place`` (order) and ``cell`` (text).
    """
    amount = F.when(F.lower("cell").rlike(words), numbers.amount_in_text(F.col("cell")))
    return cells.groupBy(document).agg(
        F.max(amount).alias("largest"), F.max_by(amount, F.when(amount.isNotNull(), F.col("place"))).alias("last"))


def number_and_date(cells: DataFrame, document: str = "invoice_id") -> DataFrame:
    """First invoice number and first date of a document in reading order, and the
    last of each, for documents that repeat them corrected."""
    number = F.nullif(F.regexp_extract("cell", r"(?i)^(?:invoice|no\.?|n\.?|number)[\s:]*([A-Z0-9\-_]+)", 1), F.lit(""))
    found = F.regexp_extract("cell", r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", 0)
    day = let(F.split(F.nullif(found, F.lit("")), r"[/\-.]"), lambda parts: F.try_to_date(
        F.concat_ws("-", *[parts[n].try_cast("int").cast("string") for n in (2, 1, 0)]), "yyyy-M-d"))
    read = cells.select(document, "place", F.inline(F.array(F.struct(number.alias("number"), day.alias("day")))))
    number, day = F.col("number"), F.col("day")

    def at(v: Column) -> Column:
        return F.when(v.isNotNull(), F.col("place"))

    # Cells without either say nothing but that the document is there.
    told = read.filter(number.isNotNull() | day.isNotNull())
    there = cells.select(document).distinct()
    return told.unionByName(there, allowMissingColumns=True).groupBy(document).agg(
        F.min_by(number, at(number)).alias("invoice_number"), F.min_by(day, at(day)).alias("invoice_date"),
        F.max_by(number, at(number)).alias("last_number"), F.max_by(day, at(day)).alias("last_date"))


def completeness(items: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: lines, lines without ``value``, and the share that has it."""
    return items.groupBy(by).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col(value).isNull()).alias("missing"),
                                 (F.count(value) / F.count(F.lit(1))).alias("complete"))


def is_valid(sku: Column, description: Column, quantity: Column) -> Column:
    """A line with a code or a text, and a positive quantity."""
    return ((F.coalesce(sku, F.lit("")) != "") | (F.coalesce(description, F.lit("")) != "")) & (quantity > 0)


def is_plausible(sku: Column, quantity: Column, price: Column, total: Column) -> Column:
    """Amounts within the bounds of real lines and a code that is more than a number."""
    return ((price > 0) & (quantity > 0) & (total >= 0) & (quantity < 1000) & (price < 10000) & (total < 100000)
            & (F.length(sku) >= 3) & ~sku.rlike("^[0-9]+$"))


def is_known_code(sku: Column, pattern: str) -> Column:
    """A code of the kinds a vendor is known to use."""
    return F.coalesce(sku.rlike(pattern), F.lit(False))


def is_charged(description: Column, quantity: Column, price: Column, total: Column) -> Column:
    """False for rows of zeros and for transport rows."""
    zeros = (quantity == 0) & (price == 0) & (total == 0)
    return ~zeros & ~F.lower(description).contains("transport")


def row_totals(quantity: Column, price: Column, total: Column) -> tuple[Column, Column]:
    """(unit price, total): the total from price and quantity, else the price from
    total and quantity (4 places)."""
    return (F.coalesce(price, round_half_up(F.try_divide(total, quantity), 4)),
            F.coalesce(round_half_up(price * quantity, 2), total))


def with_edits(items: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines with edited quantities (``edited``, one row per key) and their new totals."""
    rows = join_on_key(items, edits, list(key))
    return rows.withColumns({
        "total": F.when(F.col("edited").isNotNull(), F.col("edited") * F.col("unit_price")).otherwise(F.col("total")),
        "quantity": F.coalesce("edited", "quantity")}).drop("edited")
