"""Spreading invoice-level amounts over lines, and money rules of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.operators.keyed import join_on_key

MONEY = "decimal(18,4)"
# Products of unrounded prices keep more places, so their sums stay exact to the cent.
PRECISE = "decimal(28,8)"


def money(value: Column) -> Column:
    """Amounts are summed as decimals, so the order of rows cannot change a sum."""
    return value.cast(MONEY)


def freight_per_unit(items: DataFrame, invoices: DataFrame, positive_only: bool = False) -> DataFrame:
    """Shipping fee over the summed quantity of *all* lines of the invoice.

    0 when the quantity is not positive; ``positive_only`` also ignores fees that
    are not positive.
    """
    totals = items.groupBy("invoice_id").agg(F.sum("quantity").alias("units"))
    usable = F.col("units") > 0
    if positive_only:
        usable &= F.col("shipping_fee") > 0
    fee = F.when(usable, F.col("shipping_fee") / F.col("units")).otherwise(F.lit(0.0))
    return totals.join(invoices.select("invoice_id", "shipping_fee"), "invoice_id", "left").select(
        "invoice_id", "units", F.coalesce("shipping_fee", F.lit(0.0)).alias("shipping_fee"),
        F.coalesce(fee, F.lit(0.0)).alias("freight_per_unit"))


def landed_price(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines with freight per unit and unit price including freight."""
    fee = freight_per_unit(items, invoices).select("invoice_id", "freight_per_unit")
    return join_on_key(items, fee, ["invoice_id"]).withColumn(
        "landed_price", F.col("unit_price") + F.col("freight_per_unit"))


def spread_discount(items: DataFrame, invoices: DataFrame, mode: str = "proportional") -> DataFrame:
    """Lines with their share of the (negative) invoice discount.

    ``proportional`` to the line total, or ``equal`` per line.  Untouched when
    the discount or the sum of totals is zero; a line without units keeps its
    price.
    """
    per_invoice = (
        items.groupBy("invoice_id")
        .agg(F.sum(money(F.col("total"))).cast("double").alias("gross"), F.count(F.lit(1)).alias("lines"))
        .join(invoices.select("invoice_id", "discount"), "invoice_id", "left")
    )
    share = (F.col("total") / F.col("gross") if mode == "proportional"
             else F.lit(1.0) / F.col("lines"))
    applies = (F.coalesce("discount", F.lit(0.0)) != 0) & (F.col("gross") != 0)
    adjusted = F.when(applies, F.col("total") + F.col("discount") * share).otherwise(F.col("total"))
    price = F.when(applies & (F.col("quantity") > 0), F.col("adj_total") / F.col("quantity")) \
        .otherwise(F.col("unit_price"))
    return (
        join_on_key(items, per_invoice, ["invoice_id"])
        .withColumn("adj_total", adjusted)
        .withColumn("adj_unit_price", price)
        .drop("gross", "lines", "discount")
    )


def invoice_totals(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Subtotal of the lines and grand total with shipping, two decimals."""
    sums = items.groupBy("invoice_id").agg(
        F.sum(money(F.col("total"))).alias("subtotal"),
        F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("lines"))
    return sums.join(invoices, "invoice_id").withColumn(
        "grand_total", F.round(F.col("subtotal") + money(F.col("shipping_fee")), 2))


def line_discount(price: Column, percent: Column, quantity: Column) -> tuple[Column, Column]:
    """Unit price (4 places) and total (2 places, half up) after a line discount.

    The total is taken from the exact discounted price, not the rounded one.
    """
    exact = price.cast("decimal(14,4)") * (
        F.lit(1).cast("decimal(6,4)") - (percent.cast("decimal(10,4)") * F.lit("0.01").cast("decimal(3,2)")))
    return F.round(exact, 4), F.round(exact * quantity.cast("decimal(10,2)"), 2)


def repaired_total(quantity: Column, price: Column, total: Column) -> Column:
    """Total, recomputed (half up) when missing, unreadable or below 0.01."""
    computed = F.round(quantity.cast("decimal(12,4)") * price.cast("decimal(14,4)"), 2)
    usable = total.cast(MONEY)
    both = (quantity != 0) & (price != 0)
    return F.when(usable.isNull() | ((usable < F.lit("0.01").cast("decimal(4,2)")) & both),
                  F.coalesce(computed, usable)).otherwise(usable)


def missing_total(quantity: Column, price: Column, total: Column, credit_vendor: Column) -> Column:
    """Line total where the paper has none: 0 for vendors whose missing total means
    a full credit, else quantity times price with two decimals."""
    return F.coalesce(
        total.cast("decimal(18,2)"),
        F.when(credit_vendor, F.lit(0).cast("decimal(18,2)")).otherwise(
            F.round(quantity.cast("decimal(12,4)") * price.cast("decimal(14,4)"), 2).cast("decimal(18,2)")))


def after_global_discount(value: Column, gross: Column, discount: Column) -> Column:
    """Amount reduced by discount / gross, two decimals, when both are positive."""
    applies = (gross > 0) & (discount > 0)
    return F.when(applies, F.round(value * (1 - discount / gross), 2)).otherwise(value)


def with_vat(price: Column, rate: Column) -> Column:
    """Net price plus VAT, two decimals."""
    exact = price.cast(MONEY) * (F.lit(1).cast("decimal(6,4)") + rate.cast("decimal(8,4)") * F.lit("0.01").cast("decimal(3,2)"))
    return F.round(exact, 2)


def margin_percent(price: Column, cost: Column) -> Column:
    """Margin on the selling price in percent; null for a zero price."""
    return F.try_divide(price - cost, price) * 100


def to_base_currency(amount: Column, rate: Column) -> Column:
    """Foreign amount at ``rate``, rounded to cents."""
    return F.round(amount.cast(MONEY) * rate.cast("decimal(12,6)"), 2)


def pack_size(description: Column) -> Column:
    """Units per pack named in a description ("24 x 50 g" -> 24), else 1."""
    return F.coalesce(F.regexp_extract(description, r"(?i)(\d+)\s*x", 1).try_cast("int"), F.lit(1))


def adaptive_total(items: Column, shipping: Column, discount: Column, tax: Column,
                   declared: Column, expected: Column, tolerance: float = 0.1) -> Column:
    """The invoice total that explains the declared one, tried in a fixed order.

    Lines alone, lines and shipping, everything; else the declared total when it
    is the expected one.  Whatever came out, the net total wins when it is the
    expected one.
    """

    def close(a, b):
        return F.abs(a - b) < tolerance

    full = items + shipping + discount + tax
    net = items + shipping + discount
    chosen = (
        F.when((declared.isNull()) | (declared == 0), full)
        .when(close(items, declared), items)
        .when(close(items + shipping, declared), items + shipping)
        .when(close(full, declared), full)
        .when(close(declared, expected), declared)
        .otherwise(full)
    )
    return F.when(close(net, expected), net).otherwise(chosen)


def complete_two_of_three(quantity: Column, price: Column, total: Column):
    """(quantity, price, total) with the missing one of price / total derived from the
    quantity as it is printed.

    The quantity itself becomes whole: the nearest integer within 0.1, else cut.
    """
    near = F.abs(quantity - F.round(quantity)) < 0.1
    whole = F.when(near, F.round(quantity)).otherwise(F.floor(quantity)).cast("long")
    return whole, F.coalesce(price, F.try_divide(total, quantity)), F.coalesce(total, quantity * price)


def price_and_total(quantity: Column, amounts: Column) -> tuple[Column, Column]:
    """(unit price, total) of the amounts a line prints: the last two.

    A single amount p is the unit price where |p * quantity - p| > p, as it is from
    more than two pieces on; else it is the total, and the price is its share.
    """
    n = F.size(amounts)
    last = F.get(amounts, n - 1)
    is_price = F.abs(last * quantity - last) > last
    return (F.when(n >= 2, F.get(amounts, n - 2)).when(is_price, last).otherwise(F.try_divide(last, quantity)),
            F.when(n >= 2, last).when(is_price, last * quantity).otherwise(last))


def declared_total(candidates: list[Column], items: Column, shipping: Column) -> Column:
    """The first candidate that is not below the lines; else lines and shipping."""
    return F.coalesce(*[F.when(c >= items, c) for c in candidates], items + shipping)


def totals_by_precedence(text_subtotal: Column, text_total: Column, vat: Column, items: Column) -> tuple[Column, Column]:
    """(subtotal, total): amounts read from the text win when positive; else the lines,
    and the subtotal plus VAT where that is known."""
    subtotal = F.coalesce(F.when(text_subtotal > 0, text_subtotal), items)
    return subtotal, F.when(text_total > 0, text_total).when(vat > 0, subtotal + vat).otherwise(subtotal)
