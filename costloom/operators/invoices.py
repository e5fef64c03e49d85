"""Whole documents to whole invoices: one call for every strategy a vendor rule can name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.operators import extract, quality
from costloom.operators.keyed import Keys
from costloom.operators.layout import first_source
from costloom.operators.ordered import row_numbers
from costloom.operators.rows import first_of_equal
from costloom.sources.documents import lines_of

# In the order in which they are asked; a strategy is followed by those after it.
STRATEGIES = ["pdfplumber_table", "text_regex", "text_regex_multiline"]
FLAGS = ["merge_negative", "first_of_equal_rows"]
EQUAL = ["sku", "quantity", "total", "unit_price", "description"]


def _asked(rules: DataFrame, strategy: str) -> DataFrame:
    """Rules to ask by ``strategy``, their own first (``rank``): one that reads text also
    stands in for the strategies before it, if it has a row pattern."""
    place = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    own = STRATEGIES.index(strategy) + 1
    stands_in = (place < own) & F.col("row_pattern").isNotNull()
    return rules.filter((place == own) | stands_in).withColumns({"rank": F.lit(own) - place, "strategy": F.lit(strategy)})


def rows_of_documents(docs: DataFrame, grids: DataFrame, rules: DataFrame, max_rows: int | None = None,
                      measure: Keys | None = None) -> DataFrame:
    """Item and shipping rows of every document, by the first strategy that finds any.

    ``docs``: doc_id, vendor, text.  ``grids``: doc_id, vendor, table_no, row_no, cells.
    Columns: doc_id, vendor, ``method``, ``place`` (orders a document's rows), row_kind and
    the item values as texts.
    """
    long = lambda *names: F.struct(*[F.col(n).cast("long").alias(f"p{i}") for i, n in enumerate(names)])
    tables = extract.table_items(grids, _asked(rules, STRATEGIES[0]), max_rows, measure, with_shipping=True)
    by_line = extract.text_items(lines_of(docs), _asked(rules, STRATEGIES[1]), max_rows, measure, with_shipping=True)
    anywhere = extract.region_items(docs, _asked(rules, STRATEGIES[2]), with_shipping=True)
    found = None
    for rank, (method, rows, place) in enumerate((
            ("table", tables, long("table_no", "row_no", "sub")), ("lines", by_line.withColumn("_z", F.lit(0)), long("line_no", "_z", "_z")),
            ("text", anywhere.withColumn("_z", F.lit(0)), long("variant", "pos", "_z")))):
        one = rows.select("doc_id", "vendor", F.lit(method).alias("method"), F.lit(rank).alias("rank"), place.alias("place"), "row_kind", *extract.ITEM_VALUES)
        found = one if found is None else found.unionByName(one)
    return first_source(found, measure=measure).drop("rank")


def invoice_rows(docs: DataFrame, grids: DataFrame, rules: DataFrame, max_rows: int | None = None, measure: Keys | None = None) -> DataFrame:
    """``rows_of_documents`` with numbers, after the flags of the vendors' rules.

    Rules with ``first_of_equal_rows`` keep the first of equal rows, those with
    ``merge_negative`` put a negative line into the item above it.
    """
    flags = rules.select("vendor", *FLAGS)
    rows = rows_of_documents(docs, grids, rules, max_rows, measure)
    rows = extract.join_rules(rows, flags, "left", docs.select(F.lower(F.trim("vendor")).alias("vendor")))
    numbers = {c: F.col(c).try_cast("double") for c in ("quantity", "unit_price", "total")}
    rows = rows.withColumns(numbers)
    # Rows of other vendors differ by their place.
    rows = rows.withColumn("_apart", F.when(~F.col("first_of_equal_rows"), F.col("place")))
    once = first_of_equal(rows, ["doc_id", "row_kind", *EQUAL, "_apart"], ["place"]).drop("_apart")
    # Items and shipping rows are numbered apart, so that what follows an item is an item.
    # The keys begin with the document: all of its rows stay where they met.
    apart = ("doc_id", "row_kind")
    numbered = row_numbers(once, apart, ["place"], "pos", bounded=True)
    applies = F.col("merge_negative") & (F.col("row_kind") == "item")
    lines = extract.merge_negative(numbered, rest=("vendor", "method", "description", "merge_negative"), applies=applies, bounded=True, within=apart)
    return lines.drop("merge_negative")


def extract_items(docs: DataFrame, grids: DataFrame, rules: DataFrame, max_rows: int | None = None, measure: Keys | None = None) -> DataFrame:
    """Items of documents: doc_id, vendor, method, pos, sku, description, quantity, unit_price, total, lines."""
    return invoice_rows(docs, grids, rules, max_rows, measure).filter("row_kind = 'item'").drop("row_kind")


def extract_invoices(docs: DataFrame, grids: DataFrame, rules: DataFrame, max_rows: int | None = None, measure: Keys | None = None) -> DataFrame:
    """Invoices of documents: header fields, the lines' sum, the shipping fee of their
    rows, what the footer says in place of what was computed, ``issues`` and ``verdict``."""
    rows, is_item = invoice_rows(docs, grids, rules, max_rows, measure), F.col("row_kind") == "item"
    total = F.col("total").cast("decimal(18,4)")
    sums = rows.groupBy("doc_id").agg(
        F.count_if(is_item).alias("n_items"), F.min(F.when(is_item, F.col("method"))).alias("method"),
        F.sum(F.when(is_item, total)).cast("double").alias("items_total"),
        F.sum(F.when(~is_item & (total > 0), total)).cast("double").alias("shipping_fee"))
    found = extract.prepared(docs, rules).select(
        "doc_id", "vendor", "currency", extract.fields(F.col("text"), F.col("header")).alias("header"),
        extract.fields(F.col("text"), F.col("footer")).alias("footer"))
    whole = found.join(sums, "doc_id", "left").fillna(0, ["n_items", "items_total", "shipping_fee"])
    computed = F.map_from_arrays(F.array(F.lit("subtotal"), F.lit("shipping_fee")), F.array(F.col("items_total").cast("string"), F.col("shipping_fee").cast("string")))
    totals = extract.with_footer(F.col("footer"), computed)
    amount = lambda name: F.try_element_at("totals", F.lit(name)).try_cast("double")
    whole = whole.withColumn("totals", totals).withColumns({"subtotal": amount("subtotal"), "shipping_fee": amount("shipping_fee")})
    whole = whole.withColumn("total", F.coalesce(amount("total"), F.round(F.col("subtotal") + F.col("shipping_fee"), 2)))
    field = lambda name: F.try_element_at("header", F.lit(name))
    errors = quality.required_fields(F.col("vendor"), field("invoice_number"), field("invoice_date"))
    off = quality.subtotal_mismatch(F.col("items_total"), F.col("shipping_fee"), F.col("subtotal"), F.col("total"))
    warnings = F.concat(quality.item_warnings(F.col("n_items")), F.array_compact(F.array(F.when(off, F.lit("Lines do not add up to the subtotal")))))
    whole = whole.withColumns({"errors": errors, "warnings": warnings})
    verdict = F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")
    return whole.select(
        "doc_id", "vendor", "currency", "method", field("invoice_number").alias("invoice_number"), field("invoice_date").alias("invoice_date"),
        "n_items", "items_total", "subtotal", "shipping_fee", "total", F.concat("errors", "warnings").alias("issues"), verdict.alias("verdict"))
