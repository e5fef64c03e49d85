"""Queries: totals, discounts, tax, currency, reconciliation, data quality."""

from pyspark.sql import functions as F

from costloom.functions.numbers import as_text
from costloom.operators import allocate, quality
from costloom.operators import rows as rows_of
from costloom.operators.allocate import money
from costloom.operators.keyed import join_on_key
from costloom.operators.projections import canonical_totals
from costloom.plans.registry import query
from costloom.plans.roles import INVOICES, ITEM_ORDER, ITEMS, cents, cents_sql, with_roles

LINE = ["invoice_id", "line_no", "supplier_id", "part_id", "quantity", "total"]
LINE_SQL = ", ".join(LINE)
EXACT_TOTAL = "CAST(total AS DECIMAL(18,4))"


@query("ag_03_invoice_totals", with_roles(ITEMS, INVOICES, body=f"""
SELECT invoice_id, CAST(sum({EXACT_TOTAL}) AS DOUBLE) AS subtotal,
  CAST(round(sum({EXACT_TOTAL}) + CAST(any_value(shipping_fee) AS DECIMAL(18,4)), 2) AS DOUBLE) AS grand_total
FROM items JOIN invoices USING (invoice_id) GROUP BY invoice_id"""))
def _(r):
    return allocate.invoice_totals(r.items, r.invoices).select(
        "invoice_id", F.col("subtotal").cast("double"), F.col("grand_total").cast("double"))


@query("ag_04_missing_subtotal", with_roles(ITEMS, body=f"""
SELECT invoice_id, {cents_sql("sum(CASE WHEN part_id % 5 = 0 THEN quantity * round(unit_price + 1e-7, 2) ELSE total END)")} AS subtotal
FROM items GROUP BY invoice_id"""))
def _(r):
    """Line totals where present, else quantity times price."""
    total = F.when(F.col("part_id") % 5 != 0, F.col("total"))
    price = cents(F.col("unit_price"))
    return r.items.groupBy("invoice_id").agg(cents(F.sum(F.coalesce(
        total.cast(allocate.PRECISE), (F.col("quantity") * price).cast(allocate.PRECISE)))).alias("subtotal"))


GROSS = f"""gross AS (SELECT i.*, v.discount, CAST(sum({EXACT_TOTAL}) OVER (PARTITION BY invoice_id) AS DOUBLE) AS gross,
    count(*) OVER (PARTITION BY invoice_id) AS lines FROM items i JOIN invoices v USING (invoice_id))"""


@query("wn_13_discount_allocation", with_roles(ITEMS, INVOICES, GROSS, body=f"""
SELECT {LINE_SQL}, CASE WHEN discount <> 0 AND gross <> 0 THEN total + discount * (total / gross) ELSE total END AS adj_total,
  CASE WHEN discount <> 0 AND gross <> 0 AND quantity > 0 THEN (total + discount * (total / gross)) / quantity ELSE unit_price END AS adj_unit_price
FROM gross"""))
def _(r):
    return allocate.spread_discount(r.items, r.invoices).select(*LINE, "adj_total", "adj_unit_price")


@query("mn_11_discount_per_line", with_roles(ITEMS, INVOICES, GROSS, body=f"""
SELECT {LINE_SQL}, CASE WHEN discount <> 0 AND gross <> 0 THEN total + discount * (1.0::DOUBLE / lines) ELSE total END AS adj_total,
  CASE WHEN discount <> 0 AND gross <> 0 AND quantity > 0 THEN (total + discount * (1.0::DOUBLE / lines)) / quantity ELSE unit_price END AS adj_unit_price
FROM gross"""))
def _(r):
    """The same discount shared equally instead of by value."""
    return allocate.spread_discount(r.items, r.invoices, "equal").select(*LINE, "adj_total", "adj_unit_price")


@query("mn_01_line_discount", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(round(CAST(l_extendedprice AS DECIMAL(14,4)) * (1 - CAST(l_discount * 100 AS DECIMAL(10,4)) * CAST(0.01 AS DECIMAL(3,2))), 4) AS DOUBLE) AS unit_price,
  CAST(round(CAST(l_extendedprice AS DECIMAL(20,4)) * (1 - CAST(l_discount * 100 AS DECIMAL(10,4)) * CAST(0.01 AS DECIMAL(3,2))) * CAST(l_quantity AS DECIMAL(10,2)), 2) AS DOUBLE) AS total
FROM lineitem""")
def _(r):
    price, total = allocate.line_discount(F.col("l_extendedprice"), F.col("l_discount") * 100, F.col("l_quantity"))
    return r.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                      price.cast("double").alias("unit_price"), total.cast("double").alias("total"))


@query("mn_02_repaired_total", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, quantity, CAST(CASE WHEN part_id % 4 < 2
  THEN round(CAST(quantity AS DECIMAL(12,4)) * CAST(total AS DECIMAL(14,4)), 2) ELSE CAST(total AS DECIMAL(18,2)) END AS DOUBLE) AS total FROM items"""))
def _(r):
    """A quarter of the totals is missing, another quarter below one cent."""
    k, price = F.col("part_id") % 4, F.col("total")
    total = F.when(k == 0, None).when(k == 1, 0.005).otherwise(F.col("total"))
    fixed = allocate.repaired_total(F.col("quantity"), price, total)
    return r.items.select("invoice_id", "line_no", "supplier_id", "part_id", "quantity", fixed.cast("double").alias("total"))


@query("mn_03_missing_total", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, quantity, CAST(CASE WHEN part_id % 3 > 0 THEN CAST(total AS DECIMAL(18,2))
  WHEN supplier_id % 2 = 0 THEN 0 ELSE round(CAST(quantity AS DECIMAL(12,4)) * CAST(total AS DECIMAL(14,4)), 2) END AS DOUBLE) AS total FROM items"""))
def _(r):
    total = F.when(F.col("part_id") % 3 > 0, F.col("total"))
    out = allocate.missing_total(F.col("quantity"), F.col("total"), total, F.col("supplier_id") % 2 == 0)
    return r.items.select("invoice_id", "line_no", "supplier_id", "part_id", "quantity", out.cast("double").alias("total"))


@query("mn_04_global_discount", with_roles(ITEMS, INVOICES, GROSS, body=f"""
SELECT {LINE_SQL}, round(total * (1 - 250 / gross) + 1e-7, 2) AS net_total, round(unit_price * (1 - 250 / gross) + 1e-7, 2) AS net_price FROM gross"""))
def _(r):
    """Gross minus discount over gross, applied to every line's total and unit price."""
    gross = r.items.groupBy("invoice_id").agg(F.sum(money(F.col("total"))).cast("double").alias("gross"))
    lines = join_on_key(r.items, gross, ["invoice_id"])
    net = allocate.after_global_discount(F.col("total") + 1e-7, F.col("gross"), F.lit(250.0))
    price = allocate.after_global_discount(F.col("unit_price") + 1e-7, F.col("gross"), F.lit(250.0))
    return lines.select(*LINE, net.alias("net_total"), price.alias("net_price"))


@query("mn_06_vat_uplift", with_roles(ITEMS, INVOICES, body="""
SELECT invoice_id, line_no, supplier_id, part_id, quantity, total,
  CAST(round(CAST(total AS DECIMAL(18,4)) * (1 + CAST(tax_rate * 100 AS DECIMAL(8,4)) * CAST(0.01 AS DECIMAL(3,2))), 2) AS DOUBLE) AS gross_price,
  CAST(round(CAST(shipping_fee AS DECIMAL(18,4)) * CAST(1.2 AS DECIMAL(6,4)), 2) AS DOUBLE) AS gross_shipping
FROM items JOIN invoices USING (invoice_id)"""))
def _(r):
    lines = join_on_key(r.items, r.invoices.select("invoice_id", "shipping_fee"), ["invoice_id"], "inner")
    return lines.select(*LINE, allocate.with_vat(F.col("total"), F.col("tax_rate") * 100).cast("double").alias("gross_price"),
                        allocate.with_vat(F.col("shipping_fee"), F.lit(20.0)).cast("double").alias("gross_shipping"))


BOOKS = f"""books AS (
  SELECT invoice_id, CAST(sum({EXACT_TOTAL}) AS DOUBLE) AS items_total, count(*) AS n_items, any_value(shipping_fee) AS shipping_fee,
    any_value(discount) AS discount, CAST(round(any_value(CAST(declared_total AS DECIMAL(18,2))) * CAST(0.05 AS DECIMAL(3,2)), 2) AS DOUBLE) AS tax
  FROM items JOIN invoices USING (invoice_id) GROUP BY invoice_id),
declared AS (
  SELECT *, CASE invoice_id % 6 WHEN 0 THEN items_total WHEN 1 THEN items_total + shipping_fee
      WHEN 2 THEN items_total + shipping_fee + discount + tax WHEN 3 THEN items_total * 2 WHEN 4 THEN 0 ELSE items_total * 3 END AS declared,
    CASE invoice_id % 6 WHEN 3 THEN items_total * 2 WHEN 4 THEN NULL WHEN 5 THEN items_total + shipping_fee + discount ELSE items_total END AS expected,
    CASE WHEN invoice_id % 2 = 0 THEN 3 WHEN invoice_id % 7 = 0 THEN 50 END AS relaxed_above FROM books),
settled AS (
  SELECT *, CASE WHEN abs(items_total + shipping_fee + discount - expected) < 0.1 THEN items_total + shipping_fee + discount
    WHEN declared IS NULL OR declared = 0 THEN items_total + shipping_fee + discount + tax
    WHEN abs(items_total - declared) < 0.1 THEN items_total
    WHEN abs(items_total + shipping_fee - declared) < 0.1 THEN items_total + shipping_fee
    WHEN abs(items_total + shipping_fee + discount + tax - declared) < 0.1 THEN items_total + shipping_fee + discount + tax
    WHEN abs(declared - expected) < 0.1 THEN declared
    ELSE items_total + shipping_fee + discount + tax END AS total FROM declared)"""
BOOK_ROLES = (ITEMS, INVOICES, BOOKS)


def books(r):
    """Invoices with every way a declared and an expected total can relate."""
    sums = r.items.groupBy("invoice_id").agg(
        F.sum(money(F.col("total"))).cast("double").alias("items_total"), F.count(F.lit(1)).alias("n_items"))
    tax = F.round(F.col("declared_total").cast("decimal(18,2)") * F.lit("0.05").cast("decimal(3,2)"), 2).cast("double")
    b = sums.join(r.invoices, "invoice_id").withColumn("tax", tax)
    k = F.col("invoice_id") % 6
    items, ship, disc, tax = (F.col(c) for c in ("items_total", "shipping_fee", "discount", "tax"))
    declared = (F.when(k == 0, items).when(k == 1, items + ship).when(k == 2, items + ship + disc + tax)
                .when(k == 3, items * 2).when(k == 4, 0.0).otherwise(items * 3))
    expected = (F.when(k == 3, items * 2).when(k == 4, None).when(k == 5, items + ship + disc).otherwise(items))
    return b.select("invoice_id", "items_total", "n_items", "shipping_fee", "discount", "tax",
                    declared.alias("declared"), expected.alias("expected"),
                    F.when(F.col("invoice_id") % 2 == 0, 3).when(F.col("invoice_id") % 7 == 0, 50).alias("relaxed_above"))


@query("mn_07_adaptive_total", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, declared, expected, total FROM settled"""))
def _(r):
    return quality.reconcile(books(r)).select("invoice_id", "declared", "expected", "total")


STATUS = """CASE WHEN expected IS NOT NULL AND abs(total - expected) > CASE WHEN n_items > relaxed_above THEN 0.1 ELSE 0.05 END
  THEN 'failed' WHEN n_items = 0 THEN 'warning' ELSE 'passed' END AS status"""


@query("dq_06_expected_total", with_roles(*BOOK_ROLES, body=f"""
SELECT invoice_id, total, expected, {STATUS} FROM settled"""))
def _(r):
    return quality.reconcile(books(r)).select("invoice_id", "total", "expected", "status")


@query("jn_07_expected_total_lookup", with_roles(*BOOK_ROLES, body="""
SELECT d.invoice_id, items_total, e.expected AS known FROM declared d LEFT JOIN (SELECT invoice_id, expected FROM declared WHERE invoice_id % 3 = 0 AND expected IS NOT NULL) e USING (invoice_id)"""))
def _(r):
    """Documents with the total expected for them, where one is on file."""
    b = books(r)
    known = b.filter("invoice_id % 3 = 0 and expected is not null").select("invoice_id", F.col("expected").alias("known"))
    return b.select("invoice_id", "items_total").join(known, "invoice_id", "left")


@query("ag_11_vendor_report", with_roles(*BOOK_ROLES, body=f"""
SELECT invoice_id % 10 AS vendor, count(*) AS tests, count(*) FILTER (status = 'passed') AS passed,
  count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'failed') AS failed
FROM (SELECT *, {STATUS} FROM settled) x GROUP BY ROLLUP (invoice_id % 10)"""))
def _(r):
    """Reconciliation outcome per vendor and in total."""
    done = quality.reconcile(books(r)).withColumn("vendor", F.col("invoice_id") % 10)
    n = lambda s: F.count_if(F.col("status") == s)
    return done.rollup("vendor").agg(F.count(F.lit(1)).alias("tests"), n("passed").alias("passed"),
                                     n("warning").alias("warnings"), n("failed").alias("failed"))


@query("mn_09_currency", """
SELECT o_orderkey, c_nationkey AS currency, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)) * CAST(0.5 + c_nationkey * 0.037 AS DECIMAL(12,6)), 2) AS DOUBLE) AS base_total
FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(r):
    """Order totals at the rate of the customer's country, in cents."""
    rates = r.table("nation").select(
        F.col("n_nationkey").alias("currency"),
        (F.lit("0.5").cast("decimal(12,6)") + F.col("n_nationkey") * F.lit("0.037").cast("decimal(12,6)")).alias("rate"))
    buyers = r.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("currency"))
    rated = buyers.join(rates, "currency")
    return join_on_key(r.table("orders").select("o_orderkey", "o_custkey", "o_totalprice"), rated, ["o_custkey"], "inner").select(
        "o_orderkey", "currency", allocate.to_base_currency(F.col("o_totalprice"), F.col("rate")).cast("double").alias("base_total"))


@query("mn_10_pack_split", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size END AS units, p_retailprice / CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_size END AS unit_price FROM part""")
def _(r):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" "), "p_size", F.lit(" X 50 g")))
    units = allocate.pack_size(name)
    return r.table("part").select("p_partkey", units.alias("units"), F.try_divide("p_retailprice", units).alias("unit_price"))


@query("mn_13_two_of_three", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total AS line, CAST(CASE part_id % 4 WHEN 0 THEN quantity + 1 WHEN 1 THEN quantity ELSE quantity END AS BIGINT) AS quantity,
  CASE part_id % 3 WHEN 0 THEN total / q ELSE unit_price END AS price, CASE part_id % 3 WHEN 1 THEN q * unit_price ELSE total END AS total
FROM (SELECT *, quantity + CASE part_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.04 WHEN 2 THEN 0.6 ELSE 0 END::DOUBLE AS q FROM items) x"""))
def _(r):
    """What is missing comes from the raw quantity; then the quantity becomes whole."""
    k, part = F.col("part_id") % 3, F.col("part_id") % 4
    raw = F.col("quantity") + F.when(part == 0, 0.95).when(part == 1, 0.04).when(part == 2, 0.6).otherwise(0.0)
    q, p, t = allocate.complete_two_of_three(raw, F.when(k != 0, F.col("unit_price")), F.when(k != 1, F.col("total")))
    return r.items.select("invoice_id", "line_no", "supplier_id", "part_id", F.col("total").alias("line"), q.alias("quantity"), p.alias("price"), t.alias("total"))


@query("mn_13_single_amount", with_roles(ITEMS, body="""
, printed AS (SELECT *, CASE part_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 ELSE 0.5 END::DOUBLE AS q, unit_price AS p FROM items)
SELECT invoice_id, line_no, supplier_id, part_id, total AS line, q AS quantity,
  CASE WHEN abs(p * q - p) > p THEN p ELSE p / q END AS price, CASE WHEN abs(p * q - p) > p THEN p * q ELSE p END AS total FROM printed"""))
def _(r):
    """A line that prints one amount only prints its unit price or its total, told by the quantity."""
    part = F.col("part_id") % 4
    quantity = F.when(part == 0, 1.0).when(part == 1, 2.0).when(part == 2, 3.0).otherwise(0.5)
    price, total = allocate.price_and_total(quantity, F.array(F.col("unit_price")))
    return r.items.select("invoice_id", "line_no", "supplier_id", "part_id", F.col("total").alias("line"), quantity.alias("quantity"), price.alias("price"), total.alias("total"))


@query("ag_24_declared_total_pattern", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, CASE WHEN items_total * 0.9 >= items_total THEN items_total * 0.9
  WHEN items_total + (invoice_id % 3 - 1) >= items_total THEN items_total + (invoice_id % 3 - 1) ELSE items_total + shipping_fee END AS total FROM books"""))
def _(r):
    """First candidate, in order, that is not below the lines; else lines and shipping."""
    b, items = books(r), F.col("items_total")
    first, second = items * 0.9, items + (F.col("invoice_id") % 3 - 1)
    return b.select("invoice_id", allocate.declared_total([first, second], items, F.col("shipping_fee")).alias("total"))


@query("ag_26_totals_precedence", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, subtotal, CASE WHEN declared > 0 THEN declared WHEN tax > 0 AND invoice_id % 4 <> 0 THEN subtotal + tax ELSE subtotal END AS total
FROM (SELECT *, CASE WHEN invoice_id % 5 = 0 THEN items_total * 1.5 ELSE items_total END AS subtotal FROM declared) x"""))
def _(r):
    """Text amounts win when positive; else the lines, plus VAT where known."""
    text_subtotal = F.when(F.col("invoice_id") % 5 == 0, F.col("items_total") * 1.5)
    vat = F.when(F.col("invoice_id") % 4 != 0, F.col("tax"))
    subtotal, total = allocate.totals_by_precedence(text_subtotal, F.col("declared"), vat, F.col("items_total"))
    return books(r).select("invoice_id", subtotal.alias("subtotal"), total.alias("total"))


@query("prj_04_canonical_invoice", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, shipping_fee, CASE WHEN invoice_id % 3 = 0 THEN 0 ELSE discount END AS discount, items_total AS subtotal, total,
  CASE WHEN invoice_id % 4 = 0 THEN tax WHEN total > items_total THEN greatest(0, total - items_total - shipping_fee) ELSE 0 END AS tax
FROM (SELECT *, CASE WHEN invoice_id % 2 = 0 THEN items_total + shipping_fee + 12.5 ELSE items_total - 1 END AS total FROM books) x"""))
def _(r):
    """Parsed totals (all text) to typed amounts; a missing tax is derived."""
    k, items, ship = F.col("invoice_id"), F.col("items_total"), F.col("shipping_fee")
    total = F.when(k % 2 == 0, items + ship + 12.5).otherwise(items - 1)
    pairs = F.map_filter(F.create_map(
        F.lit("shipping_fee"), ship.cast("string"), F.lit("credit"), F.when(k % 3 == 0, "0.0"),
        F.lit("discount"), F.col("discount").cast("string"), F.lit("tax"), F.when(k % 4 == 0, F.col("tax").cast("string")),
        F.lit("subtotal"), items.cast("string"), F.lit("total"), total.cast("string")), lambda k, v: v.isNotNull())
    parsed = books(r).select("invoice_id", pairs.alias("totals"))
    return parsed.select("invoice_id", *canonical_totals(F.col("totals")))


# --- data quality -------------------------------------------------------------

TEXT_ITEMS = """texts AS (
  SELECT *, CASE WHEN part_id % 19 = 0 THEN 'twelve' WHEN part_id % 23 <> 0 THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS q,
    CASE WHEN part_id % 29 = 0 THEN 'n/a' ELSE CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR) END AS t FROM items),
issues AS (
  SELECT *, CASE WHEN q = 'twelve' THEN 1 ELSE 0 END + CASE WHEN t = 'n/a' THEN 1 ELSE 0 END AS unreadable,
    CASE WHEN coalesce(q, '') <> 'twelve' AND t <> 'n/a' AND abs(coalesce(TRY_CAST(q AS DOUBLE), 0) * round(unit_price + 1e-7, 2) - TRY_CAST(t AS DOUBLE)) > 0.05 THEN 1 ELSE 0 END AS off
  FROM texts)"""


def issue_items(r):
    part = F.col("part_id")
    q = F.when(part % 19 == 0, "twelve").when(part % 23 != 0, as_text(F.col("quantity")))
    t = F.when(part % 29 == 0, "n/a").otherwise(F.col("total").cast("decimal(18,2)").cast("string"))
    found = quality.line_issues(q, cents(F.col("unit_price")).cast("string"), t)
    return r.items.withColumn("issues", found)


def unreadable():
    return F.size(F.filter("issues", lambda m: m.endswith("is not a valid number")))


def off():
    return F.size(F.filter("issues", lambda m: m.startswith("Calculated total")))


@query("dq_03_numeric_fields", with_roles(ITEMS, TEXT_ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total, unreadable FROM issues"""))
def _(r):
    return issue_items(r).select("invoice_id", "line_no", "supplier_id", "part_id", "total", unreadable().alias("unreadable"))


@query("dq_04_line_arithmetic", with_roles(ITEMS, TEXT_ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total, off FROM issues"""))
def _(r):
    return issue_items(r).select("invoice_id", "line_no", "supplier_id", "part_id", "total", off().alias("off"))


@query("dq_05_subtotal_check", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, abs(items_total - s) > 0.5 AND abs(items_total + shipping_fee - s) > 0.5 AS mismatch
FROM (SELECT *, CASE WHEN invoice_id % 7 = 0 THEN items_total * 2 ELSE CASE WHEN declared = 0 THEN items_total + 0.4 ELSE declared END END AS s FROM declared) x"""))
def _(r):
    declared = F.col("declared")
    total = F.when(F.col("invoice_id") % 7 == 0, F.col("items_total") * 2).otherwise(F.col("items_total") + 0.4)
    subtotal = F.when(F.col("invoice_id") % 7 != 0, declared)
    return books(r).select("invoice_id", quality.subtotal_mismatch(
        F.col("items_total"), F.col("shipping_fee"), subtotal, total).alias("mismatch"))


@query("dq_01_required_keys", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'customer,metadata' WHEN 2 THEN 'vendor,customer,order_items,totals,metadata' ELSE 'vendor' END AS missing FROM events""")
def _(r):
    k = F.col("event_id") % 4
    full = '"vendor": {}, "customer": {}, "order_items": [], "totals": {}, "metadata": {}'
    record = (F.when(k == 0, F.lit("{" + full + "}")).when(k == 1, '{"vendor": {}, "order_items": [], "totals": 1}')
              .when(k == 2, F.col("props")).otherwise("{" + full.replace('"vendor"', '"seller"') + "}"))
    return r.table("events").select("event_id", F.array_join(quality.missing_keys(record), ",").alias("missing"))


@query("st_04_missing_keys", """
SELECT event_id, 5 - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS n_missing FROM events""")
def _(r):
    """Required keys minus the keys a record has."""
    record = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"totals": {}, "k": 1}')
    return r.table("events").select("event_id", F.size(quality.missing_keys(record)).alias("n_missing"))


@query("dq_02_required_fields", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, CASE WHEN invoice_id % 3 = 0 THEN 'Vendor name is missing' ELSE '' END AS vendor_errors,
  (CASE WHEN invoice_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN invoice_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN invoice_id % 5 = 0 THEN 1 ELSE 0 END) AS n_errors,
  CASE WHEN n_items < 3 THEN 'No order items found' ELSE '' END AS warnings FROM books"""))
def _(r):
    k = F.col("invoice_id")
    errors = quality.required_fields(F.when(k % 3 == 0, "").otherwise("vendor"), F.when(k % 4 != 0, k.cast("string")),
                                     F.when(k % 5 != 0, "2024-01-31"))
    only_vendor = F.filter(errors, lambda m: m.startswith("Vendor"))
    return books(r).select("invoice_id", F.array_join(only_vendor, ",").alias("vendor_errors"), F.size(errors).alias("n_errors"),
                           F.array_join(quality.item_warnings(F.greatest(F.col("n_items") - 2, F.lit(0))), ",").alias("warnings"))


@query("dq_10_base_check", with_roles(INVOICES, body="""
SELECT invoice_id, invoice_id % 4 <> 0 AS valid FROM invoices"""))
def _(r):
    """Name, number and date present."""
    errors = quality.required_fields(F.lit("vendor"), F.when(F.col("invoice_id") % 4 != 0, F.col("invoice_id").cast("string")),
                                     F.col("invoice_date").cast("string"))
    return r.invoices.select("invoice_id", (F.size(errors) == 0).alias("valid"))


VENDOR_RULES = """vendor_rules AS (SELECT s_suppkey AS supplier_id, CASE s_suppkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 1.0 ELSE 100.0 END AS line_tolerance,
    s_suppkey % 2 = 0 AS needs_sku, s_suppkey % 5 = 0 AS needs_description FROM supplier)"""


@query("dq_07_vendor_rules", with_roles(ITEMS, VENDOR_RULES, body="""
, x AS (SELECT i.*, r.*, abs(quantity * round(unit_price, 1) - total) > line_tolerance AS off FROM items i JOIN vendor_rules r USING (supplier_id))
SELECT supplier_id AS vendor, count(*) AS lines, count(*) FILTER (off) AS mismatches,
  count(*) FILTER (needs_sku AND part_id % 31 = 0) AS no_sku, count(*) FILTER (needs_description) AS no_description FROM x GROUP BY 1"""))
def _(r):
    """Each vendor is checked with its own tolerance and required fields."""
    s = F.col("s_suppkey")
    rules = r.table("supplier").select(
        s.alias("vendor"), F.when(s % 3 == 0, 0.01).when(s % 3 == 1, 1.0).otherwise(100.0).alias("line_tolerance"),
        (s % 2 == 0).alias("needs_sku"), (s % 5 == 0).alias("needs_description"))
    items = r.items.select(F.col("supplier_id").alias("vendor"), "quantity", F.round("unit_price", 1).alias("unit_price"), "total",
                           F.when(F.col("part_id") % 31 != 0, F.col("sku")).alias("sku"), F.lit(" ").alias("description"))
    has = lambda m: F.count_if(F.array_contains("issues", m))
    return quality.vendor_line_checks(items, rules).groupBy("vendor").agg(
        F.count(F.lit(1)).alias("lines"), has("line total mismatch").alias("mismatches"),
        has("missing sku").alias("no_sku"), has("missing description").alias("no_description"))


@query("dq_08_corrected_totals", with_roles(*BOOK_ROLES, body="""
SELECT invoice_id, items_total AS subtotal, CAST(round(CAST(items_total AS DECIMAL(18,4)) + CAST(shipping_fee AS DECIMAL(18,4)) + CAST(tax AS DECIMAL(18,4)), 2) AS DOUBLE) AS total FROM books"""))
def _(r):
    out = quality.corrected_totals(r.items, books(r).select("invoice_id", "shipping_fee", "tax"))
    return out.select("invoice_id", F.col("subtotal").cast("double"), F.col("total").cast("double"))


@query("dq_09_invoice_verdict", with_roles(ITEMS, TEXT_ITEMS, body="""
SELECT invoice_id, sum(unreadable) = 0 AS valid, CAST(sum(off) AS BIGINT) AS warnings FROM issues GROUP BY invoice_id"""))
def _(r):
    """An invoice is valid without errors; warnings are only counted."""
    return issue_items(r).groupBy("invoice_id").agg(
        (F.sum(unreadable()) == 0).alias("valid"), F.sum(off()).alias("warnings"))


@query("ag_12_merged_references", with_roles(ITEMS, body="""
SELECT invoice_id, part_id % 5 AS reference, sum(quantity) AS quantity, CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS total,
  arg_min(unit_price, (line_no, supplier_id, part_id, quantity, total)) AS unit_price FROM items GROUP BY 1, 2"""))
def _(r):
    """Repeated references of a document become one line; the first price stays."""
    rows = r.items.withColumn("reference", F.col("part_id") % 5)
    return rows_of.merged_references(rows, "reference", ITEM_ORDER).select("invoice_id", "reference", "quantity", "total", "unit_price")


@query("ag_13_first_of_equal_rows", with_roles(ITEMS, body="""
, d AS (SELECT *, 'Item ' || (supplier_id % 3) AS description FROM items),
f AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, sku, quantity, total, unit_price, description ORDER BY line_no, supplier_id, part_id) AS n FROM d)
SELECT invoice_id, line_no, supplier_id, part_id, sku, description, quantity, unit_price, total FROM f WHERE n = 1"""))
def _(r):
    """Rows of a document equal in code, quantity, amounts and description count
    once, the first one stays whole.  Every line is printed twice here."""
    rows = r.items.withColumn("description", F.concat(F.lit("Item "), F.col("supplier_id") % 3))
    twice = rows.withColumn("line_no", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1000)))
    key = ["invoice_id", "sku", "quantity", "total", "unit_price", "description"]
    return rows_of.first_of_equal(twice, key, ITEM_ORDER).select(
        "invoice_id", "line_no", "supplier_id", "part_id", "sku", "description", "quantity", "unit_price", "total")


@query("ag_25_first_by_reference", with_roles(ITEMS, body="""
SELECT invoice_id, sku, f.line_no, f.supplier_id, f.part_id FROM (SELECT invoice_id, sku,
  min(struct_pack(line_no := line_no, supplier_id := supplier_id, part_id := part_id, quantity := quantity, total := total)) AS f FROM items GROUP BY 1, 2) x"""))
def _(r):
    return rows_of.first_of_equal(r.items, ["invoice_id", "sku"], ITEM_ORDER).select("invoice_id", "sku", "line_no", "supplier_id", "part_id")


@query("ag_25_first_by_reference_and_amounts", with_roles(ITEMS, body="""
SELECT invoice_id, sku, quantity, total, count(*) AS printed FROM items GROUP BY ALL"""))
def _(r):
    """First line of equal reference, quantity and total; lines are printed twice."""
    twice = r.items.withColumn("line_no", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1000)))
    once = rows_of.first_of_equal(twice, ["invoice_id", "sku", "quantity", "total"], ITEM_ORDER)
    counted = r.items.groupBy("invoice_id", "sku", "quantity", "total").agg(F.count(F.lit(1)).alias("printed"))
    return once.select("invoice_id", "sku", "quantity", "total").join(counted, ["invoice_id", "sku", "quantity", "total"])


@query("ag_14_shipping_rows", with_roles(ITEMS, body="""
SELECT invoice_id, coalesce(CASE WHEN invoice_id % 4 = 0 THEN 9.5 END, CAST(sum(CASE WHEN part_id % 6 = 0 AND part_id % 12 = 0 THEN CAST(total AS DECIMAL(18,4)) END) AS DOUBLE)) AS shipping_fee
FROM items GROUP BY invoice_id"""))
def _(r):
    """Positive totals of shipping rows are summed; a footer amount replaces the sum."""
    rows = r.items.select("invoice_id", (F.col("part_id") % 6 == 0).alias("is_shipping"),
                          F.when(F.col("part_id") % 12 == 0, F.col("total")).otherwise(-F.col("total")).alias("total"))
    footers = r.invoices.filter("invoice_id % 4 = 0").select("invoice_id", F.lit(9.5).alias("footer_fee"))
    return rows_of.shipping_fees(rows, footers)


@query("ag_18_first_vat_rate", with_roles(ITEMS, body="""
SELECT invoice_id, coalesce(arg_min(r, (line_no, supplier_id, part_id, quantity, total)) FILTER (r IS NOT NULL), 5.5) AS vat_rate, count(DISTINCT r) AS rates
FROM (SELECT *, CASE WHEN tax_rate > 0.02 THEN round(tax_rate * 100, 0) END AS r FROM items) x GROUP BY invoice_id"""))
def _(r):
    rate = F.when(F.col("tax_rate") > 0.02, F.round(F.col("tax_rate") * 100, 0))
    return rows_of.first_rate(r.items.withColumn("rate", rate), ITEM_ORDER, 5.5)


@query("ag_19_field_completeness", with_roles(ITEMS, body="""
SELECT supplier_id, count(*) AS items, count(*) FILTER (part_id % 8 = 0) AS no_price, CAST(count(*) FILTER (part_id % 8 <> 0) AS DOUBLE) / count(*) AS complete
FROM items GROUP BY supplier_id"""))
def _(r):
    rows = r.items.withColumn("price", F.when(F.col("part_id") % 8 != 0, F.col("unit_price")))
    return rows_of.completeness(rows, "supplier_id", "price").withColumnRenamed("missing", "no_price")
