"""Queries that run as streams over the driver's tables until they are drained."""

from pyspark.sql import functions as F

from costloom.plans.extraction import DOC_LINES, PROSE, rules
from costloom.plans.registry import query
from costloom.plans.roles import SALES, cents, with_roles
from costloom.streaming import arrivals, costs, tables


def stream_of(r, name):
    return arrivals.arriving(r.spark, f"{r.dir}/{name}.parquet", r.table(name).schema)


@query("ss_01_document_pickup", with_roles(DOC_LINES, body="SELECT doc_id, line_no, text FROM dl"))
def _(r):
    """Documents picked up as they arrive, stored line by line."""
    folder = tables.work_folder(r.spark)
    arrivals.store_lines(stream_of(r, "documents").select("doc_id", "text"), folder)
    return tables.all_rows(r.spark, f"{folder}/lines", "doc_id long, line_no int, text string").select("doc_id", "line_no", "text")


ITEMS_OF_PROSE = "WITH " + PROSE.replace("SELECT doc_id, variant, description, sku FROM found", ", kept AS (SELECT doc_id, variant, description, sku FROM found")


@query("ss_02_extract_and_upsert", ITEMS_OF_PROSE + """)
SELECT d.doc_id, CASE WHEN count(k.doc_id) > 0 THEN 'PENDING_REVIEW' ELSE 'ERROR' END AS status, count(k.doc_id) AS n_items,
  'Extracted items: ' || count(k.doc_id) AS message FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY 1""")
def _(r):
    """Every arriving document ends with items and PENDING_REVIEW, or as ERROR."""
    folder = tables.work_folder(r.spark)
    docs = stream_of(r, "documents").select("doc_id", F.col("lang").alias("vendor"), "text")
    arrivals.upsert_invoices(docs, rules(r), folder)
    status = tables.latest_rows(r.spark, f"{folder}/status", "doc_id", "doc_id long, n_items long, status string").select("doc_id", "status", "n_items")
    logs = tables.latest_rows(r.spark, f"{folder}/logs", "doc_id", "doc_id long, type string, status string, message string").select("doc_id", "message")
    return status.join(logs, "doc_id")


@query("ss_02_stored_items", "WITH " + PROSE)
def _(r):
    """The items that the stream has stored for every document."""
    folder = tables.work_folder(r.spark)
    arrivals.upsert_invoices(stream_of(r, "documents").select("doc_id", F.col("lang").alias("vendor"), "text"), rules(r), folder)
    return arrivals.current_items(r.spark, folder).select("doc_id", "variant", "description", "sku")


LOSSES = """loss AS (SELECT ts AS sold_at, user_id AS product_id FROM events WHERE event_type = 'purchase' AND value < 25),
starts AS (SELECT DISTINCT date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS window_start FROM events, range(0, 24) h(h)),
w AS (SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(DISTINCT product_id) AS products, count(*) AS sales
  FROM starts JOIN loss ON sold_at >= window_start AND sold_at < window_start + INTERVAL 24 HOUR GROUP BY 1)"""


@query("ss_03_margin_alerts", with_roles(LOSSES, body="""
SELECT * FROM w WHERE products > 3 AND window_end <= (SELECT max(sold_at) FROM loss) - INTERVAL 1 HOUR"""))
def _(r):
    """Day-long windows, hourly, with more than three products sold at a loss."""
    folder = tables.work_folder(r.spark)
    sold = stream_of(r, "events").filter("event_type = 'purchase'").select(
        F.col("ts").cast("timestamp").alias("sold_at"), F.col("user_id").alias("product_id"), (F.col("value") - 25).alias("margin_pct"))
    costs.store_alerts(sold, folder)
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return tables.all_rows(r.spark, f"{folder}/alerts", "window_start timestamp, window_end timestamp, products long, sales long").select(naive("window_start"), naive("window_end"), "products", "sales")


@query("ss_04_sales_with_snapshot", with_roles(SALES, body="""
, snap AS (SELECT l_partkey AS product_id, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS cmp FROM lineitem GROUP BY 1)
SELECT sale_id, product_id, unit_price, cmp AS cmp_at_sale, (unit_price - cmp) / unit_price * 100 AS margin_pct FROM sales LEFT JOIN snap USING (product_id)"""))
def _(r):
    """The daily sales feed joined with the stored cost snapshot."""
    folder = tables.work_folder(r.spark)
    order = F.struct("shipped", "invoice_id", "line_no", "supplier_id", "quantity", "total")
    snapshot = r.items.groupBy(F.col("part_id").alias("product_id")).agg(F.max_by("unit_price", order).alias("cmp"))
    sales = stream_of(r, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("sale_id"), F.col("user_id").alias("product_id"), (F.col("value") * 50).alias("unit_price"))
    snapshot.write.parquet(f"{folder}/snapshot")
    costs.store_sales(sales, f"{folder}/snapshot", folder)
    return tables.all_rows(r.spark, f"{folder}/sales", "sale_id long, product_id long, unit_price double, cmp_at_sale double, margin_pct double").select("sale_id", "product_id", "unit_price", "cmp_at_sale", "margin_pct")


@query("ss_06_running_cost", """
SELECT l_partkey AS product_id, sum(l_quantity) AS stock_qty, round(sum(l_extendedprice) / sum(l_quantity) + 1e-7, 3) AS average_cost FROM lineitem GROUP BY 1""")
def _(r):
    """Average cost per product kept up to date by the purchase stream."""
    folder = tables.work_folder(r.spark)
    bought = stream_of(r, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    costs.store_running_cost(bought, folder)
    return tables.latest_rows(r.spark, f"{folder}/costs", "product_id", costs.COST_SCHEMA).select(
        "product_id", "stock_qty", cents(F.col("average_cost"), 3).alias("average_cost"))
