"""Queries: lookups, history, job and mapping statistics, updates, messages."""

from pyspark.sql import functions as F

from costloom.operators import cost, projections, report, sinks
from costloom.operators import rows as rows_of
from costloom.operators.keyed import join_on_key
from costloom.plans.costing import ARRIVALS, CMP, HISTORY_ROLES, ROLES
from costloom.plans.matching import MAPPED_ROLES, mapped_items
from costloom.plans.money import GROSS, LINE, LINE_SQL
from costloom.plans.registry import query
from costloom.plans.roles import (ALIASES, INVOICES, ITEM_ORDER, ITEMS, JOBS, LOGS, PRODUCTS, SUPPLIERS, with_roles)

AS_OF = "2024-01-31"
TYPES = ["CLICK", "VIEW", "PURCHASE", "EXPORT"]


@query("src_01_products_by_name", with_roles(PRODUCTS, body="SELECT product_id, name, sku_internal FROM products"))
def _(r):
    return r.products.select("product_id", "name", "sku_internal").orderBy("name", "product_id")


@query("src_02_first_by_unique_attribute", with_roles(PRODUCTS, ITEMS, body="""
SELECT i.invoice_id, i.line_no, i.supplier_id, i.part_id, i.total, p.name FROM items i LEFT JOIN products p ON p.sku_internal = 'P' || (i.part_id + 7)"""))
def _(r):
    """The lookup by internal SKU for a whole table of wanted keys at once."""
    wanted = r.items.select("invoice_id", "line_no", "supplier_id", "part_id", "total",
                            F.concat(F.lit("P"), F.col("part_id") + 7).alias("sku_internal"))
    return join_on_key(wanted, r.products.select("sku_internal", "name"), ["sku_internal"]).drop("sku_internal")


@query("src_03_invoice_detail", with_roles(INVOICES, ITEMS, PRODUCTS, SUPPLIERS, body=f"""
SELECT v.invoice_id, v.invoice_date, v.status, i.line_no, i.supplier_id, s.supplier_name, i.part_id, p.name AS product_name, i.quantity, i.total
FROM invoices v JOIN items i USING (invoice_id) LEFT JOIN suppliers s USING (supplier_id) LEFT JOIN products p ON p.product_id = i.part_id"""))
def _(r):
    """Invoices with supplier, lines and products, one row per line; an invoice of
    any length stays spread over rows instead of one nested array."""
    items = join_on_key(r.items.select(*LINE), r.invoices.select("invoice_id", "invoice_date", "status"), ["invoice_id"], "inner")
    items = join_on_key(items, r.suppliers.select("supplier_id", "supplier_name"), ["supplier_id"], measure=r.items)
    names = r.products.select(F.col("product_id").alias("part_id"), F.col("name").alias("product_name"))
    return join_on_key(items, names, ["part_id"], measure=r.items).select(
        "invoice_id", "invoice_date", "status", "line_no", "supplier_id", "supplier_name", "part_id", "product_name", "quantity", "total")


@query("src_03_invoice_logs", with_roles(INVOICES, LOGS, body="""
SELECT v.invoice_id, v.status, l.log_id, l.status AS log_status, l.message, l.created_at,
  row_number() OVER (PARTITION BY v.invoice_id ORDER BY l.created_at DESC, l.log_id DESC) AS place FROM invoices v JOIN logs l USING (invoice_id)"""))
def _(r):
    """The logs of every invoice, the newest first."""
    return report.invoice_logs(r.invoices, r.logs).select("invoice_id", "status", "log_id", "log_status", "message", "created_at", "place")


LATEST = """latest AS (SELECT invoice_id, arg_max(status, (created_at, log_id)) AS log_status, arg_max(message, (created_at, log_id)) AS message,
    max(created_at) AS logged_at FROM logs GROUP BY invoice_id)"""


@query("wn_04_latest_log", with_roles(LOGS, LATEST, body="SELECT invoice_id, log_status, message, logged_at FROM latest"))
def _(r):
    return report.latest_log(r.logs).select("invoice_id", F.col("last_log.status").alias("log_status"),
                                            F.col("last_log.message").alias("message"), F.col("last_log.created_at").alias("logged_at"))


@query("prj_01_history_rows", with_roles(INVOICES, LOGS, LATEST, body="""
SELECT v.invoice_id, lower(v.status) AS status, CASE WHEN l.log_status = 'ERROR' THEN l.message END AS error_message
FROM invoices v LEFT JOIN latest l USING (invoice_id)"""))
def _(r):
    return report.history_rows(r.invoices, r.logs).select("invoice_id", "status", "error_message")


@query("jn_10_invoice_list", with_roles(INVOICES, ITEMS, LOGS, LATEST, body="""
, n AS (SELECT invoice_id, count(*) AS n_items, sum(quantity) AS units FROM items GROUP BY 1)
SELECT v.invoice_id, v.invoice_date, v.status, c_name AS buyer, n.n_items, n.units, l.log_status
FROM invoices v JOIN customer ON c_custkey = v.customer_id LEFT JOIN n USING (invoice_id) LEFT JOIN latest l USING (invoice_id)"""))
def _(r):
    """All invoices with party, line counts and newest log, newest first."""
    party = r.table("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("buyer"))
    rows = join_on_key(r.invoices, party, ["customer_id"], "inner")
    rows = rows.join(report.invoice_counts(r.items), "invoice_id", "left").join(report.latest_log(r.logs), "invoice_id", "left")
    return rows.select("invoice_id", "invoice_date", "status", "buyer", "n_items", "units",
                       F.col("last_log.status").alias("log_status")).orderBy(F.col("invoice_date").desc(), "invoice_id")


@query("flt_01_history_filter", with_roles(INVOICES, body="""
SELECT invoice_id, status, c_name FROM invoices JOIN customer ON c_custkey = customer_id WHERE status = 'SUCCESS' AND contains(lower(c_name), 'omer#00000001')"""))
def _(r):
    buyers = r.table("customer").filter(F.lower("c_name").contains("Omer#00000001".lower())).select(
        F.col("c_custkey").alias("customer_id"), "c_name")
    return r.invoices.filter("status = 'SUCCESS'").join(buyers, "customer_id").select("invoice_id", "status", "c_name")


@query("ag_08_history_kpis", with_roles(INVOICES, body="""
SELECT count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PENDING_REVIEW') AS pending, count(*) FILTER (status = 'PROCESSING') AS processing,
  round(100.0 * count(*) FILTER (status = 'SUCCESS') / count(*)) AS success_rate FROM invoices"""))
def _(r):
    n = lambda s: F.count_if(F.col("status") == s)
    rate = F.round(F.try_divide(F.lit(100.0) * n("SUCCESS"), F.count(F.lit(1))))
    return r.invoices.agg(n("SUCCESS").alias("success"), n("PENDING_REVIEW").alias("pending"),
                          n("PROCESSING").alias("processing"), rate.alias("success_rate"))


@query("ag_07_job_totals", with_roles(JOBS, body="""
SELECT count(*) AS total, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'PROCESSING') AS processing,
  count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM jobs"""))
def _(r):
    return report.job_totals(r.jobs)


@query("ag_07_job_totals_by_type", with_roles(JOBS, body="""
SELECT t.type, count(job_id) AS total, count(job_id) FILTER (status = 'PENDING') AS pending, count(job_id) FILTER (status = 'COMPLETED') AS completed,
  count(job_id) FILTER (status = 'FAILED') AS failed FROM (VALUES ('CLICK'), ('VIEW'), ('PURCHASE'), ('EXPORT')) t(type) LEFT JOIN jobs USING (type) GROUP BY 1"""))
def _(r):
    return report.job_totals_by_type(r.jobs, TYPES)


@query("flt_14_eligible_jobs", with_roles(JOBS, body="""
SELECT job_id, type, attempts FROM jobs WHERE status = 'PENDING' AND attempts < max_attempts"""))
def _(r):
    return report.eligible(r.jobs).select("job_id", "type", "attempts")


@query("tk_01_next_job_by_type", with_roles(JOBS, body="""
SELECT type, arg_min(job_id, (created_at, job_id)) AS job_id, min(created_at) AS created_at FROM jobs WHERE status = 'PENDING' AND attempts < max_attempts GROUP BY type"""))
def _(r):
    return report.next_jobs(r.jobs).select("type", "job_id", "created_at")


@query("tk_02_newest_failed_jobs", with_roles(JOBS, body="""
SELECT job_id, type, error, created_at FROM jobs WHERE status = 'FAILED' ORDER BY created_at DESC, job_id LIMIT 50"""))
def _(r):
    return r.jobs.filter("status = 'FAILED'").orderBy(F.col("created_at").desc(), "job_id").limit(50).select(
        "job_id", "type", "error", "created_at")


@query("tk_03_history_page", with_roles(INVOICES, body="""
SELECT invoice_id, invoice_date, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM invoices) AS pages FROM invoices ORDER BY invoice_date DESC, invoice_id LIMIT 25 OFFSET 50"""))
def _(r):
    """Third page of 25 and the number of pages."""
    pages = r.invoices.agg(F.ceil(F.count(F.lit(1)) / 25).alias("pages"))
    order, last = [("invoice_date", True), ("invoice_id", False)], None
    for _ in range(2):  # the last row of each page leads to the next
        last = report.page_after(r.invoices.select("invoice_date", "invoice_id"), order, 25, last).orderBy("invoice_date", F.desc("invoice_id")).first().asDict()
    rows = report.page_after(r.invoices, order, 25, last)
    return rows.select("invoice_id", "invoice_date", pages.scalar().alias("pages"))


@query("tk_05_top_items", with_roles(ITEMS, body=f"""
SELECT {LINE_SQL} FROM items ORDER BY total DESC, {LINE_SQL} LIMIT 5"""))
def _(r):
    return r.items.orderBy(F.col("total").desc(), *LINE).limit(5).select(*LINE)


@query("tk_05_most_repeated_skus", with_roles(ITEMS, body="""
SELECT sku, count(*) AS n FROM items GROUP BY sku ORDER BY n DESC, sku LIMIT 10"""))
def _(r):
    return r.items.groupBy("sku").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "sku").limit(10)


@query("tk_06_preview", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def _(r):
    return r.table("part").orderBy("p_partkey").limit(10).select("p_partkey", "p_name")


UNMAPPED = """unmapped AS (SELECT m.sku, v.invoice_date AS seen_at, s.supplier_name,
    (m.invoice_id, m.line_no, m.supplier_id, m.part_id, m.total) AS pos
  FROM mapped m JOIN invoices v USING (invoice_id) JOIN suppliers s USING (supplier_id) WHERE NOT mapping_found)"""
UNMAPPED_ROLES = (*MAPPED_ROLES, INVOICES, SUPPLIERS, UNMAPPED)


def unmapped(r):
    rows = mapped_items(r).filter("not mapping_found")
    rows = join_on_key(rows, r.invoices.select("invoice_id", F.col("invoice_date").alias("seen_at")), ["invoice_id"], "inner", r.items)
    rows = join_on_key(rows, r.suppliers.select("supplier_id", "supplier_name"), ["supplier_id"], "inner", r.items)
    return rows.select("sku", "seen_at", "supplier_name", F.struct("invoice_id", "line_no", "supplier_id", "part_id", "total").alias("pos"))


GROUPED = "SELECT sku, count(*) AS n, max(seen_at) AS last_seen, arg_max(supplier_name, (seen_at, pos)) AS supplier_name FROM {} GROUP BY sku ORDER BY n DESC, sku LIMIT 50"


@query("ag_05_unmapped_skus_recent", with_roles(*UNMAPPED_ROLES, body="""
SELECT sku, count(*) AS n, max(seen_at) AS last_seen, arg_max(supplier_name, (seen_at, pos)) AS supplier_name FROM unmapped GROUP BY sku"""))
def _(r):
    """Every unmapped SKU with its count and latest sight, over all unmapped items."""
    return report.unmapped_counts(unmapped(r))


@query("tk_04_unmapped_skus_all", with_roles(*UNMAPPED_ROLES, body=GROUPED.format("unmapped")))
def _(r):
    return report.unmapped_skus(unmapped(r))


@query("ag_06_mappings_by_brand", with_roles(*UNMAPPED_ROLES, body="""
SELECT 'total' AS figure, CAST(NULL AS VARCHAR) AS supplier, count(*) AS n FROM aliases
UNION ALL SELECT 'supplier', coalesce(nullif(brand, ''), 'Unknown'), count(*) FROM aliases GROUP BY 2
UNION ALL SELECT 'recent unmapped', NULL, count(*) FROM unmapped WHERE seen_at >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY"""))
def _(r):
    """All mappings, those of each brand, and the items of the last 30 days without one."""
    return report.mapping_stats(r.aliases, unmapped(r), F.lit("1998-06-01").cast("timestamp_ntz"))


@query("flt_15_recent_unmapped", with_roles(*UNMAPPED_ROLES, body="""
SELECT count(*) AS recent_unmapped FROM unmapped WHERE seen_at >= TIMESTAMP '2000-12-01' - INTERVAL 30 DAY"""))
def _(r):
    since = F.lit("2000-12-01").cast("timestamp_ntz") - F.make_dt_interval(F.lit(30))
    return unmapped(r).filter(F.col("seen_at") >= since).agg(F.count(F.lit(1)).alias("recent_unmapped"))


@query("flt_20_log_filter", with_roles(LOGS, body="""
SELECT log_id, type, status, created_at FROM logs WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-12' AND type = 'ERROR' AND status = 'ERROR'"""))
def _(r):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return r.logs.filter((F.col("created_at") >= day("2024-01-10")) & (F.col("created_at") < day("2024-01-12"))
                         & (F.col("type") == "ERROR") & (F.col("status") == "ERROR")).select("log_id", "type", "status", "created_at")


@query("snk_07_old_jobs_removed", with_roles(JOBS, body=f"""
SELECT job_id, status, completed_at FROM jobs WHERE NOT coalesce(status = 'COMPLETED' AND completed_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY, false)"""))
def _(r):
    gone = report.expired(r.jobs, F.lit(AS_OF).cast("timestamp_ntz"), 10)
    return r.jobs.filter(~F.coalesce(gone, F.lit(False))).select("job_id", "status", "completed_at")


@query("ss_05_log_retention", with_roles(LOGS, body="""
SELECT log_id, created_at FROM logs WHERE created_at >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY"""))
def _(r):
    """Logs of the last 90 days before a given day stay."""
    keep_from = F.lit("2024-04-10").cast("timestamp_ntz") - F.make_dt_interval(F.lit(90))
    return r.logs.filter(F.col("created_at") >= keep_from).select("log_id", "created_at")


@query("snk_08_job_transitions", with_roles(JOBS, body=f"""
SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'PROCESSING' WHEN job_id % 10 = 3 THEN 'FAILED' WHEN job_id % 10 = 4 THEN 'PENDING' ELSE status END AS status,
  CASE WHEN job_id % 10 = 0 THEN attempts + 1 WHEN job_id % 10 = 4 THEN 0 ELSE attempts END AS attempts,
  CASE WHEN job_id % 10 = 3 THEN 'boom' WHEN job_id % 10 = 4 THEN NULL ELSE error END AS error,
  CASE WHEN job_id % 10 = 0 THEN TIMESTAMP '{AS_OF}' WHEN job_id % 10 = 4 THEN NULL ELSE started_at END AS started_at,
  CASE WHEN job_id % 10 = 3 THEN TIMESTAMP '{AS_OF}' WHEN job_id % 10 = 4 THEN NULL ELSE completed_at END AS completed_at FROM jobs"""))
def _(r):
    """Some jobs start, some fail, some failed ones are reset."""
    at, turn = F.lit(AS_OF).cast("timestamp_ntz"), F.col("job_id") % 10
    jobs = report.transition(r.jobs, turn == 0, "start", at)
    jobs = report.transition(jobs, turn == 3, "fail", at, F.lit("boom"))
    jobs = report.transition(jobs, turn == 4, "retry", at)
    return jobs.select("job_id", "status", "attempts", "error", "started_at", "completed_at")


@query("snk_01_insert_invoices", with_roles(INVOICES, ITEMS, body="""
SELECT invoice_id, 'UPLOAD' AS type, (SELECT count(*) FROM items i WHERE i.invoice_id = v.invoice_id) AS children FROM invoices v WHERE status = 'PROCESSING'"""))
def _(r):
    """Parents, children and logs of newly uploaded invoices."""
    out = sinks.insert_invoices(r.invoices.filter("status = 'PROCESSING'"), r.items, F.lit(AS_OF).cast("timestamp_ntz"))
    n = out["items"].groupBy("invoice_id").agg(F.count(F.lit(1)).alias("children"))
    return out["logs"].join(n, "invoice_id", "left").select("invoice_id", "type", F.coalesce("children", F.lit(0)).alias("children"))


@query("snk_02_update_and_replace", with_roles(INVOICES, ITEMS, body="""
, kept AS (SELECT invoice_id, quantity FROM items WHERE invoice_id % 4 <> 0 UNION ALL SELECT invoice_id, 1 FROM invoices WHERE invoice_id % 4 = 0)
SELECT invoice_id, CASE WHEN invoice_id % 8 = 0 THEN 'SUCCESS' ELSE any_value(v.status) END AS status,
  CASE WHEN invoice_id % 4 = 0 THEN 0 ELSE any_value(v.shipping_fee) END AS shipping_fee, count(k.quantity) AS lines, coalesce(sum(k.quantity), 0) AS units
FROM invoices v LEFT JOIN kept k USING (invoice_id) GROUP BY invoice_id"""))
def _(r):
    """Changed fields of some invoices, and all their lines replaced by one."""
    changed = r.invoices.filter("invoice_id % 4 = 0")
    changes = changed.select("invoice_id", F.when(F.col("invoice_id") % 8 == 0, "SUCCESS").otherwise("").alias("status"),
                             F.lit(0.0).alias("shipping_fee"))
    items = sinks.replace_children(r.items.select("invoice_id", "quantity"), changed.select("invoice_id", F.lit(1.0).alias("quantity")))
    sums = items.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    return sinks.update_invoices(r.invoices, changes).select("invoice_id", "status", "shipping_fee").join(
        sums, "invoice_id", "left").fillna(0, ["lines", "units"])


@query("snk_03_audit_log", with_roles(INVOICES, LOGS, body="""
SELECT status, count(*) AS n FROM (SELECT status FROM logs UNION ALL SELECT 'INFO' FROM invoices WHERE status = 'PENDING_REVIEW') x GROUP BY 1"""))
def _(r):
    """The log after one entry per reviewed invoice was appended."""
    new = r.invoices.filter("status = 'PENDING_REVIEW'").select(F.lit("INFO").alias("status"))
    return r.logs.select("status").unionByName(new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("snk_04_cell_updates", with_roles(*ROLES, ARRIVALS, body=f"""
, u AS (SELECT *, {CMP} FROM (SELECT a.invoice_id, row_index, a.freight_per_unit, coalesce(l.qty_in, l.qty_prev, 0) AS qty_prev, quantity AS qty_in,
    coalesce(l.price_new, l.price_prev) AS price_prev, landed_price AS price_new FROM arrivals a JOIN ledger l USING (row_index)) x),
cells AS (SELECT invoice_id, row_index, 0 AS step, 'L' AS c, freight_per_unit AS value FROM u UNION ALL SELECT invoice_id, row_index, 1, 'H', qty_prev FROM u
  UNION ALL SELECT invoice_id, row_index, 2, 'I', qty_in FROM u UNION ALL SELECT invoice_id, row_index, 3, 'J', price_prev FROM u
  UNION ALL SELECT invoice_id, row_index, 4, 'K', price_new FROM u UNION ALL SELECT invoice_id, row_index, 5, 'G', cmp FROM u)
SELECT invoice_id, row_index, step, 'Sheet1!' || c || row_index AS "range", value FROM cells WHERE value IS NOT NULL"""))
def _(r):
    shifted = cost.register_shift(cost.checked_items(r.items, r.invoices, r.ledger))
    return sinks.cell_updates(cost.last_line_wins(shifted, ITEM_ORDER))


@query("snk_09_outcome_messages", with_roles(INVOICES, body="""
, m AS (SELECT invoice_id, CASE WHEN status = 'SUCCESS' THEN
    'Parsing succeeded' || chr(10) || 'Supplier: <A&B> ' || customer_id || CASE WHEN invoice_id % 3 > 0 THEN chr(10) || 'Total: ' || printf('%.2f', declared_total) || ' EUR' ELSE '' END
      || chr(10) || 'Items: 0' || CASE WHEN invoice_id % 2 = 0 THEN chr(10) || 'Warnings: slow | odd' ELSE '' END
  ELSE 'Parsing failed' || chr(10) || 'Supplier: <A&B> ' || customer_id || CASE WHEN invoice_id % 3 > 0 THEN chr(10) || 'Total: ' || printf('%.2f', declared_total) || ' EUR' ELSE '' END
      || chr(10) || 'Error: "bad"' END AS text FROM invoices),
h AS (SELECT *, string_split(text, chr(10)) AS l FROM m)
SELECT invoice_id, text, '<h2>' || l[1] || '</h2><ul>' || array_to_string(list_transform(l[2:], lambda x: '<li>' ||
  replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</li>'), '') || '</ul>' AS html FROM h"""))
def _(r):
    k = F.col("invoice_id")
    warnings = F.when(k % 2 == 0, F.array(F.lit("slow"), F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    parts = report.outcome_message(F.concat(F.lit("<A&B> "), "customer_id"), F.col("status") == "SUCCESS",
                                   F.when(k % 3 > 0, F.col("declared_total")), F.lit(None).cast("int"), warnings, F.lit('"bad"'))
    return r.invoices.select("invoice_id", parts["text"].alias("text"), parts["html"].alias("html"))


@query("snk_10_cost_snapshot", with_roles(*HISTORY_ROLES, body=f"""
SELECT row_index, 'P' || (row_index - 2) AS sku_internal, cmp, qty_prev + qty_in AS quantity FROM (SELECT *, {CMP} FROM history WHERE age = 1) x"""))
def _(r):
    """Per product the cost to store for the day."""
    now = cost.current_cmp(r.items, r.invoices, r.ledger, ITEM_ORDER)
    return now.join(r.ledger.select("row_index", "sku_internal"), "row_index").select(
        "row_index", "sku_internal", "cmp", (F.col("qty_prev") + F.col("qty_in")).alias("quantity"))


@query("prj_02_invoice_label", """
SELECT event_id, 'INV-' || upper(right(event_type || '-' || event_id, 8)) AS label FROM events""")
def _(r):
    return r.table("events").select("event_id", projections.invoice_label(F.concat_ws("-", "event_type", "event_id")).alias("label"))


@query("prj_03_display_name", with_roles(ITEMS, PRODUCTS, body="""
SELECT i.invoice_id, i.line_no, i.supplier_id, i.part_id, i.total, CASE WHEN part_id % 3 = 0 THEN 'line text' WHEN part_id % 3 = 1 THEN p.name ELSE sku END AS name
FROM items i JOIN products p ON product_id = part_id"""))
def _(r):
    k = F.col("part_id") % 3
    named = join_on_key(r.items, r.products.select(F.col("product_id").alias("part_id"), "name"), ["part_id"], "inner")
    name = projections.display_name(F.when(k == 0, "line text").otherwise(""), F.when(k == 1, F.col("name")), F.col("sku"))
    return named.select("invoice_id", "line_no", "supplier_id", "part_id", "total", name.alias("name"))


@query("prj_10_edit_overlay", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, CASE WHEN part_id % 10 = 0 THEN 7 ELSE quantity END AS quantity,
  CASE WHEN part_id % 10 = 0 THEN 7 * unit_price ELSE total END AS total FROM items"""))
def _(r):
    """Edited quantities replace the original ones and give a new total."""
    edits = r.items.select("part_id").distinct().filter("part_id % 10 = 0").withColumn("edited", F.lit(7.0))
    return rows_of.with_edits(r.items, edits, ["part_id"]).select("invoice_id", "line_no", "supplier_id", "part_id", "quantity", "total")


@query("prj_11_cost_engine_rows", with_roles(ITEMS, body="""
SELECT invoice_id, sku AS invoice_sku, quantity AS qty, unit_price FROM items"""))
def _(r):
    return r.items.select("invoice_id", F.col("sku").alias("invoice_sku"), F.col("quantity").alias("qty"), "unit_price")


@query("prj_12_field_defaults", with_roles(ITEMS, body="""
, n AS (SELECT invoice_id, count(*) AS c FROM items GROUP BY 1)
SELECT i.invoice_id, line_no, supplier_id, part_id, CASE WHEN part_id % 7 < 2 THEN 'ITEM_' || c ELSE sku END AS reference,
  CASE WHEN part_id % 4 = 0 THEN '' ELSE 'Bar ' || part_id END AS description, CASE WHEN part_id % 5 = 0 THEN 0 ELSE quantity END AS quantity,
  CASE WHEN part_id % 3 = 0 THEN 0 ELSE unit_price END AS unit_price, CASE WHEN part_id % 2 = 0 THEN 0 ELSE total END AS total FROM items i JOIN n USING (invoice_id)"""))
def _(r):
    """A missing or empty reference is named after the number of lines of its document."""
    part = F.col("part_id")
    rows = r.items.withColumns({"reference": F.when(part % 7 == 1, "").when(part % 7 > 1, F.col("sku")), "quantity": F.when(part % 5 != 0, F.col("quantity")),
                                "description": F.when(part % 4 != 0, F.concat(F.lit("Bar "), part)),
                                "unit_price": F.when(part % 3 != 0, F.col("unit_price")), "total": F.when(part % 2 != 0, F.col("total"))})
    return projections.field_defaults(rows).select("invoice_id", "line_no", "supplier_id", "part_id", "reference", "description", "quantity", "unit_price", "total")
