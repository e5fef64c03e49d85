"""Queries over stored tables that grow: versions, buckets, batches, cubes, streams with state."""

from pyspark.sql import functions as F

from costloom.operators import cost, cube, sinks, versions
from costloom.plans.costing import (ARRIVALS, ASOF, CMP, COSTS, HISTORY_ROLES, KPI_SQL, MARGIN_ROLES, MARGINS, MOVE_ORDER, MOVES, ROLES, WALK, margins,
                                    purchase_costs)
from costloom.plans.extraction import doc_keys, item_tasks
from costloom.plans.registry import query
from costloom.plans.roles import INVOICES, ITEM_ORDER, ITEMS, SALES, cents, cents_sql, with_roles
from costloom.plans.streams import stream_of
from costloom.sources import buckets, cells
from costloom.sources.documents import parse_ledger
from costloom.sources.scan import tasks_for
from costloom.streaming import arrivals, stock, tables

MOVES_PER_BUCKET = 5_000


@query("ss_06_cost_with_sales", with_roles(ITEMS, SALES, MOVES, WALK, recursive=True, body="""
, last AS (SELECT product_id, max(n) AS n FROM walk GROUP BY 1)
SELECT w.product_id, s.stock_before + s.change AS stock, CASE WHEN priced THEN round(average + 1e-7, 3) END AS average_cost
FROM walk w JOIN last USING (product_id, n) JOIN stocked s USING (product_id, n)"""))
def _(r):
    """Average cost per product, kept as state by a stream of purchases and sales."""
    moved = F.col("moved_at").cast("timestamp").alias("moved_at")
    z = F.lit(0).cast("long")
    bought = r.items_of(stream_of(r, "lineitem")).select(
        F.col("part_id").alias("product_id"), F.col("shipped").cast("timestamp").alias("moved_at"), z.alias("kind"), F.col("invoice_id").alias("a"),
        F.col("line_no").cast("long").alias("b"), F.col("supplier_id").alias("c"), F.col("quantity").alias("d"), F.col("total").alias("e"),
        F.col("quantity").alias("change"), F.col("unit_price").alias("price"))
    sold = r.sales_of(stream_of(r, "events")).select(
        "product_id", F.col("sold_at").alias("moved_at"), F.lit(1).cast("long").alias("kind"), F.col("sale_id").alias("a"), z.alias("b"), z.alias("c"),
        F.lit(0.0).alias("d"), F.lit(0.0).alias("e"), (-F.col("quantity")).alias("change"), F.lit(None).cast("double").alias("price"))
    folder = tables.work_folder(r.spark)
    moves = bought.unionByName(sold.select(*[moved if c == "moved_at" else c for c in sold.columns]))
    buckets = tasks_for(r.table("lineitem"), MOVES_PER_BUCKET) + tasks_for(r.table("events"), MOVES_PER_BUCKET)
    stock.store_average_cost(moves, MOVE_ORDER, folder, buckets=buckets)
    return tables.latest_rows(r.spark, f"{folder}/averages", "product_id", stock.AVERAGE_SCHEMA).select(
        "product_id", "stock", cents(F.col("average_cost"), 3).alias("average_cost"))


VERSIONS = """marks AS (SELECT product_id, moved_at, arg_max(cmp, seq) AS cmp FROM costs GROUP BY 1, 2),
seen AS (SELECT *, lag(cmp) OVER (PARTITION BY product_id ORDER BY moved_at) AS before,
  row_number() OVER (PARTITION BY product_id ORDER BY moved_at) AS n FROM marks),
versions AS (SELECT product_id, cmp, moved_at AS valid_from, lead(moved_at) OVER (PARTITION BY product_id ORDER BY moved_at) AS valid_to
  FROM seen WHERE n = 1 OR before <> cmp)"""


def stored_costs(r):
    """The costs of three times, one after the other, as stored versions."""
    root = tables.work_folder(r.spark)
    marks = purchase_costs(r).withColumn("moved_at", F.col("moved_at").cast("timestamp_ntz"))
    year = F.year("moved_at")
    for n, part in enumerate((year < 1995, (year >= 1995) & (year < 1997), year >= 1997)):
        versions.advance(marks.filter(part), root, n, "product_id", "moved_at", "cmp", ["seq"])
    return versions.stored_versions(r.spark, root)


@query("snk_10_cost_versions", with_roles(ITEMS, COSTS, VERSIONS, body="SELECT product_id, cmp, valid_from, valid_to FROM versions"))
def _(r):
    """Every cost with the time it was valid, added to in three batches."""
    return stored_costs(r)


@query("jn_18_cost_from_versions", with_roles(ITEMS, SALES, COSTS, ASOF, body="SELECT sale_id, product_id, moved_at, cmp_at_sale FROM sale_cost"))
def _(r):
    """Sales, early and late, with the stored version that was valid at their time."""
    sales = r.sales.withColumnRenamed("sold_at", "moved_at")
    return versions.valid_at(sales, stored_costs(r), "product_id", "moved_at", "cmp").select(
        "sale_id", "product_id", "moved_at", F.col("cmp").alias("cmp_at_sale"))


SNAPSHOT_DAY = "1996-06-28"
CURRENT = f"""current AS (SELECT row_index, invoice_id, qty_prev + qty_in AS quantity, {CMP} FROM history WHERE age = 1)"""


@query("snk_10_four_tables", with_roles(*HISTORY_ROLES, CURRENT, SALES, COSTS, ASOF, MARGINS, body=f"""
SELECT 'cmp' AS "table", CAST(row_index AS BIGINT) AS id, quantity, {cents_sql('cmp', 3)} AS amount FROM current
UNION ALL SELECT 'sales', sale_id, quantity, {cents_sql('unit_price * quantity', 3)} FROM sales WHERE CAST(sold_at AS DATE) = DATE '{SNAPSHOT_DAY}'
UNION ALL SELECT 'margins', sale_id, quantity, {cents_sql('margin_pct', 3)} FROM margins WHERE CAST(moved_at AS DATE) = DATE '{SNAPSHOT_DAY}'
UNION ALL SELECT 'purchases', part_id, sum(quantity), {cents_sql('sum(CAST(total AS DECIMAL(18,4)))', 3)} FROM items WHERE CAST(shipped AS DATE) = DATE '{SNAPSHOT_DAY}' GROUP BY part_id"""))
def _(r):
    """The four tables of a day's snapshot, stored and read back."""
    day, root = F.lit(SNAPSHOT_DAY).cast("date"), tables.work_folder(r.spark)
    now = cost.current_cmp(r.items, r.invoices, r.ledger, ITEM_ORDER)
    tables_of_day = {
        "cmp": now.select(F.col("row_index").cast("long").alias("id"), (F.col("qty_prev") + F.col("qty_in")).alias("quantity"), F.col("cmp").alias("amount")),
        "sales": r.sales.filter(F.to_date("sold_at") == day).select(F.col("sale_id").alias("id"), "quantity", (F.col("unit_price") * F.col("quantity")).alias("amount")),
        "margins": margins(r).filter(F.to_date("moved_at") == day).select(F.col("sale_id").alias("id"), "quantity", F.col("margin_pct").alias("amount")),
        "purchases": r.items.filter(F.to_date("shipped") == day).groupBy(F.col("part_id").alias("id")).agg(
            F.sum("quantity").alias("quantity"), F.sum(F.col("total").cast("decimal(18,4)")).cast("double").alias("amount"))}
    sinks.write_snapshot(tables_of_day, root, SNAPSHOT_DAY)
    read = None
    for name in tables_of_day:
        one = r.spark.read.parquet(f"{root}/{name}/day={SNAPSHOT_DAY}").select(F.lit(name).alias("table"), "id", "quantity", cents(F.col("amount"), 3).alias("amount"))
        read = one if read is None else read.unionByName(one)
    return read


@query("snk_02_bucketed_upsert", with_roles(ITEMS, INVOICES, body="""
, kept AS (SELECT invoice_id, quantity FROM items WHERE invoice_id % 40 <> 0
  UNION ALL SELECT invoice_id, 1 FROM invoices WHERE invoice_id % 40 = 0 AND invoice_id % 80 <> 0 UNION ALL SELECT invoice_id, 2 FROM invoices WHERE invoice_id % 80 = 0)
SELECT invoice_id, count(*) AS lines, sum(quantity) AS units FROM kept GROUP BY 1"""))
def _(r):
    """Two upserts, and the first one again, into a table kept in hash buckets."""
    root, some = tables.work_folder(r.spark), r.invoices.filter("invoice_id % 40 = 0").select("invoice_id")
    buckets.create(r.items.select("invoice_id", "quantity"), root, "invoice_id", 16)
    for version, rows in ((1, some.withColumn("quantity", F.lit(1.0))), (2, some.filter("invoice_id % 80 = 0").withColumn("quantity", F.lit(2.0)))):
        buckets.upsert(rows, root, "invoice_id", version)
    buckets.upsert(some.withColumn("quantity", F.lit(9.0)), root, "invoice_id", 1)  # there already: nothing happens
    return buckets.read(r.spark, root).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


@query("snk_04_batched_writes", with_roles(*ROLES, ARRIVALS, body=f"""
, u AS (SELECT *, {CMP} FROM (SELECT a.invoice_id, row_index, a.freight_per_unit, coalesce(l.qty_in, l.qty_prev, 0) AS qty_prev, quantity AS qty_in,
    coalesce(l.price_new, l.price_prev) AS price_prev, landed_price AS price_new FROM arrivals a JOIN ledger l USING (row_index)) x),
cells AS (SELECT invoice_id, row_index, 0 AS step, 'L' AS c, freight_per_unit AS value FROM u UNION ALL SELECT invoice_id, row_index, 1, 'H', qty_prev FROM u
  UNION ALL SELECT invoice_id, row_index, 2, 'I', qty_in FROM u UNION ALL SELECT invoice_id, row_index, 3, 'J', price_prev FROM u
  UNION ALL SELECT invoice_id, row_index, 4, 'K', price_new FROM u UNION ALL SELECT invoice_id, row_index, 5, 'G', cmp FROM u),
placed AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY step = 5, row_index, step) AS place FROM cells WHERE value IS NOT NULL)
SELECT invoice_id, CAST((place + 19) // 20 AS BIGINT) AS batch, place, 'Sheet1!' || c || row_index AS "range", value FROM placed"""))
def _(r):
    """Cell writes in batches of 20 per invoice, averages last, through the sink and back."""
    shifted = cost.register_shift(cost.checked_items(r.items, r.invoices, r.ledger))
    # An item makes up to six updates; they are made, placed and written where its invoice is.
    won = cost.last_line_wins(shifted, ITEM_ORDER).repartition(item_tasks(r, 6), "invoice_id")
    updates = sinks.cell_updates(won).withColumn("_last", F.col("step") == 5)
    seen = lambda share: doc_keys(r, 6)(share).withColumnRenamed("doc_id", "invoice_id")
    path = tables.work_folder(r.spark)
    cells.write_batches(cells.batches(updates, ["_last", "row_index", "step"], measure=seen), path)
    return cells.read_batches(r.spark, path).select("invoice_id", "batch", F.inline("updates"))


@query("src_04_range_scan", """
SELECT p_partkey + 2 AS row_index, 'P' || p_partkey AS sku_internal, 'p' || p_partkey || ', "x"' AS supplier_skus,
  p_size + 0.5::DOUBLE AS cmp, CAST(p_size AS DOUBLE) AS qty_prev FROM part WHERE p_partkey + 2 BETWEEN 40 AND 1900""")
def _(r):
    """Rows 40 to 1900, columns B to H, of a register exported to files."""
    part, size = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.concat_ws(",", (part + 2).cast("string"), F.concat(F.lit("P"), part), F.lit("name"), F.lit(""), F.concat(F.lit('"p'), part, F.lit(', ""x"""')),
                       F.lit("unit"), F.concat(size, F.lit(".5")), size, F.lit("beyond the range"))
    path = tables.work_folder(r.spark)
    cells.write_register(r.table("part").select((part + 2).alias("row_index"), line.alias("value")), path, 4)
    return parse_ledger(cells.read_range(r.spark, path, "Sheet1!B40:H1900")).select(
        F.col("row_index").cast("long").alias("row_index"), "sku_internal", "supplier_skus", "cmp", "qty_prev")


@query("ss_01_pickup_once", """
SELECT CAST(doc_id AS VARCHAR) AS name, count(*) AS lines, sum(length(line)) AS chars FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id % 50 <> 0 AND regexp_matches(text, '[^ \t\n\r\f\v]')) GROUP BY 1""")
def _(r):
    """Documents delivered twice, some of them broken: whole ones are stored once."""
    docs = stream_of(r, "documents").select(
        F.col("doc_id").cast("string").alias("name"), F.lit("2024-01-01").cast("timestamp").alias("arrived_at"),
        F.when(F.col("doc_id") % 50 == 0, F.lit(b"\xff\xfe\xfa")).otherwise(F.col("text").cast("binary")).alias("content"))
    again = docs.withColumn("arrived_at", F.lit("2024-01-01 06:00:00").cast("timestamp"))
    folder = tables.work_folder(r.spark)
    arrivals.store_once(docs.unionByName(again), folder)
    stored = tables.all_rows(r.spark, f"{folder}/lines", "name string, hash string, line_no int, text string")
    return stored.groupBy("name").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("ag_21_stored_cube", with_roles(*MARGIN_ROLES, body=f"""
, monthly AS (SELECT *, year(moved_at) * 100 + month(moved_at) AS period FROM margins WHERE cmp_at_sale IS NOT NULL)
SELECT product_id, period, {KPI_SQL} FROM monthly GROUP BY GROUPING SETS ((product_id, period), (product_id), (period), ())"""))
def _(r):
    """KPIs by product and month, product, month and in total, from the stored parts of three times."""
    folder = f"{tables.work_folder(r.spark)}/cube"
    known = margins(r).filter("cmp_at_sale is not null").withColumn("period", F.year("moved_at") * 100 + F.month("moved_at"))
    for n, part in enumerate(("period < 199701", "period >= 199701 and period < 199901", "period >= 199901")):
        cube.store_part(cube.partials(known.filter(part), ["product_id", "period"], ["quantity", "turnover", "cost", "margin_pct"], ["margin_pct"]), folder, n)
    turnover, spent = F.sum("turnover").cast("double"), F.sum("cost").cast("double")
    return cube.rolled_up(r.spark, folder, [["product_id", "period"], ["product_id"], ["period"], []], [
        F.sum("rows").alias("sales"), F.sum("quantity").cast("double").alias("volume"), cents(turnover).alias("turnover"), cents(spent).alias("cost"),
        cents(turnover - spent).alias("margin"), cents(F.try_divide(turnover - spent, turnover) * 100, 3).alias("profitability_pct"),
        cents(F.sum("margin_pct").cast("double") / F.sum("n_margin_pct"), 3).alias("average_margin_pct")])
