"""Queries: freight, register shift, CMP, perpetual average, as-of cost, margins."""

from pyspark.sql import functions as F

from costloom.operators import allocate, cost
from costloom.operators.keyed import join_on_key
from costloom.plans.registry import query
from costloom.plans.roles import (INVOICES, ITEM_ORDER, ITEMS, LEDGER, SALES, cents, cents_sql, with_roles)

KEYS = """keys AS (
  SELECT sku AS match_sku, count(*) AS hits, min(row_index) AS row_index FROM (
    SELECT row_index, upper(trim(regexp_replace(u.t, '\\s+', ' ', 'g'))) AS sku FROM (
      SELECT row_index, unnest(regexp_split_to_array(supplier_skus, '[,;/|]')) AS t FROM ledger) u) x
  WHERE sku <> '' GROUP BY sku)"""
FREIGHT = """freight AS (
  SELECT i.invoice_id, sum(i.quantity) AS units, any_value(v.shipping_fee) AS shipping_fee,
    any_value(v.invoice_date) AS invoice_date,
    CASE WHEN sum(i.quantity) > 0 THEN any_value(v.shipping_fee) / sum(i.quantity) ELSE 0.0 END AS freight_per_unit
  FROM items i JOIN invoices v USING (invoice_id) GROUP BY i.invoice_id)"""
CHECKED = """checked AS (
  SELECT i.*, f.invoice_date, f.freight_per_unit, i.unit_price + f.freight_per_unit AS landed_price,
    CASE WHEN k.hits IS NULL THEN 'not_found' WHEN k.hits > 1 THEN 'ambiguous'
         WHEN i.quantity <= 0 OR i.unit_price < 0 THEN 'error' ELSE 'ok' END AS outcome,
    coalesce(k.hits, 0) AS hits, CASE WHEN k.hits = 1 THEN k.row_index END AS row_index
  FROM items i JOIN freight f USING (invoice_id)
  LEFT JOIN keys k ON k.match_sku = upper(trim(regexp_replace(i.sku, '\\s+', ' ', 'g'))))"""
ARRIVALS = """arrivals AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY row_index, invoice_id
      ORDER BY line_no DESC, supplier_id DESC, part_id DESC, quantity DESC, total DESC) AS rn
    FROM checked WHERE outcome = 'ok') WHERE rn = 1)"""
HISTORY = """history AS (
  SELECT a.row_index, a.invoice_date, a.invoice_id,
    coalesce(lag(a.quantity) OVER w, l.qty_in, l.qty_prev, 0) AS qty_prev, a.quantity AS qty_in,
    CASE WHEN lag(a.invoice_id) OVER w IS NOT NULL THEN lag(a.landed_price) OVER w
         ELSE coalesce(l.price_new, l.price_prev) END AS price_prev,
    a.landed_price AS price_new,
    row_number() OVER (PARTITION BY a.row_index ORDER BY a.invoice_date DESC, a.invoice_id DESC) AS age
  FROM arrivals a JOIN ledger l USING (row_index)
  WINDOW w AS (PARTITION BY a.row_index ORDER BY a.invoice_date, a.invoice_id))"""
CMP = """CASE WHEN price_prev IS NOT NULL AND qty_prev > 0
    THEN (qty_prev * price_prev + qty_in * price_new) / (qty_prev + qty_in) ELSE price_new END AS cmp"""
ROLES = (ITEMS, INVOICES, LEDGER, KEYS, FREIGHT, CHECKED)
HISTORY_ROLES = (*ROLES, ARRIVALS, HISTORY)


@query("ag_01_freight_per_unit", with_roles(ITEMS, INVOICES, FREIGHT, body="""
SELECT invoice_id, units, shipping_fee, freight_per_unit FROM freight"""))
def _(r):
    return allocate.freight_per_unit(r.items, r.invoices)


@query("ag_02_freight_positive_fee_only", with_roles(ITEMS, INVOICES, FREIGHT, body="""
SELECT invoice_id, units, shipping_fee - 500 AS shipping_fee,
  CASE WHEN units > 0 AND shipping_fee - 500 > 0 THEN (shipping_fee - 500) / units ELSE 0.0 END AS freight_per_unit
FROM freight"""))
def _(r):
    invoices = r.invoices.withColumn("shipping_fee", F.col("shipping_fee") - 500)
    return allocate.freight_per_unit(r.items, invoices, positive_only=True)


@query("mn_05_landed_unit_price", with_roles(ITEMS, INVOICES, FREIGHT, body="""
SELECT invoice_id, line_no, supplier_id, part_id, quantity, freight_per_unit,
  unit_price + freight_per_unit AS landed_price FROM items JOIN freight USING (invoice_id)"""))
def _(r):
    return allocate.landed_price(r.items, r.invoices).select(
        "invoice_id", "line_no", "supplier_id", "part_id", "quantity", "freight_per_unit", "landed_price")


@query("mn_12_freight_shares", with_roles(ITEMS, INVOICES, FREIGHT, body="""
SELECT invoice_id, any_value(f.shipping_fee) AS shipping_fee,
  abs(sum(freight_per_unit * quantity) - any_value(f.shipping_fee)) < 0.01 AS adds_up
FROM items JOIN freight f USING (invoice_id) GROUP BY invoice_id"""))
def _(r):
    """The freight shares of an invoice's lines add up to its fee."""
    lines = allocate.landed_price(r.items, r.invoices)
    shared = lines.groupBy("invoice_id").agg(
        F.sum(F.col("freight_per_unit") * F.col("quantity")).alias("shared"))
    return shared.join(r.invoices, "invoice_id").select(
        "invoice_id", "shipping_fee", (F.abs(F.col("shared") - F.col("shipping_fee")) < 0.01).alias("adds_up"))


@query("wn_01_register_shift", with_roles(*ROLES, body="""
SELECT invoice_id, line_no, supplier_id, part_id, quantity, c.row_index, sku,
  coalesce(l.qty_in, l.qty_prev, 0) AS qty_prev, quantity AS qty_in,
  coalesce(l.price_new, l.price_prev) AS price_prev, landed_price AS price_new
FROM checked c JOIN ledger l USING (row_index) WHERE outcome = 'ok'"""))
def _(r):
    shifted = cost.register_shift(cost.checked_items(r.items, r.invoices, r.ledger))
    return shifted.select("invoice_id", "line_no", "supplier_id", "part_id", "quantity", "row_index",
                          "sku", "qty_prev", "qty_in", "price_prev", "price_new")


@query("src_12_register_shift_with_stock", with_roles(*ROLES, body=f"""
SELECT invoice_id, line_no, supplier_id, part_id, qty_prev, price_prev, price_new, {CMP} FROM (
  SELECT c.*, CASE WHEN (row_index - 2) % 6 = 0 THEN 0 ELSE l.qty_prev + 3 END AS qty_prev,
    quantity AS qty_in, coalesce(l.price_new, l.price_prev) AS price_prev, landed_price AS price_new
  FROM checked c JOIN ledger l USING (row_index) WHERE outcome = 'ok') x"""))
def _(r):
    """Stock by internal SKU: the first variant counts, unknown or null is 0."""
    part = F.col("p_partkey")
    first = r.table("part").filter(part % 6 != 0).select(
        F.concat(F.lit("P"), part).alias("sku_internal"), (F.col("p_size") + 3).alias("on_hand"),
        F.lit(1).alias("variant"))
    second = first.withColumn("on_hand", F.col("on_hand") * 10).withColumn("variant", F.lit(2))
    shifted = cost.register_shift(cost.checked_items(r.items, r.invoices, r.ledger),
                                  first.unionByName(second))
    return shifted.select("invoice_id", "line_no", "supplier_id", "part_id", "qty_prev",
                          "price_prev", "price_new", "cmp")


@query("wn_18_last_line_wins", with_roles(*ROLES, ARRIVALS, body="""
SELECT invoice_id, a.row_index, sku, quantity AS qty_in, landed_price AS price_new, lines
FROM arrivals a JOIN (SELECT invoice_id, row_index, count(*) AS lines FROM checked
  WHERE outcome = 'ok' GROUP BY 1, 2) n USING (invoice_id, row_index)"""))
def _(r):
    shifted = cost.register_shift(cost.checked_items(r.items, r.invoices, r.ledger))
    return cost.last_line_wins(shifted, ITEM_ORDER).select(
        "invoice_id", "row_index", "sku", "qty_in", "price_new", "lines")


@query("wn_01_register_history", with_roles(*HISTORY_ROLES, body=f"""
SELECT row_index, invoice_date, invoice_id, qty_prev, qty_in, price_prev, price_new, {CMP} FROM history"""))
def _(r):
    return cost.cmp_history(r.items, r.invoices, r.ledger, ITEM_ORDER)


@query("wn_02_current_cmp", with_roles(*HISTORY_ROLES, body=f"""
SELECT row_index, invoice_date, invoice_id, qty_prev, qty_in, price_prev, price_new, {CMP}
FROM history WHERE age = 1"""))
def _(r):
    return cost.current_cmp(r.items, r.invoices, r.ledger, ITEM_ORDER)


ARRIVAL = ["shipped", "invoice_id", "line_no", "supplier_id", "quantity", "total"]


@query("wn_03_perpetual_average", with_roles(ITEMS, INVOICES, FREIGHT, body="""
SELECT part_id, shipped, invoice_id, line_no, supplier_id, quantity, total,
  sum(quantity) OVER w AS stock_qty,
  round(sum(quantity * (unit_price + freight_per_unit)) OVER w / sum(quantity) OVER w + 1e-7, 3) AS average_cost
FROM items JOIN freight USING (invoice_id)
WINDOW w AS (PARTITION BY part_id ORDER BY shipped, invoice_id, line_no, supplier_id, quantity, total
  ROWS UNBOUNDED PRECEDING)"""))
def _(r):
    bought = allocate.landed_price(r.items, r.invoices).select("part_id", *ARRIVAL, "landed_price")
    out = cost.perpetual_average(bought, "part_id", ARRIVAL, measure=r.items.select("part_id"))
    return out.select("part_id", *ARRIVAL, "stock_qty", cents(F.col("average_cost"), 3).alias("average_cost"))


MOVES = """moves AS (
  SELECT part_id AS product_id, shipped AS moved_at, 0 AS kind, invoice_id AS a, line_no AS b, supplier_id AS c,
    quantity AS d, total AS e, quantity AS change, unit_price AS price FROM items
  UNION ALL
  SELECT product_id, sold_at, 1, sale_id, 0, 0, 0, 0, -quantity, NULL FROM sales)"""


def stock_moves(r):
    z = F.lit(0)
    bought = r.items.select(
        F.col("part_id").alias("product_id"), F.col("shipped").alias("moved_at"), z.alias("kind"),
        F.col("invoice_id").alias("a"), F.col("line_no").cast("long").alias("b"), F.col("supplier_id").alias("c"),
        F.col("quantity").alias("d"), F.col("total").alias("e"), F.col("quantity").alias("change"),
        F.col("unit_price").alias("price"))
    sold = r.sales.select(
        "product_id", F.col("sold_at").alias("moved_at"), F.lit(1).alias("kind"), F.col("sale_id").alias("a"),
        z.cast("long").alias("b"), z.cast("long").alias("c"), F.lit(0.0).alias("d"), F.lit(0.0).alias("e"),
        (-F.col("quantity")).alias("change"), F.lit(None).cast("double").alias("price"))
    return bought.unionByName(sold)


MOVE_ORDER = ["moved_at", "kind", "a", "b", "c", "d", "e"]


WALK = """stocked AS (SELECT *, coalesce(sum(change) OVER (PARTITION BY product_id ORDER BY moved_at, kind, a, b, c, d, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stock_before,
    row_number() OVER (PARTITION BY product_id ORDER BY moved_at, kind, a, b, c, d, e) AS n FROM moves),
walk AS (
  SELECT product_id, n, moved_at, kind, a, b, c, d, e, price IS NOT NULL AS priced, CASE WHEN price IS NULL THEN 0 ELSE
      (greatest(stock_before, 0) * 0 + change * price) / (greatest(stock_before, 0) + change) END AS average FROM stocked WHERE n = 1
  UNION ALL
  SELECT s.product_id, s.n, s.moved_at, s.kind, s.a, s.b, s.c, s.d, s.e, w.priced OR s.price IS NOT NULL, CASE WHEN s.price IS NULL THEN w.average ELSE
      (greatest(s.stock_before, 0) * w.average + s.change * s.price) / (greatest(s.stock_before, 0) + s.change) END
  FROM walk w JOIN stocked s ON s.product_id = w.product_id AND s.n = w.n + 1)"""


@query("wn_03_average_with_sales", with_roles(ITEMS, SALES, MOVES, WALK, recursive=True, body="""
SELECT product_id, moved_at, kind, a, b, c, d, e, CASE WHEN priced THEN round(average + 1e-7, 3) END AS average_cost FROM walk"""))
def _(r):
    """Average cost of what is on stock after every purchase and sale."""
    out = cost.average_with_sales(stock_moves(r), "product_id", MOVE_ORDER, measure=moved_products(r))
    return out.select("product_id", *MOVE_ORDER, cents(F.col("average_cost"), 3).alias("average_cost"))


COSTS = """costs AS (SELECT part_id AS product_id, shipped AS moved_at, invoice_id * 1000000 + line_no * 100000 + supplier_id AS seq,
    max(unit_price) AS cmp FROM items GROUP BY 1, 2, 3)"""


def purchase_costs(r):
    seq = F.col("invoice_id") * 1000000 + F.col("line_no") * 100000 + F.col("supplier_id")
    return r.items.groupBy(F.col("part_id").alias("product_id"), F.col("shipped").alias("moved_at"),
                           seq.alias("seq")).agg(F.max("unit_price").alias("cmp"))


def moved_products(r):
    """The product of every purchase and sale, straight from the scans."""
    return r.items.select(F.col("part_id").alias("product_id")).unionByName(r.sales.select("product_id"))


ASOF = """sale_cost AS (
  SELECT s.sale_id, s.product_id, s.sold_at AS moved_at, s.quantity, s.unit_price,
    (SELECT arg_max(c.cmp, (c.moved_at, c.seq)) FROM costs c WHERE c.product_id = s.product_id AND c.moved_at <= s.sold_at) AS cmp_at_sale
  FROM sales s)"""


def sales_with_cost(r, max_rows=None):
    sales = r.sales.withColumnRenamed("sold_at", "moved_at")
    return cost.cost_at_sale(sales, purchase_costs(r), "product_id", "moved_at", max_rows, moved_products(r))


@query("jn_18_cost_at_sale", with_roles(ITEMS, SALES, COSTS, ASOF, body="SELECT * FROM sale_cost"))
def _(r):
    return sales_with_cost(r)


MARGINS = """margins AS (
  SELECT *, (unit_price - cmp_at_sale) / unit_price * 100 AS margin_pct,
    unit_price * quantity AS turnover,
    cmp_at_sale * quantity AS cost FROM sale_cost)"""
MARGIN_ROLES = (ITEMS, SALES, COSTS, ASOF, MARGINS)


def margins(r):
    s = sales_with_cost(r)
    return s.withColumns({
        "margin_pct": allocate.margin_percent(F.col("unit_price"), F.col("cmp_at_sale")),
        "turnover": (F.col("unit_price") * F.col("quantity")).cast(allocate.PRECISE),
        "cost": (F.col("cmp_at_sale") * F.col("quantity")).cast(allocate.PRECISE),
    })


@query("mn_08_margin_percent", with_roles(*MARGIN_ROLES, body="""
SELECT sale_id, product_id, unit_price, cmp_at_sale, margin_pct FROM margins"""))
def _(r):
    return margins(r).select("sale_id", "product_id", "unit_price", "cmp_at_sale", "margin_pct")


KPI_SQL = f"""count(*) AS sales, sum(quantity) AS volume, {cents_sql('sum(turnover)')} AS turnover,
  {cents_sql('sum(cost)')} AS cost, {cents_sql('sum(turnover) - sum(cost)')} AS margin,
  {cents_sql('(sum(turnover) - sum(cost)) / sum(turnover) * 100', 3)} AS profitability_pct, {cents_sql('avg(margin_pct)', 3)} AS average_margin_pct"""


def kpis():
    turnover, spent = F.sum("turnover").cast("double"), F.sum("cost").cast("double")
    share = F.try_divide(turnover - spent, turnover) * 100
    return [F.count(F.lit(1)).alias("sales"), F.sum("quantity").alias("volume"), cents(turnover).alias("turnover"),
            cents(spent).alias("cost"), cents(turnover - spent).alias("margin"),
            cents(share, 3).alias("profitability_pct"), cents(F.avg("margin_pct"), 3).alias("average_margin_pct")]


@query("ag_21_profitability_rollup", with_roles(*MARGIN_ROLES, body=f"""
SELECT product_id, year(moved_at) * 100 + month(moved_at) AS period, {KPI_SQL} FROM margins
WHERE cmp_at_sale IS NOT NULL GROUP BY ROLLUP (product_id, year(moved_at) * 100 + month(moved_at))"""))
def _(r):
    """KPIs per product and month, per product, and in total."""
    period = (F.year("moved_at") * 100 + F.month("moved_at")).alias("period")
    known = margins(r).filter("cmp_at_sale is not null").withColumn("period", period)
    return known.rollup("product_id", "period").agg(*kpis())


@query("ag_21_profitability_by_supplier", with_roles(*MARGIN_ROLES, body=f"""
, best AS (SELECT part_id AS product_id, arg_max(supplier_id, (shipped, invoice_id, line_no, supplier_id, quantity, total)) AS supplier_id
  FROM items GROUP BY 1)
SELECT supplier_id, s_nationkey AS nation_id, {KPI_SQL} FROM margins JOIN best USING (product_id)
JOIN supplier ON s_suppkey = supplier_id WHERE cmp_at_sale IS NOT NULL
GROUP BY CUBE (supplier_id, s_nationkey)"""))
def _(r):
    """KPIs by the supplier a product was last bought from and its country."""
    latest = r.items.groupBy(F.col("part_id").alias("product_id")).agg(
        F.max_by("supplier_id", F.struct(*ARRIVAL[:4], "quantity", "total")).alias("supplier_id"))
    known = join_on_key(margins(r).filter("cmp_at_sale is not null"), latest, ["product_id"], "inner")
    return known.join(r.suppliers, "supplier_id").cube("supplier_id", "nation_id").agg(*kpis())


@query("ag_22_cmp_record", with_roles(ITEMS, INVOICES, FREIGHT, body="""
SELECT part_id AS product_id, sum(quantity) AS quantity, max(shipped) AS calculated_at,
  round(sum(quantity * (unit_price + freight_per_unit)) + 1e-7, 2) AS total_cost,
  round(sum(quantity * (unit_price + freight_per_unit)) / sum(quantity) + 1e-7, 3) AS cmp_value
FROM items JOIN freight USING (invoice_id) GROUP BY part_id"""))
def _(r):
    value = (F.col("quantity") * F.col("landed_price")).cast(allocate.PRECISE)
    return allocate.landed_price(r.items, r.invoices).groupBy(F.col("part_id").alias("product_id")).agg(
        F.sum("quantity").alias("quantity"), F.max("shipped").alias("calculated_at"),
        cents(F.sum(value)).alias("total_cost"),
        cents(F.sum(value).cast("double") / F.sum("quantity"), 3).alias("cmp_value"))


@query("ag_23_purchase_history", with_roles(ITEMS, body="""
SELECT part_id AS product_id, shipped AS bought_on, count(*) AS purchases, sum(quantity) AS quantity,
  min(unit_price) AS lowest, max(unit_price) AS highest FROM items GROUP BY 1, 2"""))
def _(r):
    """Purchases of a product by date, one row per date (no list per product)."""
    return r.items.groupBy(F.col("part_id").alias("product_id"), F.col("shipped").alias("bought_on")).agg(
        F.count(F.lit(1)).alias("purchases"), F.sum("quantity").alias("quantity"),
        F.min("unit_price").alias("lowest"), F.max("unit_price").alias("highest"))


@query("wn_20_margin_ranking", with_roles(*MARGIN_ROLES, body="""
, daily AS (SELECT product_id, moved_at, sum(turnover) - sum(cost) AS m FROM margins WHERE cmp_at_sale IS NOT NULL GROUP BY 1, 2),
running AS (SELECT product_id, moved_at, round(m + 1e-7, 2) AS margin,
  round(sum(m) OVER (PARTITION BY product_id ORDER BY moved_at ROWS UNBOUNDED PRECEDING) + 1e-7, 2) AS running_margin FROM daily),
total AS (SELECT product_id, dense_rank() OVER (ORDER BY round(sum(m) + 1e-7, 2) DESC) AS place FROM daily GROUP BY product_id)
SELECT r.*, place FROM running r JOIN total USING (product_id)"""))
def _(r):
    """Running margin of every product over time and its place by total margin."""
    daily = margins(r).filter("cmp_at_sale is not null").groupBy("product_id", "moved_at").agg(
        (F.sum("turnover") - F.sum("cost")).alias("m"))
    return cost.margin_ranking(daily).select(
        "product_id", "moved_at", cents(F.col("m")).alias("margin"),
        cents(F.col("running")).alias("running_margin"), "place")
