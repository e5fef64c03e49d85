"""Queries: supplier SKU, brand, ledger, rule and file matching."""

from pyspark.sql import functions as F

from costloom.functions.text import normalize_sku
from costloom.operators import cost, match, quality
from costloom.operators.keyed import join_on_key
from costloom.plans.costing import CHECKED, FREIGHT, KEYS, ROLES
from costloom.plans.registry import query
from costloom.plans.roles import (ALIASES, INVOICES, ITEM_ORDER, ITEMS, LEDGER, PRODUCTS, SUPPLIERS,
                                  with_roles)
from costloom.sources.scan import tasks_for

KEYS_PER_TASK = 20_000  # keys that one task cuts into pieces
LINE = ["invoice_id", "line_no", "supplier_id", "part_id", "quantity", "total"]
LINE_SQL = ", ".join(LINE)
FIRST_ALIAS = """first_alias AS (
  SELECT sku, arg_min(product_id, alias_id) AS product_id, arg_min(brand, alias_id) AS brand
  FROM aliases WHERE trim(sku) <> '' GROUP BY sku)"""
MAPPED = """mapped AS (
  SELECT i.*, f.product_id, p.sku_internal, f.product_id IS NOT NULL AS mapping_found
  FROM items i LEFT JOIN first_alias f USING (sku) LEFT JOIN products p ON p.product_id = f.product_id)"""
MAPPED_ROLES = (ITEMS, ALIASES, PRODUCTS, FIRST_ALIAS, MAPPED)


def mapped_items(r):
    return match.map_items_to_products(r.items, r.aliases, r.products)


@query("jn_01_item_to_product", with_roles(*MAPPED_ROLES, body=f"""
SELECT {LINE_SQL}, sku, product_id, sku_internal, mapping_found FROM mapped"""))
def _(r):
    return mapped_items(r).select(*LINE, "sku", "product_id", "sku_internal", "mapping_found")


BRANDED = """branded AS (
  SELECT 2 * p_partkey AS alias_id, p_partkey AS product_id, lower(p_brand) AS sku,
    'by Supplier#' || lpad(CAST(p_partkey % 13 AS VARCHAR), 9, '0') AS brand FROM part)"""


@query("jn_02_sku_and_brand", with_roles(ITEMS, SUPPLIERS, BRANDED, body=f"""
, best AS (SELECT i.sku, s.supplier_name, min(b.alias_id) AS alias_id
  FROM (SELECT DISTINCT sku, supplier_id FROM items) i JOIN suppliers s USING (supplier_id)
  JOIN branded b ON b.sku = i.sku AND contains(b.brand, s.supplier_name) GROUP BY 1, 2)
SELECT {LINE_SQL}, i.sku, s.supplier_name, b.alias_id // 2 AS product_id, b.alias_id
FROM items i JOIN suppliers s USING (supplier_id) LEFT JOIN best b ON b.sku = i.sku AND b.supplier_name = s.supplier_name"""))
def _(r):
    """Brand text of an alias names its supplier; brand SKUs exist per supplier."""
    part = F.col("p_partkey")
    branded = r.table("part").select(
        (part * 2).alias("alias_id"), part.alias("product_id"), F.lower("p_brand").alias("sku"),
        F.concat(F.lit("by Supplier#"), F.lpad((part % 13).cast("string"), 9, "0")).alias("brand"))
    items = join_on_key(r.items, r.suppliers.select("supplier_id", "supplier_name"), ["supplier_id"], "inner").select(
        *LINE, "sku", "supplier_name")
    return match.map_by_sku_and_brand(items, branded)


@query("jn_03_ledger_match", with_roles(*ROLES, body=f"""
SELECT {LINE_SQL}, sku, CASE WHEN outcome = 'error' THEN 'ok' ELSE outcome END AS match, hits, row_index FROM checked"""))
def _(r):
    return match.match_ledger(r.items, r.ledger).select(
        *LINE, "sku", "match", "hits", F.col("row.row_index").alias("row_index"))


@query("jn_03_double_token_is_ambiguous", with_roles(body="""
cells AS (SELECT p_partkey + 2 AS row_index,
    CASE WHEN p_partkey % 3 = 0 THEN ' p' || p_partkey || '/P' || p_partkey || ' ,' ELSE '|p' || p_partkey || ';' END AS cell FROM part),
tokens AS (SELECT row_index, upper(trim(unnest(regexp_split_to_array(cell, '[,;/|]')))) AS t FROM cells)
SELECT t AS match_sku, count(*) AS hits, min(row_index) AS first_row FROM tokens WHERE t <> '' GROUP BY t"""))
def _(r):
    """A token repeated in one cell counts twice; empty tokens do not count."""
    part = F.col("p_partkey")
    twice = F.concat(F.lit(" p"), part, F.lit("/P"), part, F.lit(" ,"))
    once = F.concat(F.lit("|p"), part, F.lit(";"))
    cells = r.table("part").select((part + 2).alias("row_index"),
                                   F.when(part % 3 == 0, twice).otherwise(once).alias("supplier_skus"))
    return match.ledger_keys(cells).select("match_sku", "hits", F.col("row.row_index").alias("first_row"))


@query("jn_04_near_match_hints", with_roles(*ROLES, body="""
, u AS (SELECT DISTINCT upper(trim(sku)) AS sku FROM checked WHERE outcome = 'not_found'),
k AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'AX' || p_partkey ELSE 'X' || (p_partkey // 10) END AS known_sku FROM part),
lens AS (SELECT unnest(range(1, 6)) AS n), spots AS (SELECT unnest(range(1, 40)) AS i),
kp AS (SELECT DISTINCT known_sku, substr(known_sku, i, n) AS piece FROM k, lens, spots WHERE i <= length(known_sku)),
up AS (SELECT DISTINCT sku, substr(sku, i, n) AS piece FROM u, lens, spots WHERE i <= length(sku)),
fw AS (SELECT piece, count(*) AS n_known, min(known_sku) AS first_known FROM kp GROUP BY piece),
bw AS (SELECT substr(known_sku, 1, 5) AS piece, count(*) AS n_known, min(known_sku) AS first_known FROM k GROUP BY 1)
SELECT sku, piece, n_known, first_known, 'known contains it' AS link FROM u JOIN fw ON piece = substr(sku, 1, 5)
UNION ALL SELECT sku, piece, n_known, first_known, 'contains known' FROM up JOIN bw USING (piece)"""))
def _(r):
    """Hints for the codes the register lacks, against a catalogue of codes."""
    part = F.col("p_partkey")
    unmatched = match.match_ledger(r.items, r.ledger).filter("match = 'not_found'").select(F.col("match_sku").alias("sku"))
    code = F.when(part % 2 == 0, F.concat(F.lit("AX"), part)).otherwise(F.concat(F.lit("X"), F.floor(part / 10)))
    return match.near_keys(unmatched, r.table("part").select(code.alias("sku")), tasks=tasks_for(r.table("part"), KEYS_PER_TASK))


@query("jn_05_bulk_mapping_check", with_roles(ITEMS, ALIASES, PRODUCTS, body="""
, batch AS (SELECT row_number() OVER (ORDER BY p_partkey, k) AS "row",
    CASE WHEN p_partkey % 10 = 0 THEN 'Q' ELSE 'P' END || p_partkey AS sku_internal,
    CASE WHEN k = 1 THEN ' p' || p_partkey WHEN k = 2 THEN 'new' || p_partkey ELSE 'new' || (p_partkey - p_partkey % 2) END AS sku
  FROM part, (VALUES (1), (2), (3)) v(k)),
found AS (SELECT b.*, p.product_id, EXISTS (SELECT 1 FROM aliases a WHERE a.sku = b.sku AND a.product_id = p.product_id) AS there,
    row_number() OVER (PARTITION BY b.sku_internal, b.sku ORDER BY b."row") AS nth
  FROM batch b LEFT JOIN products p USING (sku_internal))
SELECT "row", sku_internal, sku, product_id,
  CASE WHEN product_id IS NULL THEN 'internal SKU ''' || sku_internal || ''' not found'
       WHEN there OR nth > 1 THEN 'Mapping already exists for supplier SKU ''' || sku || '''' END AS error,
  product_id IS NOT NULL AND NOT there AND nth = 1 AS created FROM found"""))
def _(r):
    """Three requested mappings per product: existing, new, and repeated or new."""
    part, k = F.col("p_partkey"), F.col("k")
    requests = r.table("part").select(part, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    batch = requests.select(
        (part * 3 + k).alias("row"),
        F.concat(F.when(part % 10 == 0, "Q").otherwise("P"), part).alias("sku_internal"),
        F.when(k == 1, F.concat(F.lit(" p"), part)).when(k == 2, F.concat(F.lit("new"), part))
        .otherwise(F.concat(F.lit("new"), part - part % 2)).alias("sku"))
    return match.validate_mappings(batch, r.products, r.aliases)


@query("jn_06_export_mapping", with_roles(ITEMS, LEDGER, body=f"""
, m AS (SELECT upper(trim(split_part(supplier_skus, ';', 1))) AS k, arg_max(sku_internal, row_index) AS s
  FROM ledger GROUP BY 1)
SELECT {LINE_SQL}, sku, coalesce(m.s, sku) AS export_sku FROM items LEFT JOIN m ON m.k = upper(trim(sku))"""))
def _(r):
    ledger = r.ledger.withColumn("supplier_skus", F.split("supplier_skus", ";")[0])
    items = r.items.select(*LINE, "sku")
    return match.export_items(items, match.export_mapping(ledger))


@query("snk_05_export_dataset", with_roles(ITEMS, LEDGER, body="""
, m AS (SELECT upper(trim(split_part(supplier_skus, ';', 1))) AS k, arg_max(sku_internal, row_index) AS s
  FROM ledger GROUP BY 1)
SELECT invoice_id, '' AS blank, coalesce(m.s, sku) AS sku, quantity FROM items LEFT JOIN m ON m.k = upper(trim(sku))"""))
def _(r):
    """The export rows: an empty column, the SKU, the quantity."""
    ledger = r.ledger.withColumn("supplier_skus", F.split("supplier_skus", ";")[0])
    out = match.export_items(r.items, match.export_mapping(ledger))
    return out.select("invoice_id", F.lit("").alias("blank"), F.col("export_sku").alias("sku"), "quantity")


RULES = """rules AS (
  SELECT lower('nation_' || n_nationkey) AS key, n_nationkey AS ord, 'rule_' || n_name AS rule FROM nation)"""
NAMED = """named AS (
  SELECT s_suppkey AS supplier_id, CASE s_suppkey % 4 WHEN 0 THEN ' Nation_' || s_nationkey || ' '
    WHEN 1 THEN 'Trade NATION_' || s_nationkey || ' Ltd' WHEN 2 THEN 'nation_' || s_nationkey || '9 and nation_3'
    ELSE s_name END AS supplier_name FROM supplier)"""


def rule_table(r):
    nation = r.table("nation")
    return nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("key"),
                         F.col("n_nationkey").alias("ord"), F.concat(F.lit("rule_"), "n_name").alias("rule"))


def named_suppliers(r):
    turn, nation = F.col("s_suppkey") % 4, F.col("s_nationkey")
    name = (F.when(turn == 0, F.concat(F.lit(" Nation_"), nation, F.lit(" ")))
            .when(turn == 1, F.concat(F.lit("Trade NATION_"), nation, F.lit(" Ltd")))
            .when(turn == 2, F.concat(F.lit("nation_"), nation, F.lit("9 and nation_3")))
            .otherwise(F.col("s_name")))
    return r.table("supplier").select(F.col("s_suppkey").alias("supplier_id"), name.alias("supplier_name"))


@query("jn_08_supplier_rule", with_roles(RULES, NAMED, body="""
SELECT n.*, (SELECT arg_min(rule, (key <> lower(trim(supplier_name)), ord)) FROM rules WHERE contains(lower(trim(supplier_name)), key)) AS rule,
  (SELECT arg_min(key, (key <> lower(trim(supplier_name)), ord)) FROM rules WHERE contains(lower(trim(supplier_name)), key)) AS rule_key
FROM named n"""))
def _(r):
    """Exact name first, then the first rule key contained in the name, else none."""
    return match.assign_rules(named_suppliers(r), rule_table(r))


@query("jn_09_rule_with_aliases", with_roles(RULES, NAMED, body="""
, slugs AS (SELECT supplier_id, replace(lower(trim(supplier_name)), ' ', '_') AS slug FROM named),
alias AS (SELECT 'supplier#' || lpad(CAST(n_nationkey * 4 + 3 AS VARCHAR), 9, '0') AS slug, 'nation_' || n_nationkey AS key FROM nation)
SELECT supplier_id, s.slug, coalesce(e.rule, a.rule) AS rule, coalesce(e.rule, a.rule) IS NOT NULL AS has_rule
FROM slugs s LEFT JOIN rules e ON e.key = s.slug LEFT JOIN alias x ON x.slug = s.slug LEFT JOIN rules a ON a.key = x.key"""))
def _(r):
    """Vendor slug -> rule: its own name, else the name an alias table gives."""
    slugs = named_suppliers(r).select(
        "supplier_id", F.replace(F.lower(F.trim("supplier_name")), F.lit(" "), F.lit("_")).alias("slug"))
    rules = rule_table(r).select("key", "rule")
    alias = r.table("nation").select(
        F.concat(F.lit("supplier#"), F.lpad((F.col("n_nationkey") * 4 + 3).cast("string"), 9, "0")).alias("slug"),
        F.concat(F.lit("nation_"), "n_nationkey").alias("key"))
    own = join_on_key(slugs, rules.select(F.col("key").alias("slug"), F.col("rule").alias("own")), ["slug"])
    by_alias = alias.join(rules, "key").select("slug", F.col("rule").alias("other"))
    rule = F.coalesce("own", "other")
    return join_on_key(own, by_alias, ["slug"]).select(
        "supplier_id", "slug", rule.alias("rule"), rule.isNotNull().alias("has_rule"))


@query("jn_17_unmapped_items", with_roles(ITEMS, ALIASES, body=f"""
SELECT {LINE_SQL}, sku FROM items i WHERE NOT EXISTS (SELECT 1 FROM aliases a WHERE a.sku = i.sku AND trim(a.sku) <> '')"""))
def _(r):
    return match.unmapped_items(r.items.select(*LINE, "sku"), r.aliases)


@query("jn_17_mapped_items", with_roles(ITEMS, ALIASES, body=f"""
SELECT {LINE_SQL}, sku FROM items i WHERE EXISTS (SELECT 1 FROM aliases a WHERE a.sku = i.sku AND trim(a.sku) <> '')"""))
def _(r):
    return match.mapped_items(r.items.select(*LINE, "sku"), r.aliases)


@query("jn_19_product_aliases", with_roles(PRODUCTS, ALIASES, body="""
SELECT DISTINCT p.product_id, p.sku_internal, a.sku AS supplier_sku, a.brand FROM products p LEFT JOIN aliases a USING (product_id)"""))
def _(r):
    return match.product_aliases(r.products.select("product_id", "sku_internal"), r.aliases)


@query("ag_09_parsing_stats", with_roles(*MAPPED_ROLES, body="""
SELECT invoice_id, count(*) AS total_items, count(*) FILTER (mapping_found) AS mapped_items,
  count(*) FILTER (NOT mapping_found) AS unmapped_items FROM mapped GROUP BY invoice_id"""))
def _(r):
    return mapped_items(r).groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if("mapping_found").alias("mapped_items"),
        F.count_if(~F.col("mapping_found")).alias("unmapped_items"))


LINES_PER_TASK = 100_000  # lines whose invoices one task counts
COUNTERS = """count(*) AS processed, count(*) FILTER (outcome = 'ok') AS updated,
  count(*) FILTER (outcome IN ('not_found', 'ambiguous')) AS skipped,
  count(*) FILTER (outcome = 'not_found') AS not_found, count(*) FILTER (outcome = 'ambiguous') AS ambiguous,
  count(*) FILTER (outcome = 'error') AS errors"""


def counters():
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return [F.count(F.lit(1)).alias("processed"), is_("ok").alias("updated"),
            is_("not_found", "ambiguous").alias("skipped"), is_("not_found").alias("not_found"),
            is_("ambiguous").alias("ambiguous"), is_("error").alias("errors")]


def faulty_items(r):
    """The items with some quantities and prices turned bad."""
    return r.items.withColumn("quantity", F.when(F.col("part_id") % 13 == 0, 0.0).otherwise(F.col("quantity"))) \
        .withColumn("unit_price", F.when(F.col("part_id") % 17 == 0, -F.col("unit_price")).otherwise(F.col("unit_price")))


FAULTY = ITEMS.replace("items AS", "good_items AS") + """,
items AS (SELECT * REPLACE (CASE WHEN part_id % 13 = 0 THEN 0 ELSE quantity END AS quantity,
    CASE WHEN part_id % 17 = 0 THEN -unit_price ELSE unit_price END AS unit_price) FROM good_items)"""
FAULTY_ROLES = (FAULTY, INVOICES, LEDGER, KEYS, FREIGHT, CHECKED)


@query("flt_13_domain_errors", with_roles(*FAULTY_ROLES, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total, outcome,
  CASE WHEN outcome = 'error' THEN CASE WHEN quantity <= 0 THEN 'Invalid quantity for ' ELSE 'Invalid unit price for ' END || sku END AS error
FROM checked"""))
def _(r):
    return cost.checked_items(faulty_items(r), r.invoices, r.ledger).select(
        "invoice_id", "line_no", "supplier_id", "part_id", "total", "outcome", "error")


@query("ag_10_cost_run_counters", with_roles(*FAULTY_ROLES, body=f"""
SELECT invoice_id, {COUNTERS} FROM checked GROUP BY invoice_id"""))
def _(r):
    return cost.checked_items(faulty_items(r), r.invoices, r.ledger).groupBy("invoice_id").agg(*counters())


@query("ag_10_cost_run_lists", with_roles(*FAULTY_ROLES, body="""
SELECT invoice_id, outcome, line_no, supplier_id, part_id, total, sku FROM checked WHERE outcome <> 'ok'"""))
def _(r):
    """The not-found, ambiguous and error lists, one row per entry with its order."""
    return cost.checked_items(faulty_items(r), r.invoices, r.ledger).filter("outcome <> 'ok'").select(
        "invoice_id", "outcome", "line_no", "supplier_id", "part_id", "total", "sku")


@query("snk_06_run_report", with_roles(*FAULTY_ROLES, body=f"""
, c AS (SELECT invoice_id, {COUNTERS} FROM checked GROUP BY invoice_id),
head AS (SELECT invoice_id, unnest(['=== Invoice Processing Report ===', 'Total items: ' || processed, 'Processed: ' || processed,
    'Updated: ' || updated, 'Skipped: ' || skipped, '', 'Not found SKUs (' || not_found || '):', '',
    'Ambiguous SKUs (' || ambiguous || '):', '', 'Errors (' || errors || '):']) AS text,
    unnest([1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 13]) AS section FROM c)
SELECT invoice_id, section, text FROM head
UNION ALL SELECT invoice_id, CASE outcome WHEN 'not_found' THEN 8 WHEN 'ambiguous' THEN 11 ELSE 14 END,
  '  - ' || CASE WHEN outcome <> 'error' THEN sku WHEN quantity <= 0 THEN 'Invalid quantity for ' || sku ELSE 'Invalid unit price for ' || sku END
FROM checked WHERE outcome <> 'ok'"""))
def _(r):
    """Report lines of every run, ordered by invoice, section and line."""
    # Dealt by invoice, so that a task counts the lines of its own invoices only, however large a part of the table is read at a time.
    items = faulty_items(r).repartition(tasks_for(r.items, LINES_PER_TASK), "invoice_id")
    lines = quality.run_report(cost.checked_items(items, r.invoices, r.ledger, r.items), counters(), ITEM_ORDER)
    return lines.select("invoice_id", "section", "text")


@query("st_05_distinct_keys", with_roles(ITEMS, body="""
SELECT DISTINCT upper(trim(sku)) AS match_sku FROM items"""))
def _(r):
    return r.items.select(normalize_sku(F.col("sku")).alias("match_sku")).distinct()


@query("jn_11_stored_file", with_roles(body="""
stored AS (SELECT event_id || '_' || user_id || '_' || lower(event_type) || '_' || (event_id % 400) || '.pdf' AS stored_name FROM events),
wanted AS (SELECT o_orderkey AS invoice_id, lower('CLICK') || '_' || (o_orderkey % 500) || '.pdf' AS file_name FROM orders),
firsts AS (SELECT w.file_name, min(s.stored_name) AS stored_name FROM (SELECT DISTINCT file_name FROM wanted) w
  JOIN stored s ON contains(s.stored_name, w.file_name) GROUP BY 1)
SELECT invoice_id, w.file_name, f.stored_name FROM wanted w LEFT JOIN firsts f USING (file_name)"""))
def _(r):
    """Invoices find the stored file whose name contains theirs; first by name."""
    stored = r.table("events").select(F.concat_ws(
        "_", "event_id", "user_id", F.lower("event_type"),
        F.concat(F.col("event_id") % 400, F.lit(".pdf"))).alias("stored_name"))
    wanted = r.table("orders").select(
        F.col("o_orderkey").alias("invoice_id"),
        F.concat(F.lit("click_"), F.col("o_orderkey") % 500, F.lit(".pdf")).alias("file_name"))
    return match.match_stored_files(wanted, stored)
