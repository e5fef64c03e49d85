"""Queries: fields, table regions, row patterns, grids and row repair."""

from pyspark.sql import functions as F

from costloom.operators import extract, invoices, projections
from costloom.operators import lines as below
from costloom.operators import rows as rows_of
from costloom.operators.keyed import join_on_key
from costloom.operators.ordered import row_numbers
from costloom.plans.registry import query
from costloom.plans.roles import ITEM_ORDER, ITEMS, with_roles
from costloom.sources.documents import join_pages, lines_of
from costloom.sources.rules import RULE_SCHEMA, with_defaults
from costloom.sources.scan import tasks_for

NUMBERS = [{"name": n, "regex_group": g, "type": "number"} for n, g in (("quantity", 3), ("unit_price", 4), ("total", 5))]
ITEM_COLUMNS = [{"name": "sku", "regex_group": 1}, {"name": "description", "regex_group": 2}, *NUMBERS]
PROSE_COLUMNS = [{"name": "description", "regex_group": 1}, {"name": "sku", "regex_group": 3}]


def prose_rule(lang, words, **more):
    return {"vendor": {"name": lang, **more.pop("vendor", {})}, "table": {
        "strategy": "text_regex_multiline", "row_pattern": f"([a-z]+) ({words}) ([a-z]+)", "columns": PROSE_COLUMNS, **more}}


RULES = [
    {"vendor": {"name": "Line Vendor"}, "table": {
        "strategy": "text_regex", "start_marker": r"Code\s+::\s+Text", "end_marker": "Sum of lines",
        "row_pattern": r"^([A-Z]\d+) (.+?) :: (\d+) u\. :: ([\d.,]+) :: ([\d.,]+)$", "columns": ITEM_COLUMNS,
        "row_validator_regex": r" u\. :: .+,\d\d$"}},
    {"vendor": {"name": "Pair Vendor"}, "flags": {"merge_two_lines": True}, "table": {
        "strategy": "text_regex",
        "row_pattern": r"^> ([A-Z]\d+) ~ (.+)$|^= ([\d.,]+) x ([\d.,]+) -> ([\d.,]+)$", "columns": ITEM_COLUMNS}},
    prose_rule("en", "the|of", vendor={"currency": "GBP"}, start_marker=" and ", end_marker=" that ",
               row_pattern_alt="of ([a-z]+) (the) ([a-z]+)", columns_alt=PROSE_COLUMNS),
    prose_rule("fr", "de|la"), prose_rule("de", "der|die"), prose_rule("es", "de|que"),
]
FIELDS = [
    {"name": "mail", "regex": "([a-z0-9._]+@[a-z0-9.]+)"}, {"name": "token", "regex": r'token = "(\w+)"'},
    {"name": "number", "regex": r"(\d+[.,]\d+)", "type": "number"},
]


def rules(r):
    return with_defaults(r.spark.createDataFrame(RULES, RULE_SCHEMA))


def cents_text(amount):
    """An amount with a decimal comma, spelled from exact cents."""
    c = F.round(amount * 100).cast("long")
    return F.concat(F.floor(c / 100), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


ROWS_PER_TASK = 1_000_000
LINES_PER_ITEM = 3  # printed lines, at most


def numbered_items(r, rows_per_item=None, tasks=None):
    """Items with ``pos``.  A query that makes many rows of an item says how many (or for how
    many ``tasks``): the items are then dealt to tasks by what is made of them, and stay where they are."""
    if rows_per_item is None and tasks is None:
        return row_numbers(r.items, ["invoice_id"], ITEM_ORDER)
    items = r.items.repartition(tasks or item_tasks(r, rows_per_item), "invoice_id")
    return row_numbers(items, ["invoice_id"], ITEM_ORDER, measure=r.items.select("invoice_id"))


def item_tasks(r, rows_per_item):
    return tasks_for(r.items, ROWS_PER_TASK // rows_per_item)


NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no, supplier_id, part_id, quantity, total) AS pos FROM items)"""


def doc_keys(r, rows_per_item=3):
    """The document of every row a query makes of the items, at most so many each; a share
    of them is made of a share of the items."""
    def seen(share):
        items = r.items.select(F.col("invoice_id").alias("doc_id"))
        copies = F.explode(F.sequence(F.lit(1), F.lit(rows_per_item)))
        return (items if share == 1.0 else items.sample(share, seed=11)).select("doc_id", copies.alias("_copy")).drop("_copy")

    return seen


def invoice_lines(r):
    """Invoices printed as text: even ones on one line per item with extra code
    lines, odd ones with two lines per item."""
    part, base = F.col("part_id"), (F.col("pos") * 4 + 10).cast("long")
    line = lambda n, t, when=None: F.struct(n.alias("line_no"), (t if when is None else F.when(when, t)).alias("text"))
    qty, total = F.col("quantity").cast("int"), cents_text(F.col("total"))
    even = F.array(
        line(base, F.concat(F.lit("A"), part, F.when(part % 17 == 0, " Shipping fee ").otherwise(" Item "), part,
                            F.lit(" :: "), qty, F.lit(" u. :: "), part, F.lit(",50 :: "), total)),
        line(base + 1, F.concat(F.lit("FID: 6"), part), (part % 3 == 0) & (part % 17 != 0)),
        line(base + 2, F.concat(F.lit("FID: 7"), part), (part % 6 == 0) & (part % 17 != 0)))
    odd = F.array(
        line(base, F.concat(F.lit("> B"), part, F.lit(" ~ Item "), part)),
        line(base + 1, F.concat(F.lit("= "), qty, F.lit(" x "), part, F.lit(",50 -> "), total), part % 5 != 0),
        line(base + 2, F.lit("= 9 x 1,00 -> 9,00"), (part % 11 == 0) & (part % 5 != 0)))
    is_even = F.col("invoice_id") % 2 == 0
    fixed = lambda n, t: line(F.lit(n).cast("long"), F.lit(t))
    frame = F.array(
        fixed(1, "Invoice"), fixed(2, "A9 outside :: 1 u. :: 1,00 :: 1,00"), fixed(3, "Code  ::  Text"),
        fixed(10**9, "Sum of lines 1,00"), fixed(10**9 + 1, "A9 after :: 1 u. :: 1,00 :: 1,00"))
    # The frame of an invoice is printed with its first item.
    lines = F.when(is_even & (F.col("pos") == 1), F.concat(frame, even)).when(is_even, even).otherwise(odd)
    vendor = F.when(is_even, "LINE vendor ").otherwise("pair vendor")
    return numbered_items(r, LINES_PER_ITEM).select("invoice_id", F.inline(lines)).filter("text is not null").select(
        F.col("invoice_id").alias("doc_id"), vendor.alias("vendor"), "line_no", "text")


@query("sc_22_row_pattern_items", with_roles(ITEMS, NUMBERED, body="""
SELECT invoice_id AS doc_id, pos * 4 + CASE WHEN invoice_id % 2 = 0 THEN 10 ELSE 11 END AS line_no,
  CASE WHEN invoice_id % 2 = 1 THEN 'B' || part_id WHEN part_id % 6 = 0 THEN '7' || part_id WHEN part_id % 3 = 0 THEN '6' || part_id ELSE 'A' || part_id END AS sku,
  'Item ' || part_id AS description, CAST(quantity AS DOUBLE) AS quantity, part_id + 0.5::DOUBLE AS unit_price, total
FROM numbered WHERE CASE WHEN invoice_id % 2 = 0 THEN part_id % 17 <> 0 ELSE part_id % 5 <> 0 END"""))
def _(r):
    """Line-by-line rules: table region, row pattern, two-line merge, code lines."""
    items = extract.text_items(invoice_lines(r), rules(r), measure=doc_keys(r))
    number = lambda c: F.col(c).try_cast("double").alias(c)
    return items.select("doc_id", "line_no", "sku", "description", number("quantity"), number("unit_price"), number("total"))


@query("wn_06_trailing_code_lines", with_roles(ITEMS, NUMBERED, body="""
SELECT invoice_id AS doc_id, pos * 4 + 10 AS line_no, CASE WHEN part_id % 6 = 0 THEN '7' || part_id ELSE '6' || part_id END AS sku, quantity
FROM numbered WHERE invoice_id % 2 = 0 AND part_id % 3 = 0 AND part_id % 17 <> 0"""))
def _(r):
    """Items whose code came from a later line; the last such line wins."""
    items = extract.text_items(invoice_lines(r), rules(r), measure=doc_keys(r))
    return items.filter("sku rlike '^[0-9]'").select("doc_id", "line_no", "sku", F.col("quantity").cast("double").alias("quantity"))


@query("wn_07_two_line_merge", with_roles(ITEMS, NUMBERED, body="""
SELECT invoice_id AS doc_id, pos * 4 + 11 AS line_no, 'B' || part_id AS sku, 'Item ' || part_id AS description, quantity, part_id + 0.5::DOUBLE AS unit_price, total
FROM numbered WHERE invoice_id % 2 = 1 AND part_id % 5 <> 0"""))
def _(r):
    """Code line plus amount line; orphan amounts and bare code lines vanish."""
    items = extract.text_items(invoice_lines(r), rules(r), measure=doc_keys(r))
    number = lambda c: F.col(c).cast("double").alias(c)
    return items.filter("sku like 'B%'").select("doc_id", "line_no", "sku", "description", number("quantity"), number("unit_price"), number("total"))


@query("ag_14_shipping_from_rows", with_roles(ITEMS, body="""
SELECT invoice_id AS doc_id, CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS shipping_fee FROM items
WHERE invoice_id % 2 = 0 AND part_id % 17 = 0 GROUP BY 1"""))
def _(r):
    """Freight read from the shipping rows of the printed invoices."""
    ruled = extract.prepared(invoice_lines(r), rules(r).filter("strategy = 'text_regex'"))
    found = extract.row_items(extract.table_lines(ruled, measure=doc_keys(r)))
    return extract.shipping_fee(extract.classify(found))


DOC_LINES = """dl AS (SELECT doc_id, i - 1 AS line_no, t[i] AS text FROM (
  SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) x)"""


def doc_lines(r):
    return lines_of(r.table("documents").select("doc_id", "text"))


@query("src_06_document_lines", with_roles(DOC_LINES, body="SELECT doc_id, line_no, text FROM dl"))
def _(r):
    return doc_lines(r)


@query("src_06_joined_pages", """
SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def _(r):
    """Page texts of a document joined in page order (a document's pages only)."""
    pages = r.table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return join_pages(pages)


@query("wn_05_table_region", with_roles(DOC_LINES, body="""
, m AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^(the|de|die) ') THEN 1 WHEN regexp_matches(text, '(?i)^(to|la|das|in) ') THEN 0 END AS mark FROM dl),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS state FROM m)
SELECT doc_id, line_no, text FROM s WHERE mark IS NULL AND state = 1"""))
def _(r):
    """Lines between opening and closing lines; regions may open again."""
    lines = doc_lines(r).withColumns({"start_marker": F.lit("^(the|de|die) "), "end_marker": F.lit("^(to|la|das|in) ")})
    return extract.table_lines(lines, bounded=True).select("doc_id", "line_no", "text")


WORDS = {"en": "the|of", "fr": "de|la", "de": "der|die", "es": "de|que"}
PROSE = """area AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN regexp_replace(regexp_replace(text, '(?is)\\A.*?(?: and )', ''), '(?is)(?: that ).*\\z', '') ELSE text END AS t
  FROM documents),
hits AS (
  """ + "\n  UNION ALL ".join(
    f"SELECT doc_id, 1 AS variant, unnest(regexp_extract_all(t, '([a-z]+) ({w}) ([a-z]+)')) AS hit FROM area WHERE lang = '{lang}'" for lang, w in WORDS.items()) + """
  UNION ALL SELECT doc_id, 2, unnest(regexp_extract_all(t, 'of ([a-z]+) (the) ([a-z]+)')) FROM area WHERE lang = 'en'),
found AS (SELECT doc_id, variant, CASE variant WHEN 2 THEN regexp_extract(hit, 'of ([a-z]+) (the) ([a-z]+)', 1) ELSE regexp_extract(hit, '([a-z]+) ([a-z]+) ([a-z]+)', 1) END AS description,
  CASE variant WHEN 2 THEN regexp_extract(hit, 'of ([a-z]+) (the) ([a-z]+)', 3) ELSE regexp_extract(hit, '([a-z]+) ([a-z]+) ([a-z]+)', 3) END AS sku FROM hits)
SELECT doc_id, variant, description, sku FROM found
WHERE description NOT IN ('ups', 'zone') AND NOT regexp_matches(description, 'shipping|freight|fracht|delivery|versand')
  AND NOT regexp_matches(description, '^(gesamt|total|subtotal|sum|tva|tax|net|brut)')
  AND upper(sku) NOT IN ('DELIVERY', 'SHIPPING', 'FREIGHT', 'VERSAND')"""


@query("sc_23_region_pattern_items", "WITH " + PROSE)
def _(r):
    """Rows matched anywhere in the region; both patterns' rows are kept."""
    docs = r.spread("documents").select("doc_id", F.col("lang").alias("vendor"), "text")
    return extract.region_items(docs, rules(r)).select("doc_id", "variant", "description", "sku")


@query("st_02_primary_and_alternate", "WITH " + PROSE.replace("SELECT doc_id, variant, description, sku FROM found", "SELECT doc_id, count(*) FILTER (variant = 1) AS primary_rows, count(*) FILTER (variant = 2) AS alternate_rows FROM found") + " GROUP BY doc_id")
def _(r):
    docs = r.spread("documents").select("doc_id", F.col("lang").alias("vendor"), "text")
    return extract.region_items(docs, rules(r)).groupBy("doc_id").agg(
        F.count_if(F.col("variant") == 1).alias("primary_rows"), F.count_if(F.col("variant") == 2).alias("alternate_rows"))


@query("sc_21_header_fields", """
SELECT doc_id, nullif(trim(regexp_extract(text, '(?im)([a-z0-9._]+@[a-z0-9.]+)', 1)), '') AS mail,
  nullif(trim(regexp_extract(text, '(?im)token = "(\\w+)"', 1)), '') AS token,
  CAST(nullif(replace(regexp_extract(text, '(?im)(\\d+[.,]\\d+)', 1), ',', '.'), '') AS DOUBLE) AS number FROM documents""")
def _(r):
    """Typed fields of whole documents by a rule list."""
    rule = with_defaults(r.spark.createDataFrame([{"vendor": {"name": "any"}, "header": {"fields": FIELDS}}], RULE_SCHEMA))
    docs = extract.prepared(r.table("documents").select("doc_id", F.lit("any").alias("vendor"), "text"), rule)
    found = docs.select("doc_id", extract.fields(F.col("text"), F.col("header")).alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return found.select("doc_id", get("mail").alias("mail"), get("token").alias("token"), get("number").cast("double").alias("number"))


@query("src_09_rule_defaults", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'GBP' ELSE 'EUR' END AS currency, 'text_regex_multiline' AS strategy FROM documents""")
def _(r):
    """Documents with their rule; missing settings take their defaults."""
    docs = r.table("documents").select("doc_id", F.col("lang").alias("vendor"))
    return join_on_key(docs, rules(r).select("vendor", "currency", "strategy"), ["vendor"]).select("doc_id", "currency", "strategy")


@query("ag_20_rule_coverage", """
SELECT CASE WHEN doc_id % 9 <> 0 THEN 'text_regex_multiline' ELSE 'no rule' END AS strategy, count(*) AS documents FROM documents GROUP BY 1""")
def _(r):
    """Documents by the strategy of their rule; some have a vendor without one."""
    docs = r.table("documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("lang")).otherwise("unknown").alias("vendor"))
    ruled = join_on_key(docs, rules(r).select("vendor", "strategy"), ["vendor"])
    return ruled.groupBy(F.coalesce("strategy", F.lit("no rule")).alias("strategy")).agg(F.count(F.lit(1)).alias("documents"))


# --- row kinds --------------------------------------------------------------------

def kind_rows(r):
    """Extracted rows of every kind, one per invoice line."""
    k = F.col("part_id") % 12
    description = F.coalesce(*[F.when(k == i, F.lit(t)) for i, t in {
        0: "CourierDelivery box", 1: "Zone 5 fee", 2: "two cups", 3: "Total amount",
        4: "Net weight pack of twenty-four bars with a long description", 5: "Expiry date: 2025",
        6: "Bar\nMega deal today\n second line ", 7: "", 8: "", 9: "[C77] Powder", 10: "Sum"}.items()],
        F.concat(F.lit("Item "), "part_id"))
    sku = F.when(k == 8, "versand").when(~k.isin(7, 9), F.concat(F.lit("S"), "part_id"))
    return r.items.select("invoice_id", "line_no", "supplier_id", "part_id", sku.alias("sku"), description.alias("description"),
                          F.when(k == 10, "Gesamtbetrag").alias("position"))


KINDS = """kinds AS (SELECT *, part_id % 12 AS k, CASE part_id % 12 WHEN 0 THEN 'shipping' WHEN 1 THEN 'shipping' WHEN 3 THEN 'footer'
  WHEN 5 THEN 'metadata' WHEN 7 THEN 'empty' WHEN 8 THEN 'shipping' WHEN 10 THEN 'footer' ELSE 'item' END AS row_kind FROM items)"""
for _name, _kind in (("flt_03_shipping_rows", "shipping"), ("flt_04_footer_rows", "footer"),
                     ("flt_05_metadata_rows", "metadata"), ("flt_06_no_identifier", "empty")):
    def _rows(r, kind=_kind):
        return extract.classify(kind_rows(r)).filter(F.col("row_kind") == kind).select(
            "invoice_id", "line_no", "supplier_id", "part_id")

    query(_name, with_roles(ITEMS, KINDS, body=f"SELECT invoice_id, line_no, supplier_id, part_id FROM kinds WHERE row_kind = '{_kind}'"))(_rows)


@query("flt_18_code_from_description", with_roles(ITEMS, KINDS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, CASE WHEN k = 9 THEN 'C77' ELSE 'S' || part_id END AS sku,
  CASE k WHEN 6 THEN 'Bar second line' WHEN 2 THEN 'two cups' WHEN 4 THEN 'Net weight pack of twenty-four bars with a long description'
    WHEN 9 THEN '[C77] Powder' ELSE 'Item ' || part_id END AS description FROM kinds WHERE row_kind = 'item'"""))
def _(r):
    """Kept rows: code taken from the text, promotion lines cut out of it."""
    return extract.classify(kind_rows(r)).filter("row_kind = 'item'").select(
        "invoice_id", "line_no", "supplier_id", "part_id", "sku", "description")


@query("flt_19_sku_whitelist", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id FROM items WHERE part_id % 3 = 0"""))
def _(r):
    sku = F.concat(F.when(F.col("part_id") % 3 == 0, "YAM").otherwise("XYAM"), F.col("part_id"))
    return r.items.filter(rows_of.is_known_code(sku, r"^(ITM|YAM)[A-Z0-9]*\d+")).select("invoice_id", "line_no", "supplier_id", "part_id")


@query("flt_21_plausible_items", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id FROM items WHERE unit_price > 0 AND quantity > 0 AND total >= 0 AND quantity < 1000
  AND unit_price < 10000 AND total < 100000 AND length(sku) >= 3 AND NOT regexp_matches(sku, '^[0-9]+$')"""))
def _(r):
    return r.items.filter(rows_of.is_plausible(F.col("sku"), F.col("quantity"), F.col("unit_price"), F.col("total"))).select(
        "invoice_id", "line_no", "supplier_id", "part_id")


@query("flt_17_zero_and_transport_rows", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id FROM items WHERE part_id % 4 > 1"""))
def _(r):
    """Rows of zeros and transport rows are left out."""
    k = F.col("part_id") % 4
    rows = r.items.withColumns({"quantity": F.when(k == 0, 0.0).otherwise(F.col("quantity")),
                                "unit_price": F.when(k == 0, 0.0).otherwise(F.col("unit_price")),
                                "total": F.when(k == 0, 0.0).otherwise(F.col("total")),
                                "description": F.when(k == 1, "Transport DE").otherwise("Bar")})
    charged = rows_of.is_charged(*map(F.col, ("description", "quantity", "unit_price", "total")))
    return rows.filter(charged).select("invoice_id", "line_no", "supplier_id", "part_id")


@query("flt_12_summary_codes", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total, 'C' || part_id AS sku FROM items WHERE part_id % 4 > 1"""))
def _(r):
    """Amounts and summary words in the code column are not items."""
    k = F.col("part_id") % 4
    sku = F.when(k == 0, "1.234,56").when(k == 1, "Gross amount").otherwise(F.concat(F.lit("C"), "part_id"))
    rows = r.spread_items.select("invoice_id", "line_no", "supplier_id", "part_id", F.col("total").alias("line"), sku.alias("sku"),
                          F.lit("1").alias("quantity"), F.lit("1,00").alias("unit_price"), F.lit("1,00").alias("total"))
    return extract.packed_items(rows).select("invoice_id", "line_no", "supplier_id", "part_id", F.col("line").alias("total"), "sku")


# --- grids ------------------------------------------------------------------------

HEAD_SQL = """CASE WHEN line_no % 3 = 1 THEN ['Pos', 'Artikel Nr', 'MENGE', 'Preis', 'Total'] WHEN line_no = 5 THEN ['x', 'y'] ELSE ['1', 'Bar', '2', '3', '4'] END"""
TABLES = f"""tables AS (SELECT invoice_id AS doc_id, line_no AS table_no, count(*) + 1 AS n_rows, {HEAD_SQL} AS headers FROM items GROUP BY ALL)"""


def tables(r):
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    n = F.col("line_no")
    headers = (F.when(n % 3 == 1, arr("Pos", "Artikel Nr", "MENGE", "Preis", "Total")).when(n == 5, arr("x", "y"))
               .otherwise(arr("1", "Bar", "2", "3", "4")))
    return r.spread_items.groupBy(F.col("invoice_id").alias("doc_id"), "line_no").agg((F.count(F.lit(1)) + 1).alias("n_rows")).select(
        "doc_id", n.alias("table_no"), "n_rows", headers.alias("headers"), arr("artikel", "menge", "kuchen").alias("keywords"),
        F.lit(6).alias("n_columns"), F.lit(0).alias("min_columns"))


USE = """u AS (SELECT *, line_no_hit OR (seen AND len(headers) >= 4) AS keep FROM (SELECT *, table_no % 3 = 1 AS line_no_hit,
  coalesce(bool_or(table_no % 3 = 1) OVER (PARTITION BY doc_id ORDER BY table_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM tables) x)"""


@query("flt_11_target_tables", with_roles(ITEMS, TABLES, USE, body="""
SELECT doc_id, table_no, CASE WHEN line_no_hit THEN 'header' ELSE 'continuation' END AS use FROM u WHERE keep"""))
def _(r):
    return extract.target_tables(tables(r)).select("doc_id", "table_no", "use")


@query("wn_14_continuation_tables", with_roles(ITEMS, TABLES, USE, body="""
SELECT doc_id, table_no FROM u WHERE keep AND NOT line_no_hit"""))
def _(r):
    return extract.target_tables(tables(r)).filter("use = 'continuation'").select("doc_id", "table_no")


@query("flt_10_invoice_tables", with_roles(ITEMS, TABLES, body="""
SELECT doc_id, table_no, table_no % 3 = 1 AS with_keywords, len(headers) >= 3 AS by_shape FROM tables"""))
def _(r):
    return tables(r).select(
        "doc_id", "table_no", extract.is_invoice_table(F.col("headers"), F.col("n_rows"), F.col("keywords")).alias("with_keywords"),
        extract.is_invoice_table(F.col("headers"), F.col("n_rows")).alias("by_shape"))


@query("prj_05_header_positions", with_roles(ITEMS, TABLES, body="""
SELECT doc_id, table_no, CASE WHEN table_no % 3 = 1 THEN 2 END AS quantity, CASE WHEN table_no % 3 = 1 THEN 1 END AS sku, CASE WHEN table_no % 3 = 1 THEN 4 END AS total FROM tables"""))
def _(r):
    words = {"sku": ["artikel", "ref"], "quantity": ["menge", "qty"], "total": ["importe", "total"]}
    places = projections.header_positions(F.col("headers"), words)
    return tables(r).select("doc_id", "table_no", places.alias("p")).select("doc_id", "table_no", "p.*")


@query("prj_06_column_roles", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS sku, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS description,
  CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS quantity, CASE p_partkey % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS unit_price,
  CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 2 END AS total FROM part""")
def _(r):
    """Roles from multilingual headers; a later header replaces an earlier one."""
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    k = F.col("p_partkey") % 3
    headers = (F.when(k == 0, arr("Item", "Product\nname", "Réf.", "Q.", "Prix  HT"))
               .when(k == 1, arr("SKU", "Libellé", "Qty", "Unit\nPrice", "Amount", "Exp. date"))
               .otherwise(arr("Description", "PU", "Total")))
    roles = projections.column_roles(headers)
    get = lambda n: F.try_element_at("m", F.lit(n)).alias(n)
    return r.table("part").select("p_partkey", roles.alias("m")).select(
        "p_partkey", get("sku"), get("description"), get("quantity"), get("unit_price"), get("total"))


@query("prj_07_inferred_columns", """
SELECT DISTINCT l_orderkey AS table_id, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 2 END AS sku, CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END AS quantity,
  CASE WHEN l_orderkey % 2 = 0 THEN 3 ELSE 3 END AS unit_price, 4 AS total FROM lineitem""")
def _(r):
    """Column roles from the cells of all rows of every table."""
    even, q = F.col("l_orderkey") % 2 == 0, F.col("l_quantity").cast("int").cast("string")
    code, words = F.concat(F.lit("YAM"), "l_partkey"), F.lit("a bar, sweet")
    price = F.concat(F.lit("€ "), q, F.lit(",50"))
    cells = F.when(even, F.array(code, words, q, price, price)).otherwise(
        F.array(words, q, F.concat(F.lit("ab-"), "l_partkey"), price, price))
    rows = r.table("lineitem").select(F.col("l_orderkey").alias("table_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", cells.alias("cells"))
    profiles = projections.column_profiles(rows.select("table_id", "cells"), known_code=r"^(ITM|YAM)[A-Z0-9]*\d+")
    return projections.infer_roles(profiles)


def grid_rows(r):
    """Table rows; every third one packs two items into its number cells."""
    part, two = F.col("part_id"), F.col("line_no") % 3 == 0
    cents = cents_text(F.col("total"))
    q = F.col("quantity").cast("int")
    cell = lambda one, other: F.when(two, F.concat(one, F.lit("\n"), other)).otherwise(one)
    cells = F.array(
        F.lit("1"), cell(F.concat(F.lit("A"), part), F.concat(F.lit("B"), part)), F.lit("Bar  of\tnuts"),
        cell(q.cast("string"), (q + 1).cast("string")), F.when(part % 7 != 0, "2,50"), F.when(part % 13 == 0, F.lit(" ")).otherwise(cell(cents, F.lit("4,25"))))
    column = lambda name, i, kind: F.struct(F.lit(name).alias("name"), F.lit(i).alias("index"), F.lit(kind).alias("type"))
    columns = F.array(column("position", 0, "string"), column("sku", 1, "string"), column("description", 2, "string"),
                      column("quantity", 3, "number"), column("unit_price", 4, "number"), column("total", 5, "number"))
    return r.spread_items.select(*["invoice_id", "line_no", "supplier_id", "part_id"], F.col("total").alias("line"), cells.alias("cells"), columns.alias("columns"))


@query("prj_08_grid_items", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total AS line, 0 AS sub, 'A' || part_id AS sku, 'Bar of nuts' AS description, CAST(quantity AS DOUBLE) AS quantity,
  CASE WHEN part_id % 7 <> 0 THEN 2.5 ELSE 0 END::DOUBLE AS unit_price, total FROM items WHERE part_id % 13 <> 0
UNION ALL SELECT invoice_id, line_no, supplier_id, part_id, total, 1, 'B' || part_id, '', quantity + 1, 0, 4.25 FROM items WHERE line_no % 3 = 0 AND part_id % 13 <> 0"""))
def _(r):
    """Rows by column position; packed rows unfold, blank totals drop the row."""
    number = lambda c: F.col(c).cast("double").alias(c)
    return extract.grid_items(grid_rows(r)).select(
        "invoice_id", "line_no", "supplier_id", "part_id", "line", "sub", "sku", "description", number("quantity"), number("unit_price"), number("total"))


@query("flt_07_blank_total_rows", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, total AS line FROM items WHERE part_id % 13 = 0"""))
def _(r):
    """Rows the blank-total rule removes."""
    return grid_rows(r).filter(~extract.has_total(F.col("cells"), F.lit(5))).select("invoice_id", "line_no", "supplier_id", "part_id", "line")


@query("flt_08_header_rows", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, part_id % 4 = 0 AS header FROM items"""))
def _(r):
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    k = F.col("part_id") % 4
    cells = F.when(k == 0, arr("ITEM", "qty", "Price")).when(k == 1, arr("ITEM", "qty")).otherwise(arr("Bar", "2", "Price"))
    return r.items.select("invoice_id", "line_no", "supplier_id", "part_id", extract.is_header_row(cells, arr("Item", "Qty", "PRICE")).alias("header"))


@query("prj_09_row_totals", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, quantity, CASE WHEN part_id % 2 = 0 THEN p ELSE floor(total / quantity * 10000 + 0.5) / 10000 END AS unit_price,
  CASE WHEN part_id % 2 = 0 THEN floor(p * quantity * 100 + 0.5) / 100 ELSE total END AS total FROM (SELECT *, part_id % 100 + 0.25::DOUBLE AS p FROM items) x WHERE part_id % 9 <> 0"""))
def _(r):
    """Total from price and quantity, else the price from total and quantity; rows
    without code and text, or without quantity, are not items (FLT-09)."""
    part = F.col("part_id")
    p = F.when(part % 2 == 0, part % 100 + 0.25)
    valid = rows_of.is_valid(F.when(part % 9 == 0, "").otherwise(F.col("sku")), F.lit(""), F.col("quantity"))
    price, total = rows_of.row_totals(F.col("quantity"), p, F.col("total"))
    return r.items.filter(valid).select("invoice_id", "line_no", "supplier_id", "part_id", "quantity", price.alias("unit_price"), total.alias("total"))


@query("flt_09_valid_items", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id FROM items WHERE part_id % 9 <> 0 AND (part_id % 5 > 0 OR part_id % 2 = 0)"""))
def _(r):
    part = F.col("part_id")
    sku = F.when(part % 5 == 0, "").otherwise(F.col("sku"))
    description = F.when(part % 2 == 0, "text").otherwise("")
    quantity = F.when(part % 9 == 0, 0.0).otherwise(F.col("quantity"))
    return r.items.filter(rows_of.is_valid(sku, description, quantity)).select("invoice_id", "line_no", "supplier_id", "part_id")


@query("wn_16_greedy_totals", with_roles(ITEMS, body="""
SELECT invoice_id, line_no, supplier_id, part_id, line, n, 'K' || n AS sku, quantity, CASE WHEN n = 2 AND part_id % 2 = 0 THEN round(quantity * 2.5 + 0.02, 2) ELSE quantity * 2.5 END AS total
FROM (SELECT invoice_id, line_no, supplier_id, part_id, total AS line, CAST(unnest(range(0, 3)) AS INT) AS n, CAST(quantity + unnest(range(0, 3)) AS DOUBLE) AS quantity FROM items) x"""))
def _(r):
    """Three packed items; for odd parts the middle amount is missing."""
    q = F.col("quantity").cast("int")
    amount = lambda i, extra: F.format_string("%.2f", (q + i) * 2.5 + extra)
    even = F.col("part_id") % 2 == 0
    totals = F.when(even, F.concat_ws("\n", amount(0, 0.0), F.lit(""), amount(1, 0.0), amount(2, 0.02))).otherwise(
        F.concat_ws("\n", amount(0, 0.0), amount(2, 0.0)))
    rows = r.spread_items.select("invoice_id", "line_no", "supplier_id", "part_id", F.col("total").alias("line"),
                          F.lit("K0\n\nK1\nK2 ").alias("sku"), F.concat_ws("\n", q, q + 1, q + 2).alias("quantity"),
                          F.lit("2,50\n2,50\n 2,50").alias("unit_price"), totals.alias("total"))
    return extract.packed_items(rows).select("invoice_id", "line_no", "supplier_id", "part_id", "line", "n", "sku", "quantity", "total")


@query("sc_20_packed_row", with_roles(ITEMS, body="""
SELECT invoice_id, count(*) * 3 AS items, sum(quantity) * 3 + count(*) * 3 AS units FROM items GROUP BY invoice_id"""))
def _(r):
    """Packed rows unfold to three items each, blanks removed per column."""
    q = F.col("quantity").cast("int")
    rows = r.spread_items.select("invoice_id", F.lit("K0\n\nK1\nK2 ").alias("sku"), F.concat_ws("\n\n", q, q + 1, q + 2).alias("quantity"),
                          F.lit("1\n1\n1").alias("unit_price"), F.lit("").alias("total"))
    return extract.packed_items(rows).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("units"))


NEGATIVE = """neg AS (SELECT invoice_id AS doc_id, pos, sku, quantity, unit_price, CASE WHEN part_id % 3 = 0 THEN -round(total / 10 + 1e-7, 2) ELSE total END AS total FROM numbered),
runs AS (SELECT *, coalesce(last_value(CASE WHEN total >= 0 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS run FROM neg),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) - 1) // 2 AS pair FROM runs)"""


@query("wn_08_negative_merge", with_roles(ITEMS, NUMBERED, NEGATIVE, body="""
SELECT doc_id, min(pos) AS pos, arg_min(sku, pos) AS sku, arg_min(quantity, pos) AS quantity, CAST(sum(CAST(total AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS lines,
  CASE WHEN count(*) > 1 THEN sign(sum(CAST(total AS DECIMAL(18,4)))) * ((2 * CAST(abs(sum(CAST(total AS DECIMAL(18,4)))) * 100 AS BIGINT) + CAST(arg_min(quantity, pos) AS BIGINT))
    // (2 * CAST(arg_min(quantity, pos) AS BIGINT))) / 100.0 ELSE arg_min(unit_price, pos) END AS unit_price
FROM ranked GROUP BY doc_id, run, pair"""))
def _(r):
    """A negative line is taken into the line before it, one line each."""
    from costloom.plans.roles import cents

    items = numbered_items(r).select(
        F.col("invoice_id").alias("doc_id"), "pos", "sku", "quantity", "unit_price",
        F.when(F.col("part_id") % 3 == 0, -cents(F.col("total") / 10)).otherwise(F.col("total")).alias("total"))
    merged = extract.merge_negative(items, measure=doc_keys(r))
    return merged.select("doc_id", "pos", "sku", "quantity", "unit_price", "total", "lines")


@query("wn_17_positions", with_roles(ITEMS, NUMBERED, body="SELECT invoice_id, line_no, supplier_id, part_id, quantity, total, pos FROM numbered"))
def _(r):
    return numbered_items(r).select("invoice_id", *ITEM_ORDER, "pos")


@query("sc_29_fixed_offset", with_roles(DOC_LINES, body="""
, n AS (SELECT *, lead(text, 2) OVER (PARTITION BY doc_id ORDER BY line_no) AS second FROM dl)
SELECT doc_id, line_no, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS code, trim(second) AS description FROM n WHERE regexp_matches(text, '^[A-Z][a-z]+ ') AND second IS NOT NULL"""))
def _(r):
    """A code line, its description two lines below."""
    return below.with_lines_below(doc_lines(r), 2).filter(F.col("text").rlike("^[A-Z][a-z]+ ") & F.col("below_2").isNotNull()).select(
        "doc_id", "line_no", F.regexp_extract("text", "^([A-Z][a-z]+)", 1).alias("code"), F.trim("below_2").alias("description"))


@query("wn_19_description_append", with_roles(DOC_LINES, body="""
, n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM dl)
SELECT doc_id, line_no, CASE WHEN contains(nxt, 'the') OR contains(nxt, 'que') THEN text || ' ' || nxt ELSE text END AS description FROM n"""))
def _(r):
    """The next line is appended where it carries one of the marker words."""
    marked = F.contains("below_1", F.lit("the")) | F.contains("below_1", F.lit("que"))
    return below.with_next_appended(doc_lines(r), marked).select("doc_id", "line_no", "description")


@query("sc_30_next_qualifying_lines", with_roles(DOC_LINES, body="""
, n AS (SELECT *, list(text) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS nxt FROM dl)
SELECT doc_id, line_no, array_to_string(list_filter(coalesce(nxt, []), lambda x: regexp_matches(x, '[A-Za-z]') AND length(x) < 120)[1:2], ' ') AS description
FROM n WHERE regexp_matches(text, '^[A-Z]')"""))
def _(r):
    """Up to two short lines with letters among the nine below a code line."""
    good = F.col("text").rlike("[A-Za-z]") & (F.length("text") < 120)
    return below.with_qualifying_below(doc_lines(r), good).filter(F.col("text").rlike("^[A-Z]")).select("doc_id", "line_no", "description")


@query("wn_22_continuation_lines", with_roles(DOC_LINES, body="""
, s AS (SELECT *, regexp_matches(text, '^(The|De|Die|El) ') AS starts, regexp_matches(text, '(?i)total|^is ') AS stops, regexp_extract(text, '^[^0-9%]*') AS words FROM dl),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS item FROM s),
m AS (SELECT *, coalesce(max(CASE WHEN stops AND NOT starts THEN 1 END) OVER (PARTITION BY doc_id, item ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS stopped FROM n WHERE item > 0)
SELECT doc_id, item, string_agg(trim(words), ' ' ORDER BY line_no) FILTER (trim(words) <> '') AS description, count(*) AS lines FROM m WHERE stopped = 0 GROUP BY 1, 2"""))
def _(r):
    """Lines after an item's first line continue its description until a stop line;
    text is cut before the first number or percent sign."""
    lines = doc_lines(r).withColumns({
        "starts": F.col("text").rlike("^(The|De|Die|El) "), "stops": F.col("text").rlike("(?i)total|^is "),
        "words": F.trim(F.regexp_extract("text", "^[^0-9%]*", 0))})
    return below.continued_items(lines)


RECORDS = {"start": r"Pos\. \d+ <", "required": ["sku", "description", "quantity"], "fields": [
    {"name": "sku", "regex": r"^Pos\. \d+ <(\w+)>"}, {"name": "description", "regex": r"> (.+?) ;"},
    {"name": "quantity", "regex": r"; (\d+) pieces ;"}, {"name": "total", "regex": r"; EUR ([\d,.]+)$", "type": "number"}]}


@query("sc_28_records_by_start", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'K' || CAST(l_partkey * 10 + i AS VARCHAR) AS sku, 'Bar ' || i AS description, CAST(l_quantity AS BIGINT) + i AS quantity,
  1234.5::DOUBLE + i AS total FROM (SELECT *, unnest(range(1, l_linenumber + 1)) AS i FROM lineitem) x WHERE i % 3 <> 0""")
def _(r):
    """A region cut into records where the next one starts, then fields by pattern,
    all given by a rule; records that miss a required field are skipped."""
    record = lambda i: F.concat(
        F.lit("Pos. "), i, F.lit(" <K"), F.col("l_partkey") * 10 + i, F.lit("> Bar "), i, F.lit(" ;\n"),
        F.col("l_quantity").cast("int") + i, F.when(i % 3 == 0, " boxes").otherwise(" pieces"), F.lit(" ; EUR "),
        F.format_number(F.lit(1234.5) + i, 2))
    region = F.array_join(F.transform(F.sequence(F.lit(1), F.col("l_linenumber")), record), "\n")
    field = lambda f: F.struct(F.lit(f["name"]).alias("name"), F.lit(f["regex"]).alias("regex"), F.lit(1).alias("group"),
                               F.lit(f.get("type", "string")).alias("type"))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    regions = r.spread("lineitem").select(
        *keys, region.alias("region"), F.lit(RECORDS["start"]).alias("record_start"),
        F.array(*map(field, RECORDS["fields"])).alias("record_fields"), F.array(*map(F.lit, RECORDS["required"])).alias("required"))
    get = lambda k, kind: F.try_element_at("found", F.lit(k)).cast(kind).alias(k)
    return extract.record_items(regions).select(
        *keys, get("sku", "string"), get("description", "string"), get("quantity", "long"), get("total", "double"))


def split_code_lines(r):
    """Product lines whose code is whole, or broken over two or three lines."""
    k, part = F.col("p_partkey") % 4, F.col("p_partkey")
    line = lambda n, t: F.struct(F.lit(n).alias("line_no"), t.alias("text"))
    name, whole, tail = F.concat(F.lit("- "), "p_name", F.lit(" - SKU:")), F.concat(F.lit("CS-COR"), part), F.concat(F.lit("COR"), part)
    lines = (F.when(k == 0, F.array(line(0, F.concat(name, F.lit(" "), whole)), line(1, F.lit("3"))))
             .when(k == 1, F.array(line(0, F.concat(name, F.lit(" CS-"))), line(1, F.concat(tail, F.lit(" 2 4.00")))))
             .when(k == 2, F.array(line(0, name), line(1, whole)))
             .otherwise(F.array(line(0, name), line(1, F.lit("CS")), line(2, tail))))
    return r.table("part").select(part.alias("doc_id"), F.inline(lines))


@query("sc_32_split_code", """
SELECT p_partkey AS doc_id, 'CS-COR' || p_partkey AS sku, p_name AS description FROM part""")
def _(r):
    """Codes put together from the end of a line and the start of the next ones."""
    return below.split_codes(split_code_lines(r))


# --- whole invoices -----------------------------------------------------------------

LINE_PATTERN = r"^([A-Z]\d+) (.+?) :: (\d+) u\. :: ([\d.,]+) :: (-?[\d.,]+)$"
WHOLE_FIELDS = {
    "header": {"fields": [{"name": "invoice_number", "regex": r"^Invoice No (\w+)$"}, {"name": "invoice_date", "regex": r"^Date (\S+)$", "type": "date"}]},
    "footer": {"fields": [{"name": "subtotal", "regex": r"^Sum ([\d.,]+)$"}, {"name": "shipping_fee", "regex": r"^Freight ([\d.,]+)$"}]}}
WHOLE_RULES = [
    {"vendor": {"name": "Plain Co"}, **WHOLE_FIELDS, "table": {"strategy": "text_regex", "row_pattern": LINE_PATTERN, "columns": ITEM_COLUMNS}},
    {"vendor": {"name": "Credit Co"}, **WHOLE_FIELDS, "flags": {"merge_negative": True, "first_of_equal_rows": True},
     "table": {"strategy": "text_regex", "row_pattern": LINE_PATTERN, "columns": ITEM_COLUMNS}},
    {"vendor": {"name": "Grid Co"}, **WHOLE_FIELDS, "table": {
        "strategy": "pdfplumber_table", "header_keywords": ["artikel", "summe"], "row_pattern": LINE_PATTERN,
        "columns": [{**c, "index": i} for i, c in enumerate(ITEM_COLUMNS)]}},
    {"vendor": {"name": "Region Co"}, **WHOLE_FIELDS, "table": {
        "strategy": "text_regex_multiline", "row_pattern": r"take ([A-Z]\d+) \((.+?)\) (\d+)\s+at ([\d.,]+) = ([\d.,]+);", "columns": ITEM_COLUMNS}},
]


# Printed rows of an item: larger tasks cost less, as each holds the buffers of many sorts.
WHOLE_ROWS_PER_ITEM = 3


def whole_tasks(r):
    """Tasks that share the documents, never as many as those of a plain exchange: Spark would
    leave out the exchange of the texts, and each of their readers would put them together."""
    tasks = item_tasks(r, WHOLE_ROWS_PER_ITEM)
    return tasks + (tasks == int(r.spark.conf.get("spark.sql.shuffle.partitions")))


def whole_documents(r):
    """Invoices of four vendors as texts and grids; every second one of Grid Co has no grid.

    The texts are put together once, in one exchange that all their readers share: nothing
    a reader asks of a text gets below its ``explode``, so the plans up to there are equal."""
    part, pos, vendor = F.col("part_id"), F.col("pos"), F.col("invoice_id") % 4
    qty, price, total = F.col("quantity").cast("int").cast("string"), F.concat(part, F.lit(",50")), cents_text(F.col("total"))
    has_grid = F.col("invoice_id") % 8 == 2
    item = F.concat(F.lit("A"), part, F.lit(" Item "), pos, F.lit(" :: "), qty, F.lit(" u. :: "), price, F.lit(" :: "), total)
    rebate = F.concat(F.lit("A"), part, F.lit(" Rebate "), pos, F.lit(" :: 1 u. :: 1,00 :: -1,00"))
    inline = F.concat(F.lit("take A"), part, F.lit(" (Item "), pos, F.lit(") "), qty, F.lit("\nat "), price, F.lit(" = "), total, F.lit(";"))
    printed = F.when(vendor == 1, F.concat_ws("\n", item, item, F.when(part % 3 == 0, rebate))).when(vendor == 3, inline).when(~has_grid, item)
    tasks = whole_tasks(r)
    # The lines of one invoice, printed in generated code before they are listed.
    lines = numbered_items(r).select("*", F.explode(F.array(printed)).alias("text"))
    bodies = lines.groupBy("invoice_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("lines"), F.sum(F.col("total").cast("decimal(18,4)")).alias("sum"),
        F.sum(F.when((F.col("invoice_id") % 4 == 1) & (part % 3 == 0), 1).otherwise(0)).alias("rebates"))
    key = F.col("invoice_id")
    stated = (F.col("sum") - F.col("rebates")).cast("double") + F.when(key % 10 == 1, 5.0).otherwise(0.0)
    text = F.concat_ws("\n", F.concat(F.lit("Invoice No K"), key), F.when(key % 7 != 0, "Date 05.03.2024"),
                       F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.when(key % 12 == 0, "A0 Shipping fee :: 1 u. :: 4,00 :: 4,00"),
                       F.when(key % 5 != 0, F.concat(F.lit("Sum "), cents_text(stated))), F.when(key % 3 == 1, "Freight 9,50"))
    name = F.element_at(F.array(*[F.lit(x["vendor"]["name"]) for x in WHOLE_RULES]), (key % 4 + 1).cast("int"))
    docs = bodies.select(key.alias("doc_id"), name.alias("vendor"), text.alias("text")).repartition(tasks, "doc_id")
    docs = docs.select("doc_id", "vendor", F.explode(F.array("text")).alias("text"))
    cells = F.array(F.concat(F.lit("A"), part), F.concat(F.lit("Item "), pos), qty, price, total)
    head = F.array(*map(F.lit, ("Artikel", "Text", "Menge", "Preis", "Summe")))
    row = lambda n, c: F.struct(n.cast("int").alias("row_no"), c.alias("cells"))
    grid = numbered_items(r, tasks=tasks).filter(has_grid).select("invoice_id", F.inline(
        F.when(pos == 1, F.array(row(F.lit(0), head), row(pos, cells))).otherwise(F.array(row(pos, cells)))))
    return docs, grid.select(F.col("invoice_id").alias("doc_id"), F.lit("Grid Co").alias("vendor"), F.lit(0).alias("table_no"), "row_no", "cells")


WHOLE = """whole AS (SELECT invoice_id AS doc_id, pos, 'A' || part_id AS sku, 'Item ' || pos AS description, CAST(quantity AS DOUBLE) AS quantity,
  invoice_id % 4 = 1 AND part_id % 3 = 0 AS rebate, CAST(total AS DECIMAL(18,4)) - CASE WHEN invoice_id % 4 = 1 AND part_id % 3 = 0 THEN 1 ELSE 0 END AS exact, part_id + 0.5::DOUBLE AS printed FROM numbered),
whole_items AS (SELECT doc_id, sku, description, quantity, CAST(exact AS DOUBLE) AS total,
  CASE WHEN rebate THEN sign(exact) * ((2 * CAST(abs(exact) * 100 AS BIGINT) + CAST(quantity AS BIGINT)) // (2 * CAST(quantity AS BIGINT))) / 100.0 ELSE printed END AS unit_price,
  CASE WHEN doc_id % 8 = 2 THEN 'table' WHEN doc_id % 4 = 3 THEN 'text' ELSE 'lines' END AS method FROM whole)"""


def whole_arguments(r):
    return (*whole_documents(r), with_defaults(r.spark.createDataFrame(WHOLE_RULES, RULE_SCHEMA)))


@query("st_06_whole_invoice_items", with_roles(ITEMS, NUMBERED, WHOLE, body="SELECT doc_id, sku, description, quantity, unit_price, total, method FROM whole_items"))
def _(r):
    """Items of all documents in one call: every strategy, its fallback, and the rules' flags."""
    return invoices.extract_items(*whole_arguments(r), measure=doc_keys(r)).select("doc_id", "sku", "description", "quantity", "unit_price", "total", "method")


@query("st_06_whole_invoices", with_roles(ITEMS, NUMBERED, WHOLE, body="""
, sums AS (SELECT doc_id, count(*) AS n_items, sum(CAST(total AS DECIMAL(18,4))) AS s, min(method) AS method FROM whole_items GROUP BY 1),
t AS (SELECT *, CAST(s AS DOUBLE) AS items_total, CAST(CASE WHEN doc_id % 5 = 0 THEN s ELSE s + CASE WHEN doc_id % 10 = 1 THEN 5 ELSE 0 END END AS DOUBLE) AS subtotal,
  CASE WHEN doc_id % 3 = 1 THEN 9.5 WHEN doc_id % 12 = 0 THEN 4.0 ELSE 0.0 END::DOUBLE AS shipping_fee FROM sums)
SELECT doc_id, ['plain co', 'credit co', 'grid co', 'region co'][doc_id % 4 + 1] AS vendor, method, 'K' || doc_id AS invoice_number, n_items, items_total, subtotal, shipping_fee,
  round(subtotal + shipping_fee, 2) AS total, CASE WHEN doc_id % 7 = 0 THEN 'error' WHEN doc_id % 10 = 1 THEN 'warning' ELSE 'ok' END AS verdict FROM t"""))
def _(r):
    """Invoices of all documents: fields, totals by footer or lines, verdict."""
    return invoices.extract_invoices(*whole_arguments(r), measure=doc_keys(r)).select(
        "doc_id", "vendor", "method", "invoice_number", "n_items", "items_total", "subtotal", "shipping_fee", "total", "verdict")
