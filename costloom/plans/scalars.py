"""Queries: number, date, text and code functions over whole tables."""

from pyspark.sql import functions as F

from costloom.functions import dates, numbers, text
from costloom.functions.falsy import finite, first_truthy, number_prefix
from costloom.plans.registry import query
from costloom.plans.roles import LEDGER, with_roles

# Number texts are spelled from exact cents in Spark and read back; the SQL side
# computes what each spelling must mean.
CENTS = """c AS (SELECT l_orderkey, l_partkey, l_linenumber, (l_partkey + l_linenumber) % 9 AS k,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
v AS (SELECT *, CAST(cents AS DOUBLE) / 100 AS val, CAST(cents // 100 * 1000 + cents % 100 * 10 AS DOUBLE) AS big,
    -CAST(cents // 10 AS DOUBLE) / 10 AS neg FROM c)"""


def number_texts(r):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    w, f = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    comma_groups = F.format_number(w, 0)
    spelled = [
        F.concat(w, F.lit("."), f), F.concat(F.lit("€ "), w, F.lit(","), f),
        F.concat(F.translate(comma_groups, ",", "."), F.lit(","), f, F.lit(" €")),
        F.concat(F.lit("$"), comma_groups, F.lit("."), f), F.concat(w, F.lit(","), f, F.lit("0")),
        F.concat(w, F.lit("."), f, F.lit("0")), F.concat(w, F.lit(","), f, F.lit("-")),
        F.when(F.col("l_orderkey") % 2 == 0, "n/a"),
        F.concat(F.lit("-"), w, F.lit(","), F.substring(f, 1, 1)),
    ]
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 9
    spelling = F.coalesce(*[F.when(k == i, s) for i, s in enumerate(spelled)])
    return r.spread("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", spelling.alias("spelling"))


def _numbers(r, style):
    return number_texts(r).select("l_orderkey", "l_partkey", "l_linenumber",
                                  numbers.parse(F.col("spelling"), style).alias("value"))


@query("sc_03_number_unified", with_roles(CENTS, body="""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN k IN (0, 1, 2, 3, 5) THEN val WHEN k = 4 THEN big
  WHEN k = 8 THEN neg ELSE 0 END AS value FROM v"""))
def _(r):
    return _numbers(r, "unified")


@query("sc_04_number_strict_eu", with_roles(CENTS, body="""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN k IN (0, 1, 2) THEN val WHEN k = 4 THEN big
  WHEN k = 5 THEN CASE WHEN cents < 100000 THEN big ELSE val END WHEN k = 6 THEN -val WHEN k = 8 THEN neg
  ELSE 0 END AS value FROM v"""))
def _(r):
    return _numbers(r, "strict_eu")


@query("sc_05_number_price", with_roles(CENTS, body="""
SELECT l_orderkey, l_partkey, l_linenumber, floor(p * 100 + 0.5) / 100 AS value FROM (
  SELECT *, CASE WHEN k IN (0, 1, 2, 3, 5) THEN val WHEN k = 4 THEN big
    WHEN k = 6 THEN CAST(cents AS DOUBLE) WHEN k = 8 THEN neg END AS p FROM v) x"""))
def _(r):
    return _numbers(r, "price")


@query("sc_01_sku_normalise", """
SELECT p_partkey, upper('p' || p_partkey || ' ' || replace(p_name, ' ', ' ')) AS sku FROM part""")
def _(r):
    raw = F.concat(F.lit(" \tp"), "p_partkey", F.lit(" \n "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit(" "))
    return r.table("part").select("p_partkey", text.normalize_sku(F.trim(F.translate(raw, "\t", " "))).alias("sku"))


@query("sc_02_sku_list", """
SELECT p_partkey, 'A' || p_partkey || '|' || upper(p_brand) || '|' || upper(p_name) AS skus, 3 AS n FROM part""")
def _(r):
    cell = F.concat(F.lit(" a"), "p_partkey", F.lit(" ;, "), "p_brand", F.lit(" /| "), "p_name", F.lit(";"))
    skus = text.split_skus(cell)
    return r.table("part").select("p_partkey", F.array_join(skus, "|").alias("skus"), F.size(skus).alias("n"))


@query("sc_06_whole_quantity", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity
FROM lineitem""")
def _(r):
    q, k = F.col("l_quantity").cast("long"), F.col("l_partkey") % 4
    spelled = (F.when(k == 0, F.concat(q, F.lit(",00"))).when(k == 1, F.concat(F.lit(" "), q, F.lit(" pcs")))
               .when(k == 2, F.concat(q, F.lit(",75"))).otherwise(F.concat(F.lit("pcs "), q)))
    return r.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                      numbers.whole_quantity(spelled).alias("quantity"))


FEE_TEXT = """f AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(round(o_totalprice) AS BIGINT) AS n FROM orders),
g AS (SELECT *, n // 100 AS w, lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS ff FROM f)"""


def fee_texts(r):
    n = F.round("o_totalprice").cast("long")
    w, f, k = F.floor(n / 100), F.lpad((n % 100).cast("string"), 2, "0"), F.col("o_orderkey") % 4
    spelled = (F.when(k == 0, F.concat(F.lit("Freight €"), w, F.lit(","), f))
               .when(k == 1, F.concat(F.lit("freight eur "), w, F.lit("."), f, F.lit(" excl. 9,00")))
               .when(k == 2, F.concat(F.lit("no amount "), w)).otherwise(F.lit("free")))
    return r.table("orders").select("o_orderkey", spelled.alias("cell"))


@query("sc_07_amount_in_text", with_roles(FEE_TEXT, body="""
SELECT o_orderkey, CASE WHEN k < 2 THEN floor(CAST(n AS DOUBLE) / 100 * 100 + 0.5) / 100 END AS amount,
  CASE WHEN k = 3 THEN NULL WHEN k = 2 THEN CAST(w AS DOUBLE) ELSE floor(CAST(n AS DOUBLE) / 100 * 100 + 0.5) / 100 END AS fee FROM g"""))
def _(r):
    cell = F.col("cell")
    return fee_texts(r).select("o_orderkey", numbers.amount_in_text(cell).alias("amount"),
                               numbers.fee_in_text(cell).alias("fee"))


@query("sc_34_grouped_amount", """
SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 3 THEN 0 WHEN 2 THEN CAST(floor(o_totalprice) AS DECIMAL(18,2))
  ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount FROM orders""")
def _(r):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    k, grouped = F.col("o_orderkey") % 4, F.format_number(price, 2)
    spelled = (F.when(k == 0, grouped).when(k == 1, F.translate(grouped, ",.", ".,"))
               .when(k == 2, F.format_number(F.floor("o_totalprice"), 0)).otherwise(F.lit("n/a")))
    return r.table("orders").select("o_orderkey", numbers.grouped_amount(spelled).cast("double").alias("amount"))


@query("sc_08_tidy_lines", """
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)) AS clean FROM documents""")
def _(r):
    return r.table("documents").select("doc_id", text.tidy_lines(F.col("text")).alias("clean"))


@query("sc_09_tidy_text", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '[ \\t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g'),
  '^\\s+|\\s+$', '', 'g') AS clean FROM pages""")
def _(r):
    return r.table("pages").select("page_id", text.tidy_text(F.col("html")).alias("clean"))


@query("sc_10_undouble", "SELECT doc_id, text AS clean FROM documents")
def _(r):
    """Whole texts with every character doubled come back as they were."""
    doubled = F.regexp_replace("text", "(?s)(.)", "$1$1")
    return r.table("documents").select("doc_id", text.undouble(doubled).alias("clean"))


@query("sc_11_undouble_guarded", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '777' WHEN 1 THEN p_name || p_partkey
  WHEN 2 THEN 'Item ' || p_partkey || ' of a list' ELSE replace(p_name, ' ', '  ') || 'x' END AS clean FROM part""")
def _(r):
    k = F.col("p_partkey") % 4
    double = lambda c: F.regexp_replace(c, "(?s)(.)", "$1$1")
    raw = (F.when(k == 0, "777").when(k == 1, double(F.concat("p_name", "p_partkey")))
           .when(k == 2, F.concat(F.lit("Item "), "p_partkey", F.lit(" of a list")))
           .otherwise(F.concat(double(F.col("p_name")), F.lit("x"))))
    return r.table("part").select("p_partkey", text.undouble_guarded(raw).alias("clean"))


@query("sc_12_regex_field", """
SELECT doc_id, nullif(trim(regexp_extract(text, '(?im)([a-z0-9._]+@[a-z0-9.]+)', 1)), '') AS mail,
  nullif(trim(regexp_extract(text, '(?im)^the (\\w+)', 1)), '') AS the_word,
  nullif(trim(regexp_extract(text, '(?im)token = "(\\w+)"', 1)), '') AS token FROM documents""")
def _(r):
    t = F.col("text")
    return r.table("documents").select(
        "doc_id", text.regex_field(t, r"([a-z0-9._]+@[a-z0-9.]+)").alias("mail"),
        text.regex_field(t, r"^the (\w+)").alias("the_word"),
        text.regex_field(t, r'token = "(\w+)"').alias("token"))


EN = ["January", "Feb", "March", "Apr", "May", "June", "Jul", "August", "Sep", "October", "Nov", "December"]
FR = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]


@query("sc_13_date_normalise", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN NULL WHEN 5 THEN '20' || strftime(o_orderdate, '%y-%m-%d')
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def _(r):
    """Also with a weekday before it, whose name holds a month's (mardi, samedi)."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    year, month, day = F.year(d), F.month(d), F.dayofmonth(d)
    name = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), month)
    spelled = (F.when(k == 0, F.concat_ws(" ", day, name(EN), year)).when(k == 1, F.concat_ws(" ", day, name(FR), year))
               .when(k == 2, F.concat_ws("-", year, month, day)).when(k == 3, F.concat_ws("/", day, month, year))
               .when(k == 4, F.concat_ws(".", day, month, year))
               .when(k == 5, F.concat_ws(".", day, month, F.date_format(d, "yy"))).when(k == 7, F.concat_ws(" ", F.lit("Mardi"), day, name(FR), year))
               .otherwise(F.concat_ws("-", month, year)))
    return r.table("orders").select("o_orderkey", dates.normalize_date(spelled).alias("iso"))


@query("sc_14_date_checked", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(r):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    year, month, day = F.year(d), F.month(d), F.dayofmonth(d)
    spelled = (F.when(k == 0, F.concat_ws(".", day, month, year)).when(k == 1, F.date_format(d, " dd/MM/yyyy "))
               .when(k == 2, F.concat_ws("-", day, month, year)).when(k == 3, F.concat_ws("-", year, month, day))
               .otherwise(F.concat(F.lit("31.02."), year)))
    return r.table("orders").select("o_orderkey", dates.parse_date(spelled).alias("day"))


@query("sc_15_compact_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(r):
    spelled = F.when(F.col("o_orderkey") % 3 < 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("20241399")
    return r.table("orders").select("o_orderkey", dates.compact_date(spelled).alias("day"))


@query("sc_16_pseudo_sku", """
SELECT p_partkey, 'ITEM_' || substr(upper(to_hex(abs(list_reduce(list_prepend(0::BIGINT,
  list_transform(regexp_extract_all(p_name || ' ' || p_partkey, '.'), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)))), 1, 8) AS sku FROM part""")
def _(r):
    name = F.concat_ws(" ", "p_name", "p_partkey")
    return r.table("part").select("p_partkey", text.pseudo_sku(name, "ITEM_").alias("sku"))


@query("sc_17_stored_file_name", """
SELECT page_id, page_id || '_1700000000000_' || regexp_replace(url, '[^a-zA-Z0-9.-]', '_', 'g') AS stored_name FROM pages""")
def _(r):
    return r.table("pages").select("page_id", F.concat_ws(
        "_", "page_id", F.lit("1700000000000"), text.safe_file_name(F.col("url"))).alias("stored_name"))


def packed_rows(r):
    """Table rows whose cells hold one line per item; the amount cell may be short."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    lines = lambda size, fn: F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), size), fn), "\n")).otherwise("")
    return r.spread("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        lines(n, lambda i: F.concat(F.lit("IAF"), part, i)).alias("sku"),
        lines(n, lambda i: F.concat(F.lit("Item "), i)).alias("description"),
        lines(n, lambda i: F.concat(F.col("l_quantity").cast("int") + i, F.lit(",00"))).alias("quantity"),
        lines(n, lambda i: F.concat(i, F.lit(".2500"))).alias("unit_price"),
        lines(n - part.cast("int") % 2, lambda i: F.concat(i, F.lit(",00"))).alias("total"))


ROW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("sc_18_parallel_cells_shortest", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'IAF' || l_partkey || i AS sku, 'Item ' || i AS description,
  CAST(l_quantity AS BIGINT) + i AS quantity, i + 0.25::DOUBLE AS unit_price,
  floor((CAST(l_quantity AS BIGINT) + i) * (i + 0.25::DOUBLE) * 100 + 0.5) / 100 AS total
FROM (SELECT *, unnest(range(1, greatest(l_linenumber - l_partkey % 2, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END)::INT + 1)) AS i FROM lineitem) x""")
def _(r):
    """One row per line of the shortest cell; total from quantity and price."""
    cells = text.zip_lines(True, sku=F.col("sku"), quantity=F.col("quantity"), unit_price=F.col("unit_price"),
                           total=F.col("total"), description=F.col("description"))
    rows = packed_rows(r).select(*ROW_KEY, F.inline(cells)).filter(
        F.trim("sku").rlike(r"^(IAF|FITT|YAM)[A-Z0-9]*\d+") & (F.col("total") != ""))
    q, p = numbers.whole_quantity(F.col("quantity")), numbers.price(F.col("unit_price"), 4)
    read = rows.select(*ROW_KEY, "sku", "description", F.inline(F.array(F.struct(q.alias("quantity"), p.alias("unit_price")))))
    return read.withColumn("total", F.floor(F.col("quantity") * F.col("unit_price") * 100 + 0.5).cast("double") / 100)


@query("sc_19_multiline_cells_longest", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'IAF' || l_partkey || i AS sku,
  CASE WHEN i <= l_linenumber - l_partkey % 2 THEN i || ',00' ELSE '' END AS total
FROM (SELECT *, unnest(range(1, l_linenumber + 1)) AS i FROM lineitem) x""")
def _(r):
    """One row per line of the longest cell, blanks filling the shorter ones."""
    cells = text.zip_lines(False, sku=F.col("sku"), total=F.col("total"))
    return packed_rows(r).select(*ROW_KEY, F.inline(cells))


@query("sc_24_json_payload", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS encoded FROM events""")
def _(r):
    data = F.from_json("props", "k bigint")
    return r.table("events").select("event_id", data["k"].alias("k"),
                                    F.to_json(F.struct(data["k"].alias("k"), F.col("event_type").alias("type"))).alias("encoded"))


@query("sc_25_finite_values", """
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE l_extendedprice / l_discount END AS ratio
FROM lineitem""")
def _(r):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    ratio = (F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(discount == 0, F.lit(float("-inf")))
             .otherwise(price / discount))
    return r.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", finite(ratio).alias("ratio"))


@query("sc_26_cell_address", with_roles(LEDGER, body="""
SELECT row_index, 'Sheet1!K' || row_index AS address FROM ledger"""))
def _(r):
    return r.ledger.select("row_index", F.format_string("%s!%s%d", F.lit("Sheet1"), F.lit("K"), "row_index").alias("address"))


@query("sc_27_value_triples", """
SELECT vec_id, CAST(i // 3 AS INT) AS n, CAST(embedding[i + 1] AS DOUBLE) AS net, CAST(embedding[i + 2] AS DOUBLE) AS gross, CAST(embedding[i + 3] AS DOUBLE) AS total
FROM (SELECT *, unnest(range(0, len(embedding) - 2, 3)) AS i FROM embeddings) x""")
def _(r):
    values = F.col("embedding").cast("array<double>")
    return r.table("embeddings").select("vec_id", F.posexplode(text.triples(values)).alias("n", "t")).select(
        "vec_id", "n", "t.*")


@query("sc_27_line_pairs", """
SELECT doc_id, CAST((i - 1) // 2 AS INT) AS n, CASE WHEN i < len(l) THEN l[i] || ' ' || l[i + 1] ELSE l[i] END AS description
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1, 2)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z]')) AS l FROM documents) y) x""")
def _(r):
    """Description lines taken two by two; an odd last one stays alone."""
    lines = F.filter(F.split("text", "\n"), lambda t: t.rlike("[A-Za-z]"))
    return r.table("documents").select("doc_id", F.posexplode(text.line_pairs(lines)).alias("n", "description"))


@query("sc_31_last_two_amounts", """
SELECT doc_id, CASE WHEN len(a) >= 2 THEN a[-2] ELSE '' END AS unit_price, CASE WHEN len(a) >= 2 THEN a[-1] ELSE '' END AS total
FROM (SELECT doc_id, regexp_extract_all(text, '(\\d+[.,]\\d{2})', 1) AS a FROM documents) x""")
def _(r):
    unit, total = text.last_two_amounts(F.col("text"))
    return r.table("documents").select("doc_id", unit.alias("unit_price"), total.alias("total"))


@query("sc_33_longest_code", """
SELECT d.doc_id, code FROM documents d LEFT JOIN (
  SELECT doc_id, arg_max(t, (length(t), -i)) AS code FROM (
    SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_])([A-Z]{2,}[0-9A-Z\\-_]*)', 1) AS a FROM documents) y) x GROUP BY doc_id) z USING (doc_id)""")
def _(r):
    return r.table("documents").select("doc_id", text.longest_code(F.col("text")).alias("code"))


@query("falsy_rules", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE event_id % 7 + 0.5 END AS picked,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS prefix FROM events""")
def _(r):
    """Zero, NaN and null count as missing; a number is read from the front of a text."""
    e = F.col("event_id")
    first = F.when(e % 3 == 0, F.col("value")).when(e % 3 == 1, F.lit(0.0)).otherwise(F.lit(float("nan")))
    label = F.when(e % 4 == 0, "none 12").otherwise(F.concat(F.lit(" "), e, F.lit("abc 9")))
    return r.table("events").select("event_id", first_truthy(first, (e % 7 + 0.5).cast("double")).alias("picked"),
                                    number_prefix(label).alias("prefix"))
