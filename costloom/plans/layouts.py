"""Queries: positioned tokens, neighbour searches, number triples, odd sources."""

from pyspark.sql import functions as F

from costloom.functions import text
from costloom.functions.unicode import nfc
from costloom.operators import extract, layout, rows
from costloom.plans.extraction import DOC_LINES, LINES_PER_ITEM, NUMBERED, doc_keys, doc_lines, item_tasks, numbered_items
from costloom.plans.registry import query
from costloom.plans.roles import ITEM_ORDER, ITEMS, LEDGER, SALES, with_roles
from costloom.sources.documents import electronic_invoices, ledger_cells, parse_ledger
from costloom.sources.rules import RULE_SCHEMA, with_defaults
from costloom.sources.scan import tasks_for

TOKENS = """words AS (SELECT doc_id, i - 1 AS n, w[i] AS text FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS w FROM documents) a) b),
tokens AS (SELECT doc_id, n, n // 200 AS page, CAST(n % 8 * 60 + length(text) % 5 AS DOUBLE) AS x,
    (n % 200) // 8 * 6.0::DOUBLE + n % 5 * 0.75 AS y, text FROM words WHERE text <> '')"""


def tokens(r):
    """Every word of every document placed on pages of 25 lines with 8 words.

    The texts are dealt by document before they are cut, so that their tokens need not
    travel to be put together by document or page."""
    n, docs = F.col("n"), r.table("documents").select("doc_id", "text")
    words = docs.repartition(tasks_for(docs, 2_000), "doc_id").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("n", "text")).filter("text <> ''")
    return words.select(
        "doc_id", n.cast("long").alias("n"), F.floor(n / 200).alias("page"),
        (n % 8 * 60 + F.length("text") % 5).cast("double").alias("x"),
        (F.floor((n % 200) / 8) * 6.0 + n % 5 * 0.75).alias("y"), "text")


@query("src_07_tokens", with_roles(TOKENS, body="SELECT doc_id, n, page, x, y, text FROM tokens"))
def _(r):
    return tokens(r).select("doc_id", "n", "page", "x", "y", "text")


@query("ag_16_line_reconstruction", with_roles(TOKENS, body="""
SELECT doc_id, page, floor(y / 0.5 + 0.5) * 0.5::DOUBLE AS line_y, trim(string_agg(text, ' ' ORDER BY x, n)) AS text FROM tokens GROUP BY 1, 2, 3"""))
def _(r):
    return layout.text_lines(tokens(r))


@query("wn_11_rows_by_gap", with_roles(TOKENS, body="""
, g AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR y - lag(y) OVER w > 2 THEN 1 ELSE 0 END AS new FROM tokens WINDOW w AS (PARTITION BY doc_id, page ORDER BY y, x, n)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page ORDER BY y, x, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "row" FROM g)
SELECT doc_id, page, "row", trim(string_agg(text, '|' ORDER BY x, n)) AS text FROM r GROUP BY 1, 2, 3"""))
def _(r):
    return layout.row_cells(layout.rows_by_gap(tokens(r), 2.0, bounded=True))


@query("wn_10_rows_by_anchor", with_roles(TOKENS, body="""
, ys AS (SELECT doc_id, page, list_sort(list(DISTINCT y)) AS ys FROM tokens GROUP BY 1, 2),
a AS (SELECT doc_id, page, list_reduce(list_transform(ys, lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[-1] > 5 THEN list_concat(acc, v) ELSE acc END) AS anchors FROM ys),
r AS (SELECT t.*, CAST(len(list_filter(anchors, lambda v: v <= y)) AS BIGINT) AS "row" FROM tokens t JOIN a USING (doc_id, page))
SELECT doc_id, page, "row", trim(string_agg(text, '|' ORDER BY x, n)) AS text FROM r GROUP BY 1, 2, 3"""))
def _(r):
    return layout.row_cells(layout.rows_by_anchor(tokens(r), bounded=True))


COLS = """xs AS (SELECT DISTINCT doc_id, x FROM tokens),
gx AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR x - lag(x) OVER w >= 10 THEN 1 ELSE 0 END AS new FROM xs WINDOW w AS (PARTITION BY doc_id ORDER BY x)),
cx AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY x ROWS UNBOUNDED PRECEDING) - 1 AS col FROM gx),
cols AS (SELECT doc_id, CAST(col AS INT) AS col, avg(x) AS centre FROM cx GROUP BY 1, 2)"""


@query("wn_12_column_clusters", with_roles(TOKENS, COLS, body="""
SELECT doc_id, col, centre, CASE WHEN centre < 100 THEN 'description' WHEN centre > 250 AND centre < 330 THEN 'quantity'
  WHEN centre > 330 AND centre < 400 THEN 'unit_price' WHEN centre > 450 THEN 'total' END AS kind FROM cols"""))
def _(r):
    return layout.columns_of(tokens(r), bounded=True)


@query("jn_12_nearest_column", with_roles(TOKENS, COLS, body="""
, far AS (SELECT *, x + CASE WHEN n % 11 = 0 THEN 200 ELSE 17 END AS fx FROM tokens)
SELECT f.doc_id, f.n, CASE WHEN min(abs(fx - centre)) < 50 THEN arg_min(col, (abs(fx - centre), col)) END AS col FROM far f JOIN cols USING (doc_id) GROUP BY f.doc_id, f.n"""))
def _(r):
    """Shifted tokens find the nearest column; far ones find none."""
    t = tokens(r)
    moved = t.withColumn("x", F.col("x") + F.when(F.col("n") % 11 == 0, 200).otherwise(17))
    return layout.nearest_column(moved, layout.columns_of(t, bounded=True), bounded=True).select("doc_id", "n", "col")


@query("jn_16_fill_from_below", with_roles(ITEMS, NUMBERED, body="""
, rows AS (SELECT invoice_id AS doc_id, pos * 14.0::DOUBLE + CASE WHEN pos > 4 THEN 20 ELSE 0 END AS y, CASE WHEN pos % 3 = 0 THEN quantity END AS q,
  CASE WHEN pos % 3 = 1 THEN unit_price END AS p, CASE WHEN pos % 3 = 2 THEN total END AS t FROM numbered),
l AS (SELECT *, lead(y) OVER w - y < 30 AS n1, lead(y, 2) OVER w - y < 30 AS n2, lead(q) OVER w AS q1, lead(q, 2) OVER w AS q2, lead(p) OVER w AS p1, lead(p, 2) OVER w AS p2,
  lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY y))
SELECT doc_id, y, coalesce(q, CASE WHEN n1 THEN q1 END, CASE WHEN n2 THEN q2 END) AS quantity, coalesce(p, CASE WHEN n1 THEN p1 END, CASE WHEN n2 THEN p2 END) AS unit_price,
  coalesce(t, CASE WHEN n1 THEN t1 END, CASE WHEN n2 THEN t2 END) AS total FROM l"""))
def _(r):
    """Each printed row carries one of the three amounts."""
    pos = F.col("pos")
    rows = numbered_items(r).select(
        F.col("invoice_id").alias("doc_id"), F.lit(1).alias("page"), (pos * 14.0 + F.when(pos > 4, 20).otherwise(0)).alias("y"),
        F.when(pos % 3 == 0, F.col("quantity")).alias("quantity"), F.when(pos % 3 == 1, F.col("unit_price")).alias("unit_price"),
        F.when(pos % 3 == 2, F.col("total")).alias("total"))
    return layout.fill_from_below(rows, ["quantity", "unit_price", "total"], measure=doc_keys(r)).drop("page")


@query("wn_15_anchor_spans", with_roles(DOC_LINES, body="""
, a AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM dl), b AS (SELECT * FROM a WHERE regexp_matches(text, '^(The|De|Die|El|Is) '))
SELECT doc_id, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), least(line_no + 50, n)) AS "end" FROM b"""))
def _(r):
    lines = doc_lines(r)
    return layout.spans(lines.withColumn("line_no", F.col("line_no").cast("long")), F.col("text").rlike("^(The|De|Die|El|Is) "), bounded=True)


@query("jn_15_nearest_code", with_roles(DOC_LINES, body="""
, c AS (SELECT *, nullif(regexp_extract(text, '^([A-Z][a-z]{5,})', 1), '') AS code, regexp_matches(text, '^[A-Z][a-z]{8,}') AS complete, regexp_matches(text, '^[A-Z][a-z]{0,3} ') AS wanted FROM dl)
SELECT w.doc_id, w.line_no, arg_min(c.code, (NOT c.complete, abs(c.line_no - w.line_no), c.code)) AS code,
  CAST(abs(arg_min(c.line_no, (NOT c.complete, abs(c.line_no - w.line_no), c.code)) - w.line_no) AS BIGINT) AS dist
FROM c w LEFT JOIN c ON c.doc_id = w.doc_id AND c.code IS NOT NULL AND c.line_no <> w.line_no AND c.line_no BETWEEN w.line_no - 25 AND w.line_no + 24
WHERE w.wanted GROUP BY 1, 2"""))
def _(r):
    """Whole codes first, then distance, then text, within 25 lines."""
    lines = doc_lines(r).select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.nullif(F.regexp_extract("text", "^([A-Z][a-z]{5,})", 1), F.lit("")).alias("code"),
        F.col("text").rlike("^[A-Z][a-z]{8,}").alias("complete"), F.col("text").rlike("^[A-Z][a-z]{0,3} ").alias("wanted"))
    return layout.nearest_code(lines, bounded=True)


@query("wn_21_typed_token_runs", with_roles(ITEMS, NUMBERED, body="""
, f AS (SELECT *, part_id % 3 = 0 AS short, coalesce(lag(part_id % 3 = 0) OVER (PARTITION BY invoice_id ORDER BY pos), false) AS after_short FROM numbered),
g AS (SELECT *, unnest(range(0, line_no + 1)) AS j FROM f WHERE NOT short AND NOT after_short)
SELECT invoice_id AS doc_id, j, part_id || ',0' || j || ' €' AS unit_price, CAST(CAST(quantity AS INT) + j AS VARCHAR) AS quantity, part_id || ',5' || j || ' €' AS total FROM g"""))
def _(r):
    """Per item its unit prices, quantities and totals; some have a quantity too few,
    which also spoils the group after them."""
    j = F.sequence(F.lit(0), F.col("line_no"))
    tok = lambda section, when, make: F.transform(F.filter(j, when), lambda i: F.struct(
        F.lit(section).alias("section"), i.alias("i"), make(i).alias("text")))
    short = F.col("part_id") % 3 == 0
    always = lambda i: i >= 0
    stream = F.concat(
        tok(0, always, lambda i: F.concat(F.col("part_id").cast("string"), F.lit(",0"), i, F.lit(" €"))),
        tok(1, lambda i: ~short | (i < F.col("line_no")), lambda i: (F.col("quantity").cast("int") + i).cast("string")),
        tok(2, always, lambda i: F.concat(F.col("part_id").cast("string"), F.lit(",5"), i, F.lit(" €"))))
    rows = numbered_items(r, 24).select("invoice_id", "pos", F.inline(stream))
    toks = rows.select(F.col("invoice_id").alias("doc_id"), (F.col("pos") * 1000 + F.col("section") * 100 + F.col("i")).alias("n"),
                       "text", F.col("text").endswith("€").alias("is_price"))
    return layout.typed_runs(toks, measure=doc_keys(r, 24), tasks=item_tasks(r, 24)).select("doc_id", "j", "unit_price", "quantity", "total")


@query("wn_09_promotions", with_roles(ITEMS, NUMBERED, body="""
SELECT invoice_id AS doc_id, pos, quantity + 9 - CASE WHEN part_id % 4 = 0 THEN 2 ELSE 0 END AS quantity,
  round(total - CASE WHEN part_id % 4 = 0 THEN 7.25 ELSE 0 END + 1e-7, 2) AS total FROM numbered"""))
def _(r):
    """Every fourth part has a promotion line two lines below its item line."""
    pos, ref = F.col("pos"), F.concat(F.lit("R"), "part_id", F.lit("#"), "pos", F.lit("#"))
    nothing = F.lit(None)
    row = lambda at, t, reference, q, tot: F.struct(at.alias("line_no"), t.alias("text"), reference.cast("string").alias("reference"),
                                                  q.cast("double").alias("quantity"), tot.cast("double").alias("total"))
    promo = F.when(F.col("part_id") % 4 == 0, F.concat(ref, F.lit(" bar - Promoción -2,00 0,00 -7,25"))).otherwise(F.lit("note"))
    lines = numbered_items(r, 3).select("invoice_id", "pos", F.inline(F.array(
        row(pos * 3, F.concat(ref, F.lit(" bar")), ref, F.col("quantity") + 9, F.col("total")),
        row(pos * 3 + 1, F.lit("text"), nothing, nothing, nothing), row(pos * 3 + 2, promo, nothing, nothing, nothing))))
    out = layout.promotions(lines.withColumnRenamed("invoice_id", "doc_id"), measure=doc_keys(r))
    return out.select("doc_id", "pos", "quantity", (F.round(F.col("total") + 1e-7, 2)).alias("total"))


# --- number triples -----------------------------------------------------------------

@query("jn_14_best_triple_by_error", with_roles(ITEMS, body="""
, n AS (SELECT row_number() OVER () AS id, invoice_id, line_no, supplier_id, part_id, total AS line, price,
    [round(total / 100, 0), quantity, price, CASE WHEN part_id % 13 = 0 THEN quantity * price * 1.25 ELSE quantity * price END, 21.0]::DOUBLE[] AS v
  FROM (SELECT *, part_id % 40 + CASE WHEN part_id % 13 = 0 THEN 60.75 ELSE 0.75 END::DOUBLE AS price FROM items) x),
p AS (SELECT id, i, j, k, v[i] AS q, v[j] AS u, v[k] AS t FROM n, range(1, 6) a(i), range(1, 6) b(j), range(1, 6) c(k) WHERE i <> j AND j <> k AND i <> k),
b AS (SELECT id, arg_min((q, u, t), (abs(q * u - t), i, j, k)) AS best FROM p WHERE q BETWEEN 1 AND 10000 AND u BETWEEN 0.5 AND 50 AND abs(q * u - t) / greatest(t, 1) < 0.2 GROUP BY id),
f AS (SELECT id, arg_min((s[i], s[j], s[k]), (i, j, k)) AS best FROM (SELECT id, list_sort(v) AS s FROM n) y, range(1, 6) a(i), range(1, 6) b(j), range(1, 6) c(k)
  WHERE i < j AND j < k AND s[i] > 0 AND s[j] > 0 AND abs(s[i] * s[j] - s[k]) / greatest(s[k], 1) < 0.3 GROUP BY id),
w AS (SELECT n.*, coalesce(b.best, f.best) AS best FROM n LEFT JOIN b USING (id) LEFT JOIN f USING (id))
SELECT invoice_id, line_no, supplier_id, part_id, line, best[1] AS quantity, best[2] AS unit_price, best[3] AS total FROM w"""))
def _(r):
    """Some lines have no combination in the usual ranges and fall back to sorted numbers."""
    odd = F.col("part_id") % 13 == 0
    price = F.col("part_id") % 40 + F.when(odd, 60.75).otherwise(0.75)
    amount = F.when(odd, F.col("quantity") * price * 1.25).otherwise(F.col("quantity") * price)
    values = F.array(F.round(F.col("total") / 100, 0), F.col("quantity"), price, amount, F.lit(21.0))
    rows = r.spread_items.select("invoice_id", "line_no", "supplier_id", "part_id", F.col("total").alias("line"), values.alias("v"))
    best = rows.select("*", F.explode(F.array(layout.best_triple_by_error(F.col("v")))).alias("b"))
    return best.select("invoice_id", "line_no", "supplier_id", "part_id", "line", "b.quantity", "b.unit_price", "b.total")


@query("jn_13_best_triple_by_score", with_roles(ITEMS, body="""
, n AS (SELECT row_number() OVER () AS id, invoice_id, line_no, supplier_id, part_id, total AS line, quantity * (part_id % 30 + 0.5) * CASE WHEN part_id % 9 = 0 THEN 1.45 ELSE 1 END::DOUBLE AS amount, quantity, part_id % 30 + 0.5 AS price FROM items),
m AS (SELECT id, unnest([
    {'i': 0, 'v': quantity::DOUBLE, 'kind': CASE WHEN part_id % 2 = 0 THEN 'quantity' ELSE 'number' END, 'dot': false, 'p': 10},
    {'i': 1, 'v': price::DOUBLE, 'kind': CASE WHEN part_id % 3 = 0 THEN 'price' ELSE 'number' END, 'dot': true, 'p': 20},
    {'i': 2, 'v': amount::DOUBLE, 'kind': 'price', 'dot': true, 'p': 30},
    {'i': 3, 'v': 5.0::DOUBLE, 'kind': 'number', 'dot': false, 'p': 5}]) AS x FROM n),
c AS (SELECT a.id, a.x AS a, b.x AS b, c.x AS c, abs(a.x.v * b.x.v - c.x.v) AS err FROM m a JOIN m b ON a.id = b.id JOIN m c ON c.id = a.id AND c.x.i <> b.x.i
  WHERE a.x.kind <> 'price' AND b.x.kind <> 'quantity' AND c.x.kind <> 'quantity'),
s AS (SELECT id, a.i AS ai, b.i AS bi, c.i AS ci, a.v AS q, b.v AS u, c.v AS t,
  CASE WHEN err < 0.01 THEN 1000 WHEN err < 0.1 THEN 500 WHEN err < 1 THEN 200 ELSE err * -100 END
  + CASE WHEN a.kind = 'quantity' THEN 500 ELSE 0 END + CASE WHEN a.v = 1 AND a.kind = 'number' THEN -600 ELSE 0 END
  + CASE WHEN b.kind = 'price' THEN 800 ELSE 0 END + CASE WHEN c.kind = 'price' THEN 400 ELSE 0 END
  + CASE WHEN b.kind = 'number' AND b.dot THEN 300 ELSE 0 END + CASE WHEN a.kind = 'number' AND NOT a.dot THEN 200 ELSE 0 END
  + CASE WHEN a.kind = 'number' AND a.dot AND a.v < 10 THEN -800 ELSE 0 END + CASE WHEN b.kind = 'number' AND b.v < 2 THEN -600 ELSE 0 END
  + CASE WHEN c.kind = 'number' AND c.v < 10 THEN -400 ELSE 0 END
  + CASE WHEN a.v < 0.5 THEN 0 WHEN a.v <= 10 THEN 200 WHEN a.v <= 50 THEN 150 WHEN a.v <= 200 THEN 100 WHEN a.v <= 1000 THEN 50 ELSE 25 END
  + CASE WHEN b.v < 1 THEN -50 WHEN b.v <= 20 THEN 150 WHEN b.v <= 50 THEN 100 WHEN b.v <= 100 THEN 50 ELSE -50 END
  + CASE WHEN c.v < 1 THEN -50 WHEN c.v <= 100 THEN 150 WHEN c.v <= 500 THEN 100 ELSE -50 END
  + CASE WHEN a.p < b.p THEN 50 ELSE 0 END + CASE WHEN a.p < c.p THEN 50 ELSE 0 END
  + CASE WHEN b.v >= c.v AND a.v > 1 THEN -1000 ELSE 0 END + CASE WHEN a.v <= b.v AND b.v <= c.v THEN 100 ELSE 0 END AS score
  FROM c WHERE err / greatest(c.v, 1) <= 0.3),
w AS (SELECT id, arg_max((q, u, t), (score, -ai, -bi, -ci)) AS best FROM s GROUP BY id),
pair AS (SELECT id, (quantity::DOUBLE, least(price, amount)::DOUBLE, greatest(price, amount)::DOUBLE) AS best FROM n
  WHERE part_id % 2 = 0 AND part_id % 3 = 0 AND abs(quantity * least(price, amount) - greatest(price, amount)) < greatest(price, amount) * 0.5),
z AS (SELECT n.*, coalesce(w.best, pair.best) AS best FROM n LEFT JOIN w USING (id) LEFT JOIN pair USING (id))
SELECT invoice_id, line_no, supplier_id, part_id, line, best[1] AS quantity, best[2] AS unit_price, best[3] AS total FROM z"""))
def _(r):
    """The best combination by points; a number may serve as quantity and as price,
    and without any combination the first quantity and the first two prices do."""
    part, q = F.col("part_id"), F.col("quantity")
    price = part % 30 + 0.5
    one = lambda v, kind, original, position: F.struct(
        v.cast("double").alias("value"), kind.alias("kind"), F.lit(original).alias("original"), F.lit(position).alias("position"))
    found = F.array(one(q, F.when(part % 2 == 0, "quantity").otherwise("number"), "12", 10),
                    one(price, F.when(part % 3 == 0, "price").otherwise("number"), "1.5", 20),
                    one(q * price * F.when(part % 9 == 0, 1.45).otherwise(1.0), F.lit("price"), "3.5", 30), one(F.lit(5.0), F.lit("number"), "5", 5))
    rows = r.spread_items.select("invoice_id", "line_no", "supplier_id", "part_id", F.col("total").alias("line"), found.alias("v"))
    best = rows.select("*", F.explode(F.array(layout.best_triple_by_score(F.col("v")))).alias("b"))
    return best.select("invoice_id", "line_no", "supplier_id", "part_id", "line", "b.quantity", "b.unit_price", "b.total")


# --- cells, sources, unions -----------------------------------------------------------

def cell_texts(r):
    part = F.col("part_id")
    cell = (F.when(part % 6 == 0, F.concat(F.lit("Shipping EUR "), (part % 90).cast("string"), F.lit(",75")))
            .when(part % 6 == 1, F.concat(F.lit("Invoice: F-"), part)).when(part % 6 == 2, F.concat(F.lit("dated "), part % 28 + 1, F.lit("/7/2024")))
            .otherwise(F.lit("Bar 99,99")))
    return r.spread_items.select("invoice_id", F.struct(*ITEM_ORDER).alias("place"), cell.alias("cell"))


PLACE = "(line_no, supplier_id, part_id, quantity, total)"


@query("ag_15_shipping_amounts", with_roles(ITEMS, body=f"""
SELECT invoice_id, max(part_id % 90 + 0.75::DOUBLE) FILTER (part_id % 6 = 0) AS largest,
  arg_max(part_id % 90 + 0.75::DOUBLE, {PLACE}) FILTER (part_id % 6 = 0) AS last FROM items GROUP BY 1"""))
def _(r):
    """The largest and the last shipping amount among a document's cells."""
    return rows.shipping_amounts(cell_texts(r))


@query("ag_17_first_date_and_number", with_roles(ITEMS, body=f"""
SELECT invoice_id, 'F-' || arg_min(part_id, {PLACE}) FILTER (part_id % 6 = 1) AS invoice_number,
  make_date(2024, 7, CAST(arg_min(part_id, {PLACE}) FILTER (part_id % 6 = 2) % 28 + 1 AS INT)) AS invoice_date,
  'F-' || arg_max(part_id, {PLACE}) FILTER (part_id % 6 = 1) AS last_number,
  make_date(2024, 7, CAST(arg_max(part_id, {PLACE}) FILTER (part_id % 6 = 2) % 28 + 1 AS INT)) AS last_date FROM items GROUP BY 1"""))
def _(r):
    """First and last number and date of a document in reading order."""
    return rows.number_and_date(cell_texts(r))


BRAND_SQL = ("€|\\d{4}-\\d{2}-\\d{2}|^(page|total|invoice|date|kg|grams|ml|pieces)($|[^\\p{L}\\p{N}_])|^\\d+$|^[^a-zA-Z]*$|chemin de"
             "|(^|[^\\p{L}\\p{N}_])(street|avenue|road|boulevard|chemin|rue|place|france|germany|usa|uk|netherlands|belgium|\\d{5})($|[^\\p{L}\\p{N}_])"
             "|\\+\\d{8,}|VAT\\s*(EU|FR|DE|NL)")


@query("flt_16_plausible_names", with_roles(DOC_LINES, body=f"""
SELECT doc_id, line_no, text FROM dl WHERE length(text) >= 3 AND regexp_matches(text, '[a-zA-Z]') AND NOT regexp_matches(text, '(?i){BRAND_SQL}')"""))
def _(r):
    """Lines that could be a manufacturer's name."""
    return doc_lines(r).filter(text.plausible_name(F.col("text"))).select("doc_id", "line_no", "text")


@query("flt_02_upload_files", """
SELECT page_id, name, length(html) AS size, (contains(mime, 'pdf') OR ends_with(lower(name), '.pdf')) AND length(html) <= 3000 AND ends_with(lower(name), '.pdf') AS valid
FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN page_id || '.PDF' WHEN 1 THEN page_id || '.pdf' ELSE page_id || '.txt' END AS name, CASE page_id % 2 WHEN 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM pages) x""")
def _(r):
    """Type, extension and size of uploaded files; contents are not needed."""
    k = F.col("page_id") % 3
    name = F.concat("page_id", F.when(k == 0, ".PDF").when(k == 1, ".pdf").otherwise(".txt"))
    mime = F.when(F.col("page_id") % 2 == 0, "application/pdf").otherwise("text/plain")
    size = F.length("html")
    return r.table("pages").select("page_id", name.alias("name"), size.alias("size"),
                                   text.valid_upload(name, mime, size, limit=3000).alias("valid"))


@query("src_05_ledger_cells", with_roles(LEDGER, body="""
SELECT row_index, sku_internal, supplier_skus, qty_prev, qty_in, price_prev, price_new FROM ledger"""))
def _(r):
    """Register rows from ragged text cells B..K, numbers read from their front."""
    number = lambda c, tail="": F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(tail))
    cells = F.array("sku_internal", F.lit("x"), F.lit(None).cast("string"), "supplier_skus", F.lit(""), F.lit("n/a"), number("qty_prev"),
                    number("qty_in", " pcs"), number("price_prev", " €"), number("price_new"))
    ragged = F.when(F.col("price_new").isNull(), F.slice(cells, 1, 9)).otherwise(cells)
    return parse_ledger(r.ledger.select("row_index", ragged.alias("cells"))).select(
        "row_index", "sku_internal", "supplier_skus", "qty_prev", "qty_in", "price_prev", "price_new")


@query("src_08_electronic_invoices", with_roles(ITEMS, body="""
SELECT invoice_id || '-' || line_no || '-' || supplier_id || '-' || part_id AS doc_id, 'INV' || invoice_id AS invoice_number, CAST(shipped AS DATE) AS invoice_date, part_id::VARCHAR AS sku,
  quantity, CAST(round(CAST(total AS DECIMAL(18,6)) * 1.055, 2) AS DOUBLE) AS unit_price, total AS line_total FROM items"""))
def _(r):
    """One embedded XML per invoice line; its second line has no SKU and is dropped."""
    tag = lambda name, *body: F.concat(F.lit(f"<{name}>"), *body, F.lit(f"</{name}>"))
    c = lambda n: F.col(n).cast("string")

    def line(*product):
        return tag("ram:IncludedSupplyChainTradeLineItem",
                   tag("ram:SpecifiedTradeProduct", *product),
                   tag("ram:SpecifiedLineTradeAgreement", tag("ram:NetPriceProductTradePrice", tag("ram:ChargeAmount", c("total")))),
                   tag("ram:SpecifiedLineTradeDelivery", tag("ram:BilledQuantity", c("quantity"))),
                   tag("ram:SpecifiedLineTradeSettlement", tag("ram:ApplicableTradeTax", tag("ram:RateApplicablePercent", F.lit("5.5"))),
                       tag("ram:SpecifiedTradeSettlementLineMonetarySummation", tag("ram:LineTotalAmount", c("total")))))

    xml = tag("rsm:CrossIndustryInvoice",
              tag("rsm:ExchangedDocument", tag("ram:ID", F.lit("INV"), c("invoice_id")),
                  tag("ram:IssueDateTime", tag("udt:DateTimeString", F.date_format("shipped", "yyyyMMdd")))),
              tag("rsm:SupplyChainTradeTransaction", line(tag("ram:SellerAssignedID", c("part_id")), tag("ram:Name", F.lit("Bar"))),
                  line(tag("ram:Name", F.lit("no code")))))
    docs = r.spread_items.select(F.concat_ws("-", "invoice_id", "line_no", "supplier_id", "part_id").alias("doc_id"), xml.alias("xml"))
    return electronic_invoices(docs).select("doc_id", "invoice_number", "invoice_date", "sku", "quantity", "unit_price", "line_total")


@query("src_10_expected_totals", """
SELECT event_id, nfc_normalize('re' || chr(769) || 'f ' || event_type) AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS expected FROM events""")
def _(r):
    """File-name -> total objects as rows; names are compared in one Unicode form."""
    doc = F.replace("props", F.lit('"k"'), F.concat(F.lit('"réf '), "event_type", F.lit('"')))
    rows = r.table("events").select("event_id", F.explode(F.from_json(doc, "map<string,double>")).alias("key", "expected"))
    return rows.select("event_id", nfc("key").alias("name"), "expected")


@query("src_11_json_recovery", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS from_braces, CAST(json_extract(props, '$.k') AS BIGINT) AS from_last_line FROM events""")
def _(r):
    """A JSON result found again between log lines."""
    noisy = F.concat(F.lit("INFO start\n"), "props", F.lit("\nDone."))
    lines = F.concat(F.lit('{"k": -1}\nlog {x\n'), "props", F.lit(" "))
    k = lambda t: F.from_json(t, "k bigint")["k"]
    return r.table("events").select("event_id", k(text.json_object_text(noisy)).alias("from_braces"),
                                    k(text.last_json_line(lines)).alias("from_last_line"))


@query("src_13_sales_feed", with_roles(SALES, body="SELECT sale_id, product_id, sold_at, quantity, unit_price FROM sales"))
def _(r):
    return r.sales


METHODS = """methods AS (SELECT invoice_id AS doc_id, part_id, 1 AS rank, 'grid' AS method FROM items WHERE invoice_id % 3 = 0
  UNION ALL SELECT invoice_id, part_id, 2, 'lines' FROM items WHERE invoice_id % 2 = 0 UNION ALL SELECT invoice_id, part_id, 3, 'text' FROM items)"""


def methods(r):
    """Rows three extraction methods found; each reaches other documents."""
    part = lambda cond, rank, name: r.items.filter(cond).select(
        F.col("invoice_id").alias("doc_id"), "part_id", F.lit(rank).alias("rank"), F.lit(name).alias("method"))
    return part("invoice_id % 3 = 0", 1, "grid").unionByName(part("invoice_id % 2 = 0", 2, "lines")).unionByName(part("true", 3, "text"))


@query("st_03_union_of_methods", with_roles(ITEMS, METHODS, body="SELECT doc_id, part_id, method FROM methods"))
def _(r):
    return methods(r).select("doc_id", "part_id", "method")


@query("st_06_fallback_chain", with_roles(ITEMS, METHODS, body="""
SELECT m.doc_id, part_id, method FROM methods m JOIN (SELECT doc_id, min(rank) AS rank FROM methods GROUP BY 1) b USING (doc_id, rank)"""))
def _(r):
    return layout.first_source(methods(r)).select("doc_id", "part_id", "method")


@query("st_01_union_of_pages", with_roles(ITEMS, body="""
SELECT invoice_id AS doc_id, line_no AS page, part_id, quantity FROM items"""))
def _(r):
    """Items of a document's odd and even pages together again."""
    page = lambda odd: r.items.filter(F.col("line_no") % 2 == odd).select(
        F.col("invoice_id").alias("doc_id"), F.col("line_no").alias("page"), "part_id", "quantity")
    return page(1).unionByName(page(0))


@query("src_04_register_export", """
SELECT p_partkey + 2 AS row_index, 'P' || p_partkey AS sku_internal, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'p' || p_partkey || ', "x"' END AS supplier_skus,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size + 0.5::DOUBLE END AS cmp, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE CAST(p_size AS DOUBLE) END AS qty_prev,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 2.0::DOUBLE END AS qty_in FROM part""")
def _(r):
    """Register rows out of exported CSV lines, ragged and partly unreadable."""
    part, size = F.col("p_partkey"), F.col("p_size").cast("string")
    line = F.concat_ws(
        ",", (part + 2).cast("string"), F.concat(F.lit("P"), part), F.lit("name"), F.lit(""),
        F.when(part % 4 == 0, "").otherwise(F.concat(F.lit('"p'), part, F.lit(', ""x"""'))), F.lit("unit"),
        F.when(part % 5 == 0, "n/a").otherwise(F.concat(size, F.lit(".5"))), F.when(part % 3 == 0, "-").otherwise(size))
    # Lines may end before the last cells.
    line = F.when(part % 7 == 0, line).otherwise(F.concat(line, F.lit(",2,,")))
    ledger = parse_ledger(ledger_cells(r.table("part").select(line.alias("value"))))
    return ledger.select("row_index", "sku_internal", "supplier_skus", "cmp", "qty_prev", "qty_in")


GRID_RULE = {"vendor": {"name": "grid"}, "table": {
    "strategy": "pdfplumber_table", "header_keywords": ["artikel", "menge", "summe"], "min_columns": 4,
    "columns": [{"name": "sku", "index": 0}, {"name": "description", "index": 1}, {"name": "quantity", "index": 2, "type": "number"},
                {"name": "unit_price", "index": 3, "type": "number"}, {"name": "total", "index": 4, "type": "number"}]}}


@query("sc_18_table_strategy", with_roles(ITEMS, NUMBERED, body="""
SELECT invoice_id AS doc_id, CAST(CASE WHEN pos <= 3 THEN 1 ELSE pos // 3 + 2 END AS INT) AS table_no,
  CAST(CASE WHEN pos <= 3 THEN pos ELSE pos - greatest(4, 3 * (pos // 3)) END AS INT) AS row_no, 'T' || part_id AS sku, 'Bar ' || part_id AS description,
  CAST(quantity AS DOUBLE) AS quantity, part_id % 50 + 0.5::DOUBLE AS unit_price,
  CASE WHEN part_id % 4 = 0 THEN round(quantity * (part_id % 50 + 0.5::DOUBLE), 2) ELSE 7.25 END AS total FROM numbered WHERE part_id % 6 <> 0"""))
def _(r):
    """Items of table grids: a table with the rule's header words, then tables that go
    on without one; summary rows and tables of another shape are left out."""
    part, pos = F.col("part_id"), F.col("pos")
    text_of = lambda v: v.cast("string")
    cells = F.array(F.when(part % 6 == 0, "").otherwise(F.concat(F.lit("T"), part)), F.when(part % 6 == 0, "Total net").otherwise(F.concat(F.lit("Bar "), part)),
                    text_of(F.col("quantity").cast("int")), F.concat(text_of(part % 50), F.lit(",50")), F.when(part % 4 != 0, "7,25"))
    # A row without a total has no total column at all.
    cells = F.when(part % 4 == 0, F.slice(cells, 1, 4)).otherwise(cells)
    arr = lambda *w: F.array(*[F.lit(x) for x in w])
    row = lambda table, n, c: F.struct(table.cast("int").alias("table_no"), n.cast("int").alias("row_no"), c.alias("cells"))
    # The first table has a header row and up to three items; each later one begins at a third item.
    third = F.floor(pos / 3)
    body = row(F.when(pos <= 3, 1).otherwise(third + 2), F.when(pos <= 3, pos).otherwise(pos - F.greatest(F.lit(4), 3 * third)), cells)
    heads = [row(F.lit(0), F.lit(0), arr("Kunde", "Nr")), row(F.lit(1), F.lit(0), arr("Artikel", "Text", "MENGE", "Preis", "Summe"))]
    grid = numbered_items(r, LINES_PER_ITEM).select("invoice_id", F.inline(
        F.when(pos == 1, F.array(*heads, body)).otherwise(F.array(body))))
    rule = with_defaults(r.spark.createDataFrame([GRID_RULE], RULE_SCHEMA))
    items = extract.table_items(grid.select(F.col("invoice_id").alias("doc_id"), F.lit("grid").alias("vendor"), "table_no", "row_no", "cells"), rule, measure=doc_keys(r))
    number = lambda c: F.col(c).cast("double").alias(c)
    return items.select("doc_id", "table_no", "row_no", "sku", "description", number("quantity"), number("unit_price"), number("total"))


FOOTER_RULE = {"vendor": {"name": "foot"}, "footer": {"fields": [
    {"name": "subtotal", "regex": r"^Net ([\d.,]+)$"}, {"name": "total", "regex": r"^Gross ([\d.,]+)$"},
    {"name": "order", "regex": r"^Order (\w+)$", "type": "string", "target": "metadata"},
    {"name": "terms", "regex": r"^Terms (.+)$", "type": "string", "target": "vendor"}]}}


@query("sc_21_footer_fields", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.5 ELSE round(o_totalprice, 2) END AS subtotal, CASE WHEN o_orderkey % 5 = 0 THEN 2.5 ELSE 1234.5 END::DOUBLE AS total,
  'K' || o_orderkey AS order_no, CASE WHEN o_orderkey % 2 = 0 THEN '30 days net' END AS terms FROM orders""")
def _(r):
    """Footer fields by a rule: totals replace computed ones, others go to their part."""
    key = F.col("o_orderkey")
    body = F.concat_ws("\n", F.when(key % 3 != 0, F.concat(F.lit("Net "), F.format_number(F.round("o_totalprice", 2), 2))),
                       F.when(key % 5 != 0, "Gross 1.234,50"), F.concat(F.lit("Order K"), key), F.when(key % 2 == 0, "Terms 30 days net"))
    rule = with_defaults(r.spark.createDataFrame([FOOTER_RULE], RULE_SCHEMA))
    docs = extract.prepared(r.table("orders").select(key, F.lit("foot").alias("vendor"), body.alias("text")), rule)
    found = docs.select("o_orderkey", "footer", F.explode(F.array(extract.fields(F.col("text"), F.col("footer")))).alias("found"))
    computed = F.create_map(F.lit("subtotal"), F.lit("1.5"), F.lit("total"), F.lit("2.5"))
    parts = found.select("o_orderkey", extract.with_footer(F.col("found"), computed).alias("totals"), extract.by_target(F.col("found"), F.col("footer")).alias("parts"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))
    return parts.select("o_orderkey", get("totals", "subtotal").cast("double").alias("subtotal"), get("totals", "total").cast("double").alias("total"),
                        get(get("parts", "metadata"), "order").alias("order_no"), get(get("parts", "vendor"), "terms").alias("terms"))
