"""Line items, header and footer fields out of document text and table grids.

Rules are data: a rule row is joined to its documents, and its patterns are
evaluated as column values.  One plan serves every vendor, whatever the number of
rules, and nothing is looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.dates import normalize_date
from costloom.functions.falsy import let
from costloom.functions.numbers import as_text, unified, unified_plain
from costloom.functions.text import tidy_lines, undouble
from costloom.operators.keyed import Keys, join_on_key
from costloom.operators.ordered import RUN, LastValue, Lead, OrderedGroups, RunningMax, RunningSum

# Words that mark shipping, footer and promotion rows.
SHIPPING_SKUS = ["DELIVERY", "SHIPPING", "FREIGHT", "VERSAND"]
SHIPPING_WORDS = ["shipping", "freight", "fracht", "delivery", "versand", "szállítás"]
FOOTER_WORDS = ["gesamt", "total", "subtotal", "sum", "tva", "tax", "net", "brut"]
METADATA_PHRASES = ["expiry date:", "black friday", "deal of the month", "mega deal", "sample points", "(expires:"]


def _any_of(words: list[str]) -> str:
    return "|".join(w.replace("(", r"\(") for w in words)


def _match(text: Column, pattern: Column, group) -> Column:
    return F.call_function("regexp_extract", text, pattern, group)


# A rule list has one row per vendor.  Up to this many it is broadcast, a longer
# one is joined by key with vendors of very many documents spread.
MAX_BROADCAST_RULES = 10_000


def with_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents (or lines) with the columns of their vendor's rule."""
    docs = docs.withColumn("vendor", F.lower(F.trim("vendor")))
    return join_rules(docs, _readable(rules), "inner")


def join_rules(docs: DataFrame, rules: DataFrame, how: str, measure: Keys | None = None) -> DataFrame:
    """Rows joined with their vendor's rule; only a long rule list needs a look for vendors of many rows."""
    few = rules.select("vendor").limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    return docs.join(F.broadcast(rules), "vendor", how) if few else join_on_key(docs, rules, ["vendor"], how, measure)


def prepared(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Documents with their rule; doubled text is repaired where it asks for it."""
    repaired = F.when(F.col("preprocess") == "deduplicate", undouble(F.col("text"))).otherwise(F.col("text"))
    return with_rules(docs, rules).withColumn("text", repaired)


def _once(value: Column) -> Column:
    """A generated column: computed once per row, never copied into later
    expressions or pushed-down filters by the optimizer."""
    return F.explode(F.array(value))


FIELDS_APART = 12  # fields of a rule that keep their patterns compiled


def fields(text: Column, wanted: Column) -> Column:
    """Map name -> value of the header or footer fields that are found.

    Dates become ISO text, numbers the unified reading; a field not found, or
    found empty, has no entry.
    """
    def one(f: Column, raw: Column) -> Column:
        value = let(F.trim(raw), lambda s: F.when(s != "", F.when(f["type"] == "date", normalize_date(s))
                                                  .when(f["type"] == "number", unified(s).cast("string")).otherwise(s)))
        return F.struct(f["name"].alias("key"), value.alias("value"))

    def read(s: Column, f: Column) -> Column:
        return _match(s, F.concat(F.lit("(?im)"), f["regex"]), f["group"])

    # The first fields are read by an expression each: one that sees the same pattern
    # from row to row keeps it compiled, one that goes from field to field would not.
    def raws(s: Column) -> Column:
        first = F.array(*[read(s, F.get(wanted, F.lit(n))) for n in range(FIELDS_APART)])
        rest = F.slice(wanted, FIELDS_APART + 1, F.greatest(F.size(wanted) - FIELDS_APART, F.lit(0)))
        return F.when(F.size(wanted) <= FIELDS_APART, first).otherwise(F.concat(first, F.transform(rest, lambda f: read(s, f))))

    found = let(text, lambda s: let(raws(s), lambda texts: F.filter(
        F.transform(wanted, lambda f, i: one(f, F.get(texts, i))), lambda p: p["value"].isNotNull())))
    return let(found, _last_of_each)


def _last_of_each(found: Column) -> Column:
    names = F.array_distinct(F.transform(found, lambda p: p["key"]))
    # The same field may have several rules; the last one found wins.
    return F.map_from_entries(F.transform(names, lambda k: F.struct(
        k, F.element_at(F.transform(F.filter(found, lambda p: p["key"] == k), lambda p: p["value"]), -1))))


def table_lines(lines: DataFrame, max_rows: int | None = None, measure: Keys | None = None, bounded: bool = False) -> DataFrame:
    """Lines inside the item table.

    A start marker opens the table, an end marker closes it, the start is tested
    first, and the table may open again on a later page.  Marker lines are never
    inside.  Without a start marker every line but the end markers is inside.
    Needs start_marker and end_marker as columns.
    """
    seq = OrderedGroups(with_marks(lines), ["doc_id"], ["line_no"], max_rows, measure, bounded)
    return inside_table(seq.with_columns(_state=table_state()))


def table_state() -> LastValue:
    return LastValue(F.col("_mark"))


def with_marks(lines: DataFrame) -> DataFrame:
    opens = F.col("start_marker").isNotNull() & _found("text", "start_marker")
    closes = ~opens & F.col("end_marker").isNotNull() & _found("text", "end_marker")
    return lines.withColumns({"_mark": F.when(opens, 1).when(closes, 0), "_open": F.col("start_marker").isNull()})


def inside_table(lines: DataFrame) -> DataFrame:
    state = F.coalesce(F.col("_state"), F.lit(0)) == 1
    return lines.filter(F.col("_mark").isNull() & (state | F.col("_open"))).drop("_mark", "_state", "_open")


def _found(text: str, pattern: str) -> Column:
    """The pattern of the row's rule occurs in the text, whatever the case.

    ``regexp_instr`` keeps a compiled pattern as long as it does not change from
    row to row; ``rlike`` would compile a pattern column for every row.
    """
    return F.coalesce(F.expr(f"regexp_instr({text}, concat('(?i)', {pattern})) > 0"), F.lit(False))


# Separates the groups of a row match; no printed text holds it.
_PART = "\u0001"


def _whole(pattern: Column) -> Column:
    """A pattern that takes the whole text around the first place where ``pattern`` fits."""
    return F.concat(F.lit(r"(?s:\A.*?)(?:"), pattern, F.lit(r")(?s:.*\z)"))


def _template(wanted: Column) -> Column:
    """Replaces such a text by the groups that columns name, each after a ``_PART``."""
    groups = F.transform(wanted, lambda c: F.concat(F.lit(_PART + "$"), c["regex_group"]))
    return F.concat(F.array_join(groups, ""), F.lit(_PART))


ITEM_VALUES = ["sku", "description", "position", "quantity", "unit_price", "total",
               "original_price", "discount_percent"]


ITEM_FLAGS = ("doc_id", "vendor", "line_no", "merge_two_lines", "missing_total_is_zero", "_code", RUN)
CODE_LINE = r"FID:\s*(\d+)"


def _readable(rules: DataFrame) -> DataFrame:
    """Rules with what reading a line needs, worked out once per rule: the pattern that
    takes a whole line, what replaces it, and where each item value is found."""
    return rules.withColumns({
        "_pattern": _whole(F.col("row_pattern")), **_row_places("columns"), **_row_places("columns_alt", "_alt"),
        **_grid_places(F.col("columns"))})


def _row_places(columns: str, suffix: str = "") -> dict[str, Column]:
    """What replaces a row, and which of its parts each item value is."""
    wanted = F.filter(columns, lambda c: c["regex_group"].isNotNull())
    at = F.array(*[F.array_position(F.transform(wanted, lambda c: c["name"]), k).cast("int") for k in ITEM_VALUES])
    kinds = F.array(*[F.exists(wanted, lambda c: (c["name"] == k) & (c["type"] == "number")) for k in ITEM_VALUES])
    return {f"_template{suffix}": _template(wanted), f"_at{suffix}": at, f"_number{suffix}": kinds}


def _grid_places(columns: Column) -> dict[str, Column]:
    """Where each item value stands in a grid's rows, and whether it is an amount."""
    first = lambda k: F.get(F.filter(columns, lambda c: c["name"] == k), F.lit(0))
    return {"_grid_at": F.array(*[first(k)["index"] for k in ITEM_VALUES]),
            "_grid_number": F.array(*[first(k)["type"] == "number" for k in ITEM_VALUES])}


# Row patterns that a plan may spell out; a longer list stays a column.
MAX_SPELLED_PATTERNS = 32


def spelled_patterns(rules: DataFrame) -> list[tuple[str, str]] | None:
    """The different patterns of a short rule list, with what replaces their matches."""
    found = _readable(rules).filter("_pattern is not null").select("_pattern", "_template").distinct()
    rows = found.limit(MAX_SPELLED_PATTERNS + 1).collect()
    return sorted(map(tuple, rows)) if len(rows) <= MAX_SPELLED_PATTERNS else None


def row_cells(lines: DataFrame, patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """Lines with ``_cells``: the texts of the groups that their rule's row pattern
    finds, in one run of it, null if it finds nothing.

    ``patterns`` are those of all rules: spelled out, each is compiled once and not
    whenever the rule changes from one line to the next.
    """
    valid = F.col("row_validator").isNull() | _found("trim(text)", "row_validator")
    code = F.col("_code").isNotNull() if "_code" in lines.columns else F.lit(False)
    packed = F.call_function("regexp_replace", F.trim("text"), F.col("_pattern"), F.col("_template"))
    if patterns:
        packed = F.coalesce(*[F.when(F.col("_pattern") == p, F.regexp_replace(F.trim("text"), F.lit(p), F.lit(t))) for p, t in patterns])
    read = lines.select("*", _once(F.when(~code & valid, F.split(packed, _PART, -1))).alias("_cells"))
    return read.withColumn("_cells", F.when(F.size("_cells") > 1, F.col("_cells")))


def row_items(lines: DataFrame) -> DataFrame:
    """Lines that match the row pattern, as items (all values texts).

    Lines with ``_code`` set (a number belonging to an earlier item) pass through
    without values.
    """
    if "_code" not in lines.columns:
        lines = lines.withColumn("_code", F.lit(None).cast("string"))
    if "_cells" not in lines.columns:
        lines = row_cells(lines)
    keep = [c for c in ITEM_FLAGS if c in lines.columns]
    hits = lines.filter(F.col("_code").isNotNull() | F.col("_cells").isNotNull())
    return item_values(hits, keep, row_texts())


def row_texts() -> list[Column]:
    """What the row pattern found for each item value; a group that took no part is absent."""
    return [F.nullif(F.get("_cells", F.get("_at", F.lit(n))), F.lit("")) for n in range(len(ITEM_VALUES))]


def item_values(rows: DataFrame, keep: list[str], raws: list[Column]) -> DataFrame:
    """``keep`` and the item values: ``raws`` are their texts as printed, null where there
    is none, and ``_number`` says which of them are amounts."""
    texts = rows.select(*keep, "_number", *[raw.alias(f"_raw_{k}") for k, raw in zip(ITEM_VALUES, raws)])
    # Plain spellings are read by themselves: without array functions that is generated code.
    plain = F.struct(*[F.when(F.get("_number", F.lit(n)), unified_plain(F.col(f"_raw_{k}"))).alias(k) for n, k in enumerate(ITEM_VALUES)])
    read = texts.select("*", _once(plain).alias("_n"))

    def value(n: int, k: str) -> Column:
        raw, v = F.col(f"_raw_{k}"), F.col(f"_n.{k}")
        spelled = (F.when(v == F.floor(v), v.cast("long").cast("string")).when(v.isNotNull(), v.cast("string"))
                   .when(raw.isNotNull(), as_text(unified(raw))))
        return F.when(F.get("_number", F.lit(n)), spelled).otherwise(F.when(raw.isNotNull(), tidy_lines(raw))).alias(k)

    return read.select(*keep, *[value(n, k) for n, k in enumerate(ITEM_VALUES)])


def line_kind() -> Column:
    """head (code and text, no total), tail (total only), code, or whole."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    head = has("sku") & has("description") & ~has("total")
    tail = has("total") & ~has("sku") & ~has("description")
    return (F.when(F.col("_code").isNotNull(), "code").when(~F.col("merge_two_lines"), "whole")
            .when(head, "head").when(tail, "tail").otherwise("whole"))


def merge_two_lines(items: DataFrame) -> DataFrame:
    """Vendors that print an item on two lines: code and text, then the amounts.

    The amount line takes code and text from the line ``_before`` it (the last
    head or tail); an amount line without a head is dropped, and so is every head.
    """
    paired = (F.col("_kind") == "tail") & (F.col("_before.kind") == "head")
    kept = items.filter(F.col("_kind").isin("whole", "code") | F.coalesce(paired, F.lit(False)))
    take = lambda c: F.when(F.col("_kind") == "tail", F.col(f"_before.{c}")).otherwise(F.col(c))
    return kept.withColumns({"sku": take("sku"), "description": take("description")}).drop("_before", "_kind")


def classify(items: DataFrame) -> DataFrame:
    """Items with a code found in the text, and ``row_kind``: item, shipping,
    footer, metadata or empty.  Metadata lines inside a text are cut out."""
    desc = F.coalesce("description", F.lit(""))
    low, place = F.lower(desc), F.lower(F.coalesce("position", F.lit("")))
    has_id = (desc != "") | (F.coalesce("sku", F.lit("")) != "") | (place != "")
    code = F.when(F.coalesce("sku", F.lit("")) != "", F.col("sku")).otherwise(
        F.nullif(F.regexp_extract(desc, r"^\[(.+?)\]", 1), F.lit("")))
    shipping = (F.upper(F.coalesce("sku", F.lit(""))).isin(SHIPPING_SKUS) | low.rlike(r"\b(ups|zone)\b")
                | low.rlike(_any_of(SHIPPING_WORDS)) | place.rlike(_any_of(SHIPPING_WORDS)))
    short = F.length(F.trim(low)) < 50
    footer = place.rlike(_any_of(FOOTER_WORDS)) | (short & F.trim(low).rlike(f"^({_any_of(FOOTER_WORDS)})"))
    phrases = _any_of(METADATA_PHRASES)
    promo = F.trim(low).rlike(f"^({phrases})")
    # Most texts are one line, which is kept or not; only longer ones are cut.
    one_line, said = ~F.contains(desc, F.lit("\n")), low.rlike(phrases)
    kept = F.filter(F.split(desc, "\n"), lambda s: ~F.lower(s).rlike(phrases))
    nothing = F.when(one_line, said).otherwise(F.size(kept) == 0)
    kind = (F.when(~has_id, "empty").when(shipping, "shipping").when(footer, "footer")
            .when(promo | nothing, "metadata").otherwise("item"))
    text = F.when(one_line, F.when(said, "").otherwise(F.trim(desc))).otherwise(
        F.array_join(F.transform(kept, lambda s: F.trim(s)), " "))
    return items.withColumns({"row_kind": kind, "sku": code, "description": text})


def with_missing_total(items: DataFrame) -> DataFrame:
    """Total quantity * price (2 places) where the row has none, or "0" for
    vendors whose missing total is a full credit."""
    q, p = F.col("quantity").try_cast("double"), F.col("unit_price").try_cast("double")
    computed = F.format_string("%.2f", q * p)
    known = F.col("quantity").isNotNull() & F.col("unit_price").isNotNull()
    fill = F.when(known & F.col("missing_total_is_zero"), F.lit("0")).when(
        q.isNotNull() & p.isNotNull(), computed)
    return items.withColumn("total", F.coalesce("total", fill))


def shipping_fee(classified: DataFrame) -> DataFrame:
    """Per document the sum of the positive totals of its shipping rows."""
    total = F.col("total").try_cast("decimal(18,4)")
    return classified.filter("row_kind = 'shipping'").groupBy("doc_id").agg(
        F.sum(F.when(total > 0, total)).cast("double").alias("shipping_fee"))


def text_items(docs: DataFrame, rules: DataFrame, max_rows: int | None = None,
               measure: Keys | None = None, with_shipping: bool = False) -> DataFrame:
    """Items of documents whose rule reads the text line by line.

    ``docs``: doc_id, vendor, line_no, text (one row per line).  Table regions,
    two-line items and codes on later lines all look along the same order, so the
    lines are partitioned by document once and stay there to the end.
    ``with_shipping`` keeps the shipping rows too, and ``row_kind``.
    """
    rules = rules.filter("strategy = 'text_regex'")
    code = F.nullif(F.regexp_extract("text", CODE_LINE, 1), F.lit(""))
    # All that a line shows by itself is read before the lines are put in order, so
    # the rules join once and only lines that mean something travel.
    read = row_cells(with_marks(prepared(docs, rules)).withColumn("_code", code), spelled_patterns(rules))
    telling = read.filter("_mark is not null or _code is not null or _cells is not null")
    telling = item_values(telling, [*[c for c in ITEM_FLAGS if c in read.columns], "_mark", "_open"], row_texts())
    seq = OrderedGroups(telling, ["doc_id"], ["line_no"], max_rows, measure)
    rows = inside_table(seq.with_columns(keep_run=True, _state=table_state())).withColumn("_kind", line_kind())
    half = F.when(F.col("_kind").isin("head", "tail"), F.struct(F.col("_kind").alias("kind"), "sku", "description"))
    seq = seq.resume(rows)
    merged = merge_two_lines(seq.with_columns(keep_run=True, _before=LastValue(half, inclusive=False)))
    kept = classify(merged).filter(F.col("_code").isNotNull() | F.col("row_kind").isin(*_kinds(with_shipping)))
    # A code line gives its number to the last item before it; the last one wins.
    is_item = F.col("_code").isNull()
    if with_shipping:  # a shipping row is a row of its own and takes no code
        is_shipping = is_item & (F.col("row_kind") == "shipping")
        kept, is_item = kept.withColumn("_own", F.when(is_shipping, F.col("line_no"))), is_item & ~is_shipping
    owned = seq.resume(kept).with_columns(_item=RunningSum(is_item.cast("long")))
    values = ["vendor", "line_no", "missing_total_is_zero", *ITEM_VALUES, *(["row_kind"] if with_shipping else [])]
    alone = ["_own"] if with_shipping else []
    counts = (F.col("_item") > 0) | F.col("_own").isNotNull() if with_shipping else F.col("_item") > 0
    items = owned.filter(counts).groupBy("doc_id", "_item", *alone).agg(
        F.min_by(F.struct(*values), F.when(F.col("_code").isNull(), F.col("line_no"))).alias("i"),
        F.max_by("_code", F.when(F.col("_code").isNotNull(), F.col("line_no"))).alias("code"))
    items = items.select("doc_id", "i.*", "code").withColumn("sku", F.coalesce("code", "sku")).drop("code")
    return with_missing_total(items)


def _kinds(with_shipping: bool) -> list[str]:
    return ["item", "shipping"] if with_shipping else ["item"]


def region(text: Column, start: Column, end: Column) -> Column:
    """The text between the first start marker and the next end marker; a marker
    that is missing or not found leaves its side open."""
    head = F.when(start.isNull(), text).otherwise(F.call_function(
        "regexp_replace", text, F.concat(F.lit(r"(?is)\A.*?(?:"), start, F.lit(")")), F.lit("")))
    return F.when(end.isNull(), head).otherwise(F.call_function(
        "regexp_replace", head, F.concat(F.lit("(?is)(?:"), end, F.lit(r").*\z")), F.lit("")))


def region_items(docs: DataFrame, rules: DataFrame, with_shipping: bool = False) -> DataFrame:
    """Items of documents whose rule matches rows anywhere in the table region,
    across lines, with a second pattern for rows printed the other way round.
    Rows both patterns find stay twice."""
    ruled = prepared(docs, rules.filter("strategy = 'text_regex_multiline'"))
    area = ruled.withColumn("area", region(F.col("text"), F.col("start_marker"), F.col("end_marker")))

    def rows(pattern: str, suffix: str, variant: int) -> DataFrame:
        full = F.concat(F.lit("(?s)"), F.col(pattern))
        hits = area.filter(F.col(pattern).isNotNull()).withColumn(
            "hit", F.call_function("regexp_extract_all", F.col("area"), full, F.lit(0)))
        places = [F.col(f"{c}{suffix}").alias(c) for c in ("_template", "_at", "_number")]
        one = hits.select("doc_id", "vendor", "missing_total_is_zero", F.lit(variant).alias("variant"), *places,
                          full.alias("pattern"), F.posexplode("hit").alias("pos", "hit"))
        packed = F.call_function("regexp_replace", F.col("hit"), _whole(F.col("pattern")), F.col("_template"))
        read = one.select("*", _once(F.split(packed, _PART, -1)).alias("_cells"))
        read = read.withColumn("_cells", F.when(F.size("_cells") > 1, F.col("_cells")))
        return item_values(read, ["doc_id", "vendor", "missing_total_is_zero", "variant", "pos"], row_texts())

    found = rows("row_pattern", "", 1).unionByName(rows("row_pattern_alt", "_alt", 2))
    return with_missing_total(classify(found).filter(F.col("row_kind").isin(*_kinds(with_shipping))))


# --- table grids ----------------------------------------------------------------

def keyword_hits(headers: Column, keywords: Column) -> Column:
    """How many keywords occur in some header, whatever the case."""
    low = F.transform(headers, lambda h: F.lower(F.coalesce(h, F.lit(""))))
    return F.size(F.filter(keywords, lambda k: F.exists(low, lambda h: F.contains(h, F.lower(k)))))


def table_items(rows: DataFrame, rules: DataFrame, max_rows: int | None = None, measure: Keys | None = None,
                with_shipping: bool = False) -> DataFrame:
    """Items of documents whose rule reads table grids (strategy ``pdfplumber_table``).

    ``rows``: doc_id, vendor, table_no, row_no (0 is a table's first row), cells.  A
    table is used if its first row has the rule's header words, if it goes on with
    the items of an earlier one, or if the rule names no words; the header row is
    skipped, packed rows unfold, rows are told apart by kind, totals are filled in.
    """
    ruled = with_rules(rows, rules.filter("strategy = 'pdfplumber_table'"))
    first = F.col("row_no") == 0
    tables = ruled.groupBy("doc_id", "table_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.when(first, F.col("cells"))).alias("headers"),
        F.max(F.when(first, F.col("header_keywords"))).alias("keywords"), F.max(F.when(first, F.col("min_columns"))).alias("min_columns"),
        F.max(F.when(first, F.size("columns"))).alias("n_columns")).filter("headers is not null")
    used = target_tables(tables, max_rows, measure).select("doc_id", "table_no", "use")
    data = join_on_key(ruled, used, ["doc_id", "table_no"], "inner").filter((F.col("use") != "header") | (F.col("row_no") > 0))
    items = grid_items(data.select("doc_id", "vendor", "table_no", "row_no", "missing_total_is_zero", "cells", "columns", "_grid_at", "_grid_number"))
    return with_missing_total(classify(items).filter(F.col("row_kind").isin(*_kinds(with_shipping))))


def with_footer(found: Column, computed: Column) -> Column:
    """Totals of a record: what the footer says replaces what was computed, by name."""
    return F.map_concat(F.map_filter(computed, lambda k, v: ~F.map_contains_key(found, k)), found)


def by_target(found: Column, wanted: Column) -> Column:
    """Fields found, by the part of the record (``target``) they belong to."""
    targets = F.array_distinct(F.transform(wanted, lambda f: f["target"]))
    names = lambda t: F.transform(F.filter(wanted, lambda f: f["target"] == t), lambda f: f["name"])
    return F.map_from_entries(F.transform(targets, lambda t: F.struct(
        t, F.map_filter(found, lambda k, v: F.array_contains(names(t), k)))))


def target_tables(tables: DataFrame, max_rows: int | None = None, measure: Keys | None = None) -> DataFrame:
    """Tables that hold items: ``use`` = header, continuation, or all (no keywords).

    ``tables``: doc_id, table_no, headers (first row), n_rows, keywords,
    n_columns (of the rule) and min_columns.  A table without matching headers
    continues the items only when some table before it had data rows.
    """
    width = F.size("headers")
    hit = keyword_hits(F.col("headers"), F.col("keywords")) >= 2
    wide = tables.filter((F.col("min_columns") <= 0) | (width >= F.col("min_columns")))
    seq = OrderedGroups(wide.withColumn("_hit", hit), ["doc_id"], ["table_no"], max_rows, measure)
    rows_before = RunningMax(F.when(F.col("_hit") & (F.col("n_rows") > 1), 1), inclusive=False)
    out = seq.with_columns(_seen=rows_before)
    use = (F.when(F.size("keywords") == 0, "all").when(F.col("_hit"), "header")
           .when((F.col("_seen") == 1) & (width >= F.col("n_columns") - 2), "continuation"))
    return out.withColumn("use", use).filter("use is not null").drop("_hit", "_seen")


def is_invoice_table(headers: Column, n_rows: Column, keywords: Column | None = None,
                     max_rows: int | None = None) -> Column:
    """At least 3 columns, a row (with ``max_rows`` no more than that many) and, with
    keywords, two of them in headers."""
    shape = (F.size(headers) >= 3) & (n_rows >= 1)
    if max_rows is not None:
        shape &= n_rows <= max_rows
    return shape if keywords is None else shape & (keyword_hits(headers, keywords) >= 2)


def is_header_row(cells: Column, headers: Column) -> Column:
    low = lambda a: F.transform(a, lambda x: F.lower(F.coalesce(x, F.lit(""))))
    return F.coalesce(low(cells) == low(headers), F.lit(False))


def has_total(cells: Column, total_index: Column) -> Column:
    """The configured total cell is not blank (or there is no such cell)."""
    inside = total_index.isNotNull() & (total_index < F.size(cells))
    return ~inside | (F.trim(F.coalesce(F.get(cells, total_index), F.lit(""))) != "")


def grid_items(rows: DataFrame) -> DataFrame:
    """Items of table rows: ``rows`` has cells and the rule's columns.

    A row whose number cells hold several lines becomes several rows; blank rows
    and rows with a blank total are dropped.
    """
    if "_grid_at" not in rows.columns:
        rows = rows.select("*", *[_once(v).alias(k) for k, v in _grid_places(F.col("columns")).items()])
    cells, cols = F.col("cells"), F.col("columns")
    by_number = F.exists(cols, lambda c: (c["type"] == "number") & F.contains(
        F.coalesce(F.get(cells, c["index"]), F.lit("")), F.lit("\n")))
    anywhere = F.exists(cells, lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("\n")))
    # A row without a line break anywhere is what most rows are, and needs no look at its columns.
    packed = F.contains(F.array_join(cells, ""), F.lit("\n")) & F.when(F.size(cols) > 0, by_number).otherwise(anywhere)
    split = F.transform(cells, lambda c: F.split(F.coalesce(c, F.lit("")), "\n"))
    n = F.array_max(F.transform(split, lambda p: F.size(p)))
    whole = F.when(F.exists(cells, lambda c: c.isNull()), F.transform(cells, lambda c: F.coalesce(c, F.lit("")))).otherwise(cells)
    out = F.when(~packed, F.array(whole)).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(
            split, lambda p: F.coalesce(F.get(p, i), F.lit("")))))
    one = rows.select(*[c for c in rows.columns if c != "cells"], F.posexplode(out).alias("sub", "cells"))
    total_index = F.get("_grid_at", F.lit(ITEM_VALUES.index("total")))
    filled = F.trim(F.array_join("cells", "")) != ""
    kept = one.filter(filled & has_total(F.col("cells"), total_index)).withColumn("_number", F.col("_grid_number"))
    # A column beyond the end of a short row has no value at all.
    raws = [F.get("cells", F.get("_grid_at", F.lit(n))) for n in range(len(ITEM_VALUES))]
    return item_values(kept, [c for c in kept.columns if c not in ("cells", "columns", "_grid_at", "_grid_number", "_number")], raws)


def merge_negative(items: DataFrame, max_rows: int | None = None, measure: Keys | None = None,
                   rest: tuple[str, ...] = (), applies: Column | None = None, bounded: bool = False,
                   within: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """An item followed by a negative total absorbs that one line: the totals add
    up, the unit price is new total over the item's own quantity (2 places).

    Needs doc_id, pos, sku, quantity, unit_price, total (numbers).  A run of
    negative lines pairs up from its start, so only every second line is absorbed.
    ``rest`` names more columns to keep of the item; where ``applies`` is false every
    line stays by itself.  ``within`` names the columns whose lines follow one another.
    """
    lines = OrderedGroups(items, within, ["pos"], max_rows, measure, bounded)
    # A run begins at a line that is not negative; its lines are numbered in it.
    starts = F.when(F.coalesce("total", F.lit(0.0)) >= 0, F.col("_at"))
    numbered = lines.with_columns(keep_run=True, _at=RunningSum(F.lit(1).cast("long")))
    runs = lines.resume(numbered).with_columns(keep_run=True, _start=LastValue(starts))
    odd = (F.col("_at") - F.coalesce("_start", F.lit(1))) % 2 == 0
    if applies is not None:
        odd = ~F.coalesce(applies, F.lit(False)) | odd
    amount = F.col("total").cast("decimal(18,4)")
    paired = lines.resume(runs.withColumn("_first", odd)).with_columns(_next=Lead(F.struct("_first", amount.alias("amount"))))
    taken = ~F.col("_next._first")
    added = F.when(taken, F.col("_next.amount"))
    merged = paired.filter("_first").withColumns({
        "_sum": F.coalesce(amount + added, amount, added).cast("decimal(28,4)"), "n": F.when(taken, 2).otherwise(1).cast("long")})
    total = F.round("_sum", 2)
    # Divided as decimals: an exact half cent is rounded up, never as its double happens to lie.
    price = F.when((F.col("n") > 1) & (F.col("quantity") != 0), F.round(
        total.cast("decimal(18,2)") / F.col("quantity").cast("decimal(12,4)"), 2).cast("double")).otherwise(F.col("unit_price"))
    return merged.select(*within, "pos", "sku", "quantity", price.alias("unit_price"),
                         total.cast("double").alias("total"), F.col("n").alias("lines"), *rest)


def packed_items(rows: DataFrame) -> DataFrame:
    """Items of vendors that print a whole block of items into one table row.

    ``rows`` has sku, quantity, unit_price, total cells of several lines.  Blank
    lines are removed per column, codes, quantities and prices align by position,
    and totals align greedily: the next total belongs to the item when it is
    within 0.05 of quantity * price (or nothing can be computed and it is
    positive); otherwise the computed amount is taken and the total waits.
    """
    def lines(name: str) -> Column:
        return F.filter(F.split(F.coalesce(name, F.lit("")), "\n"), lambda s: F.trim(s) != "")

    skus, qtys, prices, totals = (lines(n) for n in ("sku", "quantity", "unit_price", "total"))
    amounts = F.transform(totals, lambda t: unified(t))
    raw = F.transform(skus, lambda s, i: F.struct(
        i.alias("n"), F.trim(s).alias("sku"), unified(F.get(qtys, i)).alias("quantity"),
        unified(F.get(prices, i)).alias("unit_price")))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<double>").alias("picked"))

    def step(acc: Column, item: Column) -> Column:
        computed = item["quantity"] * item["unit_price"]
        waiting = F.get(F.col("_amounts"), acc["next"])
        fits = F.coalesce((F.abs(waiting - computed) < 0.05) | ((computed == 0) & (waiting > 0)), F.lit(False))
        return let(fits, lambda match: F.struct(
            (acc["next"] + match.cast("int")).alias("next"),
            F.concat(acc["picked"], F.array(
                F.when(match, waiting).when(computed > 0, F.round(computed, 2)))).alias("picked")))

    prepared_rows = rows.select("*", _once(F.struct(amounts.alias("amounts"), raw.alias("raw"))).alias("_p")).select(
        *rows.columns, F.col("_p.amounts").alias("_amounts"), F.col("_p.raw").alias("_raw"))
    aligned = F.aggregate("_raw", start, step)["picked"]
    done = prepared_rows.select("*", aligned.alias("_totals"))
    keep = [c for c in rows.columns if c not in ("sku", "quantity", "unit_price", "total")]
    both = F.zip_with("_raw", "_totals", lambda a, t: F.struct(
        a["n"].alias("n"), a["sku"].alias("sku"), a["quantity"].alias("quantity"),
        a["unit_price"].alias("unit_price"), t.alias("total")))
    # Words of summary rows that end up in the code column.
    summary = "GROSS|AMOUNT|IMPORTANT|SUPPLIER|TAXABLE|SHIPPING|DISCOUNT"
    amount_like = r"^(?=.{6,})(?=.*,)(?=.*\.)[\d.,]+$"
    return done.select(*keep, F.inline(both)).filter(
        ~F.upper("sku").rlike(summary) & ~F.col("sku").rlike(amount_like))


def split_records(text: Column, start: Column) -> Column:
    """A text region cut into records, each beginning where ``start`` matches."""
    return F.split(text, F.concat(F.lit(r"\n(?="), start, F.lit(")")))


def record_items(regions: DataFrame) -> DataFrame:
    """Fields of the records of text regions: one row per record, ``record`` counts from 0.

    ``regions`` has ``region`` and, of its rule, ``record_start`` (a pattern), the
    fields wanted (``record_fields``) and the names that must be there (``required``).
    Records without one of these are left out.
    """
    rest = [c for c in regions.columns if c not in ("region", "record_start", "record_fields", "required")]
    records = regions.select(*rest, "record_fields", "required", F.posexplode(split_records(F.col("region"), F.col("record_start"))).alias("record", "_text"))
    found = records.select(*rest, "record", "required", _once(fields(F.replace("_text", F.lit("\n"), F.lit(" ")), F.col("record_fields"))).alias("found"))
    return found.filter(F.forall("required", lambda k: F.try_element_at("found", k).isNotNull())).drop("required")
