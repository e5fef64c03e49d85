"""Shaping records: canonical invoices, display columns, column roles of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.falsy import first_text, first_truthy, number_prefix
from costloom.operators.keyed import join_on_key


def canonical_totals(totals: Column) -> list[Column]:
    """Typed totals of a parsed record whose values are texts.

    ``credit`` wins over ``discount`` as soon as it is written, also as "0.0".
    A missing or zero tax is what the total has above subtotal and shipping.
    """

    def amount(text: Column) -> Column:
        return F.coalesce(number_prefix(first_text(text, F.lit("0"))), F.lit(0.0))

    def of(name: str) -> Column:
        return F.try_element_at(totals, F.lit(name))

    shipping, subtotal, total = amount(of("shipping_fee")), amount(of("subtotal")), amount(of("total"))
    above = (F.coalesce(of("total"), F.lit("")) != "") & (F.coalesce(of("subtotal"), F.lit("")) != "") & (total > subtotal)
    derived = F.when(above, F.greatest(F.lit(0.0), total - subtotal - shipping)).otherwise(0.0)
    return [
        shipping.alias("shipping_fee"), amount(first_text(of("credit"), of("discount"))).alias("discount"),
        first_truthy(amount(of("tax")), derived).alias("tax"), subtotal.alias("subtotal"), total.alias("total"),
    ]


def canonical_items(items: Column) -> Column:
    """Typed lines of a parsed record; the SKU may be called reference."""

    def one(i: Column) -> Column:
        number = lambda c: F.coalesce(number_prefix(first_text(c, F.lit("0"))), F.lit(0.0))
        return F.struct(
            F.coalesce(first_text(i["sku"], i["reference"]), F.lit("")).alias("supplier_sku"),
            F.coalesce(i["description"], F.lit("")).alias("description"),
            number(i["quantity"]).alias("quantity"), number(i["unit_price"]).alias("unit_price"),
            number(i["total"]).alias("total"))

    return F.transform(items, one)


def invoice_label(invoice_id: Column) -> Column:
    return F.concat(F.lit("INV-"), F.upper(F.right(invoice_id.cast("string"), F.lit(8))))


def display_name(description: Column, product: Column, sku: Column) -> Column:
    return F.coalesce(first_text(description, product), sku)


def field_defaults(items: DataFrame, document: str = "invoice_id") -> DataFrame:
    """Lines with what is missing filled in: the reference (also an empty one) is named
    after the number of lines of the document, the description is empty, and quantity,
    unit price and total are 0."""
    counts = items.groupBy(document).agg(F.count(F.lit(1)).alias("_lines"))
    rows = join_on_key(items, counts, [document])
    return rows.withColumns({
        "reference": F.coalesce(F.nullif("reference", F.lit("")), F.concat(F.lit("ITEM_"), "_lines")),
        "description": F.coalesce("description", F.lit("")),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("quantity", "unit_price", "total")}}).drop("_lines")


# Header words of a column, by column, several languages.
HEADER_WORDS = {
    "sku": ["reference", "referencia", "ref"],
    "description": ["description", "conceptos", "descripción"],
    "quantity": ["quantity", "cantidad", "cant"],
    "unit_price": ["price", "precio"],
    "total": ["total", "importe"],
}


def header_positions(headers: Column, words: dict[str, list[str]] | None = None) -> Column:
    """Struct of 0-based positions: per column the first header with one of its words."""
    low = F.transform(headers, lambda h: F.lower(F.coalesce(h, F.lit(""))))

    def first(keys: list[str]) -> Column:
        hit = F.transform(low, lambda h: h.rlike("|".join(keys)))
        place = F.array_position(hit, True)
        return F.when(place > 0, place.cast("int") - 1)

    return F.struct(*[first(keys).alias(name) for name, keys in (words or HEADER_WORDS).items()])


def header_role(header: Column) -> Column:
    """What one header means; the first rule that fits decides."""
    h = F.trim(F.regexp_replace(F.lower(header), r"\s+", " "))
    return (
        F.when(h.rlike("item|sku|code|réf|ref"), "sku")
        .when(h.rlike("description|libell|product|name"), "description")
        .when(h.rlike(r"qty|quantity|^q\.$|^q "), "quantity")
        .when((h.contains("unit") & h.contains("price")) | (h == "pu"), "unit_price")
        .when(h.rlike("amount|total|prix ht|montant ht"), "total")
        .when(h.contains("exp") & h.contains("date"), "exp_date")
    )


def column_roles(headers: Column) -> Column:
    """Map role -> 0-based position; a later header of the same role replaces it."""
    pairs = F.filter(
        F.transform(headers, lambda h, i: F.struct(header_role(h).alias("role"), i.alias("place"))),
        lambda p: p["role"].isNotNull())
    roles = F.array_distinct(F.transform(pairs, lambda p: p["role"]))
    return F.map_from_entries(F.transform(roles, lambda role: F.struct(
        role, F.array_max(F.transform(F.filter(pairs, lambda p: p["role"] == role), lambda p: p["place"])))))


def column_profiles(cells: DataFrame, known_code: str | None = None) -> DataFrame:
    """Shares of code-like, numeric and price-like cells per table column.

    ``cells``: table_id, cells.  All rows of a table count; they are added up before
    the shuffle.  ``known_code`` is the pattern of codes that are surely codes.
    """
    values = cells.select("table_id", F.posexplode("cells").alias("col", "value")).filter("value is not null")
    v = F.trim("value")
    share = lambda cond: F.avg(cond.cast("double"))
    return values.groupBy("table_id", "col").agg(
        share(v.rlike(known_code) if known_code else F.lit(False)).alias("known_sku"),
        share(v.rlike(r"^[A-Za-z0-9\-_.]{3,}$") & ~v.rlike(r"^\d+$")).alias("code"),
        share(v.rlike(r"^\d+(?:[.,]\d+)?$")).alias("numeric"),
        share(v.rlike(r"^-?\d+[.,]\d{2,}$") | v.rlike(r"^€?\s*-?\d+[.,]?\d*$")).alias("price"))


def infer_roles(profiles: DataFrame) -> DataFrame:
    """Role of every column from its profile, walking the columns left to right.

    A known SKU pattern always makes the column the SKU.  A code-like column
    becomes the SKU while none is set, and a SKU found in column 0 does not count
    as set.  Then quantity, then the first two price-like columns.  The columns
    of one table fit in one row, so the walk is a fold over a small array.
    """
    ordered = profiles.groupBy("table_id").agg(F.sort_array(F.collect_list(
        F.struct("col", "known_sku", "code", "numeric", "price"))).alias("cols"))
    start = F.struct(*[F.lit(None).cast("int").alias(n) for n in ("sku", "quantity", "unit_price", "total")])

    def step(acc: Column, c: Column) -> Column:
        col = c["col"]
        known = c["known_sku"] >= 0.6
        code = ~known & (F.coalesce(acc["sku"], F.lit(0)) == 0) & (c["code"] >= 0.6)
        qty = ~known & ~code & (c["numeric"] >= 0.8)
        money = ~known & ~code & ~qty & (c["price"] >= 0.6)
        first = money & acc["unit_price"].isNull()
        second = money & ~first & acc["total"].isNull()
        pick = lambda cond, old: F.when(cond, col).otherwise(acc[old]).alias(old)
        return F.struct(pick(known | code, "sku"), pick(qty, "quantity"), pick(first, "unit_price"), pick(second, "total"))

    return ordered.select("table_id", F.aggregate("cols", start, step).alias("r")).select("table_id", "r.*")
