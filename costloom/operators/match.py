"""Matching supplier SKUs to products and documents to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.text import normalize_sku, split_skus
from costloom.operators.keyed import join_on_key, rows_with_key


def first_alias(aliases: DataFrame) -> DataFrame:
    """One mapping per supplier SKU: the one with the smallest id."""
    rest = [c for c in aliases.columns if c != "sku"]
    best = aliases.groupBy("sku").agg(F.min_by(F.struct(*rest), "alias_id").alias("m"))
    return best.select("sku", "m.*")


def map_items_to_products(items: DataFrame, aliases: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the product their exact SKU is mapped to; blank SKUs match nothing."""
    mapping = (
        first_alias(aliases.filter(F.trim("sku") != ""))
        .select("sku", "product_id")
        .join(products.select("product_id", "sku_internal"), "product_id")
    )
    return join_on_key(items, mapping, ["sku"]).withColumn(
        "mapping_found", F.col("product_id").isNotNull()
    )


def ledger_keys(ledger: DataFrame) -> DataFrame:
    """Per normalised SKU: how often the ledger names it and in which row.

    A token written twice in one cell counts twice.  ``row`` is only meaningful
    for a SKU that occurs once.
    """
    others = [c for c in ledger.columns if c != "supplier_skus"]
    return (
        ledger.select(*others, F.explode(split_skus(F.col("supplier_skus"))).alias("match_sku"))
        .groupBy("match_sku")
        .agg(F.count(F.lit(1)).alias("hits"),
             F.min_by(F.struct(*others), "row_index").alias("row"))
    )


def match_ledger(items: DataFrame, ledger: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Items with ``match`` = ok / not_found / ambiguous and, if ok, their ledger row.

    ``source`` is the scan the items came from, when they already went through joins.
    """
    match_sku = normalize_sku(F.col("sku")).alias("match_sku")
    keyed = items.withColumn("match_sku", match_sku)
    found = join_on_key(keyed, ledger_keys(ledger), ["match_sku"],
                        measure=(source or items).select(match_sku))
    status = (
        F.when(F.col("hits").isNull(), "not_found")
        .when(F.col("hits") > 1, "ambiguous")
        .otherwise("ok")
    )
    return found.select(
        *keyed.columns,
        status.alias("match"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when(F.col("hits") == 1, F.col("row")).alias("row"),
    )


def near_keys(unmatched: DataFrame, known: DataFrame, width: int = 5, tasks: int | None = None) -> DataFrame:
    """Which known keys look like an unmatched one: either contains the other's head.

    A key contains the other's first ``width`` characters exactly when one of its
    pieces equals that head, so both directions are equi-joins.  The known side is
    grouped per piece first: a prefix shared by very many keys stays one row with
    the number of keys and the first of them instead of every pair.  All keys
    behind a link are the known keys with that piece (``pieces``) or head.
    ``tasks`` is the number of tasks that the keys of each side are dealt to before
    they are cut: a key makes many pieces, so by its bytes a task would get too many.
    """
    keys = unmatched.select("sku").distinct()
    others = known.select(F.col("sku").alias("known_sku")).distinct()
    if tasks:
        keys, others = keys.repartition(tasks, "sku"), others.repartition(tasks, "known_sku")
    summary = [F.count(F.lit(1)).alias("n_known"), F.min("known_sku").alias("first_known")]
    head = F.substring("known_sku", 1, width)
    in_known = pieces(others, "known_sku", width).groupBy("piece").agg(*summary)
    heads = others.groupBy(head.alias("piece")).agg(*summary)
    forward = keys.withColumn("piece", F.substring("sku", 1, width)).join(in_known, "piece")
    backward = pieces(keys, "sku", width).join(heads, "piece")
    cols = ["sku", "piece", "n_known", "first_known"]
    return forward.select(*cols, F.lit("known contains it").alias("link")).unionByName(
        backward.select(*cols, F.lit("contains known").alias("link")))


def pieces(df: DataFrame, name: str, width: int) -> DataFrame:
    """Every distinct substring of up to ``width`` characters of a short key."""
    spots = F.sequence(F.lit(1), F.length(name))
    cut = F.flatten(F.transform(spots, lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(width)), lambda n: F.substring(F.col(name), i, n))))
    return df.filter(F.length(name) > 0).select(
        name, F.explode(F.array_distinct(cut)).alias("piece"))


def validate_mappings(batch: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Verdict per requested mapping row: created, product unknown, already there.

    The first row of a batch that introduces a (SKU, product) pair creates it;
    later repeats of the pair are errors like pairs that existed before.
    """
    known = products.select("sku_internal", "product_id")
    existing = (
        aliases.select("sku", "product_id").distinct().join(known, "product_id")
        .select("sku", "sku_internal", F.lit(True).alias("exists"))
    )
    first = batch.groupBy("sku_internal", "sku").agg(F.min("row").alias("first_row"))
    checked = join_on_key(batch, known, ["sku_internal"])
    checked = join_on_key(checked, existing, ["sku_internal", "sku"], measure=batch)
    checked = join_on_key(checked, first, ["sku_internal", "sku"], measure=batch)
    repeat = F.col("exists").isNotNull() | (F.col("row") > F.col("first_row"))
    error = (
        F.when(F.col("product_id").isNull(),
               F.concat(F.lit("internal SKU '"), "sku_internal", F.lit("' not found")))
        .when(repeat, F.concat(F.lit("Mapping already exists for supplier SKU '"), "sku", F.lit("'")))
    )
    return checked.select("row", "sku_internal", "sku", "product_id",
                          error.isNull().alias("created"), error.alias("error"))


def export_mapping(ledger: DataFrame) -> DataFrame:
    """Whole-cell SKU (trimmed, upper case) -> internal SKU over the whole register;
    the last row wins."""
    rows = ledger.filter((F.col("supplier_skus") != "") & (F.col("sku_internal") != ""))
    return rows.groupBy(F.upper(F.trim("supplier_skus")).alias("match_sku")).agg(
        F.max_by("sku_internal", "row_index").alias("sku_internal"))


def export_items(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Export rows; an unmapped item keeps its supplier SKU."""
    keyed = items.withColumn("match_sku", F.upper(F.trim("sku")))
    return join_on_key(keyed, mapping, ["match_sku"]).select(
        *items.columns, F.coalesce("sku_internal", "sku").alias("export_sku"))


GRAM = 5  # characters by which a longer key is looked for


def grams(text: Column, width: int = GRAM) -> Column:
    """The different substrings of ``width`` characters of a text."""
    last = F.length(text) - width + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, width))))


def contained(texts: DataFrame, wanted: DataFrame, width: int = GRAM) -> DataFrame:
    """``text`` and ``key``: which of the ``wanted`` keys (column ``key``) which of the ``texts`` (column ``text``) hold.

    A key of ``width`` characters or more is looked for by that gram of it which the
    fewest texts have, and compared where a text has it; a text is listed once per
    gram, so by its length, however many keys and lengths of keys there are.  Shorter
    keys are joined with the short substrings of the texts.
    """
    texts, keys = texts.select("text").distinct(), wanted.select("key").distinct()
    own = keys.select("key", F.explode(grams(F.col("key"), width)).alias("gram"))
    # Only grams that some key has are counted; the counts grow with texts and keys, so they are never broadcast.
    listed = texts.select("text", F.explode(grams(F.col("text"), width)).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    known = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(known.hint("merge"), "gram", "left")
    rarest = counted.groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r"))
    rarest = rarest.filter("r.n > 0").select("key", "r.gram")  # a gram that no text has: no text has the key
    long = listed.join(rarest, "gram").filter(F.contains("text", "key")).select("text", "key")
    short = keys.filter((F.length("key") > 0) & (F.length("key") < width)).withColumnRenamed("key", "piece")
    return long.unionByName(pieces(texts, "text", width - 1).join(short, "piece").select("text", F.col("piece").alias("key")))


def assign_rules(suppliers: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule of each supplier: exact name first, else the first rule (by ``ord``)
    whose key is contained in the name, else none.

    ``rules`` (key, ord, rule) is the vendors' rule list.
    """
    names = suppliers.select("supplier_name").distinct().withColumn("norm", F.lower(F.trim("supplier_name")))
    found = contained(names.select(F.col("norm").alias("text")), rules).withColumnRenamed("text", "norm")
    hits = join_on_key(names.join(found, "norm"), rules, ["key"], "inner", measure=rules.select("key")).withColumn(
        "rank", F.struct((F.col("key") != F.col("norm")).alias("partial"), "ord"))
    best = hits.groupBy("supplier_name").agg(
        F.min_by(F.struct("rule", "key"), "rank").alias("b"))
    return join_on_key(suppliers, best, ["supplier_name"]).select(
        *suppliers.columns, F.col("b.rule").alias("rule"), F.col("b.key").alias("rule_key"))


def map_by_sku_and_brand(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """First mapping with the item's SKU whose brand contains the supplier's name.

    Which brands hold which names is found once for all SKUs; mappings are then keyed
    by (SKU, name) and reduced to the smallest one before the items look theirs up: no
    item meets all mappings of its SKU.
    """
    offered = aliases.groupBy("sku", "brand").agg(F.min_by(F.struct("alias_id", "product_id"), "alias_id").alias("m"))
    held = contained(offered.select(F.col("brand").alias("text")), items.select(F.col("supplier_name").alias("key")))
    named = offered.join(held.select(F.col("text").alias("brand"), F.col("key").alias("supplier_name")), "brand")
    best = named.groupBy("sku", "supplier_name").agg(F.min("m").alias("m"))
    return join_on_key(items, best, ["sku", "supplier_name"]).select(
        *items.columns, F.col("m.product_id").alias("product_id"), F.col("m.alias_id").alias("alias_id"))


def match_stored_files(invoices: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored file whose name contains the invoice's file name; the first by name."""
    found = contained(stored.select(F.col("stored_name").alias("text")), invoices.select(F.col("file_name").alias("key")))
    # Reduced before it meets the invoices: one row per name.
    first = found.groupBy(F.col("key").alias("file_name")).agg(F.min("text").alias("stored_name"))
    return join_on_key(invoices, first, ["file_name"])


def unmapped_items(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items whose SKU no mapping has."""
    return rows_with_key(items, aliases.filter(F.trim("sku") != ""), ["sku"], present=False)


def mapped_items(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items whose SKU some mapping has."""
    return rows_with_key(items, aliases.filter(F.trim("sku") != ""), ["sku"])


def product_aliases(products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every product with its supplier SKUs and brands, one row for each different
    pair; a product without any keeps one row."""
    pairs = aliases.select("product_id", F.col("sku").alias("supplier_sku"), "brand").distinct()
    return products.join(pairs, "product_id", "left")
