"""Weighted average purchase cost: register shift, history, perpetual average."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions.falsy import finite, first_truthy
from costloom.functions.text import normalize_sku
from costloom.operators.allocate import PRECISE
from costloom.operators.keyed import join_on_key
from costloom.operators.match import ledger_keys, match_ledger
from costloom.operators.ordered import RUN, Lag, LastValue, OrderedGroups, RunningMax, RunningSum
from costloom.session import ensure_checkpoint_dir, max_group_rows


def cmp_value(qty_prev: Column, price_prev: Column, qty_in: Column, price_new: Column) -> Column:
    """Average of stock and arrival; the new price when there is no history.

    Never rounded.  ``price_prev`` is the previous *purchase price*, not the
    previous average.
    """
    average = (qty_prev * price_prev + qty_in * price_new) / (qty_prev + qty_in)
    return F.when(price_prev.isNotNull() & (qty_prev > 0), average).otherwise(price_new)


def checked_items(items: DataFrame, invoices: DataFrame, ledger: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Lines with landed price, ledger match and ``outcome``.

    ok / not_found / ambiguous / error, where error is a quantity that is not
    positive or a negative price.  Freight is spread over all lines, also those
    that are later skipped.  ``source`` is the scan the items came from, when they
    already went through a shuffle.
    """
    measure = None if source is None else source.select("invoice_id")
    units = items.groupBy("invoice_id").agg(F.sum("quantity").alias("units"))
    fee = F.col("shipping_fee") / F.col("units")
    per_unit = (
        units.join(invoices.select("invoice_id", "invoice_date", "shipping_fee"), "invoice_id")
        .select("invoice_id", "invoice_date",
                F.when(F.col("units") > 0, fee).otherwise(F.lit(0.0)).alias("freight_per_unit"))
    )
    matched = match_ledger(join_on_key(items, per_unit, ["invoice_id"], "inner", measure), ledger, items if source is None else source)
    error = (
        F.when(F.col("match") != "ok", None)
        .when(F.col("quantity") <= 0, F.concat(F.lit("Invalid quantity for "), "sku"))
        .when(F.col("unit_price") < 0, F.concat(F.lit("Invalid unit price for "), "sku"))
    )
    return (
        matched.withColumn("landed_price", F.col("unit_price") + F.col("freight_per_unit"))
        .withColumn("error", error)
        .withColumn("outcome", F.when(F.col("error").isNotNull(), "error").otherwise(F.col("match")))
    )


def register_shift(checked: DataFrame, stock: DataFrame | None = None) -> DataFrame:
    """New register values of every good line, all read from the same old row.

    J takes the old K when K is filled, K the landed price, I the quantity; H is
    the stock of ``stock`` (sku_internal, on_hand; missing means 0) or, without a
    stock source, the old I when filled, else the old H.
    """
    good = checked.filter("outcome = 'ok'")
    if stock is None:
        qty_prev = F.coalesce("row.qty_in", "row.qty_prev", F.lit(0.0))
    else:
        on_hand = stock.groupBy(F.col("sku_internal").alias("_stock_sku")).agg(
            F.min_by("on_hand", "variant").alias("on_hand"))
        good = join_on_key(good.withColumn("_stock_sku", F.col("row.sku_internal")), on_hand, ["_stock_sku"])
        qty_prev = F.coalesce(F.col("on_hand").cast("double"), F.lit(0.0))
    shifted = good.withColumn("qty_prev", qty_prev).withColumns({
        "row_index": F.col("row.row_index"),
        "price_prev": F.coalesce("row.price_new", "row.price_prev"),
        "qty_in": F.col("quantity"),
        "price_new": F.col("landed_price"),
    })
    price = first_truthy(F.col("price_new"), F.col("unit_price"))
    return shifted.withColumn(
        "cmp", finite(cmp_value(F.col("qty_prev"), F.col("price_prev"), F.col("qty_in"), price)))


def last_line_wins(shifted: DataFrame, item_order: list[str]) -> DataFrame:
    """One update per invoice and ledger row: the invoice's last line for it."""
    cols = [c for c in ("sku", "qty_prev", "qty_in", "price_prev", "price_new", "freight_per_unit", "cmp")
            if c in shifted.columns]
    return (
        shifted.groupBy("invoice_id", "invoice_date", "row_index")
        .agg(F.max_by(F.struct(*cols), F.struct(*item_order)).alias("u"), F.count(F.lit(1)).alias("lines"))
        .select("invoice_id", "invoice_date", "row_index", "u.*", "lines")
    )


ARRIVAL_ORDER = ["invoice_date", "invoice_id"]


def arrivals(items, invoices, ledger, item_order) -> DataFrame:
    """Per ledger row and invoice: quantity and landed price of the winning line,
    plus the register values the row started with."""
    good = checked_items(items, invoices, ledger).filter("outcome = 'ok'")
    start = F.struct(
        F.coalesce("row.qty_in", "row.qty_prev", F.lit(0.0)).alias("qty"),
        F.coalesce("row.price_new", "row.price_prev").alias("price"),
    )
    line = F.struct("quantity", "landed_price", start.alias("start"))
    return (
        good.groupBy(F.col("row.row_index").alias("row_index"), "invoice_date", "invoice_id")
        .agg(F.max_by(line, F.struct(*item_order)).alias("l"))
        .select("row_index", "invoice_date", "invoice_id", F.col("l.quantity").alias("qty_in"),
                F.col("l.landed_price").alias("price_new"), "l.start")
    )


def _register_columns(history: DataFrame) -> DataFrame:
    known = F.col("before").isNotNull()
    qty_prev = F.when(known, F.col("before.qty")).otherwise(F.col("start.qty"))
    price_prev = F.when(known, F.col("before.price")).otherwise(F.col("start.price"))
    return history.select(
        "row_index", "invoice_date", "invoice_id",
        qty_prev.alias("qty_prev"), "qty_in", price_prev.alias("price_prev"), "price_new",
        cmp_value(qty_prev, price_prev, F.col("qty_in"), F.col("price_new")).alias("cmp"))


def ledger_rows(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """``row_index`` of every item that the register names: one row may take the items
    of many SKUs, so groups are measured by row and not by SKU."""
    keys = ledger_keys(ledger.select("row_index", "supplier_skus")).filter("hits = 1").select("match_sku", F.col("row.row_index").alias("row_index"))
    return items.select(normalize_sku(F.col("sku")).alias("match_sku")).join(keys, "match_sku").select("row_index")


def cmp_history(items, invoices, ledger, item_order, max_rows=None) -> DataFrame:
    """Register row after every arrival.  One arrival only needs the one before
    it, so the history is a lag, not a recursion."""
    seq = OrderedGroups(arrivals(items, invoices, ledger, item_order), ["row_index"], ARRIVAL_ORDER,
                        max_rows, measure=lambda share: ledger_rows(items.sample(share, seed=11) if share < 1 else items, ledger))
    state = F.struct(F.col("qty_in").alias("qty"), F.col("price_new").alias("price"))
    return _register_columns(seq.with_columns(before=Lag(state)))


def current_cmp(items, invoices, ledger, item_order) -> DataFrame:
    """Register row after the latest arrival.

    Only the last two arrivals of a row matter.  Ranking is cut to two rows per
    task before the shuffle, so even a product that fills most of the data sends
    two rows per task.
    """
    newest = Window.partitionBy("row_index").orderBy(*[F.col(c).desc() for c in ARRIVAL_ORDER])
    last_two = (
        arrivals(items, invoices, ledger, item_order)
        .withColumn("age", F.row_number().over(newest))
        .filter("age <= 2")
    )
    state = F.struct(F.col("qty_in").alias("qty"), F.col("price_new").alias("price"))
    return _register_columns(
        last_two.withColumn("before", F.lead(state).over(newest)).filter("age = 1"))


def perpetual_average(purchases: DataFrame, key: str, order: list[str], max_rows=None,
                      measure=None) -> DataFrame:
    """Average cost after each purchase when nothing leaves stock: the running
    value over the running quantity.  Needs ``quantity`` and ``landed_price``."""
    value = (F.col("quantity") * F.col("landed_price")).cast(PRECISE)
    seq = OrderedGroups(purchases, [key], order, max_rows, measure)
    out = seq.with_columns(
        stock_qty=RunningSum(F.col("quantity")), stock_value=RunningSum(value))
    return out.withColumn(
        "average_cost", F.col("stock_value").cast("double") / F.col("stock_qty"))


def average_with_sales(moves: DataFrame, key: str, order: list[str], max_rows=None, measure=None) -> DataFrame:
    """Average cost after each move when sales take stock out.

    ``moves`` has ``change`` (quantity in, or negative out) and ``price`` (null
    for sales).  A sale leaves the average alone; a purchase makes it
    ``keep * previous + add`` with ``keep = stock / (stock + in)``, where the
    stock before the move is a running sum.  Those steps are linear, so each run
    of rows folds to one (keep, add) pair and a long key can be folded in pieces:
    a row's average is ``keep * (average before its run) + add``.
    """
    bought = F.col("price").isNotNull()
    seq = OrderedGroups(moves, [key], order, max_rows, measure)
    steps = seq.with_columns(
        keep_run=True,
        stock_before=RunningSum(F.col("change"), inclusive=False),
        priced=RunningMax(F.when(bought, 1)),
    )
    held = F.greatest(F.col("stock_before").cast("double"), F.lit(0.0))
    after = held + F.col("change")
    steps = steps.withColumns({
        # A purchase that leaves nothing held changes nothing.
        "keep": F.when(bought & (after != 0), held / F.nullif(after, F.lit(0.0))).otherwise(F.lit(1.0)),
        "add": F.when(bought & (after != 0), F.col("change") * F.col("price") / F.nullif(after, F.lit(0.0))).otherwise(F.lit(0.0)),
    })
    longest = max(max_rows or max_group_rows(moves.sparkSession), 1024)
    folded = _fold(steps, seq.parts, order, "run_keep", "run_add", longest)
    before = F.lit(0.0)
    if seq.split:
        ends = folded.groupBy(key, RUN).agg(F.max_by(F.struct("run_keep", "run_add"), F.struct(*order)).alias("e"))
        ends = ends.select(key, RUN, F.col("e.run_keep").alias("keep"), F.col("e.run_add").alias("add"))
        # One row per (key, run); a key meets at most every run, in order.
        ended = _fold(ends, [key], [RUN], "_keep", "_add", longest)
        before_run = F.lag("_add").over(Window.partitionBy(key).orderBy(RUN))
        folded = join_on_key(folded, ended.select(key, RUN, before_run.alias("before")), [key, RUN])
        before = F.coalesce("before", F.lit(0.0))
    value = F.col("run_keep") * before + F.col("run_add")
    return folded.select(*moves.columns, "stock_before",
                         F.when(F.col("priced") == 1, value).alias("average_cost"))


def _fold(steps: DataFrame, parts: list[str], order: list[str], keep_name: str, add_name: str, longest: int) -> DataFrame:
    """Running composition of the (keep, add) steps, started over for every group.

    A parallel prefix: composing linear maps is associative, so after round r every
    row holds the composition of the last 4 ** r steps, made of its own and three
    others, 4 ** (r - 1) rows apart.  All rounds go over one sorting.  They reach four
    times over ``longest`` rows, the size at which groups are split; a group beyond
    their reach ends the query.
    """
    w = Window.partitionBy(*parts).orderBy(*order)
    rounds = math.ceil(math.log(4 * longest, 4))
    rows = steps.withColumns({keep_name: F.col("keep"), add_name: F.col("add")})
    for r in range(rounds):
        lags = [(F.lag(keep_name, i * 4 ** r, 1.0).over(w), F.lag(add_name, i * 4 ** r, 0.0).over(w)) for i in (1, 2, 3)]
        rows = rows.select("*", *[x.alias(f"_{name}{i}") for i, pair in enumerate(lags, 1) for name, x in zip(("k", "a"), pair)])
        k, a = ([F.col(own), *(F.col(f"_{name}{i}") for i in (1, 2, 3))] for own, name in ((keep_name, "k"), (add_name, "a")))
        rows = rows.withColumns({add_name: a[0] + k[0] * (a[1] + k[1] * (a[2] + k[2] * a[3])), keep_name: k[0] * k[1] * k[2] * k[3]})
        rows = rows.select(*steps.columns, keep_name, add_name)
    too_long = F.lag(F.lit(True), 4 ** rounds).over(w)
    rows = rows.withColumn("_far", too_long)
    checked = F.when(F.col("_far"), F.raise_error(F.lit("a group is longer than the rounds reach; set costloom.maxGroupRows higher"))).otherwise(F.col(add_name))
    return rows.withColumn(add_name, checked.cast("double")).drop("_far")


def cost_at_sale(sales: DataFrame, costs: DataFrame, key: str, time: str, max_rows=None, measure=None) -> DataFrame:
    """Each sale with the latest cost known at its time (as-of).

    ``costs`` has ``key``, ``time``, ``seq`` (orders costs of the same time) and
    ``cmp``.  Both sides go through one ordering of (time, costs before sales,
    seq), so there is no pairwise comparison and no per-sale search.
    """
    sale = F.struct(*sales.columns)
    rows = sales.select(key, time, F.lit(1).alias("kind"), F.col("sale_id").alias("seq"),
                        F.lit(None).cast("double").alias("known"), sale.alias("sale"))
    marks = costs.select(key, time, F.lit(0).alias("kind"), "seq", F.col("cmp").alias("known"))
    seq = OrderedGroups(rows.unionByName(marks, allowMissingColumns=True),
                        [key], [time, "kind", "seq"], max_rows, measure)
    out = seq.with_columns(cmp_at_sale=LastValue(F.col("known")))
    return out.filter("kind = 1").select("sale.*", "cmp_at_sale")


def margin_ranking(daily: DataFrame, max_rows=None) -> DataFrame:
    """Running margin of every product over time, and its place by total margin.

    ``daily``: product_id, moved_at, ``m`` (the day's margin).  Places are given over
    the distinct totals, one global order that is cut into runs when it is large.
    The days are used several times, so they are fixed first.
    """
    ensure_checkpoint_dir(daily.sparkSession)
    daily = daily.checkpoint()
    running = OrderedGroups(daily, ["product_id"], ["moved_at"], max_rows).with_columns(running=RunningSum(F.col("m")))
    totals = daily.groupBy("product_id").agg(F.round(F.sum("m").cast("double") + 1e-7, 2).alias("total"))
    ladder = totals.select("total").distinct().select("total", (-F.col("total")).alias("down"), F.lit(1).alias("all"))
    places = OrderedGroups(ladder, ["all"], ["down"], max_rows).with_columns(place=RunningSum(F.lit(1).cast("long")))
    placed = totals.join(places.select("total", "place"), "total").select("product_id", "place")
    return join_on_key(running, placed, ["product_id"], "inner", measure=daily.select("product_id"))
