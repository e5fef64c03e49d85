"""Positioned text: visual lines, rows and columns, neighbours, best number triples.

Tokens are rows (doc_id, page, n, x, y, text) with y growing downwards and ``n``
numbering the tokens of a document.  Lists are only ever collected for one visual
line or the heights of one page.  ``bounded`` says that a document's tokens or
lines come out of one row's text, so no hot documents need to be looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.functions.falsy import let
from costloom.operators.keyed import Keys, hot_list, join_on_key
from costloom.operators.ordered import Lag, LastValue, Lead, NextValue, OrderedGroups, RunningSum
from costloom.session import max_group_rows

PAGE = ["doc_id", "page"]


def _joined(tokens: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """Texts of each group from left to right."""
    line = F.sort_array(F.collect_list(F.struct("x", "n", "text")))
    return tokens.groupBy(*keys).agg(
        F.trim(F.array_join(F.transform(line, lambda t: t["text"]), sep)).alias("text"))


def text_lines(tokens: DataFrame, step: float = 0.5) -> DataFrame:
    """Lines of text: tokens whose y rounds to the same multiple of ``step``."""
    y = F.floor(F.col("y") / step + 0.5) * step
    return _joined(tokens.withColumn("line_y", y), [*PAGE, "line_y"], " ").filter("text <> ''")


def rows_by_gap(tokens: DataFrame, gap: float = 5.0, max_rows: int | None = None,
                measure: Keys | None = None, bounded: bool = False) -> DataFrame:
    """Tokens with ``row``: a new row starts more than ``gap`` below the *previous* token."""
    seq = OrderedGroups(tokens, PAGE, ["y", "x", "n"], max_rows, measure, bounded)
    above = seq.with_columns(keep_run=True, _above=Lag(F.col("y")))
    new = F.when(F.col("_above").isNull() | (F.col("y") - F.col("_above") > gap), 1).otherwise(0)
    return seq.resume(above.withColumn("_new", new.cast("long"))).with_columns(
        row=RunningSum(F.col("_new"))).drop("_above", "_new")


def rows_by_anchor(tokens: DataFrame, gap: float = 5.0, bounded: bool = False) -> DataFrame:
    """Tokens with ``row``: a new row starts more than ``gap`` below the *first*
    token of the current row.

    Which heights start a row depends on one another, so the distinct heights of
    a page (not its tokens) are folded in order; a token's row is the number of
    starting heights at or above it.
    """
    def tops(ys: Column) -> Column:
        return F.aggregate(F.array_sort(F.array_distinct(ys)), F.array().cast("array<double>"), lambda acc, y: F.when(
            (F.size(acc) == 0) | (y - F.try_element_at(acc, F.lit(-1)) > gap), F.array_append(acc, y)).otherwise(acc))

    def row_of(y: Column, starts: Column) -> Column:
        return F.size(F.filter(starts, lambda top: top <= y)).cast("long").alias("row")

    if bounded:  # a page is part of one text: its tokens get their rows without a join
        rest = [c for c in tokens.columns if c not in PAGE]
        # A null key meets no page.
        known = tokens.filter(" and ".join(f"{k} is not null" for k in (*PAGE, "y")))
        pages = known.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("_tokens"))
        rows = let(tops(F.transform("_tokens", lambda t: t["y"])), lambda starts: F.transform(
            "_tokens", lambda t: F.struct(*[t[c].alias(c) for c in rest], row_of(t["y"], starts))))
        return pages.select(*PAGE, F.inline(rows)).select(*PAGE, "y", *[c for c in rest if c != "y"], "row")
    # One row per height of a page; tokens find theirs by an equi-join on the height.
    heights = tokens.select(*PAGE, "y").distinct().groupBy(*PAGE).agg(F.collect_list("y").alias("ys"))
    placed = heights.select(*PAGE, F.inline(let(tops(F.col("ys")), lambda starts: F.transform(
        "ys", lambda y: F.struct(y.alias("y"), row_of(y, starts))))))
    return join_on_key(tokens, placed, [*PAGE, "y"], "inner")


def row_cells(rows: DataFrame) -> DataFrame:
    return _joined(rows, [*PAGE, "row"], "|")


def columns_of(tokens: DataFrame, gap: float = 10.0, max_rows: int | None = None,
               measure: Keys | None = None, bounded: bool = False) -> DataFrame:
    """Columns of a document: distinct x values chained while closer than ``gap``;
    the centre is their mean and the place on the page tells what a column holds."""
    xs = tokens.select("doc_id", "x").distinct()
    seq = OrderedGroups(xs, ["doc_id"], ["x"], max_rows, measure, bounded)
    left = seq.with_columns(keep_run=True, _left=Lag(F.col("x")))
    new = F.when(F.col("_left").isNull() | (F.col("x") - F.col("_left") >= gap), 1).otherwise(0)
    numbered = seq.resume(left.withColumn("_new", new.cast("long"))).with_columns(col=RunningSum(F.col("_new")))
    centre = F.col("centre")
    kind = (F.when(centre < 100, "description").when((centre > 250) & (centre < 330), "quantity")
            .when((centre > 330) & (centre < 400), "unit_price").when(centre > 450, "total"))
    return numbered.groupBy("doc_id", (F.col("col") - 1).cast("int").alias("col")).agg(
        F.avg("x").alias("centre")).withColumn("kind", kind)


def nearest_column(tokens: DataFrame, columns: DataFrame, reach: float = 50.0, bounded: bool = False) -> DataFrame:
    """Tokens with the column whose centre is nearest (the first on a tie), null
    when none is closer than ``reach``.  A document's columns are at least a gap
    apart, so they are few and travel as one small array per document."""
    centres = columns.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("col", "centre"))).alias("_centres"))
    ranked = F.transform("_centres", lambda c: F.struct(
        F.abs(F.col("x") - c["centre"]).alias("dist"), c["col"].alias("col")))
    best = let(F.array_min(ranked), lambda b: F.when(b["dist"] < reach, b["col"]))
    joined = tokens.join(centres, ["doc_id"], "left") if bounded else join_on_key(tokens, centres, ["doc_id"])
    return joined.withColumn("col", best).drop("_centres")


def fill_from_below(rows: DataFrame, values: list[str], reach: float = 30.0, max_rows: int | None = None,
                    measure: Keys | None = None) -> DataFrame:
    """Missing values of a row taken from the next two rows, if within ``reach``.

    ``rows``: doc_id, page, y (one row per height) and the value columns.
    """
    seq = OrderedGroups(rows, PAGE, ["y"], max_rows, measure)
    one = seq.with_columns(keep_run=True, _b1=Lead(F.struct("y", *values)))
    two = seq.resume(one).with_columns(_b2=Lead(F.col("_b1")))
    near = lambda b, v: F.when(F.col(f"{b}.y") - F.col("y") < reach, F.col(f"{b}.{v}"))
    return two.withColumns({v: F.coalesce(F.col(v), near("_b1", v), near("_b2", v)) for v in values}).drop("_b1", "_b2")


def spans(lines: DataFrame, is_anchor: Column, reach: int = 50, max_rows: int | None = None, bounded: bool = False) -> DataFrame:
    """Anchors with the lines they own: up to the next anchor, and ``reach`` lines
    (or the end of the document) after the last one."""
    marked = lines.select("doc_id", "line_no", F.when(is_anchor, F.col("line_no")).alias("_anchor"))
    seq = OrderedGroups(marked, ["doc_id"], ["line_no"], max_rows, bounded=bounded)
    found = seq.with_columns(_next=NextValue(F.col("_anchor"))).filter("_anchor is not null")
    length = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("_n"))
    end = F.coalesce("_next", F.least(F.col("line_no") + reach, F.col("_n")))
    joined = found.join(length, ["doc_id"], "left") if bounded else join_on_key(found, length, ["doc_id"])
    return joined.select("doc_id", F.col("line_no").alias("start"), end.alias("end"))


def nearest_code(lines: DataFrame, reach: int = 25, max_rows: int | None = None, bounded: bool = False) -> DataFrame:
    """Lines that need a code (``wanted``) with the best candidate near them.

    ``code`` / ``complete`` are the candidate of a line and whether it is whole.
    Whole codes win, then the nearer one, then the smaller text.  The best of a
    class is the last one before or the first one after the line, so nothing is
    joined; before reaches ``reach`` lines, after one line less.
    """
    whole = F.when(F.col("code").isNotNull() & F.col("complete"), F.struct("line_no", "code"))
    part = F.when(F.col("code").isNotNull() & ~F.col("complete"), F.struct("line_no", "code"))
    seq = OrderedGroups(lines, ["doc_id"], ["line_no"], max_rows, bounded=bounded)
    seen = seq.with_columns(
        _w0=LastValue(whole, inclusive=False), _w1=NextValue(whole),
        _p0=LastValue(part, inclusive=False), _p1=NextValue(part))

    def candidate(name: str, rank: int, limit: int) -> Column:
        c = F.col(name)
        dist = F.abs(c["line_no"] - F.col("line_no"))
        return F.when(dist <= limit, F.struct(F.lit(rank).alias("rank"), dist.alias("dist"), c["code"].alias("code")))

    best = F.array_min(F.array_compact(F.array(
        candidate("_w0", 0, reach), candidate("_w1", 0, reach - 1),
        candidate("_p0", 1, reach), candidate("_p1", 1, reach - 1))))
    return seen.filter("wanted").select("doc_id", "line_no", best["code"].alias("code"), best["dist"].cast("long").alias("dist"))


def typed_runs(tokens: DataFrame, max_rows: int | None = None,
               measure: Keys | None = None, tasks: int | None = None) -> DataFrame:
    """Rows out of a token stream "prices, then n integers, then n prices".

    ``tokens``: doc_id, n, text, is_price.  After n integers the next n prices are
    totals, prices beyond them are unit prices of the following group.  A group
    counts only when it has as many unit prices and totals as integers; the j-th
    of each belong together.  Tokens get their places in the order of their document, where
    they are; only documents too large for a task are joined to their groups, and ``tasks``
    says how many are to share the tokens then.
    """
    seq = OrderedGroups(tokens, ["doc_id"], ["n"], max_rows, measure)
    before = seq.with_columns(keep_run=True, _before=Lag(F.col("is_price")))
    new = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("is_price")), 1).otherwise(0)
    runs = seq.resume(before.withColumn("_new", new.cast("long"))).with_columns(
        run=RunningSum(F.col("_new")), at=RunningSum(F.lit(1).cast("long")))
    member = _members_by_join(runs, max_rows, measure, tasks) if seq.split else _members_in_order(runs)
    pick = lambda name: F.max(F.when(F.col("role") == name, F.col("text")))
    return member.filter((F.col("j") >= 0) & (F.col("j") < F.col("size"))).groupBy("doc_id", "grp", "j").agg(
        pick("unit").alias("unit_price"), pick("qty").alias("quantity"), pick("total").alias("total"))


def _fits(size: Column, before: Column, earlier: Column, after: Column) -> Column:
    """A run of ``size`` integers has as many unit prices and totals: ``before`` and ``after``
    are the sizes of the runs around it, ``earlier`` that of the integers before these."""
    return (before - F.least(before, F.coalesce(earlier, F.lit(0))) == size) & (F.least(after, size) == size)


def _members_in_order(runs: DataFrame) -> DataFrame:
    """Tokens (doc_id, run, at, text) with their place in a valid group.  A run knows those
    before it from their last tokens, and hears of the next one at its own last token."""
    order = Window.partitionBy("doc_id").orderBy("run", "n")
    run = Window.partitionBy("doc_id", "run").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    is_last = F.col("at") == F.col("first") + F.col("size") - 1

    def of_last(value: Column) -> Column:
        return F.last(F.when(is_last, value), ignorenulls=True).over(earlier)

    def heard(name: str) -> Column:
        return F.max(F.when(is_last, F.col(name))).over(run)

    sized = runs.filter("doc_id is not null").select("doc_id", "n", "run", "at", "text", *[
        f.over(run).alias(name) for name, f in (("size", F.count(F.lit(1))), ("first", F.min("at")), ("_price", F.first("is_price")))])
    counts = F.when(~F.col("_price"), F.col("size"))
    around = sized.select("*", of_last(F.col("size")).alias("_b"), of_last(counts).alias("_n0"), F.lead("size").over(order).alias("_next"))
    after = around.withColumn("_a", heard("_next"))
    # The size of a valid group, else null.
    valid = F.when(~F.col("_price") & _fits(F.col("size"), F.col("_b"), F.col("_n0"), F.col("_a")), F.col("size"))
    sizes = after.select("doc_id", "n", "run", "at", "text", "size", "first", valid.alias("_qty"))
    # 0 stands for a run that is no valid group, so that the runs before it are not taken for the last one.
    known = F.coalesce(F.col("_qty"), F.lit(0))
    told = sizes.select("*", of_last(known).alias("_total"), F.lead(known).over(order).alias("_next"))
    placed = told.withColumn("_unit", heard("_next"))
    start = {"unit": F.col("first") + F.col("size") - F.col("_unit"), "qty": F.col("first"), "total": F.col("first")}
    role = lambda name, step: F.struct(
        (F.col("run") + step).alias("grp"), (F.col("at") - start[name]).alias("j"), F.col(f"_{name}").alias("size"), F.lit(name).alias("role"))
    return placed.select("doc_id", "text", F.inline(F.array(role("unit", 1), role("qty", 0), role("total", -1))))


def _members_by_join(runs: DataFrame, max_rows: int | None, measure: Keys | None, tasks: int | None) -> DataFrame:
    """The same for documents that are larger than a task."""
    sizes = runs.groupBy("doc_id", "run").agg(
        F.first("is_price").alias("is_price"), F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    order = OrderedGroups(sizes, ["doc_id"], ["run"], max_rows, measure)
    around = order.with_columns(keep_run=True, _b=Lag(F.struct("size", "first")), _a=Lead(F.struct("size", "first")))
    earlier = order.resume(around).with_columns(_n0=LastValue(F.when(~F.col("is_price"), F.col("size")), inclusive=False))
    groups = earlier.filter("not is_price")
    valid = groups.filter(_fits(F.col("size"), F.col("_b.size"), F.col("_n0"), F.col("_a.size"))).select(
        "doc_id", F.col("run").alias("grp"), F.col("size"), F.col("first"),
        (F.col("_b.first") + F.col("_b.size") - F.col("size")).alias("unit_first"), F.col("_a.first").alias("total_first"))
    # Every token of a valid group knows its run; three runs lead to one group.
    role = lambda run, first, name: valid.select(
        "doc_id", F.col("grp"), (F.col("grp") + run).alias("run"), F.col(first).alias("_first"),
        F.col("size"), F.lit(name).alias("role"))
    roles = role(-1, "unit_first", "unit").unionByName(role(0, "first", "qty")).unionByName(role(1, "total_first", "total"))
    if tasks is not None:
        runs, roles = (x.repartition(tasks, "doc_id", "run") for x in (runs.select("doc_id", "run", "at", "text"), roles))
    return runs.join(roles, ["doc_id", "run"]).withColumn("j", F.col("at") - F.col("_first"))


def promotions(lines: DataFrame, max_rows: int | None = None,
               measure: Keys | None = None) -> DataFrame:
    """Item lines reduced by promotion lines among the next three.

    ``lines``: doc_id, line_no, text, reference, quantity, total (nulls on other
    lines).  A promotion line names the same reference and " - Promoción"; its
    first amount, if negative, lowers the quantity and its last one the total.
    """
    seq = OrderedGroups(lines, ["doc_id"], ["line_no"], max_rows, measure)
    one = seq.with_columns(keep_run=True, _t1=Lead(F.col("text")))
    two = seq.resume(one).with_columns(keep_run=True, _t2=Lead(F.col("_t1")))
    three = seq.resume(two).with_columns(_t3=Lead(F.col("_t2")))
    ahead = F.array("_t1", "_t2", "_t3")
    mine = F.filter(ahead, lambda t: F.contains(t, F.col("reference")) & F.contains(t, F.lit(" - Promoción")))
    numbers = F.filter(F.transform(mine, lambda t: F.transform(
        F.regexp_extract_all(t, F.lit(r"(-?\d+,\d{2})"), 1), lambda v: F.replace(v, F.lit(","), F.lit(".")).cast("double"))),
        lambda a: F.size(a) >= 2)
    cut = lambda at: F.aggregate(numbers, F.lit(0.0), lambda acc, a: acc - F.least(F.element_at(a, at), F.lit(0.0)))
    out = three.filter("reference is not null").withColumns({
        "quantity": F.col("quantity") - cut(1), "total": F.round(F.col("total") - cut(-1), 2)})
    return out.filter("quantity > 0 and total > 0").drop("_t1", "_t2", "_t3")


def best_triple_by_error(numbers: Column, max_quantity: float = 10_000.0) -> Column:
    """(quantity, unit price, total) among the numbers of one item whose product
    error is smallest; the first combination wins a tie.

    Quantity at least 1, unit price 0.5 to 50, relative error below 20 %.  Without
    such a combination the first rising three of the sorted numbers that are off by
    less than 30 %.  An item's numbers are a handful, so they are combined inside the row.
    """
    def near(share: float):
        return lambda err, t: err / F.greatest(t, F.lit(1.0)) < share

    every = _placed(numbers)
    best = _best(F.filter(every, lambda n: n["value"].between(1, max_quantity)), F.filter(every, lambda n: n["value"].between(0.5, 50)), every,
                 lambda i, j: i != j, lambda i, j, k: (k != i) & (k != j), near(0.2), lambda err, a, b, c: -err)
    ordered = _placed(F.array_sort(numbers))
    positive = F.filter(ordered, lambda n: n["value"] > 0)
    rising = _best(positive, positive, ordered, lambda i, j: i < j, lambda i, j, k: j < k, near(0.3), lambda err, a, b, c: F.lit(0.0))
    return F.coalesce(_triple(best), _triple(rising))


def best_triple_by_score(numbers: Column) -> Column:
    """The same choice by plausibility points; combinations off by more than 30 %
    do not compete.  ``numbers``: array of (value, kind, original, position) with
    kind quantity, price or number.

    A number may serve as quantity and as price; only unit price and total differ.
    Without any combination the first quantity and the first two prices are tried
    (``first_pair``).
    """
    def role(unfit: str, points) -> Column:
        fit = F.filter(F.transform(numbers, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda p: p["n"]["kind"] != unfit)
        return F.transform(fit, lambda p: F.struct(
            p["n"]["value"].alias("value"), p["n"]["position"].alias("position"), p["i"].alias("i"), points(p["n"]).alias("points")))

    best = _best(role("price", _quantity_points), role("quantity", _price_points), role("quantity", _total_points),
                 lambda i, j: F.lit(True), lambda i, j, k: k != j, lambda err, t: err / F.greatest(t, F.lit(1.0)) <= 0.3, _points)
    values = lambda kind: F.transform(F.filter(numbers, lambda n: n["kind"] == kind), lambda n: n["value"])
    return F.coalesce(_triple(best), first_pair(F.get(values("quantity"), 0), values("price")))


def _triple(best: Column) -> Column:
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(*[b[c].alias(c) for c in ("quantity", "unit_price", "total")])))


def _sum_of(signs: list[tuple[Column, int]]) -> Column:
    total = F.lit(0)
    for cond, points in signs:
        total = total + F.when(cond, points).otherwise(0)
    return total


def _band(value: Column, low: float, steps: list[tuple[float, int]], above: int, below: int) -> Column:
    """Points by range, upper bounds included, in order."""
    band = F.when(value < low, below)
    for top, points in steps:
        band = band.when(value <= top, points)
    return band.otherwise(above)


def _is(n: Column, kind: str) -> Column:
    return n["kind"] == kind


def _dotted(n: Column) -> Column:
    return F.contains(n["original"], F.lit("."))


# Points for each sign that speaks for or against a number in its place.
# A price is never tried as a quantity, so no points say so.
def _quantity_points(a: Column) -> Column:
    q = a["value"]
    return _sum_of([(_is(a, "quantity"), 500), ((q == 1.0) & _is(a, "number"), -600), (_is(a, "number") & ~_dotted(a), 200),
                    (_is(a, "number") & _dotted(a) & (q < 10), -800)]) + _band(q, 0.5, [(10, 200), (50, 150), (200, 100), (1000, 50)], 25, 0)


def _price_points(b: Column) -> Column:
    u = b["value"]
    return _sum_of([(_is(b, "price"), 800), (_is(b, "number") & _dotted(b), 300), (_is(b, "number") & (u < 2.0), -600)]) \
        + _band(u, 1.0, [(20, 150), (50, 100), (100, 50)], -50, -50)


def _total_points(c: Column) -> Column:
    t = c["value"]
    return _sum_of([(_is(c, "price"), 400), (_is(c, "number") & (t < 10.0), -400)]) + _band(t, 1.0, [(100, 150), (500, 100)], -50, -50)


def _points(err: Column, a: Column, b: Column, c: Column) -> Column:
    """Plausibility of a combination: what its numbers have by themselves, and together."""
    q, u, t = a["value"], b["value"], c["value"]
    together = _sum_of([(a["position"] < b["position"], 50), (a["position"] < c["position"], 50),
                        ((u >= t) & (q > 1), -1000), ((q <= u) & (u <= t), 100)])
    accuracy = F.when(err < 0.01, 1000.0).when(err < 0.1, 500.0).when(err < 1.0, 200.0).otherwise(err * -100)
    return accuracy + (a["points"] + b["points"] + c["points"] + together)


def _placed(numbers: Column) -> Column:
    return F.transform(numbers, lambda n, i: F.struct(n.alias("value"), i.alias("i")))


def _best(quantities: Column, prices: Column, totals: Column, pair, apart, near, score) -> Column:
    """Highest score over the choices of a quantity, a unit price and a total, the first of equals.

    The three lists hold what may stand in a place: ``value``, ``i`` (its place among the
    item's numbers) and what ``score`` reads.  ``pair`` and ``apart`` say which places go
    together; only totals ``near`` the product are scored.
    """
    def best_of(numbers: Column, one) -> Column:
        return F.array_max(F.transform(numbers, one))

    def scored(a: Column, b: Column, totals: Column) -> Column:
        def error(product: Column, c: Column) -> Column:
            return F.abs(product - c["value"])

        return let(a["value"] * b["value"], lambda product: best_of(
            F.filter(totals, lambda c: apart(a["i"], b["i"], c["i"]) & near(error(product, c), c["value"])),
            lambda c: F.struct(
                score(error(product, c), a, b, c).alias("score"), (-a["i"]).alias("i"), (-b["i"]).alias("j"), (-c["i"]).alias("k"),
                a["value"].alias("quantity"), b["value"].alias("unit_price"), c["value"].alias("total"))))

    lists = F.struct(quantities.alias("quantities"), prices.alias("prices"), totals.alias("totals"))
    return let(lists, lambda s: best_of(s["quantities"], lambda a: best_of(
        F.filter(s["prices"], lambda b: pair(a["i"], b["i"])), lambda b: scored(a, b, s["totals"]))))


def first_source(items: DataFrame, rank: str = "rank", measure: Keys | None = None, max_rows: int | None = None) -> DataFrame:
    """Per document only the rows of its best ranked source ("use B if A is empty").

    The rows of a document meet once, in one task; only with documents too large for
    that the best ranks are found first and joined to the rows.
    """
    limit = max_rows or max_group_rows(items.sparkSession)
    if hot_list(items.select("doc_id") if measure is None else measure, limit) is None:
        # A null document has no best; nothing is asked of its rows where they are made.
        best = F.when(F.col("doc_id").isNotNull(), F.min(rank).over(Window.partitionBy("doc_id")))
        ranked = items.withColumn("_best", best)
    else:
        best = items.groupBy("doc_id").agg(F.min(rank).alias("_best"))
        ranked = join_on_key(items, best, ["doc_id"], "inner", measure, max_rows)
    return ranked.filter(F.col(rank) == F.col("_best")).drop("_best")


def first_pair(quantity: Column, prices: Column, tolerance: float = 0.5) -> Column:
    """(quantity, unit price, total) when no scored triple was found: of the first
    two prices the smaller is the unit price; null when they are off by half."""
    a, b = F.try_element_at(prices, F.lit(1)), F.try_element_at(prices, F.lit(2))
    unit, total = F.least(a, b), F.greatest(a, b)
    fits = b.isNotNull() & (F.abs(quantity * unit - total) < total * tolerance)
    return F.when(fits, F.struct(quantity.alias("quantity"), unit.alias("unit_price"), total.alias("total")))
