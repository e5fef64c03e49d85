"""Looking along a document's lines: below, ahead, until a stop line.

A document's lines come out of one row's text, so their groups are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.text import split_sku
from costloom.operators.ordered import Lead, NextValue, OrderedGroups, RunningMax, RunningSum


def ordered_lines(lines: DataFrame) -> OrderedGroups:
    return OrderedGroups(lines, ["doc_id"], ["line_no"], bounded=True)


def with_lines_below(lines: DataFrame, count: int) -> DataFrame:
    """Lines with the texts of the next ``count`` lines as ``below_1``, ``below_2``, ..."""
    seq = ordered_lines(lines)
    out, source = lines, "text"
    for i in range(1, count + 1):
        out = seq.resume(out).with_columns(keep_run=i < count, **{f"below_{i}": Lead(F.col(source))})
        source = f"below_{i}"
    return out


def with_next_appended(lines: DataFrame, marked: Column) -> DataFrame:
    """``description``: the line's text, with the next line's (``below_1``) where that is ``marked``."""
    below = with_lines_below(lines, 1)
    return below.withColumn("description", F.when(marked, F.concat_ws(" ", "text", "below_1")).otherwise(F.col("text")))


def with_qualifying_below(lines: DataFrame, good: Column, reach: int = 9) -> DataFrame:
    """``description``: up to two ``good`` lines among the ``reach`` below, joined.

    Each line keeps the next good one, and that one the next after it; nothing is
    listed per line.
    """
    seq = ordered_lines(lines.withColumn("_good", good))
    one = seq.with_columns(keep_run=True, _next=NextValue(F.when(F.col("_good"), F.struct("line_no", "text"))))
    both = F.struct("line_no", "text", F.col("_next").alias("after"))
    two = seq.resume(one).with_columns(_pair=NextValue(F.when(F.col("_good"), both)))
    last = F.col("line_no") + reach
    near = F.col("_pair.line_no") <= last
    first = F.when(near, F.col("_pair.text"))
    second = F.when(near & (F.col("_pair.after.line_no") <= last), F.col("_pair.after.text"))
    return two.withColumn("description", F.concat_ws(" ", first, second)).drop("_good", "_next", "_pair")


def continued_items(lines: DataFrame) -> DataFrame:
    """Items with the lines that continue them: ``doc_id``, ``item``, ``description``, ``lines``.

    Needs ``starts`` (a line opens an item), ``stops`` (it ends one unless it opens the
    next) and ``words`` (what the line adds).  The lines of one item are part of one text.
    """
    rows = ordered_lines(lines).with_columns(item=RunningSum(F.col("starts").cast("long")))
    stop = F.when(F.col("stops") & ~F.col("starts"), 1)
    inside = OrderedGroups(rows.filter("item > 0"), ["doc_id", "item"], ["line_no"], bounded=True).with_columns(stopped=RunningMax(stop))
    parts = F.sort_array(F.collect_list(F.when(F.col("words") != "", F.struct("line_no", "words"))))
    return inside.filter("stopped is null").groupBy("doc_id", "item").agg(
        F.nullif(F.array_join(F.transform(parts, lambda p: p["words"]), " "), F.lit("")).alias("description"),
        F.count(F.lit(1)).alias("lines"))


def split_codes(lines: DataFrame, mark: str = "SKU:") -> DataFrame:
    """Codes put together from the end of a marked line and the start of the next two."""
    below = with_lines_below(lines, 2)
    return below.filter(F.contains("text", F.lit(mark))).select("doc_id", *split_sku("text", "below_1", "below_2"))
