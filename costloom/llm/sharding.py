"""Shards of nearly equal bytes by histogram sort.

Documents are sorted by a 64-bit key and cut into shards where the bytes below
reach each multiple of a shard's share.  The key's upper 31 bits come from the text
and its lower 32 from doc_id: equal texts lie side by side, in one shard where
they fit, and a group of copies too large for one shard can still be cut.

The cuts are found by histogram sort.  Every task counts the exact bytes below the
candidate boundaries (probes) among its rows, Spark adds the counts up, and each
cut's interval shrinks to the two probes around it, until the bytes below a probe
are within the tolerance of what is wanted or the interval is a single key.  Only
counts go to the driver, at most ``PROBES`` + 1 for each cut.

Shards are made of cells of about ``cell_bytes``, cut in the same way, so that no
task ever holds a whole shard.  Rows are exchanged once, by cell; a row's slot is
its place in the cell after the rows of the cells before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import staged, table
from costloom.llm.registry import query

SHARDS = 40
OVERHEAD = 16           # bytes a row counts besides its text
CELL_BYTES = 8 << 20    # bytes of a cell, the unit of the exchange
PROBES = 15             # probes inside every open interval and round
TOLERANCE = 0.002       # of a cell: how far a cut may be from its place
LOW, HIGH = -(1 << 62), 1 << 62


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def sort_key(doc_id: Column, text: Column) -> Column:
    """31 bits of the text, then 32 of doc_id, as a long around zero."""
    by_text = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33)
    by_id = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit(""))), 32)
    return F.shiftleft(by_text - (1 << 30), 32).bitwiseOR(by_id)


def weigh(keys: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below every bound; ``keys`` has ``key`` and ``size``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(bounds) + 1, dtype=np.int64), np.zeros(len(bounds) + 1, dtype=np.int64)
        for batch in batches:
            slot = np.searchsorted(bounds, batch["key"].to_numpy(), side="right")
            np.add.at(size, slot, batch["size"].to_numpy())
            rows += np.bincount(slot, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"slot": at, "size": size[at], "rows": rows[at]})

    counted = keys.mapInPandas(count, "slot long, size long, rows long").groupBy("slot").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    size, rows = np.zeros(len(bounds) + 1, dtype=np.int64), np.zeros(len(bounds) + 1, dtype=np.int64)
    for r in counted.collect():
        size[r.slot], rows[r.slot] = r.size, r.rows
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def find_cuts(keys: DataFrame, wanted: np.ndarray, tolerance: float, probes: int = PROBES) -> np.ndarray:
    """For every wanted number of bytes a key with about that many bytes below it.

    ``wanted`` rises.  Of a cut's probes the nearest to its place wins, and equal
    ones the lowest; where one key holds more than the tolerance, the cut lies
    before or after it, whichever is nearer.
    """
    low, high = np.full(len(wanted), LOW, dtype=object), np.full(len(wanted), HIGH, dtype=object)
    best = np.full(len(wanted), LOW, dtype=object)
    off = np.array(wanted, dtype=np.float64)  # nothing lies below the lowest key
    is_open = off > tolerance
    while is_open.any():
        bounds = sorted({int(lo + (hi - lo) * k // (probes + 1)) for lo, hi in {*zip(low[is_open], high[is_open])} for k in range(1, probes + 1)}
                        | {int(hi) for hi in high[is_open]})
        below, _ = weigh(keys, np.array(bounds, dtype=np.int64))
        for i in np.flatnonzero(is_open):
            a, b = np.searchsorted(bounds, int(low[i]), side="right"), np.searchsorted(bounds, int(high[i]), side="right")
            own = below[a:b]
            k = int(np.searchsorted(own, wanted[i]))
            for j in (k - 1, k):
                if 0 <= j < len(own) and abs(own[j] - wanted[i]) < off[i]:
                    best[i], off[i] = bounds[a + j], abs(own[j] - wanted[i])
            new_low = bounds[a + k - 1] if k > 0 else low[i]
            new_high = bounds[a + k] if k < len(own) else high[i]
            low[i], high[i] = new_low, new_high
            is_open[i] = off[i] > tolerance and high[i] - low[i] > 1
    return np.array(best, dtype=np.int64)


def longs(values) -> Column:
    """A constant array of longs, however many, as one literal."""
    return F.split(F.lit(",".join(str(int(x)) for x in values)), ",").cast("array<bigint>")


def cell_of(key: str, bounds: np.ndarray) -> Column:
    """Number of bounds at or below ``key``, by halving."""
    if not len(bounds):
        return F.lit(0)
    listed = longs(bounds)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(listed, at + step - 1) <= F.col(key), F.lit(False)), at + step).otherwise(at))


def shard(docs: DataFrame, shards: int = SHARDS, cell_bytes: int = CELL_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of ``docs``, all columns, with ``shard`` and ``slot``.

    Shards hold nearly the same bytes (UTF-8 bytes of the text plus 16 a row, a null
    text has none); slots count from 0 without a gap, in order of the key, then
    doc_id, then text (nulls first).  Rows equal in doc_id and text have one key
    and stay together.  Columns of ``docs`` called ``shard`` or ``slot`` are replaced.
    No rows give no rows.
    """
    text = F.col("text").cast("string")
    docs = docs.drop("shard", "slot")
    keyed = docs.withColumn("_costloom_key", sort_key(F.col("doc_id"), text))
    keys = staged(keyed.select(F.col("_costloom_key").alias("key"), size_of(text).alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    cells = max(1, -(-total // (shards * cell_bytes)))  # cells in a shard
    wanted = np.arange(1, shards * cells) * (total / (shards * cells))
    bounds = find_cuts(keys, wanted, tolerance * total / (shards * cells))
    _, rows_below = weigh(keys, np.unique(bounds))
    below = dict(zip(np.unique(bounds).tolist(), rows_below.tolist()))
    starts = [0, *[below[int(b)] for b in bounds]]  # rows before each cell
    cell = cell_of("_costloom_key", bounds)
    # A cell's place in its shard: its rows' slots go on where the cell before ends.
    offset = F.get(longs(starts[c] - starts[c - c % cells] for c in range(shards * cells)), F.col("_costloom_cell"))
    order = Window.partitionBy("_costloom_cell").orderBy("_costloom_key", "doc_id", "text")
    placed = keyed.withColumn("_costloom_cell", cell).withColumn("slot", F.row_number().over(order) - 1 + offset)
    placed = placed.withColumn("shard", F.expr(f"_costloom_cell div {cells}").cast("int"))
    return placed.select(*docs.columns, "shard", "slot")


@query("op5_shard_documents")
def op5_shard_documents(spark, sf_dir):
    """Shard and slot of every document, bytes shared out evenly."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
