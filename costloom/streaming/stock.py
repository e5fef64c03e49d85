"""Average cost of what is on stock, kept per product by a stream of purchases and sales.

The average depends on the order of a product's moves, and moves may arrive out of
order.  The state holds, per product, what is settled (stock, average, time of the last
settled move) and the moves that the watermark has not passed yet; products share the
state of a bucket.  A move is settled once no earlier one can come: when the bucket's next
rows arrive, or when its timer fires.  Every change gives the product's row as of now, its waiting moves included, so
the latest row is right at any time and final once nothing waits.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from costloom.streaming.tables import COMPACT_EVERY, compact, run_batches, write_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AVERAGE_SCHEMA = "product_id long, stock double, average_cost double, last_move timestamp, waiting long"


def fold(stock: float, average: float | None, moves: list[tuple]) -> tuple[float, float | None]:
    """Stock and average after ``moves`` in order; the last two values of a move are its
    change of stock and its price (none for a sale).

    A sale leaves the average alone.  A purchase averages what is held (nothing, if the
    stock is negative) with what comes; one that leaves nothing held changes nothing, and
    neither does a move without a change.
    """
    for *_, change, price in moves:
        if change is None:
            continue
        held = max(stock, 0.0)
        if price is not None and held + change != 0:
            average = (held * (average or 0.0) + change * price) / (held + change)
        stock += change
    return stock, average


# Products share a state key, as a call for every product would cost far more than its moves.
BUCKETS = 4096


def plain(column: pd.Series, whole: bool = False) -> list:
    """Values of a column as Python ones, null as None; whole numbers that a null turned
    into floats are whole again."""
    if not column.hasnans:
        return column.tolist()
    return [None if x != x else int(x) if whole else x for x in column.tolist()]


def in_order(moves: list[tuple], n: int) -> None:
    """Sort by the first ``n`` values, nulls last: a move without a time is never settled."""
    try:
        moves.sort(key=lambda m: m[:n])
    except TypeError:
        moves.sort(key=lambda m: [(x is None, x) for x in m[:n]])


class StockAverage(StatefulProcessor):
    """Keeps ``fold`` of the moves of a bucket's products; ``order`` names the columns that
    order a product's moves, the time first, with their types.

    The state of a bucket is one value of arrays: what is settled by product, the moves
    that wait, and the next timer.
    """

    def __init__(self, order: dict[str, str]):
        self.order = list(order)
        self.whole = [kind in ("tinyint", "smallint", "int", "bigint") for kind in order.values()]
        kinds = ["bigint", *order.values(), "double", "double"]
        self.schema = ("timer_ms long, product array<bigint>, stock array<double>, average array<double>, last_us array<bigint>, "
                       + ", ".join(f"wait_{i} array<{kind}>" for i, kind in enumerate(kinds)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for batch in rows:
            new += zip(plain(batch["product_id"], True), *map(plain, (batch[c] for c in self.order), self.whole),
                       plain(batch["change"]), plain(batch["price"]))
        yield self._advanced(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._advanced([], timerValues)

    def _advanced(self, new, timers):
        """Settle what the watermark has passed; rows of the products that changed."""
        n = len(self.order)
        timer, products, stocks, averages, lasts, *waiting = self.state.get() or (None, *[()] * (n + 7))
        settled = {p: s for p, *s in zip(products, stocks, averages, lasts)}
        moves = {}
        for p, *move in [*zip(*waiting), *new]:
            moves.setdefault(p, []).append(tuple(move))
        arrived = {m[0] for m in new}
        now_ms = timers.getCurrentWatermarkInMs()
        rest, out, due = [], [], []
        for p, own in moves.items():
            in_order(own, n)
            ready = sum(1 for m in own if m[0] is not None and m[0] < now_ms * 1000)
            stock, average, last = settled.get(p, (0.0, None, None))
            stock, average = fold(stock, average, own[:ready])
            last = own[ready - 1][0] if ready else last
            settled[p] = (stock, average, last)
            left = own[ready:]
            rest += [(p, *m) for m in left]
            times = [m[0] for m in left if m[0] is not None]
            if times:
                due.append(times[-1] // 1000 + 1)
            if ready or p in arrived:
                stock, average = fold(stock, average, left)
                out.append((p, stock, average, times[-1] if times else last, len(left)))
        if due and (timer is None or timer <= now_ms or min(due) < timer):
            timer = min(due)
            self.handle.registerTimer(timer)
        columns = map(list, zip(*rest)) if rest else [[]] * (n + 3)
        self.state.update((timer, list(settled), *map(list, zip(*settled.values())), *columns))
        ids, stocks, averages, lasts, counts = zip(*out) if out else [()] * 5
        return pd.DataFrame({"product_id": pd.array(ids, dtype="Int64"), "stock": pd.array(stocks, dtype="Float64"),
                             "average_cost": pd.array(averages, dtype="Float64"), "last_move": pd.to_datetime(pd.Series(lasts, dtype="Int64"), unit="us"),
                             "waiting": pd.array(counts, dtype="Int64")})

    def close(self) -> None:
        pass


def average_cost(moves: DataFrame, order: list[str], lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """Product rows (``AVERAGE_SCHEMA``) whose average or stock changed.

    ``moves`` streams product_id, the ``order`` columns (a timestamp first; together
    they identify a product's move), ``change`` (quantity in, or negative out) and
    ``price`` (null for sales).  Moves later than ``lateness`` behind the newest one are
    left out, as by any watermark.  Products are dealt to ``buckets``, each with one state;
    a micro-batch should bring a bucket no more moves than one task can sort.
    """
    kinds = dict(moves.dtypes)
    at = order[0]
    names = [f"{at}_us", *order[1:]]
    timed = moves.withWatermark(at, lateness).withColumn(f"{at}_us", F.unix_micros(at))
    bucket = F.pmod(F.xxhash64("product_id"), F.lit(buckets)).alias("bucket")
    keyed = timed.select(bucket, F.col("product_id").cast("long").alias("product_id"), at, *names,
                         F.col("change").cast("double").alias("change"), F.col("price").cast("double").alias("price"))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        StockAverage({n: kinds.get(n, "bigint") for n in names}), AVERAGE_SCHEMA, outputMode="Update", timeMode="EventTime")


def store_average_cost(moves: DataFrame, order: list[str], folder: str, lateness: str = "1 day",
                       handle: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> None:
    """Drain ``moves`` into the table ``averages`` of ``folder`` (``tables.latest_rows``).

    State and progress lie in ``folder``, so a run that follows, after a stop or a
    failure, goes on where the last whole batch ended.  A folder keeps its number of ``buckets``.
    """
    def store(batch: DataFrame, n: int) -> None:
        if handle:
            handle(batch, n)
        write_batch(batch, f"{folder}/averages", n)
        if n and n % COMPACT_EVERY == 0:
            compact(batch.sparkSession, f"{folder}/averages", "product_id", n, AVERAGE_SCHEMA)

    with_rocksdb(moves.sparkSession, lambda: run_batches(average_cost(moves, order, lateness, buckets), store, folder, "update")).awaitTermination()


def with_rocksdb(spark: SparkSession, start: Callable):
    """Start a stream whose state has several columns a key; it copies the session's
    settings as it starts, so the session keeps its own."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before)
