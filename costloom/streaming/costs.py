"""Sales and purchases as streams: cost at sale, running cost, margin alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.operators.allocate import PRECISE, margin_percent
from costloom.operators.keyed import join_on_key
from costloom.streaming.tables import COMPACT_EVERY, compact, drain, write_batch


def sales_with_snapshot(sales: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Sales with the cost of a snapshot (one row per product: product_id, cmp) and the margin."""
    costs = snapshot.select("product_id", F.col("cmp").alias("cmp_at_sale"))
    joined = join_on_key(sales, costs, ["product_id"])
    return joined.withColumn("margin_pct", margin_percent(F.col("unit_price"), F.col("cmp_at_sale")))


def store_sales(sales: DataFrame, snapshot: str, folder: str) -> None:
    """Sales with the stored snapshot table at a path, which every micro-batch reads
    anew: a new snapshot is picked up by the next one."""

    def handle(batch: DataFrame, n: int) -> None:
        stored = batch.sparkSession.read.parquet(snapshot)
        write_batch(sales_with_snapshot(batch, stored), f"{folder}/sales", n)

    drain(sales, handle, folder)


def running_cost(purchases: DataFrame) -> DataFrame:
    """Quantity, value and average cost per product over all purchases so far.

    Sums are all the state there is, they combine before the shuffle, and a
    product that fills most of the stream still is one row per task.
    """
    value = (F.col("quantity") * F.col("unit_price")).cast(PRECISE)
    return purchases.groupBy("product_id").agg(
        F.sum("quantity").alias("stock_qty"), F.sum(value).alias("stock_value")).withColumn(
        "average_cost", F.col("stock_value").cast("double") / F.col("stock_qty"))


COST_SCHEMA = "product_id long, stock_qty double, stock_value decimal(38,8), average_cost double"


def store_running_cost(purchases: DataFrame, folder: str) -> None:
    """Products whose cost changed, batch by batch (``tables.latest_rows``)."""

    def handle(batch: DataFrame, n: int) -> None:
        write_batch(batch, f"{folder}/costs", n)
        if n and n % COMPACT_EVERY == 0:
            compact(batch.sparkSession, f"{folder}/costs", "product_id", n, COST_SCHEMA)

    drain(running_cost(purchases), handle, folder, "update")


def margin_alerts(sales: DataFrame, threshold: int = 3, length: str = "24 hours", slide: str = "1 hour",
                  lateness: str = "1 hour") -> DataFrame:
    """Windows in which more than ``threshold`` different products sold at a loss.

    Products are made distinct per window first (state: one row per window and
    product, whatever the number of sales) and then counted.  A window is
    reported once the watermark has passed its end.
    """
    losses = sales.filter("margin_pct < 0").withWatermark("sold_at", lateness)
    products = losses.groupBy(F.window("sold_at", length, slide), "product_id").agg(F.count(F.lit(1)).alias("sales"))
    windows = products.groupBy("window").agg(
        F.count(F.lit(1)).alias("products"), F.sum("sales").alias("sales"))
    return windows.filter(F.col("products") > threshold).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "products", "sales")


def store_alerts(sales: DataFrame, folder: str, **options) -> None:
    drain(margin_alerts(sales, **options), lambda batch, n: write_batch(batch, f"{folder}/alerts", n), folder)
