"""The business tables of the engine, expressed over the driver's tables.

Every role is a plain projection (and in SQL a plain SELECT), so filters and
column choices reach the parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.sources.scan import spread


class Roles:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table for queries with much work per row."""
        return spread(self.table(name))

    @cached_property
    def items(self) -> DataFrame:
        """Invoice lines; ``ITEM_ORDER`` orders them totally inside an invoice."""
        return self.items_of(self.table("lineitem"))

    @cached_property
    def spread_items(self) -> DataFrame:
        return self.items_of(self.spread("lineitem"))

    def items_of(self, lineitem: DataFrame) -> DataFrame:
        part = F.col("l_partkey")
        return lineitem.select(
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_suppkey").alias("supplier_id"),
            part.alias("part_id"),
            F.col("l_linenumber").alias("line_no"),
            F.when(part % 7 == 0, F.concat(F.lit("x"), part))
            .when(part % 11 == 0, F.concat(F.lit("brand#"), part % 25 + 1))
            .otherwise(F.concat(F.lit(" p"), part))
            .alias("sku"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            F.col("l_extendedprice").alias("total"),
            F.col("l_shipdate").alias("shipped"),
            F.col("l_discount").alias("discount_rate"),
            F.col("l_tax").alias("tax_rate"),
        )

    @cached_property
    def invoices(self) -> DataFrame:
        price = F.col("o_totalprice").cast("decimal(18,2)")
        return self.table("orders").select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("invoice_date"),
            F.round(price * F.lit("0.01").cast("decimal(4,2)"), 2).cast("double").alias("shipping_fee"),
            (-F.round(price * F.lit("0.02").cast("decimal(4,2)"), 2)).cast("double").alias("discount"),
            F.when(F.col("o_orderstatus") == "F", "SUCCESS")
            .when(F.col("o_orderstatus") == "O", "PENDING_REVIEW")
            .otherwise("PROCESSING").alias("status"),
            F.col("o_totalprice").alias("declared_total"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Per-product cost register; row numbers start at 2 below a header."""
        part = F.col("p_partkey")
        return self.table("part").select(
            (part + 2).cast("int").alias("row_index"),
            F.concat(F.lit("P"), part).alias("sku_internal"),
            F.concat(F.lit("p"), part, F.lit(" ; "), F.col("p_brand")).alias("supplier_skus"),
            F.lit(None).cast("double").alias("cmp"),
            F.col("p_size").cast("double").alias("qty_prev"),
            F.when(part % 3 != 0, F.col("p_size") * 2.0).alias("qty_in"),
            F.when(part % 5 != 0, F.col("p_retailprice") * 2.0).alias("price_prev"),
            F.when(part % 4 != 0, F.col("p_retailprice") * 3.0).alias("price_new"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.concat(F.lit("P"), F.col("p_partkey")).alias("sku_internal"),
            F.col("p_brand").alias("brand"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        """Supplier SKU -> product; the brand SKU belongs to many products."""
        part = self.table("part")
        own = part.select(
            (F.col("p_partkey") * 2).alias("alias_id"),
            F.col("p_partkey").alias("product_id"),
            F.concat(F.lit(" p"), F.col("p_partkey")).alias("sku"),
            F.col("p_brand").alias("brand"),
        )
        brand = part.select(
            (F.col("p_partkey") * 2 + 1).alias("alias_id"),
            F.col("p_partkey").alias("product_id"),
            F.lower("p_brand").alias("sku"),
            F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("brand"),
        )
        return own.unionByName(brand)

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"),
            F.col("s_nationkey").alias("nation_id"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        turn = F.col("event_id") % 5
        status = (F.when(turn <= 1, "PENDING").when(turn == 2, "PROCESSING")
                  .when(turn == 3, "COMPLETED").otherwise("FAILED"))
        return self.table("events").select(
            F.col("event_id").alias("job_id"),
            F.upper("event_type").alias("type"),
            status.alias("status"),
            F.col("props").alias("data"),
            (F.col("event_id") % 4).cast("int").alias("attempts"),
            F.lit(3).alias("max_attempts"),
            F.when(turn == 4, F.concat(F.lit("failed after "), F.col("event_id") % 4)).alias("error"),
            F.when(turn >= 2, F.col("ts")).alias("started_at"),
            F.when(turn >= 3, F.expr("ts + make_dt_interval(cast(event_id % 20 as int))")).alias("completed_at"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("log_id"),
            F.col("user_id").alias("invoice_id"),
            F.upper("event_type").alias("type"),
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "purchase", "SUCCESS")
            .otherwise("INFO").alias("status"),
            F.col("props").alias("message"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def sales(self) -> DataFrame:
        return self.sales_of(self.table("events"))

    def sales_of(self, events: DataFrame) -> DataFrame:
        """Purchases of shoppers, moved onto the years the invoices cover."""
        return events.filter("event_type = 'purchase'").select(
            F.col("event_id").alias("sale_id"),
            F.col("user_id").alias("product_id"),
            F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(cast(event_id % 2500 as int))").alias("sold_at"),
            (F.col("event_id") % 5 + 1).cast("double").alias("quantity"),
            (F.col("value") * 50).alias("unit_price"),
        )


def cents(value, places: int = 2):
    """Result column in cents.  The tiny nudge puts exact half cents on the same
    side whichever way an engine rounds; ``cents_sql`` says the same in SQL."""
    return F.round(value.cast("double") + 1e-7, places)


def cents_sql(value: str, places: int = 2) -> str:
    return f"round(CAST({value} AS DOUBLE) + 1e-7, {places})"


# Orders the lines of one invoice totally.
ITEM_ORDER = ["line_no", "supplier_id", "part_id", "quantity", "total"]

# The same roles as SQL, for the oracle side.
ITEMS = """items AS (
  SELECT l_orderkey AS invoice_id, l_suppkey AS supplier_id, l_partkey AS part_id,
    l_linenumber AS line_no,
    CASE WHEN l_partkey % 7 = 0 THEN 'x' || l_partkey
         WHEN l_partkey % 11 = 0 THEN 'brand#' || (l_partkey % 25 + 1)
         ELSE ' p' || l_partkey END AS sku,
    l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
    l_extendedprice AS total, l_shipdate AS shipped, l_discount AS discount_rate,
    l_tax AS tax_rate FROM lineitem)"""
INVOICES = """invoices AS (
  SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, o_orderdate AS invoice_date,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS DOUBLE) AS shipping_fee,
    CAST(-round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.02 AS DECIMAL(4,2)), 2) AS DOUBLE) AS discount,
    CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING_REVIEW' ELSE 'PROCESSING' END AS status,
    o_totalprice AS declared_total FROM orders)"""
LEDGER = """ledger AS (
  SELECT CAST(p_partkey + 2 AS INT) AS row_index, 'P' || p_partkey AS sku_internal,
    'p' || p_partkey || ' ; ' || p_brand AS supplier_skus,
    CAST(p_size AS DOUBLE) AS qty_prev,
    CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) * 2 END AS qty_in,
    CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice * 2 END AS price_prev,
    CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 3 END AS price_new FROM part)"""
PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS name, 'P' || p_partkey AS sku_internal,
    p_brand AS brand FROM part)"""
ALIASES = """aliases AS (
  SELECT p_partkey * 2 AS alias_id, p_partkey AS product_id, ' p' || p_partkey AS sku,
    p_brand AS brand FROM part
  UNION ALL
  SELECT p_partkey * 2 + 1, p_partkey, lower(p_brand),
    CASE WHEN p_partkey % 9 <> 0 THEN p_brand END FROM part)"""
SUPPLIERS = """suppliers AS (
  SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_nationkey AS nation_id FROM supplier)"""
JOBS = """jobs AS (
  SELECT event_id AS job_id, upper(event_type) AS type,
    CASE WHEN event_id % 5 <= 1 THEN 'PENDING' WHEN event_id % 5 = 2 THEN 'PROCESSING'
         WHEN event_id % 5 = 3 THEN 'COMPLETED' ELSE 'FAILED' END AS status,
    props AS data, CAST(event_id % 4 AS INT) AS attempts, 3 AS max_attempts,
    CASE WHEN event_id % 5 = 4 THEN 'failed after ' || (event_id % 4) END AS error,
    CASE WHEN event_id % 5 >= 2 THEN ts END AS started_at,
    CASE WHEN event_id % 5 >= 3 THEN ts + to_days(CAST(event_id % 20 AS INT)) END AS completed_at,
    ts AS created_at FROM events)"""
LOGS = """logs AS (
  SELECT event_id AS log_id, user_id AS invoice_id, upper(event_type) AS type,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'SUCCESS' ELSE 'INFO' END AS status,
    props AS message, ts AS created_at FROM events)"""
SALES = """sales AS (
  SELECT event_id AS sale_id, user_id AS product_id,
    TIMESTAMP '1995-01-01' + to_days(CAST(event_id % 2500 AS INT)) AS sold_at,
    CAST(event_id % 5 + 1 AS DOUBLE) AS quantity, value * 50 AS unit_price
  FROM events WHERE event_type = 'purchase')"""


def with_roles(*roles: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(roles) + "\n" + body
