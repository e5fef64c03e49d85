"""Newly arrived documents: pickup, extraction and upsert of their invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.operators.extract import ITEM_VALUES, region_items
from costloom.operators.keyed import join_on_key
from costloom.sources.documents import lines_of
from costloom.streaming.tables import COMPACT_EVERY, compact, drain, latest_rows, rows_since, write_batch


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that appear at a path, each read once.

    The path is a folder or, for a table that is one file, that file: it is given as a
    pattern of itself, which the reader resolves to either.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


ITEM_SCHEMA = ", ".join(["doc_id long", "vendor string", "missing_total_is_zero boolean", "variant int", "pos int",
                         *(f"{c} string" for c in ITEM_VALUES), "row_kind string"])


STATUS_SCHEMA = "doc_id long, n_items long, status string"
LOG_SCHEMA = "doc_id long, type string, status string, message string"


def store_lines(docs: DataFrame, folder: str) -> None:
    """Lines of every new document."""
    drain(docs, lambda batch, n: write_batch(lines_of(batch), f"{folder}/lines", n), folder)


def upsert_invoices(docs: DataFrame, rules: DataFrame, folder: str) -> None:
    """Items, status and log of every new document.

    A document that comes again replaces its items: its status row of the new
    batch makes the old batch's rows obsolete (``current_items``).  Documents
    without a single item end as ERROR, the others wait for review.
    """

    def handle(batch: DataFrame, n: int) -> None:
        write_batch(region_items(batch, rules), f"{folder}/items", n)
        # Read back what was stored, so the extraction runs once per batch.
        items = batch.sparkSession.read.parquet(f"{folder}/items/batch={n}")
        counts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
        status = join_on_key(batch.select("doc_id").distinct(), counts, ["doc_id"]).select(
            "doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.when(F.col("n_items") > 0, "PENDING_REVIEW").otherwise("ERROR").alias("status"))
        write_batch(status, f"{folder}/status", n)
        logs = status.select("doc_id", F.lit("PROCESSING").alias("type"), F.when(
            F.col("status") == "ERROR", "ERROR").otherwise("SUCCESS").alias("status"),
            F.concat(F.lit("Extracted items: "), "n_items").alias("message"))
        write_batch(logs, f"{folder}/logs", n)
        if n and n % COMPACT_EVERY == 0:
            spark = batch.sparkSession
            compact(spark, f"{folder}/items", "doc_id", n, rows=_current(spark, folder))
            compact(spark, f"{folder}/status", "doc_id", n, STATUS_SCHEMA)
            compact(spark, f"{folder}/logs", "doc_id", n, LOG_SCHEMA)

    drain(docs, handle, folder)


def _current(spark: SparkSession, folder: str) -> DataFrame:
    newest = latest_rows(spark, f"{folder}/status", "doc_id", STATUS_SCHEMA).select("doc_id", "batch")
    return join_on_key(rows_since(spark, f"{folder}/items", ITEM_SCHEMA), newest, ["doc_id", "batch"], "inner")


def current_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of the latest processing of every document."""
    return _current(spark, folder).drop("batch")


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
DELIVERED = "name string, arrived_at timestamp, content binary"
QUARANTINE_SCHEMA = "name string, arrived_at timestamp, reason string"


def delivered_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files below a folder (``DELIVERED``); a name says where below it the file came to."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("arrived_at"), "content")


def store_once(deliveries: DataFrame, folder: str, lateness: str = "1 day") -> None:
    """Lines of every document, once however often it is delivered within ``lateness``.

    The same document is the same name with the same bytes; another content under a
    known name is a new version.  State is one hash per document of that time.  What is
    no text (not UTF-8, or blank) goes to ``quarantine`` with the reason.
    """
    once = (deliveries.withColumn("hash", F.sha2(F.coalesce("content", F.lit(b"")), 256))
            .withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["name", "hash"]))

    def handle(batch: DataFrame, n: int) -> None:
        text = F.try_validate_utf8(F.col("content").cast("string"))
        read = batch.select("name", "arrived_at", "hash", text.alias("text"), F.when(
            F.col("content").isNull() | (F.length("content") == 0), "empty").when(text.isNull(), "not UTF-8").when(~text.rlike(r"\S"), "blank").alias("reason"))
        write_batch(read.filter("reason is not null").select("name", "arrived_at", "reason"), f"{folder}/quarantine", n)
        write_batch(lines_of(read.filter("reason is null").select("name", "hash", "text")), f"{folder}/lines", n)

    drain(once, handle, folder)
