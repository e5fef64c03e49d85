"""Streams over tables that are folders, empty starts and compacted versions."""

from pyspark.sql import functions as F

from costloom.plans.catalog import QUERIES
from costloom.streaming import arrivals, tables


def folder_tables(spark, sf_dir, names):
    folder = tables.work_folder(spark)
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_streams_read_folder_tables(spark, sf_dir):
    names = ["documents", "events", "lineitem", "part"]
    folder = folder_tables(spark, sf_dir, names)
    for name in ("ss_01_document_pickup", "ss_02_stored_items", "ss_04_sales_with_snapshot", "ss_06_running_cost"):
        ours, theirs = (QUERIES[name](spark, d) for d in (folder, sf_dir))
        assert ours.count() > 0
        assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_empty_start(spark):
    folder = tables.work_folder(spark)
    assert tables.all_rows(spark, f"{folder}/none", "k long, v string").columns == ["k", "v", "batch"]
    assert tables.latest_rows(spark, f"{folder}/none", "k", "k long, v string").count() == 0
    inbox = f"{folder}/inbox"
    spark.range(0).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(inbox)
    arrivals.store_lines(arrivals.arriving(spark, inbox, "doc_id long, text string"), folder)
    assert tables.all_rows(spark, f"{folder}/lines", "doc_id long, line_no int, text string").count() == 0


def test_compacted_versions(spark):
    folder = tables.work_folder(spark)
    table, schema = f"{folder}/t", "k long, v long"
    for batch in range(7):
        tables.write_batch(spark.range(batch, batch + 3).select(F.col("id").alias("k"), F.lit(batch).cast("long").alias("v")), table, batch)
        if batch in (2, 4):
            tables.compact(spark, table, "k", batch, schema)
    want = {k: min(k, 6) for k in range(9)}
    got = {r.k: r.v for r in tables.latest_rows(spark, table, "k", schema).collect()}
    assert got == want
