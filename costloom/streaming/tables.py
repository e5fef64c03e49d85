"""Tables written by streams: one folder per micro-batch.

A batch that is run again after a failure overwrites its own folder, so results
never double.  Readers take, per key, the rows of the latest batch that has the
key.  Every ``COMPACT_EVERY`` batches the latest rows are written as a version of
their own, so that readers need not open all batches; nothing is rewritten in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.operators.keyed import join_on_key
from costloom.session import ensure_checkpoint_dir
from costloom.sources.stored import versions


COMPACT_EVERY = 20


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def all_rows(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """Rows of every batch with their ``batch``.

    Given the table's schema, a table of which no batch was written yet has no rows.
    """
    if schema is None:
        return spark.read.parquet(table)
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def rows_since(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """Rows of the newest compacted version and of the batches after it, with their ``batch``."""
    upto = _compacted(spark, table)
    rows = all_rows(spark, table, schema)
    if upto is None:
        return rows
    return rows.filter(F.col("batch") > upto).unionByName(spark.read.schema(rows.schema).parquet(f"{table}-compact/upto={upto}"))


def latest_rows(spark: SparkSession, table: str, key: str, schema: str | None = None) -> DataFrame:
    """Per key the rows its latest batch wrote, of the newest compacted version and
    the batches after it."""
    rows = rows_since(spark, table, schema)
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return join_on_key(rows, newest, [key, "batch"], "inner", measure=rows.select(key, "batch"))


def compact(spark: SparkSession, table: str, key: str, upto: int, schema: str | None = None, rows: DataFrame | None = None) -> None:
    """Write the latest rows (or ``rows``, with their batch) of the batches up to ``upto``
    as one version beside the table.

    Readers then leave these batches out (whole folders, by the batch in their name).
    A version that is written again is the same, so a repeated batch does no harm.
    """
    done = _compacted(spark, table)
    if done is not None and done >= upto:
        return
    rows = latest_rows(spark, table, key, schema) if rows is None else rows
    rows.filter(F.col("batch") <= upto).write.mode("overwrite").parquet(f"{table}-compact/upto={upto}")


def _compacted(spark: SparkSession, table: str) -> int | None:
    """The newest whole version: folders of versions are few, one per ``COMPACT_EVERY`` batches."""
    return max(versions(spark, f"{table}-compact", "upto"), default=None)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str,
                output_mode: str = "append", every: str | None = None):
    """Start ``handle`` on every micro-batch.

    Without ``every`` the query drains what has arrived and stops; with it
    ("5 seconds") it keeps polling.
    """
    writer = (stream.writeStream.outputMode(output_mode).foreachBatch(handle)
              .option("checkpointLocation", f"{folder}/progress"))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str, output_mode: str = "append") -> None:
    """Process everything that has arrived and return when it is stored."""
    run_batches(stream, handle, folder, output_mode).awaitTermination()
