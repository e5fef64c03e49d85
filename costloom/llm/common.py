"""What the operators share: tables, the shared folder, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words and the white space between them, as the contracts spell them.
SPACE = r"\x20\x09-\x0D"
# Rows with whole texts that are worked on at a time; ordinary texts make a few MB.
TEXT_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="costloom-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/costloom-llm/{uuid.uuid4().hex}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    This cuts the lineage in a way that survives lost executors, keeps repeated
    use from repeating the work, and gives Spark the table's real size, so that
    a join broadcasts it only when it is small.
    """
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A small scan dealt to every core; larger ones stay as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def learnable(doc_id: Column, parts: int, held_out: int) -> Column:
    """False for rows held out of learning: crc32 of the doc_id as text, mod ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts != held_out, F.lit(True))


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` over rows that hold whole texts, handed to ``fn`` a few rows at a time.

    Spark bounds the bytes of the batches it sends; what ``fn`` makes of them is
    bounded here, where they are read, whatever the session's settings are by then.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(at, TEXT_ROWS) for batch in batches for at in range(0, len(batch), TEXT_ROWS))

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow column of texts; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
