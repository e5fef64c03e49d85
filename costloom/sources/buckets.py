"""A table in hash buckets whose upserts rewrite the buckets they touch and no other.

``data/v=n/bucket=b`` holds what version n wrote of bucket b.  ``manifest/v=n`` lists for
every bucket the version to read; its commit is the commit of the upsert, so readers see
a version whole or not at all, and an upsert that is run again does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.operators.keyed import rows_with_key
from costloom.sources.stored import folders, versions

BUCKET = "bucket"


def create(df: DataFrame, root: str, key: str, buckets: int) -> None:
    """Store ``df`` as version 0, dealt by ``key``."""
    _write(_dealt(df, key, buckets), root, 0, {}, range(buckets), buckets, df.schema.json())


def upsert(new: DataFrame, root: str, key: str, version: int) -> list[int]:
    """Replace all rows of the keys in ``new``; returns the buckets rewritten (none if the version is there)."""
    spark = new.sparkSession
    if version in versions(spark, f"{root}/manifest", "v"):
        return []
    where, buckets, schema = _manifest(spark, root)
    dealt = _dealt(new, key, buckets)
    touched = sorted(r[0] for r in dealt.select(BUCKET).distinct().collect())  # at most one row per bucket
    old = _read(spark, root, {b: v for b, v in where.items() if b in touched}, schema)
    kept = _dealt(rows_with_key(old, new, [key], present=False), key, buckets)
    _write(kept.unionByName(dealt), root, version, where, touched, buckets, schema)
    return touched


def read(spark: SparkSession, root: str) -> DataFrame:
    where, _, schema = _manifest(spark, root)
    return _read(spark, root, where, schema)


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, root: str, version: int, where: dict[int, int], touched, buckets: int, schema: str) -> None:
    spark = rows.sparkSession
    path = f"{root}/data/v={version}"
    # Rebalanced: a large bucket is written by several tasks, small ones share a task.
    rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    written = {int(name.split("=")[1]) for name in folders(spark, path) if name.startswith(f"{BUCKET}=")}
    now = {b: v for b, v in where.items() if b not in set(touched)} | {b: version for b in written}
    listed = spark.createDataFrame([(b, v) for b, v in sorted(now.items())], "bucket int, version int")
    about = listed.withColumns({"buckets": F.lit(buckets), "schema": F.lit(schema)})
    if not now:
        about = spark.createDataFrame([(None, None, buckets, schema)], "bucket int, version int, buckets int, schema string")
    about.coalesce(1).write.mode("overwrite").json(f"{root}/manifest/v={version}")


def _manifest(spark: SparkSession, root: str) -> tuple[dict[int, int], int, str]:
    """The newest committed list: one row per bucket, so its size is that of the layout."""
    newest = versions(spark, f"{root}/manifest", "v")[-1]
    rows = spark.read.schema("bucket int, version int, buckets int, schema string").json(f"{root}/manifest/v={newest}").collect()
    return {r.bucket: r.version for r in rows if r.bucket is not None}, rows[0].buckets, rows[0].schema


def _read(spark: SparkSession, root: str, where: dict[int, int], schema: str) -> DataFrame:
    from pyspark.sql.types import StructType
    import json

    fields = StructType.fromJson(json.loads(schema))
    if not where:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(*[f"{root}/data/v={v}/{BUCKET}={b}" for b, v in sorted(where.items())])
