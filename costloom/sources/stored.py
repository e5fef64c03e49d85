"""Folders of versions: which are whole, and which is the newest."""

from __future__ import annotations

from pyspark.sql import SparkSession


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the whole folders ``path/name=n``, in order: those whose write was committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    found = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(folder) if f.isDirectory()) if store.exists(folder) else []
