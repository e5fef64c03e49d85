"""Session settings the library relies on, and where it may cut lineage."""

import tempfile

from pyspark.sql import SparkSession

# Largest number of rows one ordered group or one join key may bring into a
# single task before the operators split it.  Override per session with
# ``spark.conf.set("costloom.maxGroupRows", n)``.
MAX_GROUP_ROWS = 4_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the runtime re-planning that the plans count on.

    Only runtime SQL settings are touched; sizing (shuffle partitions, memory,
    broadcast threshold) stays with whoever started the session.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    master = spark.sparkContext.master
    if not checkpoint_folder(spark) and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return spark


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder that the cluster names."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("costloom.maxGroupRows", str(MAX_GROUP_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, preferring the cluster's folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without one gets a scratch folder, because there every task runs on
    this machine anyway.
    """
    sc = spark.sparkContext
    named = checkpoint_folder(spark)
    if sc.getCheckpointDir() is not None:
        return
    if named:
        sc.setCheckpointDir(named)
    else:  # a local session, as ``tune`` has made sure
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="costloom-checkpoint-"))
