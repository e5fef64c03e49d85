"""Reading tables."""

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least one partition per core, for expensive work per row.

    A table of many files or row groups is returned as it is; only a small one
    that would be read by fewer tasks than there are cores is redistributed.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def tasks_for(scan: DataFrame, rows_per_task: int) -> int:
    """Tasks that share a table with at most about so many of its rows each, at least one
    per core.  The rows are counted from the files' footers."""
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows_per_task))
