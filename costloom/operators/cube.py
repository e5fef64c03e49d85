"""Figures of sales kept as a cube of parts that add up.

A day's sales become one row per cell of the finest grain, with sums and counts only;
any coarser grouping adds rows up, whichever days they came from.  A new day reads its
own sales, and a day that is loaded again replaces its part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.operators.allocate import PRECISE


def partials(facts: DataFrame, grain: Sequence[str], sums: Sequence[str], counted: Sequence[str] = ()) -> DataFrame:
    """Per cell: ``rows``, the decimal sum of each of ``sums``, and the number of non-null ``counted``."""
    return facts.groupBy(*grain).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).cast(PRECISE)).alias(c) for c in sums],
        *[F.count(c).alias(f"n_{c}") for c in counted])


def store_part(part: DataFrame, folder: str, number: int) -> None:
    part.write.mode("overwrite").parquet(f"{folder}/part={number}")


def rolled_up(spark: SparkSession, folder: str, sets: Sequence[Sequence[str]], figures: Sequence[Column]) -> DataFrame:
    """The stored parts grouped by each of ``sets`` of columns; a column that a set lacks is null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cells = spark.read.parquet(folder)
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*figures)
