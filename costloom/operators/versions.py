"""Costs with the time they are valid: a slowly changing table that grows by batches.

A version of a product's cost is valid from the moment it was set up to the moment
another value replaced it; the latest one is open.  Closed versions are only ever
added to, open ones are one row per product, so a batch of new costs reads the open
rows and writes what it closes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.operators.keyed import join_on_key, rows_with_key
from costloom.operators.ordered import Lag, Lead, OrderedGroups
from costloom.sources.stored import versions


def versions_of(marks: DataFrame, key: str, at: str, value: str, order: list[str], max_rows: int | None = None) -> DataFrame:
    """``key``, ``value``, ``valid_from``, ``valid_to`` (null: open) of cost marks.

    Of the marks of one moment the last by ``order`` counts; a mark that repeats the
    value before it starts no version.
    """
    last = marks.groupBy(key, at).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_now"))
    seq = OrderedGroups(last, [key], [at], max_rows)
    seen = seq.with_columns(keep_run=True, _before=Lag(F.struct(F.col("_now"))))
    changed = seen.filter(F.col("_before").isNull() | ~F.col("_before._now").eqNullSafe(F.col("_now")))
    ends = seq.resume(changed).with_columns(valid_to=Lead(F.col(at)))
    return ends.select(key, F.col("_now.v").alias(value), F.col(at).alias("valid_from"), "valid_to")


def extend(opened: DataFrame, marks: DataFrame, key: str, at: str, value: str, order: list[str],
           max_rows: int | None = None, store: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> dict[str, DataFrame]:
    """What a batch of marks makes of the open versions: ``closed``, ``open`` and ``late``.

    ``late`` marks lie before the version that is open for their product; they would
    change closed versions and are handed back.  ``store`` may put away rows that are
    used more than once.
    """
    since = opened.select(key, F.col("valid_from").alias("_since"))
    timed = store(join_on_key(marks, since, [key]), "timed")
    late = F.coalesce(F.col(at) < F.col("_since"), F.lit(False))
    fresh = timed.filter(~late).drop("_since")
    first = F.struct(*[F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in order])  # sorts before any mark
    own = rows_with_key(opened, fresh, [key]).select(key, F.col("valid_from").alias(at), F.col(value), first.alias("_order"))
    new = fresh.select(key, at, value, F.struct(*order).alias("_order"))
    made = store(versions_of(own.unionByName(new), key, at, value, ["_order"], max_rows), "made")
    untouched = rows_with_key(opened, fresh, [key], present=False)
    return {"closed": made.filter("valid_to is not null"),
            "open": untouched.unionByName(made.filter("valid_to is null")), "late": timed.filter(late).drop("_since")}


def advance(marks: DataFrame, root: str, batch: int, key: str, at: str, value: str, order: list[str]) -> None:
    """Add a batch of marks to the stored versions below ``root``.

    Writes ``closed/batch=n``, ``late/batch=n`` and, last, ``open/batch=n``, which makes
    the batch count.  A batch that is run again writes the same again.  The marks and
    what they make are worked out once, below ``steps``, whatever is read from them.
    """
    spark = marks.sparkSession
    schema = f"{key} {dict(marks.dtypes)[key]}, {value} {dict(marks.dtypes)[value]}, valid_from {dict(marks.dtypes)[at]}, valid_to {dict(marks.dtypes)[at]}"
    done = [n for n in versions(spark, f"{root}/open", "batch") if n < batch]
    opened = spark.read.schema(schema).parquet(f"{root}/open/batch={done[-1]}") if done else spark.createDataFrame([], schema)

    def store(rows: DataFrame, name: str) -> DataFrame:
        place = f"{root}/steps/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(place)
        return spark.read.schema(rows.schema).parquet(place)

    parts = extend(opened, marks, key, at, value, order, store=store)
    for name in ("closed", "late", "open"):
        parts[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def stored_versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions: the closed ones of every counted batch and the open ones of the newest."""
    done = versions(spark, f"{root}/open", "batch")
    closed = spark.read.parquet(*[f"{root}/closed/batch={n}" for n in done])
    return closed.unionByName(spark.read.parquet(f"{root}/open/batch={done[-1]}"))


def valid_at(facts: DataFrame, made: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Facts with the ``value`` that was valid at their time, null before the first one.

    The range join is an equi-join on (key, month): a version is listed for the months
    it covers, the open ones up to the last fact, and the rest is a comparison among
    the versions of one month.
    """
    last = facts.agg(F.max(at)).scalar()
    month = lambda c: F.trunc(c, "MM")
    until = F.coalesce(F.col("valid_to"), F.greatest(last, F.col("valid_from")))
    months = F.sequence(month(F.col("valid_from")), F.greatest(month(until), month(F.col("valid_from"))), F.expr("interval 1 month"))
    listed = made.select(F.col(key).alias("_key"), F.col(value), "valid_from", "valid_to", F.explode(months).alias("_month"))
    meets = ((F.col(key) == F.col("_key")) & (month(F.col(at)) == F.col("_month")) & (F.col(at) >= F.col("valid_from"))
             & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))
    return facts.join(listed, meets, "left").select(*facts.columns, value)
