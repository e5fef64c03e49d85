"""Joining a fact table with one-row-per-key results when a key may be hot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.session import ensure_checkpoint_dir, max_group_rows

# A hot-key list is held and broadcast only up to this many keys; a longer one is
# a checkpointed table that Spark joins like any other.
MAX_HOT_KEYS = 100_000
# Sampled rows expected for a key at the limit; enough to find it surely.
SAMPLED_ROWS = 1_000


# Keys of a source: all of its rows, or what to make of a share of them.
Keys = DataFrame | Callable[[float], DataFrame]


def hot_keys(keys: Keys, limit: int) -> DataFrame:
    """Keys (all columns of ``keys``) with about ``limit`` rows or more, and ``rows``.

    Being on the list only changes how work is spread, never a result, so large
    inputs are sampled: a key at the limit still shows about a thousand times,
    and next to nothing is shuffled.  ``keys`` may be a function of the share to
    look at, for keys that take a join to find: it samples before it joins.
    """
    share = min(1.0, SAMPLED_ROWS / limit)
    if callable(keys):
        seen = keys(share)
    else:
        seen = keys if share == 1.0 else keys.sample(share, seed=11)
    rows = F.count(F.lit(1)) / share
    floor = limit if share == 1.0 else limit / 2
    return seen.groupBy(*seen.columns).agg(rows.alias("rows")).filter(F.col("rows") > floor)


def hot_list(keys: Keys, limit: int) -> DataFrame | None:
    """The hot keys as a fixed table, or None without any.

    It is looked for once, in one job, and never evaluated again: whatever order the
    source's rows come in, every use of the list sees the same keys and copies.
    """
    found = hot_keys(keys, limit)
    rows = found.limit(MAX_HOT_KEYS + 1).collect()
    if not rows:
        return None
    if len(rows) <= MAX_HOT_KEYS:
        return F.broadcast(found.sparkSession.createDataFrame(rows, found.schema))
    ensure_checkpoint_dir(found.sparkSession)
    return found.checkpoint()


def join_on_key(facts: DataFrame, per_key: DataFrame, keys: Sequence[str],
                how: str = "left", measure: Keys | None = None,
                max_rows: int | None = None) -> DataFrame:
    """``facts`` joined with ``per_key``, which holds one row per key.

    Spark decides between broadcast and shuffle from the runtime size of
    ``per_key``.  If it has to shuffle, a key with very many facts would land in
    one task, so hot keys get several copies of their single ``per_key`` row,
    each taking a share of the facts.  The result is the same rows either way.

    ``measure`` is where hot keys are looked for; give the source scan when
    ``facts`` is the outcome of earlier joins, so the look costs one column scan.
    """
    keys = list(keys)
    limit = max_rows or max_group_rows(facts.sparkSession)
    source = facts.select(*keys) if measure is None else measure
    hot = hot_list(source if callable(source) else source.select(*keys), limit)
    if hot is None:
        return facts.join(per_key, keys, how)
    hot = hot.select(*keys, F.ceil(F.col("rows") / limit).cast("int").alias("_copies"))
    # A null key matches nothing, so its facts may be spread freely.
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    spread = F.when(no_key, F.lit(4096)).otherwise(F.coalesce("_copies", F.lit(1)))
    row = F.xxhash64(*facts.columns) + F.spark_partition_id()
    facts = (
        facts.join(hot, keys, "left")
        .withColumn("_share", F.pmod(row, spread).cast("int"))
        .drop("_copies")
    )
    shares = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    copies = (
        per_key.join(hot, keys, "left").withColumn("_share", F.explode(shares)).drop("_copies")
    )
    return facts.join(copies, [*keys, "_share"], how).drop("_share")


def rows_with_key(facts: DataFrame, wanted: DataFrame, keys: Sequence[str], present: bool = True,
                  measure: Keys | None = None, max_rows: int | None = None) -> DataFrame:
    """Facts whose key is (or with ``present=False`` is not) among ``wanted``."""
    once = wanted.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    marked = join_on_key(facts, once, keys, "inner" if present else "left", measure, max_rows)
    if not present:
        marked = marked.filter(F.col("_wanted").isNull())
    return marked.select(*facts.columns)
