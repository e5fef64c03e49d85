"""Order-dependent columns that survive a key holding most of the rows.

``Window.partitionBy(key)`` sends every row of a key to one task.  That is the
right plan for all keys but the hot ones, which are looked for first in a sample
of the keys.  Only the rows of hot keys are treated apart: they are
range-partitioned by (key, order), which cuts even a single key into even runs,
and the run number is fixed by a checkpoint so that every later use sees the same
cut; all other rows go the plain way.  Each column is computed inside (key, run)
and, for hot keys, corrected with what the earlier runs of the same key carry
over.  A run boundary lies inside at most one key, so the carry table has at most
two rows per run.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.operators.keyed import Keys, hot_list
from costloom.session import ensure_checkpoint_dir, max_group_rows

RUN = "_run"


@dataclass(frozen=True)
class Lag:
    """Value of the previous row of the key; ``default`` on the first row."""

    value: Column
    default: Column | None = None

    def local(self, w):
        return F.lag(F.struct(self.value.alias("v"))).over(w)

    def summary(self, order):
        return F.max_by(F.struct(self.value.alias("v")), order)

    def carry(self, summary, w):
        return F.lag(summary).over(w)

    def merge(self, local, carry):
        prev = local if carry is None else F.coalesce(local, carry)
        if self.default is None:
            return prev["v"]
        return F.when(prev.isNull(), self.default).otherwise(prev["v"])


@dataclass(frozen=True)
class Lead:
    """Value of the next row of the key; null on the last row."""

    value: Column

    def local(self, w):
        return F.lead(F.struct(self.value.alias("v"))).over(w)

    def summary(self, order):
        return F.min_by(F.struct(self.value.alias("v")), order)

    def carry(self, summary, w):
        return F.lead(summary).over(w)

    def merge(self, local, carry):
        nxt = local if carry is None else F.coalesce(local, carry)
        return nxt["v"]


@dataclass(frozen=True)
class RunningSum:
    """Sum over the key up to this row (or up to the row before it)."""

    value: Column
    inclusive: bool = True

    def local(self, w):
        end = Window.currentRow if self.inclusive else -1
        return F.sum(self.value).over(w.rowsBetween(Window.unboundedPreceding, end))

    def summary(self, order):
        return F.sum(self.value)

    def carry(self, summary, w):
        return F.sum(summary).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def merge(self, local, carry):
        if carry is None:
            return F.coalesce(local, F.lit(0))
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


@dataclass(frozen=True)
class RunningMax:
    """Largest non-null value of the key up to this row (or before it)."""

    value: Column
    inclusive: bool = True

    def local(self, w):
        end = Window.currentRow if self.inclusive else -1
        return F.max(self.value).over(w.rowsBetween(Window.unboundedPreceding, end))

    def summary(self, order):
        return F.max(self.value)

    def carry(self, summary, w):
        return F.max(summary).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def merge(self, local, carry):
        return local if carry is None else F.greatest(local, carry)


@dataclass(frozen=True)
class LastValue:
    """Latest non-null value of the key up to this row (or before it)."""

    value: Column
    inclusive: bool = True

    def local(self, w):
        end = Window.currentRow if self.inclusive else -1
        return F.last(self.value, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, end)
        )

    def summary(self, order):
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def carry(self, summary, w):
        return F.last(summary, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, -1)
        )

    def merge(self, local, carry):
        return local if carry is None else F.coalesce(local, carry)


@dataclass(frozen=True)
class NextValue:
    """Nearest non-null value of the key after this row."""

    value: Column

    def local(self, w):
        return F.first(self.value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))

    def summary(self, order):
        return F.min_by(self.value, F.when(self.value.isNotNull(), order))

    def carry(self, summary, w):
        return F.first(summary, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))

    def merge(self, local, carry):
        return local if carry is None else F.coalesce(local, carry)


class OrderedGroups:
    """Rows grouped by ``keys`` and totally ordered by ``order`` inside a key.

    ``order`` must identify a row inside its key, otherwise the answer of any
    order-dependent column would depend on how rows happen to arrive.

    ``measure`` holds just the key of every row of a source that has at least the
    rows of ``df`` (or makes such keys from a share of it); large groups are looked
    for there when ``df`` itself is the outcome of joins that would have to run twice.
    ``bounded`` says that no look is needed: a group is made of one row of a source,
    such as the lines of a document's text.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 max_rows: int | None = None, measure: Keys | None = None, bounded: bool = False):
        spark = df.sparkSession
        self.keys, self.order = list(keys), list(order)
        limit = max_rows or max_group_rows(spark)
        groups = df.select(*self.keys) if measure is None else measure
        hot = None if bounded else hot_list(groups, limit)
        self.split = hot is not None
        if self.split:
            ensure_checkpoint_dir(spark)
            # A measure may know the first keys only; then all groups below these are split.
            known = self.keys[:len(hot.columns) - 1]
            hot = hot.toDF(*[f"_hot_{k}" for k in known], "_hot_rows")
            is_hot = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in known]
            runs = math.ceil(hot.agg(F.sum("_hot_rows")).first()[0] / limit) + 1
            runs_of_hot = (
                df.join(hot, is_hot, "left_semi")
                .repartitionByRange(runs, *self.keys, *self.order)
                .withColumn(RUN, F.spark_partition_id())
                .checkpoint()
            )
            # Rows of all other keys form one run of their key, number -1.
            df = df.join(hot, is_hot, "left_anti").withColumn(RUN, F.lit(-1)).unionByName(runs_of_hot)
        self.df = df

    def resume(self, df: DataFrame) -> "OrderedGroups":
        """The same groups over ``df``: rows of an earlier ``with_columns(keep_run=True)``
        that were only filtered or given more columns.  Nothing is partitioned anew."""
        nxt = copy.copy(self)
        nxt.df = df
        return nxt

    @property
    def parts(self) -> list[str]:
        return self.keys + ([RUN] if self.split else [])

    def with_columns(self, keep_run: bool = False, **ops) -> DataFrame:
        """Add one column per named operator; all share one sort.

        ``keep_run`` keeps the run number for callers that go on inside runs.
        """
        w = Window.partitionBy(*self.parts).orderBy(*self.order)
        names = {name: f"_local_{name}" for name in ops}
        out = self.df.select(
            "*", *[op.local(w).alias(names[name]) for name, op in ops.items()]
        )
        if self.split:
            out = out.join(
                self._carry(ops),
                [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in self.keys]
                + [F.col(RUN) == F.col(f"_c_{RUN}")],
                "left",
            )
        merged = [
            op.merge(
                F.col(names[name]), F.col(f"_carry_{name}") if self.split else None
            ).alias(name)
            for name, op in ops.items()
        ]
        kept = [F.col(c) for c in self.df.columns if keep_run or c != RUN]
        return out.select(*kept, *merged)

    def _carry(self, ops) -> DataFrame:
        """What the earlier runs of a hot key hand to each of its runs."""
        hot = self.df.filter(F.col(RUN) >= 0)
        straddling = (
            hot.groupBy(*self.keys)
            .agg(F.min(RUN).alias("_first"), F.max(RUN).alias("_last"))
            .filter("_first < _last")
            .drop("_first", "_last")
        )
        edges = straddling.select(*[F.col(k).alias(f"_e_{k}") for k in self.keys])
        rows = hot.join(edges, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in self.keys], "left_semi")
        order = F.struct(*self.order)
        summary = rows.groupBy(*self.keys, RUN).agg(
            *[op.summary(order).alias(f"_sum_{name}") for name, op in ops.items()]
        )
        w = Window.partitionBy(*self.keys).orderBy(RUN)
        return summary.select(
            *[F.col(k).alias(f"_c_{k}") for k in self.keys],
            F.col(RUN).alias(f"_c_{RUN}"),
            *[
                op.carry(F.col(f"_sum_{name}"), w).alias(f"_carry_{name}")
                for name, op in ops.items()
            ],
        )


def row_numbers(df: DataFrame, keys, order, name: str = "pos", max_rows: int | None = None,
                measure: Keys | None = None, bounded: bool = False) -> DataFrame:
    """1-based position inside the key."""
    groups = OrderedGroups(df, keys, order, max_rows, measure, bounded)
    return groups.with_columns(**{name: RunningSum(F.lit(1).cast("long"))})
