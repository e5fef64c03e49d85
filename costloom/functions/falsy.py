"""Missing-value rules of the business data, kept apart from plain SQL nulls."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used.

    Inside array functions Spark evaluates every copy of an expression, so the
    steps of longer parsers are bound this way.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def first_truthy(*cols: Column) -> Column:
    """First numeric value that is neither null, NaN nor zero, else the last one."""
    out = cols[-1]
    for c in reversed(cols[:-1]):
        out = F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (c != 0), c).otherwise(out)
    return out


def first_text(*cols: Column) -> Column:
    """First string that is neither null nor empty (``"0"`` counts as present)."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def number_prefix(text: Column) -> Column:
    """Leading number of a text ("12abc" -> 12), null when there is none."""
    lead = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return lead.try_cast("double")


def finite(value: Column) -> Column:
    """Null for NaN and infinities."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def round_half_up(value: Column, places: int) -> Column:
    """Round halves towards plus infinity, also for negative amounts."""
    scale = float(10 ** places)
    return F.floor(value * scale + 0.5).cast("double") / scale
