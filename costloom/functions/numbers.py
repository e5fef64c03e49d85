"""Three ways suppliers' numbers are read.  They disagree on purpose: the same
text means different amounts on different vendors' paper, so the caller names
the style.

``unified``    a comma followed by exactly three digits separates thousands
``strict_eu``  dots and commas before groups of three separate thousands
``price``      amounts with two decimals, everything longer is thousands
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from costloom.functions.falsy import first_text, let, round_half_up

# Marks that may surround an amount.
UNIFIED_MARKS = r"€|EUR|\$|£"
STRICT_MARKS = r"€|EUR"
PRICE_MARKS = r"[€$£¥]"
INVISIBLE = r"[\u00a0\u202f\u200b]"
SPACE = r"[\s\u00a0\u202f]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _has(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(mark))


def _swap_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("."))


def _drop(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, marks, "")


def _after_comma(text: Column) -> Column:
    return F.substring_index(text, ",", -1)


def _one_comma(text: Column) -> Column:
    return text.rlike(r"^[^,]*,[^,]*$")


def _comma_last(text: Column) -> Column:
    """The rightmost separator is a comma."""
    return text.rlike(r",[^.,]*$")


def unified(text: Column) -> Column:
    """Amount in the mixed style; unreadable or missing text is 0."""
    return let(text, _unified)


def unified_plain(text: Column) -> Column:
    """``unified`` of the two commonest spellings, which need no cleaning; null for all others."""
    return (
        F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
        .when(text.rlike(r"^\d{1,5},(\d{1,2}|\d{4,9})$"), _swap_comma(text).try_cast("double"))
    )


def _unified(text: Column) -> Column:
    def dotted(s: Column) -> Column:
        both = _has(s, ",") & _has(s, ".")
        comma_is_decimal = _one_comma(s) & (F.length(_after_comma(s)) != 3)
        return (
            F.when(both & _comma_last(s), _swap_comma(_drop(s, r"\.")))
            .when(both, _drop(s, ","))
            .when(_has(s, ",") & comma_is_decimal, _swap_comma(s))
            .otherwise(_drop(s, ","))
        )

    keep = r"[^0-9.\-]"

    def checked(value: Column) -> Column:
        # A lost decimal comma shows as a huge amount: "125267,18%" is not 12.5 million.
        cents = F.length(_drop(_after_comma(text), r"[^0-9]")) == 2
        lost_comma = (value > 100000) & ~_has(text, ".") & _one_comma(text) & cents
        again = _drop(_swap_comma(text), keep).try_cast("double")
        return F.coalesce(F.when(lost_comma, F.coalesce(again, value)).otherwise(value), F.lit(0.0))

    def read(s: Column) -> Column:
        plain = s.rlike(r"^-?\d+(\.\d+)?$")
        return F.when(plain, s.try_cast("double")).otherwise(
            let(_drop(dotted(s), keep).try_cast("double"), checked))

    # The two commonest spellings need no cleaning.
    return (
        F.when(text.isNull(), 0.0)
        .when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("double"))
        .when(text.rlike(r"^\d{1,5},(\d{1,2}|\d{4,9})$"), _swap_comma(text).try_cast("double"))
        .otherwise(let(_drop(_strip(_drop(text, UNIFIED_MARKS)), INVISIBLE), read))
    )


def strict_eu(text: Column) -> Column:
    """Amount where grouped dots are thousands; a minus may lead or trail."""

    def unsigned(s: Column) -> Column:
        comma, dot = _has(s, ","), _has(s, ".")
        cents = s.rlike(r"^[^,]*,[^,]{2}$")
        groups = s.rlike(r"^[^,]*(,[^,]{3})+$") & ~s.startswith("0,")
        dotted = (
            F.when(comma & dot & _comma_last(s), _swap_comma(_drop(s, r"\.")))
            .when(comma & dot, _drop(s, ","))
            .when(comma & ~cents & groups, _drop(s, ","))
            .when(comma, _swap_comma(s))
            .when(s.rlike(r"^-?\d{1,3}(\.\d{3})+$"), _drop(s, r"\."))
            .otherwise(s)
        )
        # Letters a cast would take for a type mark ("12d", "NaN") are not amounts.
        number = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
        value = let(dotted, lambda d: F.when(d.rlike(number), d.try_cast("double")))
        return F.coalesce(value, F.lit(0.0))

    def signed(s: Column) -> Column:
        negative = s.startswith("-") | s.endswith("-")
        body = F.when(s.startswith("-"), _drop(s, "^-")).otherwise(_drop(s, "-$"))
        value = let(_drop(body, " "), unsigned)
        return let(value, lambda v: F.when(negative, -v).otherwise(v))

    return let(_drop(_strip(_drop(F.coalesce(text, F.lit("")), STRICT_MARKS)), r"[\x00-\x1F\x7F]"), signed)


def price(text: Column, places: int = 2) -> Column:
    """Amount on a price list, rounded to 2 (or 4) places; unreadable is null."""
    two = r"\d{2}$"

    def dotted(s: Column) -> Column:
        comma, dot = _has(s, ","), _has(s, ".")
        both = comma & dot
        decimal_comma = r"^([^,]*),"
        return (
            F.when(both & _comma_last(s) & s.rlike("," + two), F.regexp_replace(_drop(s, r"\."), decimal_comma, "$1."))
            .when(both & _comma_last(s), _drop(s, ","))
            .when(both & s.rlike(r"\." + two), _drop(s, ","))
            .when(both, _drop(s, r"\."))
            .when(comma & _one_comma(s) & ~s.rlike("," + two) & (F.length(_after_comma(s)) > 2), _drop(s, ","))
            .otherwise(F.regexp_replace(s, decimal_comma, "$1."))
        )

    def read(t: Column) -> Column:
        s = let(F.trim(_drop(_drop(t, "^-"), PRICE_MARKS)), dotted)
        lead = F.regexp_extract(s, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
        return let(lead, lambda v: round_half_up(F.when(t.startswith("-"), -v).otherwise(v), places))

    return let(F.trim(text), read)


STYLES = {"unified": unified, "strict_eu": strict_eu, "price": price}


def parse(text: Column, style: str) -> Column:
    return STYLES[style](text)


def whole_quantity(text: Column) -> Column:
    """Leading integer of a quantity: "15,00" and "15 pcs" are 15, else null."""
    return F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("long")


def amount_in_text(text: Column) -> Column:
    """First amount with at least two decimals inside a text, as a price."""
    return price(F.regexp_extract(text, r"(?i)(?:€|eur)?\s*(\d+[.,]\d{2,})", 1))


def fee_in_text(text: Column) -> Column:
    """First number of a cell (decimals optional) as a positive price, else null."""
    found = price(F.regexp_extract(text, r"€?\s*(\d+(?:[.,]\d+)?)", 1))
    return let(found, lambda v: F.when(v > 0, v))


def grouped_amount(text: Column) -> Column:
    """Amount with grouped thousands, either separator, optional cents.

    Anything else is read as a plain number with a decimal comma; unreadable
    text is 0.00.  The result is a two-place decimal.
    """
    grouped = r"^(\d{1,3}(?:[.,]\d{3})*)(?:[.,](\d{2}))?$"

    def read(s: Column) -> Column:
        whole = _drop(F.regexp_extract(s, grouped, 1), "[.,]")
        cents = first_text(F.regexp_extract(s, grouped, 2), F.lit("00"))
        return F.when(s.rlike(grouped), F.concat(whole, F.lit("."), cents)).otherwise(_swap_comma(s))

    amount = let(_drop(text, " "), read).try_cast("decimal(18,2)")
    return F.coalesce(amount, F.lit(0).cast("decimal(18,2)"))


def as_text(value: Column) -> Column:
    """A number the way extracted records carry it: integral values without point."""
    return let(value, lambda v: F.when(v == F.floor(v), v.cast("long").cast("string"))
               .otherwise(v.cast("string")))
