"""Dates as suppliers write them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from costloom.functions.falsy import let

# Month names by number, English, Dutch and French, long names first.
MONTHS = {
    "01": ["january", "januari", "janvier", "jan"],
    "02": ["february", "februari", "février", "fevrier", "feb"],
    "03": ["march", "maart", "mars", "mar"],
    "04": ["april", "avril", "apr"],
    "05": ["may", "mei", "mai"],
    "06": ["june", "juni", "juin", "jun"],
    "07": ["july", "juli", "juillet", "jul"],
    "08": ["august", "augustus", "août", "aout", "aug"],
    "09": ["september", "septembre", "sept", "sep"],
    "10": ["october", "oktober", "octobre", "oct", "okt"],
    "11": ["november", "novembre", "nov"],
    "12": ["december", "décembre", "decembre", "dec"],
}


def normalize_date(text: Column) -> Column:
    """ISO text from day-month-year, year-first or month-name dates.

    The four-digit side is the year; a two-digit year is put in this century.
    The calendar is not checked, so "31-02-2024" passes through.  Month names count
    as whole words only, so a weekday ("mardi") is no month.
    """
    def digits(s: Column) -> Column:
        for number, names in MONTHS.items():
            s = F.regexp_replace(s, r"(?<!\p{L})(?:" + "|".join(names) + r")(?!\p{L})", number)
        return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\d\-/.]", " "), r"\s+", " "))

    # Most dates are digits and marks, where there is nothing to replace.
    s = let(F.lower(F.trim(text)), lambda t: F.when(t.rlike(r"\A[\d\-/.]+\z"), t).otherwise(digits(t)))

    def two(x: Column) -> Column:
        return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)

    def iso(part: Column) -> Column:
        a, b, c = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(2))
        year_first = F.length(a) == 4
        year = (
            F.when(year_first, a)
            .when(F.length(c) == 4, c)
            .when(c.try_cast("int") < 100, F.concat(F.lit("20"), c))
            .otherwise(F.when(c != "", c))
        )
        day = F.when(year_first, c).otherwise(a)
        complete = (F.size(part) == 3) & year.isNotNull()
        return F.when(complete, F.concat_ws("-", year, two(b), two(day)))

    return let(F.split(s, r"[\-/.\s]", -1), iso)


def parse_date(text: Column) -> Column:
    """Calendar-checked date from D.M.Y, D/M/Y, D-M-Y or the year-first forms."""
    s = F.trim(text)
    day_first = r"^(\d{1,2})([./\-])(\d{1,2})\2(\d{4})$"
    year_first = r"^(\d{4})([./\-])(\d{1,2})\2(\d{1,2})$"
    iso = F.when(s.rlike(day_first), F.regexp_replace(s, day_first, "$4-$3-$1")) \
        .when(s.rlike(year_first), F.regexp_replace(s, year_first, "$1-$3-$4"))
    return F.try_to_date(iso, "yyyy-M-d")


def compact_date(text: Column) -> Column:
    """Date written YYYYMMDD, null when it is not one."""
    return F.try_to_date(F.when(text.rlike(r"^\d{8}$"), text), "yyyyMMdd")
