"""Text repair and field extraction as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from costloom.functions.falsy import let


def normalize_sku(sku: Column) -> Column:
    """Trimmed, inner white space collapsed to one blank, upper case."""
    return F.upper(F.trim(F.regexp_replace(sku, r"\s+", " ")))


def split_skus(cell: Column) -> Column:
    """The normalised non-empty SKUs of a delimited ledger cell."""
    parts = F.transform(F.split(cell, r"[,;/|]"), normalize_sku)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda s: s != "")


def tidy_lines(text: Column) -> Column:
    """White space collapsed and trimmed line by line, line breaks kept."""
    blanks = F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")
    tidy = F.trim(F.regexp_replace(blanks, " ?\n ?", "\n"))
    # Most texts are one line with single blanks.
    return F.coalesce(F.when(~text.rlike(r"[\t-\r]|  "), F.trim(text)).otherwise(tidy), F.lit(""))


def tidy_text(text: Column) -> Column:
    """Blanks and tabs collapsed, line ends made uniform, outer white space cut."""
    s = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\r\n?", "\n")
    return F.coalesce(F.regexp_replace(s, r"^\s+|\s+\z", ""), F.lit(""))


def undouble(text: Column) -> Column:
    """Every pair of equal neighbours becomes one character ("RRaaww" -> "Raw")."""
    return F.coalesce(F.regexp_replace(text, r"(?s)(.)\1", "$1"), F.lit(""))


def undouble_guarded(text: Column) -> Column:
    """Doubling repaired only where the whole text looks doubled.

    A repeated digit ("99") is a number and stays.  Fully paired texts of four or
    more characters are halved.  Otherwise more than 40 % of the characters must
    repeat their neighbour, and white space is never halved.
    """
    n = F.length(text)
    number = text.rlike(r"^(\d)\1+\z")
    paired = (n % 2 == 0) & (n >= 4) & text.rlike(r"(?s)^(?:(.)\1)+\z")
    head = F.substring(text, F.lit(1), n - 1)
    solid = F.length(F.regexp_replace(head, r"[ \n\t]", ""))
    repeats = n - F.length(F.regexp_replace(text, r"(?s)([^ \n\t])(?=\1)", ""))
    mostly = (solid > 5) & (repeats > solid * 0.4)
    return (
        F.when((n < 2) | number, text)
        .when(paired, F.regexp_replace(text, r"(?s)(.)\1", "$1"))
        .when(mostly, F.regexp_replace(text, r"(?s)([^ \n\t])\1", "$1"))
        .otherwise(text)
    )


def regex_field(text: Column, pattern: str, group: int = 1) -> Column:
    """Trimmed group of the first match, ignoring case, line by line; else null.

    An empty match counts as missing, as everywhere in the extracted records.
    """
    found = F.trim(F.regexp_extract(text, "(?im)" + pattern, group))
    return F.nullif(found, F.lit(""))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9.\-]", "_")


def pseudo_sku(description: Column, prefix: str) -> Column:
    """Stable SKU for suppliers without one: 32-bit text hash in hex.

    The hash is the usual ``31 * h + code`` over the characters, wrapped to a
    signed 32-bit integer after every step.
    """
    codes = F.transform(
        F.filter(F.split(description, ""), lambda c: c != ""), lambda c: F.ascii(c)
    )
    h = F.aggregate(
        codes,
        F.lit(0).cast("long"),
        lambda acc, c: F.pmod(acc * 31 + c + F.lit(2**31), F.lit(2**32)) - F.lit(2**31),
    )
    return F.concat(F.lit(prefix), F.substring(F.hex(F.abs(h)), 1, 8))


def escape_html(text: Column) -> Column:
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                        ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def json_object_text(noisy: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a noisy output, null if none."""
    return F.nullif(F.regexp_extract(noisy, r"(?s)\{.*\}", 0), F.lit(""))


def last_json_line(noisy: Column) -> Column:
    """Last line that looks like one JSON object, else the whole text."""
    lines = F.filter(F.split(noisy, "\n"), lambda s: F.trim(s).rlike(r"^\{.*\}$"))
    return F.when(F.size(lines) > 0, F.trim(F.element_at(lines, -1))).otherwise(noisy)


def longest_code(line: Column) -> Column:
    """Longest code-like token of a line (two capitals, then capitals, digits,
    dashes), the first one on a tie, null if there is none."""
    tokens = F.regexp_extract_all(line, F.lit(r"(?<![\p{L}\p{N}_])([A-Z]{2,}[0-9A-Z\-_]*)"), 1)
    ranked = F.transform(tokens, lambda t, i: F.struct(
        F.length(t).alias("size"), (-i).alias("place"), t.alias("token")))
    return F.array_max(ranked)["token"]


def amounts(text: Column) -> Column:
    """Every amount with two decimals, in reading order."""
    return F.regexp_extract_all(text, F.lit(r"(\d+[.,]\d{2})"), 1)


def last_two_amounts(text: Column) -> tuple[Column, Column]:
    """(unit price, total): the last two amounts of a block, blank unless two exist."""
    found = amounts(text)
    enough = F.size(found) >= 2
    return (F.when(enough, F.try_element_at(found, F.lit(-2))).otherwise(""),
            F.when(enough, F.try_element_at(found, F.lit(-1))).otherwise(""))


def triples(values: Column) -> Column:
    """A flat list read as (net, gross, total) triples; a short rest is dropped."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0))),
                      lambda i: (i % 3 == 0) & (i + 2 < F.size(values)))
    return F.transform(starts, lambda i: F.struct(
        F.get(values, i).alias("net"), F.get(values, i + 1).alias("gross"),
        F.get(values, i + 2).alias("total")))


def zip_lines(shortest: bool, **cells: Column) -> Column:
    """Multi-line cells of one table row as an array of rows.

    The shortest cell decides how many rows there are, or the longest one with
    blanks filling the others.
    """
    split = F.struct(*[F.split(F.coalesce(c, F.lit("")), "\n").alias(name) for name, c in cells.items()])

    def rows(parts: Column) -> Column:
        sizes = [F.size(parts[name]) for name in cells]
        n = F.least(*sizes) if shortest else F.greatest(*sizes)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[
            F.coalesce(F.get(parts[name], i), F.lit("")).alias(name) for name in cells]))

    return let(split, rows)


def split_sku(line: str, next_line: str, second_line: str) -> list[Column]:
    """(sku, description) of a line with ``SKU:``, whose code may be broken.

    Tried in order: the whole code on the line; a prefix on the line and the rest
    below; the whole code below; a prefix below and the rest one line further.
    """
    text, n1, n2 = F.trim(line), F.trim(next_line), F.trim(second_line)
    prefix = lambda c, p: F.regexp_replace(F.regexp_extract(c, p, 1), "-$", "")
    rest = lambda c: F.regexp_extract(c, r"^([A-Z0-9.]{3,})", 1)

    def joined(head: Column, tail: Column) -> Column:
        return F.when((head != "") & (tail != ""), F.concat_ws("-", head, tail))

    here = F.nullif(F.regexp_extract(text, r"SKU:\s*([A-Z]{2,4}-[A-Z0-9]+)", 1), F.lit(""))
    broken = joined(prefix(text, r"SKU:\s*([A-Z]{2,4}-?)$"), rest(n1))
    bare = text.endswith("SKU:")
    below = F.nullif(F.regexp_extract(n1, r"^([A-Z]{2,4}-[A-Z0-9]+)$", 1), F.lit(""))
    twice = joined(prefix(n1, r"^([A-Z]{2,4}-?)$"), rest(n2))
    sku = F.coalesce(here, broken, F.when(bare, below), F.when(bare, twice))
    description = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*-?\s*SKU:.*$", "")), r"^[- ]+", "")
    return [sku.alias("sku"), description.alias("description")]


# What a manufacturer's name never contains.
NOT_A_NAME = [
    "€", r"\d{4}-\d{2}-\d{2}", r"^(page|total|invoice|date|kg|grams|ml|pieces)\b", r"^\d+$", r"^[^a-zA-Z]*$",
    "chemin de", r"\b(street|avenue|road|boulevard|chemin|rue|place)\b",
    r"\b(france|germany|usa|uk|netherlands|belgium)\b", r"\b\d{5}\b", r"\+\d{8,}", r"VAT\s*(EU|FR|DE|NL)",
]


def plausible_name(name: Column, also_not: list[str] = ()) -> Column:
    """At least three characters with a letter, and none of the excluded patterns
    (``also_not`` adds a house's own names and addresses)."""
    pattern = "(?iU)" + "|".join([*NOT_A_NAME, *also_not])
    return (F.length(name) >= 3) & name.rlike("[a-zA-Z]") & ~name.rlike(pattern)


def valid_upload(name: Column, mime: Column, size: Column, limit: int = 10 * 1024 * 1024) -> Column:
    """A PDF by type or extension, not larger than ``limit``, named ``*.pdf``."""
    extension = F.lower(name).endswith(".pdf")
    return (F.contains(mime, F.lit("pdf")) | extension) & (size <= limit) & extension


def line_pairs(lines: Column) -> Column:
    """Lines joined two by two with a blank; an odd last line stays alone."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(2))
    return F.when(F.size(lines) > 0, F.transform(starts, lambda i: F.array_join(F.slice(lines, i + 1, 2), " ")))
