"""Writing results: parent/child inserts, child replacement, cell updates, logs.

Every function that changes a table returns the new table as a DataFrame; the
``write_*`` helpers store one.  Storage is plain Parquet, so a change is "new
content into a new version folder", and readers of the old one are undisturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.operators.keyed import rows_with_key


def cell_updates(updates: DataFrame, tab: str = "Sheet1") -> DataFrame:
    """Register updates as single cell writes, in column order L, H, I, J, K, G.

    A null value is no write.  ``step`` keeps the order inside a row; the average
    (G) follows the others because it is computed from them.
    """
    columns = {"L": "freight_per_unit", "H": "qty_prev", "I": "qty_in", "J": "price_prev", "K": "price_new", "G": "cmp"}
    cells = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(letter).alias("letter"),
                               F.col(name).cast("double").alias("value"))
                      for step, (letter, name) in enumerate(columns.items())])
    return (
        updates.select("invoice_id", "row_index", F.inline(cells))
        .filter("value is not null")
        .withColumn("range", F.format_string("%s!%s%d", F.lit(tab), "letter", "row_index"))
        .select("invoice_id", "row_index", "step", "range", "value")
    )


def insert_invoices(invoices: DataFrame, items: DataFrame, at: Column) -> dict[str, DataFrame]:
    """New parents, their children and one upload log per parent."""
    logs = invoices.select("invoice_id", F.lit("UPLOAD").alias("type"), F.lit("SUCCESS").alias("status"),
                           F.lit("Invoice uploaded").alias("message"), at.alias("created_at"))
    children = rows_with_key(items, invoices, ["invoice_id"])
    return {"invoices": invoices, "items": children, "logs": logs}


def update_invoices(invoices: DataFrame, changes: DataFrame) -> DataFrame:
    """Parents with the provided fields replaced.

    Dates, status and supplier change only to a non-empty value; amounts change
    to whatever is provided, also to 0.
    """
    renamed = changes.select("invoice_id", *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != "invoice_id"])
    out = invoices.join(renamed, "invoice_id", "left")
    values = {}
    for c in changes.columns:
        if c == "invoice_id":
            continue
        new = F.col(f"_new_{c}")
        if dict(changes.dtypes)[c] == "string":
            new = F.nullif(new, F.lit(""))
        values[c] = F.coalesce(new, F.col(c))
    return out.withColumns(values).select(*invoices.columns)


def replace_children(items: DataFrame, new_items: DataFrame) -> DataFrame:
    """All lines of every invoice in ``new_items`` replaced by the new ones."""
    return rows_with_key(items, new_items, ["invoice_id"], present=False).unionByName(new_items)


def drop_children(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Lines without those of the given invoices (before they are parsed again)."""
    return rows_with_key(items, invoices, ["invoice_id"], present=False)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A table's new content in its own folder; returns the folder."""
    path = f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_export(df: DataFrame, path: str) -> None:
    """Export rows as CSV with a header (blank, SKU, Quantity)."""
    df.select(F.lit(None).cast("string").alias(" "), F.col("sku").alias("SKU"), F.col("quantity").alias("Quantity")) \
        .write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files in printing order."""
    lines.sort("invoice_id", "section", "order").select("text").write.mode("overwrite").text(path)


def write_snapshot(tables: dict[str, DataFrame], root: str, day: str) -> None:
    """The four cost tables of a day: CMP, sales, margins, purchases."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/day={day}")
