"""Read-side reports over invoices, logs, jobs and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions.text import escape_html
from costloom.operators.keyed import join_on_key
from costloom.operators.ordered import row_numbers


def latest_log(logs: DataFrame) -> DataFrame:
    """Newest log per invoice (largest id on the same instant)."""
    return logs.groupBy("invoice_id").agg(F.max_by(
        F.struct("log_id", "status", "message", "created_at"), F.struct("created_at", "log_id")).alias("last_log"))


def history_rows(invoices: DataFrame, logs: DataFrame) -> DataFrame:
    """History list: status in lower case, and the log message only when the
    newest log is an error."""
    last = F.col("last_log")
    return join_on_key(invoices, latest_log(logs), ["invoice_id"]).withColumns({
        "status": F.lower("status"),
        "error_message": F.when(last["status"] == "ERROR", last["message"]),
    })


def invoice_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("units"))


def job_totals(jobs: DataFrame) -> DataFrame:
    """Number of jobs, in total and per status, in one pass."""
    n = lambda s: F.count_if(F.col("status") == s)
    return jobs.agg(F.count(F.lit(1)).alias("total"), n("PENDING").alias("pending"), n("PROCESSING").alias("processing"),
                    n("COMPLETED").alias("completed"), n("FAILED").alias("failed"))


def job_totals_by_type(jobs: DataFrame, types: list[str]) -> DataFrame:
    """Counts for a fixed list of types; a type without jobs keeps its row of zeros."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = jobs.filter(F.col("type").isin(types)).groupBy("type").agg(
        F.count(F.lit(1)).alias("total"), n("PENDING").alias("pending"), n("COMPLETED").alias("completed"),
        n("FAILED").alias("failed"))
    wanted = jobs.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return wanted.join(counted, "type", "left").fillna(0)


def eligible(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "PENDING") & (F.col("attempts") < F.col("max_attempts")))


def next_jobs(jobs: DataFrame) -> DataFrame:
    """Oldest eligible job of every type."""
    rest = [c for c in jobs.columns if c != "type"]
    return eligible(jobs).groupBy("type").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "job_id")).alias("j")).select("type", "j.*")


def transition(jobs: DataFrame, chosen: Column, action: str, at: Column, note: Column | None = None) -> DataFrame:
    """Jobs after ``start`` / ``complete`` / ``fail`` / ``retry`` of the chosen ones."""
    nothing = F.lit(None)
    change = {
        "start": {"status": F.lit("PROCESSING"), "started_at": at, "attempts": F.col("attempts") + 1},
        "complete": {"status": F.lit("COMPLETED"), "result": note, "completed_at": at},
        "fail": {"status": F.lit("FAILED"), "error": note, "completed_at": at},
        "retry": {"status": F.lit("PENDING"), "error": nothing, "attempts": F.lit(0),
                  "started_at": nothing, "completed_at": nothing},
    }[action]
    return jobs.withColumns({
        name: F.when(chosen, value).otherwise(F.col(name))
        for name, value in change.items() if value is not None and name in jobs.columns})


def expired(jobs: DataFrame, as_of: Column, days: int = 30) -> Column:
    """Completed more than ``days`` ago (``as_of`` is passed in, never "now")."""
    age = as_of - F.make_dt_interval(F.lit(days))
    return (F.col("status") == "COMPLETED") & (F.col("completed_at") < age)


def unmapped_counts(unmapped: DataFrame) -> DataFrame:
    """Per unmapped SKU: count, last seen, supplier of the latest item."""
    return unmapped.groupBy("sku").agg(
        F.count(F.lit(1)).alias("n"), F.max("seen_at").alias("last_seen"),
        F.max_by("supplier_name", F.struct("seen_at", "pos")).alias("supplier_name"))


def mapping_stats(aliases: DataFrame, unmapped: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Figures of the SKU mappings: ``figure``, ``supplier``, ``n``.

    ``total`` counts all mappings, ``supplier`` those of each brand (blank ones as
    Unknown), most first, and ``recent unmapped`` the items without a product whose
    invoice came in during the last ``days`` days.  Needs brand, and seen_at.
    """
    brand = F.coalesce(F.nullif("brand", F.lit("")), F.lit("Unknown"))
    counted = aliases.groupBy(brand.alias("supplier")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("supplier").alias("figure"), "supplier", "n")
    none = F.lit(None).cast("string").alias("supplier")
    total = aliases.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("figure"), none, "n")
    recent = unmapped.filter(F.col("seen_at") >= as_of - F.make_dt_interval(F.lit(days))).agg(F.count(F.lit(1)).alias("n"))
    rows = total.unionByName(counted).unionByName(recent.select(F.lit("recent unmapped").alias("figure"), none, "n"))
    return rows.orderBy(F.array_position(F.array(*map(F.lit, ("total", "supplier", "recent unmapped"))), F.col("figure")), F.desc("n"), "supplier")


def invoice_logs(invoices: DataFrame, logs: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Logs with their invoice's status and ``place`` (1 is the newest of its invoice)."""
    own = logs.select("invoice_id", "log_id", F.col("status").alias("log_status"), "message", "created_at")
    rows = join_on_key(own, invoices.select("invoice_id", "status"), ["invoice_id"], "inner")
    down = rows.withColumns({"_at": -F.unix_micros(F.col("created_at").cast("timestamp")), "_id": -F.col("log_id")})
    return row_numbers(down, ["invoice_id"], ["_at", "_id"], "place", max_rows, logs.select("invoice_id"))


def unmapped_skus(unmapped: DataFrame, limit: int = 50) -> DataFrame:
    """Most frequent unmapped SKUs: count, last seen, supplier of the latest.

    All unmapped items are counted.  Needs sku, seen_at, supplier_name and ``pos``
    (a total order).
    """
    return unmapped_counts(unmapped).orderBy(F.col("n").desc(), "sku").limit(limit)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page (1-based) of an ordered result, for the first few pages: every page
    before it is sorted along.  ``page_after`` leads to late ones."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, after: dict | None = None) -> DataFrame:
    """One page of an ordered result: the first ``size`` rows behind the row ``after``.

    ``order`` lists (column, descending); together the columns identify a row.
    ``after`` has the columns of the last row of the page before (none: the first
    page), so a late page costs as much as an early one.
    """
    if after:
        behind, equal = F.lit(False), F.lit(True)
        for name, down in order:
            value = F.lit(after[name])
            behind |= equal & ((F.col(name) < value) if down else (F.col(name) > value))
            equal &= F.col(name) == value
        df = df.filter(behind)
    return df.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order]).limit(size)


def outcome_message(supplier: Column, success: Column, total: Column, items: Column,
                    warnings: Column, error: Column) -> dict[str, Column]:
    """Subject, text and HTML of a parsing outcome; absent parts are left out."""
    amount = F.format_string("%.2f", total)
    body = F.when(success, F.concat_ws(
        "\n", F.lit("Parsing succeeded"), F.concat(F.lit("Supplier: "), supplier),
        F.concat(F.lit("Total: "), F.when(total.isNotNull(), amount), F.lit(" EUR")),
        F.concat(F.lit("Items: "), F.coalesce(items, F.lit(0)).cast("string")),
        F.concat(F.lit("Warnings: "), F.when(F.size(warnings) > 0, F.array_join(warnings, " | "))),
    )).otherwise(F.concat_ws(
        "\n", F.lit("Parsing failed"), F.concat(F.lit("Supplier: "), supplier),
        F.concat(F.lit("Total: "), F.when(total.isNotNull(), amount), F.lit(" EUR")),
        F.concat(F.lit("Error: "), F.nullif(error, F.lit("")))))
    lines = F.split(body, "\n")
    entries = F.transform(F.slice(lines, 2, F.size(lines)), lambda line: F.concat(
        F.lit("<li>"), escape_html(line), F.lit("</li>")))
    head = F.when(success, "Parsing succeeded").otherwise("Parsing failed")
    return {
        "subject": F.concat(F.when(success, "PDF parsed successfully · ").otherwise("PDF parsing failed · "), supplier),
        "text": body,
        "html": F.concat(F.lit("<h2>"), head, F.lit("</h2><ul>"), F.array_join(entries, ""), F.lit("</ul>")),
    }
