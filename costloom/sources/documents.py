"""Documents as rows: whole texts, ordered lines, token tables, XML invoices."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.functions.falsy import number_prefix


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row per document (doc_id is the file name)."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line, in order; the other columns of the document are kept."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def join_pages(pages: DataFrame) -> DataFrame:
    """Page texts (doc_id, page, text) of a document joined by line breaks."""
    ordered = F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def ledger_cells(lines: DataFrame, columns: int = 10) -> DataFrame:
    """Cells (columns B, C, ...) of a register exported as headerless CSV lines.

    The row number is the first cell of a line, so it does not depend on how the
    export is split for reading.  Short lines have null in the cells they lack.
    """
    schema = ", ".join(["row_index int"] + [f"c{i} string" for i in range(columns)])
    raw = lines.select(F.from_csv("value", schema, {"escape": '"', "mode": "PERMISSIVE"}).alias("r"))
    return raw.select("r.row_index", F.array(*[f"r.c{i}" for i in range(columns)]).alias("cells"))


def read_ledger_cells(spark: SparkSession, path: str, columns: int = 10) -> DataFrame:
    """``ledger_cells`` of an exported file or folder."""
    return ledger_cells(spark.read.text(path), columns)


def parse_ledger(cells: DataFrame) -> DataFrame:
    """Typed register rows from ragged cells B..K; unreadable numbers are null,
    only the previous quantity becomes 0."""
    def cell(i):
        return F.get("cells", F.lit(i))

    return cells.select(
        "row_index",
        F.coalesce(cell(0), F.lit("")).alias("sku_internal"), F.coalesce(cell(3), F.lit("")).alias("supplier_skus"),
        number_prefix(cell(5)).alias("cmp"), F.coalesce(number_prefix(cell(6)), F.lit(0.0)).alias("qty_prev"),
        number_prefix(cell(7)).alias("qty_in"), number_prefix(cell(8)).alias("price_prev"),
        number_prefix(cell(9)).alias("price_new"))


LINE_XML = """struct<
  SpecifiedTradeProduct: struct<SellerAssignedID: string, Name: string>,
  SpecifiedLineTradeAgreement: struct<NetPriceProductTradePrice: struct<ChargeAmount: string>>,
  SpecifiedLineTradeDelivery: struct<BilledQuantity: string>,
  SpecifiedLineTradeSettlement: struct<ApplicableTradeTax: struct<RateApplicablePercent: string>,
    SpecifiedTradeSettlementLineMonetarySummation: struct<LineTotalAmount: string>>>"""
XML_SCHEMA = f"""
ExchangedDocument struct<ID: string, IssueDateTime: struct<DateTimeString: string>>,
SupplyChainTradeTransaction struct<
  IncludedSupplyChainTradeLineItem: array<{LINE_XML}>,
  ApplicableHeaderTradeAgreement: struct<SellerTradeParty: struct<Name: string>>,
  ApplicableHeaderTradeSettlement: struct<InvoiceCurrencyCode: string,
    SpecifiedTradeSettlementHeaderMonetarySummation: struct<LineTotalAmount: string, GrandTotalAmount: string>>>
"""


def electronic_invoices(docs: DataFrame) -> DataFrame:
    """Lines of embedded electronic invoices: ``docs`` has doc_id and xml.

    The unit price includes VAT, round(net * (1 + rate / 100), 2); lines without
    SKU, name, quantity, price or total are left out.
    """
    plain = F.regexp_replace("xml", r"<(/?)\w+:", "<$1")
    doc = docs.select("doc_id", F.from_xml(plain, XML_SCHEMA).alias("x"))
    head, trade = F.col("x.ExchangedDocument"), F.col("x.SupplyChainTradeTransaction")
    settled = trade["ApplicableHeaderTradeSettlement"]
    totals = settled["SpecifiedTradeSettlementHeaderMonetarySummation"]
    line = F.col("line")
    net = line["SpecifiedLineTradeAgreement"]["NetPriceProductTradePrice"]["ChargeAmount"].try_cast("decimal(18,6)")
    rate = line["SpecifiedLineTradeSettlement"]["ApplicableTradeTax"]["RateApplicablePercent"].try_cast("decimal(8,4)")
    rows = doc.select(
        "doc_id", head["ID"].alias("invoice_number"),
        F.try_to_date(head["IssueDateTime"]["DateTimeString"], "yyyyMMdd").alias("invoice_date"),
        trade["ApplicableHeaderTradeAgreement"]["SellerTradeParty"]["Name"].alias("vendor"),
        settled["InvoiceCurrencyCode"].alias("currency"),
        totals["LineTotalAmount"].try_cast("double").alias("subtotal"),
        totals["GrandTotalAmount"].try_cast("double").alias("total"),
        F.posexplode(trade["IncludedSupplyChainTradeLineItem"]).alias("pos", "line"))
    typed = rows.select(
        *[c for c in rows.columns if c != "line"],
        line["SpecifiedTradeProduct"]["SellerAssignedID"].alias("sku"),
        line["SpecifiedTradeProduct"]["Name"].alias("name"),
        line["SpecifiedLineTradeDelivery"]["BilledQuantity"].try_cast("double").alias("quantity"),
        F.round(net * (1 + F.coalesce(rate, F.lit(0).cast("decimal(8,4)")) * F.lit("0.01").cast("decimal(3,2)")), 2)
        .cast("double").alias("unit_price"),
        line["SpecifiedLineTradeSettlement"]["SpecifiedTradeSettlementLineMonetarySummation"]["LineTotalAmount"]
        .try_cast("double").alias("line_total"))
    return typed.dropna(subset=["sku", "name", "quantity", "unit_price", "line_total"])
