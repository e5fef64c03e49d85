"""Order-dependent and document operators on small cases worked out by hand."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from costloom.operators import allocate, cost, extract, layout, match, projections, quality, report, sinks
from costloom.plans.roles import ITEM_ORDER, Roles
from costloom.sources import documents
from costloom.sources.rules import read_rules
from costloom.streaming import arrivals, costs, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def ledger(spark, data):
    return spark.createDataFrame(data, "row_index int, sku_internal string, supplier_skus string, cmp double, qty_prev double,"
                                       " qty_in double, price_prev double, price_new double")


def items(spark, data):
    df = spark.createDataFrame(data, "invoice_id long, line_no int, sku string, quantity double, unit_price double")
    return df.withColumns({"supplier_id": F.lit(1), "part_id": F.lit(1), "total": F.col("quantity") * F.col("unit_price")})


def invoices(spark, data):
    return spark.createDataFrame(data, "invoice_id long, invoice_date string, shipping_fee double, discount double")


def test_register_shift_and_average(spark):
    led = ledger(spark, [(2, "P1", " a1 ; A2", None, 7.0, 10.0, None, 3.0), (3, "P2", "b", None, 4.0, None, None, None),
                         (4, "P3", "c,c", None, 0.0, None, None, None), (5, "P4", "b", None, 0.0, None, None, None),
                         (6, "P5", "d", None, 5.0, None, 2.0, None)])
    it = items(spark, [(1, 1, " A1", 20.0, 3.3), (1, 2, "b", 1.0, 1.0), (1, 3, "C", 1.0, 1.0), (1, 4, "zz", 0.0, 1.0), (1, 5, "d", -2.0, 1.0)])
    inv = invoices(spark, [(1, "2024-01-01", 6.0, 0.0)])
    checked = cost.checked_items(it, inv, led)
    assert rows(checked, "line_no", "outcome") == [(1, "ok"), (2, "ambiguous"), (3, "ambiguous"), (4, "not_found"), (5, "error")]
    got = cost.register_shift(checked).select("qty_prev", "qty_in", "price_prev", "price_new", "cmp").first()
    # Fee 6 over 20 + 1 + 1 + 0 - 2 = 20 units; 10 @ 3.00 on stock meet 20 @ 3.60.
    assert (got.qty_prev, got.qty_in, got.price_prev) == (10.0, 20.0, 3.0)
    assert got.price_new == pytest.approx(3.6) and got.cmp == pytest.approx(3.4)
    stock = spark.createDataFrame([("P1", 100, 2), ("P1", None, 1)], "sku_internal string, on_hand int, variant int")
    with_stock = cost.register_shift(checked, stock).first()
    assert with_stock.qty_prev == 0.0 and with_stock.cmp == with_stock.price_new


def test_two_lines_on_one_ledger_row(spark):
    led = ledger(spark, [(2, "P1", "a", None, 1.0, 10.0, None, 3.0)])
    it = items(spark, [(1, 1, "a", 5.0, 2.0), (1, 2, "A ", 7.0, 4.0), (2, 1, "a", 3.0, 6.0)])
    inv = invoices(spark, [(1, "2024-01-01", 0.0, 0.0), (2, "2024-02-01", 0.0, 0.0)])
    shifted = cost.register_shift(cost.checked_items(it, inv, led))
    assert rows(shifted.filter("invoice_id = 1"), "qty_prev", "price_prev") == [(10.0, 3.0), (10.0, 3.0)]
    last = cost.last_line_wins(shifted, ITEM_ORDER)
    assert rows(last, "invoice_id", "qty_in", "price_new", "lines") == [(1, 7.0, 4.0, 2), (2, 3.0, 6.0, 1)]
    history = rows(cost.cmp_history(it, inv, led, ITEM_ORDER), "invoice_id", "qty_prev", "price_prev", "cmp")
    assert history == [(1, 10.0, 3.0, pytest.approx((30 + 28) / 17)), (2, 7.0, 4.0, pytest.approx((28 + 18) / 10))]
    assert rows(cost.current_cmp(it, inv, led, ITEM_ORDER), "invoice_id", "cmp") == [(2, pytest.approx(4.6))]


def test_perpetual_average(spark):
    bought = spark.createDataFrame([("p", 1, 10.0, 3.0), ("p", 2, 20.0, 3.6)], "k string, n int, quantity double, landed_price double")
    assert [r[0] for r in cost.perpetual_average(bought, "k", ["n"]).orderBy("n").select("average_cost").collect()] == pytest.approx([3.0, 3.4])


@pytest.mark.parametrize("limit", [None, 2])
def test_average_with_sales(spark, limit):
    moves = spark.createDataFrame([("p", 0, -1.0, None), ("p", 1, 10.0, 3.0), ("p", 2, -9.0, None), ("p", 3, 20.0, 3.6),
                                   ("p", 4, -20.0, None), ("p", 5, 5.0, 9.0), ("q", 1, 1.0, 7.0)], "k string, n int, change double, price double")
    got = {(r.k, r.n): r.average_cost for r in cost.average_with_sales(moves, "k", ["n"], max_rows=limit).collect()}
    assert got[("p", 0)] is None and got[("p", 1)] == 3.0 and got[("p", 2)] == 3.0
    assert got[("p", 3)] == pytest.approx(3.6)  # nothing was left on stock
    assert got[("p", 5)] == pytest.approx(9.0) and got[("q", 1)] == 7.0


def test_allocations_add_up(spark):
    it = items(spark, [(1, 1, "a", 3.0, 10.0), (1, 2, "b", 0.0, 5.0), (1, 3, "c", 7.0, 2.5)])
    inv = invoices(spark, [(1, "2024-01-01", 12.0, -9.5)])
    for mode in ("proportional", "equal"):
        out = allocate.spread_discount(it, inv, mode)
        assert out.agg(F.sum("adj_total") - F.sum("total")).first()[0] == pytest.approx(-9.5)
    landed = allocate.landed_price(it, inv)
    assert landed.agg(F.sum(F.col("freight_per_unit") * F.col("quantity"))).first()[0] == pytest.approx(12.0)


def test_printed_invoice(spark):
    rule = {"vendor": {"name": "Shop", "language": "en"}, "preprocess": None,
            "header": {"fields": [{"name": "number", "regex": r"Invoice Number:\s*(\d+)"}, {"name": "date", "regex": r"Date:\s*([\d.]+)", "type": "date"}]},
            "table": {"strategy": "text_regex", "start_marker": "^Items", "end_marker": "Subtotal",
                      "row_pattern": r"^(?P<sku>[A-Z]\d+) (.+?) (\d+) x ([\d.,]+)(?: ([\d.,]+))?$",
                      "columns": [{"name": "sku", "regex_group": 1}, {"name": "description", "regex_group": 2},
                                  {"name": "quantity", "regex_group": 3, "type": "number"}, {"name": "unit_price", "regex_group": 4, "type": "number"},
                                  {"name": "total", "regex_group": 5, "type": "number"}]},
            "footer": {"fields": [{"name": "total", "regex": r"^Total\s*([\d.,]+)"}]}}
    folder = spark_tmp(spark)
    spark.createDataFrame([(json.dumps(rule),)], "value string").coalesce(1).write.text(f"{folder}/rules")
    rules = read_rules(spark, f"{folder}/rules")
    text = ("Invoice Number: 77\nDate: 30.10.2024\nA0 outside 1 x 1\nITEMS\nA1 Bar 990 x 0,7950 787.05\nA2 Cup 2 x 1,50\nFID: 5\n"
            "A3 CourierDelivery 1 x 9 356.00\nSubtotal 1\nA9 Bar 1 x 1\nItems\nA4 Bar 1 x 2,00 2,00\nTotal 1.143,05")
    docs = spark.createDataFrame([("d", " SHOP", text)], "doc_id string, vendor string, text string")
    ruled = extract.prepared(docs, rules).select(extract.fields(F.col("text"), F.col("header")).alias("h"), extract.fields(F.col("text"), F.col("footer")).alias("f")).first()
    assert ruled.h == {"number": "77", "date": "2024-10-30"} and ruled.f == {"total": "1143.05"}
    lines = documents.lines_of(docs)
    for limit in (None, 3):
        got = rows(extract.text_items(lines, rules, limit), "sku", "quantity", "unit_price", "total")
        assert got == [("5", "2", "1.5", "3.00"), ("A1", "990", "0.795", "787.05"), ("A4", "1", "2", "2")]
    found = extract.row_items(extract.table_lines(extract.prepared(lines, rules)))
    assert rows(extract.shipping_fee(extract.classify(found)), "shipping_fee") == [(356.0,)]


def spark_tmp(spark):
    return tables.work_folder(spark)


def test_negative_lines_pair_up(spark):
    data = [(1, 1, "a", 2.0, 5.0, 10.0), (1, 2, "b", 1.0, -3.0, -3.0), (1, 3, "c", 1.0, -1.0, -1.0), (1, 4, "d", 1.0, -2.0, -2.0),
            (2, 1, "x", 1.0, -4.0, -4.0), (2, 2, "y", 1.0, 6.0, 6.0)]
    df = spark.createDataFrame(data, "doc_id int, pos int, sku string, quantity double, unit_price double, total double")
    for limit in (None, 2):
        got = rows(extract.merge_negative(df, limit), "doc_id", "sku", "unit_price", "total")
        assert got == [(1, "a", 3.5, 7.0), (1, "c", -3.0, -3.0), (2, "x", -4.0, -4.0), (2, "y", 6.0, 6.0)]


def test_typed_runs(spark):
    stream = "1,00 €|2,00 €|3|4|3,00 €|8,00 €|5,00 €|6|30,00 €|7,00 €|8,00 €|9|1,00 €".split("|")
    df = spark.createDataFrame([("d", i, t, t.endswith("€")) for i, t in enumerate(stream)], "doc_id string, n int, text string, is_price boolean")
    for limit in (None, 3):
        got = rows(layout.typed_runs(df, limit), "unit_price", "quantity", "total")
        assert got == [("1,00 €", "3", "3,00 €"), ("2,00 €", "4", "8,00 €"), ("5,00 €", "6", "30,00 €")]


def test_number_triples(spark):
    df = spark.createDataFrame([([2.0, 12.0, 3.5, 42.0],), ([1.0],), ([7.0, 0.2, 3.0],)], "v array<double>")
    got = [r.b and (r.b.quantity, r.b.unit_price, r.b.total) for r in df.select(layout.best_triple_by_error(F.col("v")).alias("b")).collect()]
    assert got == [(12.0, 3.5, 42.0), None, None]


def test_first_pair_fallback(spark):
    df = spark.createDataFrame([(4.0, [10.0, 2.5]), (4.0, [100.0, 2.5]), (4.0, [2.5])], "q double, p array<double>")
    got = [tuple(r.b) if r.b else None for r in df.select(layout.first_pair(F.col("q"), F.col("p")).alias("b")).collect()]
    assert got == [(4.0, 2.5, 10.0), None, None]


def test_ledger_csv(spark):
    folder = spark_tmp(spark)
    lines = ["2,P1,x,,a;b,,1.5,10,20 pcs,3.1,3.2", "3,P2,,,c", "4,,,,,,n/a,,,,"]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(f"{folder}/ledger")
    got = documents.parse_ledger(documents.read_ledger_cells(spark, f"{folder}/ledger"))
    assert rows(got, "row_index", "sku_internal", "supplier_skus", "cmp", "qty_prev", "qty_in", "price_new")[:2] == [
        (2, "P1", "a;b", 1.5, 10.0, 20.0, 3.2), (3, "P2", "c", None, 0.0, None, None)]


def test_text_files(spark):
    folder = spark_tmp(spark)
    spark.createDataFrame([("a\nb",)], "value string").coalesce(1).write.text(f"{folder}/t")
    assert documents.read_texts(spark, f"{folder}/t").select("text").first().text.strip() == "a\nb"


def test_written_tables(spark):
    folder = spark_tmp(spark)
    it = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "invoice_id int, quantity double")
    path = sinks.write_version(it, f"{folder}/items", "1")
    new = sinks.replace_children(spark.read.parquet(path), spark.createDataFrame([(1, 9.0)], "invoice_id int, quantity double"))
    path = sinks.write_version(new, f"{folder}/items", "2")
    assert rows(spark.read.parquet(path), "invoice_id", "quantity") == [(1, 9.0), (2, 4.0)]
    assert rows(sinks.drop_children(it, it.filter("invoice_id = 1")), "invoice_id") == [(2,)]
    log = it.select("invoice_id", F.lit("INFO").alias("status"))
    sinks.append(log, f"{folder}/log")
    sinks.append(log, f"{folder}/log")
    assert spark.read.parquet(f"{folder}/log").count() == 6
    sinks.write_export(spark.createDataFrame([("a", 2)], "sku string, quantity int"), f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").first()["SKU"] == "a"
    sinks.write_snapshot({"cmp": it}, folder, "2024-01-31")
    assert spark.read.parquet(f"{folder}/cmp").count() == 3


def test_printed_report(spark, sf_dir):
    r = Roles(spark, sf_dir)
    from costloom.plans.matching import counters

    folder = spark_tmp(spark)
    one = r.items.filter("invoice_id = 1")
    sinks.write_report(quality.run_report(cost.checked_items(one, r.invoices, r.ledger), counters(), ITEM_ORDER), f"{folder}/report")
    lines = [x.value for x in spark.read.text(f"{folder}/report").collect()]
    assert "=== Invoice Processing Report ===" in lines and any(t.startswith("Not found SKUs (") for t in lines)


def test_changed_invoices(spark):
    inv = spark.createDataFrame([(1, "NEW", 5.0), (2, "NEW", 6.0)], "invoice_id int, status string, shipping_fee double")
    changes = spark.createDataFrame([(1, "", 0.0)], "invoice_id int, status string, shipping_fee double")
    assert rows(sinks.update_invoices(inv, changes), "invoice_id", "status", "shipping_fee") == [(1, "NEW", 0.0), (2, "NEW", 6.0)]


def test_canonical_record(spark):
    parsed = spark.createDataFrame([({"credit": "0.0", "discount": "-5", "total": "110", "subtotal": "100", "shipping_fee": "4"},)], "t map<string,string>")
    row = parsed.select(*projections.canonical_totals(F.col("t"))).first()
    assert (row.discount, row.tax, row.total) == (0.0, 6.0, 110.0)
    it = spark.createDataFrame([([("", "r1", None, "2 pcs", "1.5", "")],)], "i array<struct<sku string, reference string, description string, quantity string, unit_price string, total string>>")
    assert tuple(it.select(projections.canonical_items(F.col("i")).alias("i")).first().i[0]) == ("r1", "", 2.0, 1.5, 0.0)


def test_rule_assignment(spark):
    suppliers = spark.createDataFrame([(1, " Acme "), (2, "The acme foods"), (3, "none"), (4, "")], "supplier_id int, supplier_name string")
    rules = spark.createDataFrame([("foods", 1, "F"), ("acme", 2, "A")], "key string, ord int, rule string")
    assert rows(match.assign_rules(suppliers, rules), "supplier_id", "rule") == [(1, "A"), (2, "F"), (3, None), (4, None)]


def test_page_of_results(spark):
    assert [r.id for r in report.page(spark.range(10), ["id"], 2, 4).collect()] == [4, 5, 6, 7]


def test_arrivals_replace_items(spark):
    folder, inbox = spark_tmp(spark), spark_tmp(spark)
    schema = "doc_id long, vendor string, text string"
    rule = [{"vendor": {"name": "v"}, "table": {"strategy": "text_regex_multiline", "row_pattern": r"#(\w+)",
                                               "columns": [{"name": "sku", "regex_group": 1}]}}]
    from costloom.sources.rules import RULE_SCHEMA, with_defaults
    rules = with_defaults(spark.createDataFrame(rule, RULE_SCHEMA))
    send = lambda data: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(inbox)
    send([(1, "v", "#a #b"), (2, "v", "nothing")])
    arrivals.upsert_invoices(arrivals.arriving(spark, inbox, spark.read.parquet(inbox).schema), rules, folder)
    send([(1, "v", "#c")])
    arrivals.upsert_invoices(arrivals.arriving(spark, inbox, spark.read.parquet(inbox).schema, files_per_batch=1), rules, folder)
    assert rows(arrivals.current_items(spark, folder), "doc_id", "sku") == [(1, "c")]
    assert rows(tables.latest_rows(spark, f"{folder}/status", "doc_id"), "doc_id", "status") == [(1, "PENDING_REVIEW"), (2, "ERROR")]


def test_running_cost_over_batches(spark):
    folder, inbox = spark_tmp(spark), spark_tmp(spark)
    schema = "product_id long, quantity double, unit_price double"
    for data in ([(1, 10.0, 3.0), (2, 1.0, 5.0)], [(1, 20.0, 3.6)]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(inbox)
        costs.store_running_cost(arrivals.arriving(spark, inbox, spark.read.parquet(inbox).schema), folder)
    got = rows(tables.latest_rows(spark, f"{folder}/costs", "product_id"), "product_id", "average_cost")
    assert got == [(1, pytest.approx(3.4)), (2, 5.0)]


def test_contained_keys_against_all_pairs(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abc_") for _ in range(rnd.randrange(0, 25))) for _ in range(80)] + [None, "éaé_abc", "aaaaaaaaaa"]
    keys = ["".join(rnd.choice("abc_") for _ in range(rnd.randrange(0, 9))) for _ in range(120)] + [None, "", "éaé_a", "aaaaa", "zzzzzz", "é"]
    found = match.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    wanted = {(t, k) for t in texts for k in keys if t and k and k in t}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == wanted and len(rows) == len(wanted)


def test_single_amounts_are_told_by_the_quantity(spark):
    rows = spark.createDataFrame([(1.0, [5.0]), (2.0, [5.0]), (3.0, [5.0]), (0.5, [5.0]), (4.0, [2.0, 9.0]), (0.0, [5.0])], "q double, a array<double>")
    price, total = allocate.price_and_total(F.col("q"), F.col("a"))
    assert [tuple(r) for r in rows.select(price, total).collect()] == [(5.0, 5.0), (2.5, 5.0), (5.0, 15.0), (10.0, 5.0), (2.0, 9.0), (None, 5.0)]


def test_mapping_stats_are_sorted(spark):
    aliases = spark.createDataFrame([("x",), ("y",), ("y",), (None,), ("",), (None,)], "brand string")
    unmapped = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 30, 31)], "seen_at timestamp_ntz")
    found = report.mapping_stats(aliases, unmapped, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert [tuple(r) for r in found.collect()] == [("total", None, 6), ("supplier", "Unknown", 3), ("supplier", "y", 2), ("supplier", "x", 1), ("recent unmapped", None, 3)]
