"""Steps that must stay small when tables grow: what is computed once, what is sent where."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from costloom.functions import text
from costloom.functions.dates import normalize_date
from costloom.operators import extract, layout, match, rows, versions
from costloom.operators.rows import first_of_equal
from costloom.plans import catalog
from costloom.plans.extraction import ITEM_COLUMNS, doc_keys, invoice_lines, item_tasks
from costloom.plans.roles import Roles
from costloom.sources import cells
from costloom.sources.files import names_in, store_of
from costloom.sources.rules import RULE_SCHEMA, with_defaults


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grams_are_counted_for_wanted_keys_only_and_never_broadcast(spark):
    texts = spark.createDataFrame([(f"{i}_click_{i % 7}.pdf",) for i in range(50)], "text string")
    keys = spark.createDataFrame([("click_3.pdf",), ("click_9.pdf",), ("k_3",), ("",)], "key string")
    found = match.contained(texts, keys)
    got = {(r.text, r.key) for r in found.collect()}
    assert got == {(t, k) for t in (f"{i}_click_{i % 7}.pdf" for i in range(50)) for k in ("click_3.pdf", "k_3") if k in t}
    counts = [x for x in plan_of(found).splitlines() if "strategy=merge" in x]
    assert counts and "LeftSemi" in plan_of(found)


def test_best_triples_combine_the_numbers_once(spark):
    one = "struct<value:double,kind:string,original:string,position:int>"
    rows = [([(3.0, "quantity", "3", 1), (2.5, "price", "2.5", 2), (7.5, "price", "7.5", 3), (None, "number", "x", 4)], [3.0, 2.5, 7.5, None]),
            ([], []), (None, None), ([(1.0, None, None, None)], [1.0]), ([(2.0, "quantity", "2", 1), (4.0, "price", "4", 2), (9.0, "price", "9", 3)], [2.0, 60.0, 130.0])]
    df = spark.createDataFrame(rows, f"s array<{one}>, v array<double>")
    got = df.select(layout.best_triple_by_score(F.col("s")).alias("s"), layout.best_triple_by_error(F.col("v")).alias("e"))
    assert [(r.s and tuple(r.s), r.e and tuple(r.e)) for r in got.collect()] == [
        ((3.0, 2.5, 7.5), (3.0, 2.5, 7.5)), (None, None), (None, None), (None, None), ((2.0, 4.0, 9.0), (60.0, 2.0, 130.0))]
    assert plan_of(df.select(layout.best_triple_by_score(F.col("s")).alias("b"))).count("array_max(") == 3
    assert plan_of(df.select(layout.best_triple_by_error(F.col("v")).alias("b"))).count("array_max(") == 6


def test_first_fields_of_a_rule_have_an_expression_each(spark):
    n = extract.FIELDS_APART + 3
    text = " ".join(f"f{i}={i}," for i in range(n))
    kind = "array<struct<name:string,regex:string,group:int,type:string>>"
    rules = [(f"f{i}", rf"f{i}=(\d+)", 1, "number" if i % 2 else "string") for i in range(n)] + [("f0", "F1=(.)", 1, "string"), ("none", "zz(.)", 1, "string")]
    df = spark.createDataFrame([(text, rules), (text, rules[:2]), (text, []), (None, rules)], f"text string, wanted {kind}")
    found = df.select(extract.fields(F.col("text"), F.col("wanted")).alias("m"))
    value = lambda i: f"{i}.0" if i % 2 else str(i)
    assert [r.m for r in found.collect()] == [{f"f{i}": value(i) if i else "1" for i in range(n)}, {"f0": "0", "f1": "1.0"}, {}, {}]
    assert plan_of(found).count("regexp_extract(") > extract.FIELDS_APART


def test_marks_of_a_batch_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(cost):
        seen.add(1)
        return cost

    marks = spark.createDataFrame([(i % 5, i, float(i // 10), i) for i in range(100)], "product_id long, at int, cmp double, seq int")
    marks = marks.withColumn("cmp", F.udf(counted, "double")("cmp"))
    root = str(tmp_path)
    for n in range(2):
        seen.value = 0
        versions.advance(marks.filter("at < 50" if n == 0 else "at >= 50"), root, n, "product_id", "at", "cmp", ["seq"])
        assert seen.value == 50
    got = versions.stored_versions(spark, root).orderBy("product_id", "valid_from").collect()
    assert [tuple(r) for r in got if r.product_id == 0] == [(0, float(k), 10 * k, 10 * k + 10 if k < 9 else None) for k in range(10)]


def test_tokens_are_dealt_by_document_before_they_are_cut(spark, sf_dir):
    for name in ("ag_16_line_reconstruction", "wn_10_rows_by_anchor"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_rows_by_anchor_of_whole_pages_and_by_join_agree(spark):
    rows_ = [(d, p, i, float(i % 4), None if i == 7 else (i * 13 % 40) / 2.0, f"w{i}") for d in (1, None) for p in (0, None) for i in range(30)]
    tokens = spark.createDataFrame(rows_, "doc_id long, page long, n long, x double, y double, text string")
    whole, joined = (layout.rows_by_anchor(tokens, 3.0, bounded=b).select("doc_id", "page", "n", "x", "y", "text", "row") for b in (True, False))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, joined.collect()))
    assert whole.count() == 29 and joined.agg(F.max("row")).first()[0] == 6


def test_first_and_last_dates_are_read_once_a_cell(spark):
    cells = [(1, 1, "Invoice: F-7"), (1, 2, "dated 05/07/2024"), (1, 3, "on 31.2.2024"), (1, 4, "No. B9"), (2, 1, "nothing"), (None, 1, "n 3-4-2023"), (3, 1, None)]
    found = rows.number_and_date(spark.createDataFrame(cells, "invoice_id long, place int, cell string"))
    got = {r[0]: (r.invoice_number, str(r.invoice_date), r.last_number, str(r.last_date)) for r in found.collect()}
    assert got == {1: ("F-7", "2024-07-05", "B9", "2024-07-05"), 2: ("thing", "None", "thing", "None"), 3: (None, "None", None, "None"),
                   None: ("3-4-2023", "2023-04-03", "3-4-2023", "2023-04-03")}
    assert found._jdf.queryExecution().analyzed().toString().count("(\\d{4})") == 1


def test_cells_are_cut_into_lines_once(spark):
    df = spark.createDataFrame([("a\nb\nc", "1\n2"), (None, "1")], "s string, q string")
    made = [df.select(text.zip_lines(shortest, s=F.col("s"), q=F.col("q")).alias("z")) for shortest in (True, False)]
    assert [[tuple(x) for x in r.z] for d in made for r in d.collect()] == [
        [("a", "1"), ("b", "2")], [("", "1")], [("a", "1"), ("b", "2"), ("c", "")], [("", "1")]]
    assert all(d._jdf.queryExecution().analyzed().toString().count("split(") == 2 for d in made)


def test_cell_batches_are_dealt_by_invoice_and_stored_as_they_come(spark, tmp_path):
    rows = pa.RecordBatch.from_pylist([{"invoice_id": i, "batch": 1, "updates": [{"place": 1, "range": f"S!A{i}", "value": i / 2}]} for i in range(3)])
    writer = cells.CellWriter(str(tmp_path))
    found, none = writer.write(iter([rows, rows.slice(0, 1)])), writer.write(iter([]))
    writer.commit([found, none])
    store, base = store_of(str(tmp_path))
    assert [(x.rows, x.file.endswith(".arrow")) for x in (found, none)] == [(4, True), (0, True)] and len(names_in(store, f"{base}/data")) == 1
    parts = cells.CellReader(str(tmp_path)).partitions()
    assert [b.num_rows for p in parts for b in cells.CellReader(str(tmp_path)).read(p)] == [3, 1]
    assert cells.read_batches(spark, str(tmp_path)).filter("updates[0].value = 1").count() == 1


def test_keys_are_dealt_before_they_are_cut_into_pieces(spark):
    keys = spark.createDataFrame([("X12345",), ("P1",), (None,), ("",)], "sku string")
    known = spark.createDataFrame([("AX1234",), ("AX1234",), ("P12",), (None,)], "sku string")
    made, plain = match.near_keys(keys, known, tasks=3), match.near_keys(keys, known)
    assert plan_of(made).count("RepartitionByExpression") == 4 and plan_of(plain).count("RepartitionByExpression") == 0
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect())) != []


def test_report_lines_are_counted_where_their_invoice_is(spark, sf_dir):
    assert "REPARTITION_BY_NUM" in catalog.QUERIES["snk_06_run_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


ITEM_LINES = ["> B7 ~  Two \t words ", "= 2 x 1.234,50 -> 2,00", "A1 outside", "FID: 44", "> C8 ~ Total", "= 1 x 1,00 -> 1,00"]


def generators(df):
    return [x for x in plan_of(df).splitlines() if "Generate explode(" in x or "Generate inline(" in x]


def test_values_of_a_line_are_read_in_generated_code_before_lines_are_ordered(spark):
    rule = spark.createDataFrame([{"vendor": {"name": "v"}, "flags": {"merge_two_lines": True}, "table": {
        "strategy": "text_regex", "row_pattern": r"^> ([A-Z]\d+) ~ (.+)$|^= (\d+) x ([\d.,]+) -> ([\d.,]+)$", "columns": ITEM_COLUMNS}}], RULE_SCHEMA)
    lines = spark.createDataFrame([(1, " V ", n, t) for n, t in enumerate(ITEM_LINES)], "doc_id int, vendor string, line_no int, text string")
    found = extract.text_items(lines, with_defaults(rule))
    assert [(r.line_no, r.sku, r.description, r.quantity, r.unit_price, r.total) for r in found.collect()] == [
        (1, "44", "Two words", "2", "1234.5", "2")]
    assert generators(found) and not any("lambda" in x for x in generators(found))
    plan = plan_of(found)
    assert plan.index("_state") < plan.index("Generate explode(")  # nodes are printed from the last to the first


def test_printed_lines_are_made_where_their_invoice_is(spark, tmp_path):
    items = spark.createDataFrame(
        [(k, s, 4 + s, 1, 2.0, 5.25, 0.0, 0.0, None) for k in (1, 2, None) for s in (1, 2)],
        "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    r = Roles(spark, str(tmp_path))
    lines = invoice_lines(r)
    assert "Union" not in plan_of(lines) and lines.rdd.getNumPartitions() == item_tasks(r, 3)
    got = [(x.doc_id, x.line_no, x.text) for x in lines.orderBy("doc_id", "line_no", "text").collect()]
    assert [n for k, n, _ in got if k == 2] == [1, 2, 3, 14, 18, 19, 20, 10**9, 10**9 + 1]
    assert [n for k, n, _ in got if k == 1] == [n for k, n, _ in got if k is None] == [14, 18, 19]


def test_grid_values_are_read_in_generated_code(spark):
    cells = [["A1", " Bar  of\tnuts ", "1.234,50", " "], ["A2", None, "", "2,00"], ["A3"], ["B1\nB2", "x", "3\n4", "5"], [" ", None], None, []]
    columns = [{"name": "sku", "index": 0, "type": "string"}, {"name": "description", "index": 1, "type": "string"},
               {"name": "quantity", "index": 2, "type": "number"}, {"name": "total", "index": 3, "type": "number"}]
    rows = spark.createDataFrame([(i, c, columns) for i, c in enumerate(cells)],
                                 "n int, cells array<string>, columns array<struct<name:string,index:int,type:string>>")
    found = extract.grid_items(rows)
    got = [(r.n, r.sub, r.sku, r.description, r.quantity, r.total) for r in found.orderBy("n", "sub").collect()]
    assert got == [(1, 0, "A2", "", "0", "2"), (2, 0, "A3", None, None, None), (3, 0, "B1", "x", "3", "5")]
    assert "lambda" not in generators(found)[0]  # the values; before them come the places of each row's own columns


def test_texts_of_one_line_and_of_several_are_told_apart_alike(spark):
    texts = ["Mega deal", "Bar\nMega deal today\n second line ", "Mega deal\nBLACK FRIDAY", " a \t b ", "", None, "Sample points for Bar", "x\n\n y"]
    df = spark.createDataFrame([(n, "S", t, None) for n, t in enumerate(texts)], "n int, sku string, description string, position string")
    got = {r.n: (r.row_kind, r.description) for r in extract.classify(df).collect()}
    assert got == {0: ("metadata", ""), 1: ("item", "Bar second line"), 2: ("metadata", ""), 3: ("item", "a \t b"), 4: ("item", ""), 5: ("item", ""),
                   6: ("metadata", ""), 7: ("item", "x  y")}
    odd = spark.createDataFrame([(t,) for t in (" a \t b ", "\n", " \n \n ", "a\r\n  b\x0b", "one", None, "", "\ta\n\nb ")], "t string")
    assert [r.t for r in odd.select(text.tidy_lines(F.col("t")).alias("t")).collect()] == ["a b", "\n", "\n\n", "a\nb", "one", "", "", "a\n\nb"]


def test_rows_in_a_region_read_their_values_in_generated_code(spark):
    rule = spark.createDataFrame([{"vendor": {"name": "v"}, "table": {
        "strategy": "text_regex_multiline", "row_pattern": r"take ([A-Z]\d+) \((.+?)\) (\d+)\s+at ([\d.,]+) = ([\d.,]+);", "columns": ITEM_COLUMNS,
        "row_pattern_alt": r"back (\w+) ([A-Z]\d+)", "columns_alt": [{"name": "sku", "regex_group": 2}, {"name": "description", "regex_group": 1}]}}], RULE_SCHEMA)
    docs = spark.createDataFrame([(1, "v", "take A1 (Bar\n of) 2\nat 1,50 = 3,00;\nback bar B2")], "doc_id int, vendor string, text string")
    found = extract.region_items(docs, with_defaults(rule))
    assert sorted((r.variant, r.sku, r.description, r.quantity, r.unit_price, r.total) for r in found.collect()) == [
        (1, "A1", "Bar of", "2", "1.5", "3"), (2, "B2", "bar", None, None, None)]
    assert generators(found) and not any("lambda" in x for x in generators(found))


def test_the_best_source_is_found_while_its_rows_are_read_once(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a2"), (2, 3, "c"), (None, 1, "x"), (None, 2, "y")], "doc_id int, rank int, v string")
    once = layout.first_source(rows, measure=rows.select("doc_id"))
    assert plan_of(once).count("LogicalRDD") == 1
    for found in (once, layout.first_source(rows), layout.first_source(rows, max_rows=1)):
        assert sorted(map(tuple, found.collect())) == [(1, 1, "a"), (1, 1, "a2"), (2, 3, "c")]


def test_negative_lines_are_taken_up_in_one_order(spark):
    data = [(1, "item", n, 2.0, 5.0, t) for n, t in enumerate([-1.0, -2.0, -4.0, 9.0, -0.5, None, -3.0, -0.25, 7.0], 1)]
    data += [(1, "shipping", 1, 1.0, -1.0, -1.0), (1, "shipping", 2, 1.0, -2.0, -2.0), (None, "item", 1, 4.0, 1.0, 4.0), (None, "item", 2, 1.0, -1.0, -1.0)]
    df = spark.createDataFrame([(*d, "s") for d in data], "doc_id int, row_kind string, pos int, quantity double, unit_price double, total double, sku string")
    found = extract.merge_negative(df, bounded=True, within=("doc_id", "row_kind"), applies=F.col("row_kind") == "item")
    assert "Aggregate" not in plan_of(found)
    got = sorted(((r.doc_id or 0, r.row_kind, r.pos, r.total, r.lines, r.unit_price) for r in found.collect()))
    assert got == [(0, "item", 1, 3.0, 2, 0.75), (1, "item", 1, -3.0, 2, -1.5), (1, "item", 3, -4.0, 1, 5.0), (1, "item", 4, 8.5, 2, 4.25),
                   (1, "item", 6, -3.0, 2, -1.5), (1, "item", 8, -0.25, 1, 5.0), (1, "item", 9, 7.0, 1, 5.0),
                   (1, "shipping", 1, -1.0, 1, -1.0), (1, "shipping", 2, -2.0, 1, -2.0)]


def test_equal_rows_keep_the_first_without_a_grouping(spark):
    rows = spark.createDataFrame([("k", 0.0, 2, "b"), ("k", -0.0, 1, "a"), (None, 1.0, 1, "c"), (None, 1.0, 2, "d")], "k string, v double, n int, t string")
    found = first_of_equal(rows, ["k", "v"], ["n"])
    assert "Aggregate" not in plan_of(found)
    assert sorted((str(r.k), str(r.v), r.t) for r in found.collect()) == [("None", "1.0", "c"), ("k", "0.0", "a")]


def test_whole_invoices_read_texts_that_were_put_together_once(spark, tmp_path):
    items = spark.createDataFrame([(k, 1, 4 + k, 1, 2.0, 5.25, 0.0, 0.0, None) for k in (1, 2, 3, 4, 8)],
        "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalog.QUERIES["st_06_whole_invoice_items"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.sku, r.total, r.method) for r in found.collect()) == [
        (1, "A5", 5.25, "lines"), (2, "A6", 5.25, "table"), (3, "A7", 5.25, "text"), (4, "A8", 5.25, "lines"), (8, "A12", 5.25, "lines")]
    # Readers of the texts share one exchange; the other exchange of items is for the grids.
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("collect_list(struct(pos") == 2 and "ReusedExchange" in plan  # partial and final of one grouping


def test_dates_of_digits_are_read_like_dates_with_words(spark):
    dates = ["05.03.2024", " 2024-3-5 ", "5/3/24", "5 March 2024", "mardi 5 mars 2024", "5..3.2024", "", "-", "05.03.2024 10", "05.03.2024\n", None]
    df = spark.createDataFrame([(d,) for d in dates], "d string")
    assert [r.d for r in df.select(normalize_date(F.col("d")).alias("d")).collect()] == [
        "2024-03-05", "2024-03-05", "2024-03-05", "2024-03-05", "2024-03-05", None, None, None, None, "2024-03-05", None]


def test_typed_tokens_meet_their_group_without_a_join(spark):
    """Both ways say the same of any stream: unknown tokens, runs of all lengths, no document."""
    rnd = random.Random(5)
    stream = [(d, n, f"{n}{'€' if p else ''}", p) for d in (*range(40), None) for n, p in enumerate(
        p for _ in range(12) for p in [rnd.choice([True, False, True, False, None])] * rnd.choice([1, 1, 2, 2, 3]))]
    regular = [(d, n, f"{n}", n // 3 % 4 != 1) for d in range(100, 120) for n in range(48)]
    df = spark.createDataFrame(stream + regular, "doc_id int, n int, text string, is_price boolean").repartition(3, "n")
    once = layout.typed_runs(df, measure=df.select("doc_id"))
    assert "Join" not in plan_of(once)
    joined = layout.typed_runs(df, max_rows=10)
    assert "Join" in plan_of(joined)
    got = sorted(map(tuple, once.collect()))
    assert got == sorted(map(tuple, joined.collect())) and len({r[0] for r in got}) > 20
    assert (100, 2, 0, "0", "3", "6") in got and all(r[0] is not None for r in got)
