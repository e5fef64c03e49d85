"""Stored tables that grow: stock state, versions, buckets, batched writes, range scans, pickup, cube."""

import json
import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from costloom.operators import cost, cube, versions
from costloom.sources import buckets, cells
from costloom.sources.files import names_in, store_of
from costloom.streaming import arrivals, stock, tables

DAY = datetime(2024, 1, 1)
MOVES = "product_id long, moved_at timestamp, seq long, change double, price double"


def random_moves(n=400, products=5, seed=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(products), DAY + timedelta(minutes=17 * i), i, *((float(rnd.randint(1, 9)), round(rnd.random() * 9 + 1, 2)) if rnd.random() < 0.5 else (-float(rnd.randint(1, 6)), None)))
            for i in range(n)]


def averages(moves):
    """Stock and average of every product, move by move."""
    out = {}
    for product, _, _, change, price in sorted(moves, key=lambda m: m[1:3]):
        held, average = out.get(product, (0.0, None))
        base = max(held, 0.0)
        if price is not None:
            average = (base * (average or 0.0) + change * price) / (base + change)
        out[product] = (held + change, average)
    return out


def same(found, wanted):
    return found.keys() == wanted.keys() and all(
        found[k][0] == pytest.approx(w[0]) and (found[k][1] is None) == (w[1] is None) and (w[1] is None or found[k][1] == pytest.approx(w[1])) for k, w in wanted.items())


def deliver(spark, inbox, name, rows, schema=MOVES):
    """One more file in a folder that a stream watches."""
    store, path = store_of(inbox)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{inbox}-new-{name}")
    source = next(f for f in names_in(store, f"{path}-new-{name}") if f.endswith(".parquet"))
    store.create_dir(path, recursive=True)
    store.copy_file(source, f"{path}/{name}.parquet")


def test_stock_state_survives_a_stop_and_a_failure(spark):
    folder = tables.work_folder(spark)
    inbox, moves = f"{folder}/inbox", random_moves()
    shuffled = list(moves)
    # Moves of a file come in any order, and the files overlap by less than the lateness.
    random.Random(5).shuffle(shuffled)
    thirds = [[m for m in shuffled if m[2] % 400 < 150], [m for m in shuffled if 150 <= m[2] < 260], [m for m in shuffled if m[2] >= 260]]
    thirds[0], thirds[1] = thirds[0][:-5] , thirds[1] + [m for m in thirds[0][-5:]]
    settings = spark.conf.get(stock.PROVIDER)

    def run(handle=None):
        stream = arrivals.arriving(spark, inbox, MOVES, files_per_batch=1)
        stock.store_average_cost(stream, ["moved_at", "seq"], folder, "30 days", handle)

    def latest():
        rows = tables.latest_rows(spark, f"{folder}/averages", "product_id", stock.AVERAGE_SCHEMA).collect()
        return {r.product_id: (r.stock, r.average_cost) for r in rows}

    deliver(spark, inbox, "a", thirds[0])
    run()
    assert same(latest(), averages(thirds[0]))
    deliver(spark, inbox, "b", thirds[1])

    def fail(batch, n):
        raise RuntimeError("the store is away")

    with pytest.raises(Exception, match="the store is away"):
        run(fail)
    run()
    assert same(latest(), averages(thirds[0] + thirds[1]))
    deliver(spark, inbox, "c", thirds[2])
    run()
    assert same(latest(), averages(moves))
    assert spark.conf.get(stock.PROVIDER) == settings


class OneState:
    """The state, timers and watermark of one bucket, without a stream."""

    def __init__(self):
        self.value, self.timers, self.now_ms = None, [], 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now_ms


def test_products_of_a_bucket_share_a_state_and_settle_apart():
    kept, one = stock.StockAverage({"at": "bigint", "seq": "bigint"}), OneState()
    kept.init(one)
    frame = lambda *rows: iter([pd.DataFrame(list(rows), columns=["product_id", "at", "seq", "change", "price"])])
    told = lambda out: {int(r.product_id): (r.stock, r.average_cost, r.waiting) for r in pd.concat(out).itertuples()}
    out = told(kept.handleInputRows((0,), frame((7, 9000, 1, -8.0, None), (7, 2000, 1, 5.0, 2.0), (8, 1000, 1, 4.0, 3.0), (9, 3000, 1, -1.0, None)), one))
    assert out[7] == (-3.0, 2.0, 2) and out[8] == (4.0, 3.0, 1) and out[9][0] == -1.0 and pd.isna(out[9][1])
    assert one.timers == [2]  # the first product of which nothing waits
    one.now_ms = 4
    out = told(kept.handleExpiredTimer((0,), one, None))
    assert out[7] == (-3.0, 2.0, 1) and out[8] == (4.0, 3.0, 0) and out.keys() == {7, 8, 9} and one.timers == [2, 10]
    assert told(kept.handleExpiredTimer((0,), one, None)) == {}  # nothing new, no rows
    assert told(kept.handleInputRows((0,), frame((8, 5000, 1, 4.0, 5.0)), one)) == {8: (8.0, 4.0, 1)}


def test_moves_without_an_order_value_come_last():
    moves = [(3, 1), (1, None), (None, 2), (1, 0)]
    stock.in_order(moves, 2)
    assert moves == [(1, 0), (1, None), (3, 1), (None, 2)]
    assert stock.plain(pd.Series([1.0, float("nan")]), True) == [1, None]


def test_fold_of_moves():
    assert stock.fold(0.0, None, [(5.0, 2.0), (-8.0, None), (4.0, 3.0), (-4.0, None)]) == (-3.0, 3.0)
    assert stock.fold(0.0, None, [(0.0, 9.0), (-1.0, None)]) == (-1.0, None)
    assert stock.fold(2.0, 3.0, [(None, 9.0), (None, None), (-1.0, None)]) == (1.0, 3.0)


@pytest.mark.parametrize("max_rows", [None, 60])
def test_average_with_sales_in_pieces(spark, max_rows):
    """The parallel prefix gives what a walk gives, also for a key that is cut."""
    moves = random_moves(900, products=2, seed=8)
    frame = spark.createDataFrame(moves, MOVES)
    rows = cost.average_with_sales(frame, "product_id", ["moved_at", "seq"], max_rows).collect()
    for n in (1, 300, 899):
        wanted = averages(moves[:n + 1])[moves[n][0]][1]
        found = next(r for r in rows if r.seq == n).average_cost
        assert found == (None if wanted is None else pytest.approx(wanted))


def test_average_with_sales_refuses_groups_beyond_its_reach(spark):
    steps = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.lit(0.5).alias("keep"), F.lit(1.0).alias("add"))
    assert cost._fold(steps, ["k"], ["n"], "a", "b", 75).count() == 300
    with pytest.raises(Exception, match="longer than the rounds reach"):
        cost._fold(steps, ["k"], ["n"], "a", "b", 16).agg(F.sum("b")).collect()


def test_versions_in_batches_equal_versions_at_once(spark):
    rnd, root = random.Random(4), tables.work_folder(spark)
    marks = [(rnd.randrange(6), DAY + timedelta(days=rnd.randrange(200)), i, float(rnd.randrange(4))) for i in range(300)]
    frame = spark.createDataFrame(marks, "product_id long, at timestamp, seq long, cmp double")
    for n, (a, b) in enumerate(((0, 60), (60, 120), (120, 200))):
        part = frame.filter((F.col("at") >= DAY + timedelta(days=a)) & (F.col("at") < DAY + timedelta(days=b)))
        versions.advance(part, root, n, "product_id", "at", "cmp", ["seq"])
        if n == 1:
            versions.advance(part, root, n, "product_id", "at", "cmp", ["seq"])  # run again: the same again
    stored = versions.stored_versions(spark, root)
    whole = versions.versions_of(frame, "product_id", "at", "cmp", ["seq"])
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    # A mark before the open version is handed back, and a late sale meets the version of its time.
    late = spark.createDataFrame([(marks[0][0], DAY - timedelta(days=9), 999, 9.0)], frame.schema)
    versions.advance(late, root, 3, "product_id", "at", "cmp", ["seq"])
    assert spark.read.parquet(f"{root}/late/batch=3").count() == 1
    sales = [(i, rnd.randrange(7), DAY + timedelta(days=rnd.randrange(-5, 260), hours=1)) for i in range(80)]
    found = versions.valid_at(spark.createDataFrame(sales, "sale long, product_id long, sold timestamp"), versions.stored_versions(spark, root), "product_id", "sold", "cmp")
    costs = {r.sale: r.cmp for r in found.collect()}
    assert len(costs) == 80
    for sale, product, sold in sales:
        known = [m for m in marks if m[0] == product and m[1] <= sold]
        assert costs[sale] == (max(known, key=lambda m: (m[1], m[2]))[3] if known else None)


def files_of(root):
    store, path = store_of(root)
    return {f"{d}/{x}" for d, _, names in os.walk(f"{path}/data") for x in names if x.endswith(".parquet")}


def test_bucketed_upsert_leaves_other_files_alone(spark):
    root = tables.work_folder(spark)
    rows = spark.range(400).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"))
    buckets.create(rows, root, "k", 8)
    before = files_of(root)
    stamps = {f: os.stat(f).st_mtime_ns for f in before}
    new = spark.createDataFrame([(3, -1), (3, -2), (200, -3)], "k long, v long")
    touched = buckets.upsert(new, root, "k", 1)
    assert 1 <= len(touched) <= 2
    after = files_of(root)
    assert before <= after and {f: os.stat(f).st_mtime_ns for f in before} == stamps
    assert {f.split("bucket=")[1].split("/")[0] for f in after - before} == set(map(str, touched))
    wanted = sorted([(i % 100, i) for i in range(400) if i % 100 != 3] + [(3, -1), (3, -2), (200, -3)])
    assert sorted(map(tuple, buckets.read(spark, root).collect())) == wanted
    assert buckets.upsert(new, root, "k", 1) == [] and files_of(root) == after
    # Data without a manifest, as a writer that failed leaves it, is not read.
    spark.range(1).write.parquet(f"{root}/data/v=2/bucket=0")
    assert sorted(map(tuple, buckets.read(spark, root).collect())) == wanted


def test_empty_bucketed_table(spark):
    root = tables.work_folder(spark)
    buckets.create(spark.createDataFrame([], "k long, v long"), root, "k", 4)
    assert buckets.read(spark, root).count() == 0
    buckets.upsert(spark.createDataFrame([(1, 2)], "k long, v long"), root, "k", 1)
    assert list(map(tuple, buckets.read(spark, root).collect())) == [(1, 2)]


def test_batches_are_in_order_and_a_failing_task_leaves_nothing(spark):
    path = tables.work_folder(spark)
    updates = spark.range(95).select((F.col("id") % 2).alias("invoice_id"), F.col("id").alias("n"), F.concat(F.lit("S!A"), "id").alias("range"), F.col("id").cast("double").alias("value"))
    made = cells.batches(updates, ["n"])
    cells.write_batches(made, path)
    found = {(r.invoice_id, r.batch): [(u.place, u.range) for u in r.updates] for r in cells.read_batches(spark, path).collect()}
    assert {k: len(v) for k, v in found.items()} == {(0, 1): 20, (0, 2): 20, (0, 3): 8, (1, 1): 20, (1, 2): 20, (1, 3): 7}
    assert found[1, 2][0] == (21, "S!A41") and found[1, 2][-1] == (40, "S!A79")
    store, base = store_of(path)
    files = names_in(store, f"{base}/data")
    broken = made.repartition(4).withColumn("batch", F.when(F.col("batch") == 3, F.raise_error(F.lit("no connection"))).otherwise(F.col("batch")).cast("long"))
    with pytest.raises(Exception, match="no connection"):
        cells.write_batches(broken, path)
    assert names_in(store, f"{base}/data") == files and len(names_in(store, f"{base}/manifest")) == 1
    cells.write_batches(made.filter("batch = 1"), path)
    assert cells.read_batches(spark, path).count() == 8


def test_an_attempt_that_does_not_count_is_taken_away(spark, tmp_path):
    import pyarrow as pa

    writer = cells.CellWriter(str(tmp_path))
    rows = pa.RecordBatch.from_pylist([{"invoice_id": 1, "batch": 1, "updates": [{"place": 1, "range": "S!A1", "value": 1.0}]}])
    first, again = writer.write(iter([rows])), writer.write(iter([rows]))
    writer.commit([again])
    store, base = store_of(str(tmp_path))
    assert [f.removeprefix(f"{base}/") for f in names_in(store, f"{base}/data")] == [again.file] != [first.file]
    assert cells.read_batches(spark, str(tmp_path)).count() == 1


def test_register_range_reads_its_blocks(spark):
    path = tables.work_folder(spark)
    lines = spark.range(2, 5002).select(F.col("id").alias("row_index"), F.concat_ws(",", "id", F.concat(F.lit("b"), "id"), F.lit('"c, ""x"""'), F.lit("d")).alias("value"))
    cells.write_register(lines, path, 3)
    everything = cells.RegisterReader(path, "Sheet!A2:D").partitions()
    some = cells.RegisterReader(path, "Sheet!B40:C60").partitions()
    store, base = store_of(path)
    size = sum(store.get_file_info(f).size for f in names_in(store, f"{base}/data"))
    assert sum(p.size for p in everything) == size and len(some) == 1 and some[0].size < size / 3
    found = {r.row_index: r.cells for r in cells.read_range(spark, path, "Sheet!B40:C60").collect()}
    assert sorted(found) == list(range(40, 61)) and found[41] == ["b41", 'c, "x"']
    assert cells.read_range(spark, path, "B2:B").count() == 5000
    assert cells.read_range(spark, path, "B9000:B9001").count() == 0
    assert cells.parse_range("Sheet1!AA2:AB9") == (27, 28, 2, 9)
    with pytest.raises(ValueError):
        cells.parse_range("nonsense")


def test_pickup_once(spark, tmp_path):
    folder, inbox = tables.work_folder(spark), tmp_path / "inbox"
    for sub, name, data in (("a", "x.txt", b"one\ntwo"), ("b", "x.txt", b"one\ntwo"), ("a", "bad.txt", b"\xff\xfe"), ("a", "blank.txt", b" \n ")):
        (inbox / sub).mkdir(parents=True, exist_ok=True)
        (inbox / sub / name).write_bytes(data)

    def run():
        arrivals.store_once(arrivals.delivered_files(spark, str(inbox), files_per_batch=2), folder)

    run()
    (inbox / "c").mkdir()
    (inbox / "c" / "x.txt").write_bytes(b"one\ntwo")      # once more
    (inbox / "c" / "y.txt").write_bytes(b"three")
    (inbox / "d").mkdir()
    (inbox / "d" / "x.txt").write_bytes(b"another text")  # a new version
    run()
    lines = tables.all_rows(spark, f"{folder}/lines", "name string, hash string, line_no int, text string").collect()
    assert sorted((r.name, r.line_no, r.text) for r in lines) == [("x.txt", 0, "another text"), ("x.txt", 0, "one"), ("x.txt", 1, "two"), ("y.txt", 0, "three")]
    bad = tables.all_rows(spark, f"{folder}/quarantine", arrivals.QUARANTINE_SCHEMA).collect()
    assert {(r.name, r.reason) for r in bad} == {("bad.txt", "not UTF-8"), ("blank.txt", "blank")}


def test_cube_of_three_days_and_a_day_loaded_again(spark):
    folder = tables.work_folder(spark) + "/cube"
    facts = spark.range(600).select((F.col("id") % 7).alias("p"), (F.col("id") % 3).alias("s"), (F.col("id") % 3).alias("day"), (F.col("id") * 1.25).alias("v"),
                                    F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("m"))
    for day in (0, 1, 2, 1):
        cube.store_part(cube.partials(facts.filter(F.col("day") == day), ["p", "s"], ["v", "m"], ["m"]), folder, day)
    figures = [F.sum("rows").alias("n"), F.sum("v").cast("double").alias("v"), (F.sum("m").cast("double") / F.sum("n_m")).alias("mean")]
    sets = [["p", "s"], ["s"], []]
    found = {(r.p, r.s): (r.n, r.v, round(r["mean"], 6)) for r in cube.rolled_up(spark, folder, sets, figures).collect()}
    direct = facts.groupingSets([[F.col(c) for c in s] for s in sets], "p", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.avg("m").alias("mean"))
    assert found == {(r.p, r.s): (r.n, r.v, round(r["mean"], 6)) for r in direct.collect()}


def test_items_status_and_logs_are_compacted(spark, monkeypatch):
    from costloom.plans.extraction import RULES
    from costloom.sources.rules import RULE_SCHEMA, with_defaults

    monkeypatch.setattr(arrivals, "COMPACT_EVERY", 2)
    folder = tables.work_folder(spark)
    rules = with_defaults(spark.createDataFrame(RULES, RULE_SCHEMA))
    schema = "doc_id long, vendor string, text string"
    for n in range(4):
        rows = [(k, "fr", f"mot{'abcd'[n]} de suite" if (k + n) % 3 else "rien") for k in range(n, n + 4)]
        deliver(spark, f"{folder}/inbox", f"f{n}", rows, schema)
        arrivals.upsert_invoices(arrivals.arriving(spark, f"{folder}/inbox", schema), rules, folder)
    store, base = store_of(folder)
    for name in ("items", "status", "logs"):
        assert store.get_file_info(f"{base}/{name}-compact/upto=2").type.name == "Directory"
    wanted = {}
    for n in range(4):
        for k in range(n, n + 4):
            wanted[k] = f"mot{'abcd'[n]}" if (k + n) % 3 else None
    found = {r.doc_id: r.description for r in arrivals.current_items(spark, folder).collect()}
    assert found == {k: v for k, v in wanted.items() if v}
