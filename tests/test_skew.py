"""Split groups and spread keys give exactly what the plain plans give."""

import random

import pytest
from pyspark.sql import functions as F

from costloom.operators import cost, extract, layout
from costloom.operators.keyed import hot_keys, join_on_key, rows_with_key
from costloom.operators.ordered import (Lag, LastValue, Lead, NextValue, OrderedGroups, RunningMax, RunningSum,
                                        row_numbers)
from costloom.plans.costing import MOVE_ORDER, purchase_costs, stock_moves
from costloom.plans.extraction import invoice_lines, rules
from costloom.plans.roles import ITEM_ORDER, Roles


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}", i, rnd.choice([None, rnd.randrange(100)]))
            for i in range(3000)]
    rows += [(None, 5000 + i, i) for i in range(50)]
    return spark.createDataFrame(rows, "k string, n int, v int").repartition(8)


OPS = {
    "lag": lambda: Lag(F.col("v")), "lag0": lambda: Lag(F.col("v"), F.lit(-1)), "lead": lambda: Lead(F.col("v")),
    "total": lambda: RunningSum(F.col("v")), "before": lambda: RunningSum(F.col("v"), inclusive=False),
    "top": lambda: RunningMax(F.col("v")), "top_before": lambda: RunningMax(F.col("v"), inclusive=False),
    "last": lambda: LastValue(F.col("v")), "last_before": lambda: LastValue(F.col("v"), inclusive=False),
    "next": lambda: NextValue(F.col("v")),
}


def by_hand(rows):
    out, groups = set(), {}
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((n, v))
    for k, g in groups.items():
        vs = [v for _, v in g]
        for i, (n, v) in enumerate(g):
            known = [x for x in vs[:i + 1] if x is not None]
            past = [x for x in vs[:i] if x is not None]
            later = [x for x in vs[i + 1:] if x is not None]
            out.add((k, n, v, vs[i - 1] if i else None, vs[i - 1] if i else -1, vs[i + 1] if i + 1 < len(g) else None,
                     sum(known), sum(past), max(known, default=None), max(past, default=None),
                     known[-1] if known else None, past[-1] if past else None, later[0] if later else None))
    return out


@pytest.mark.parametrize("limit", [10_000, 100])
def test_ordered_columns(spark, skewed, limit):
    groups = OrderedGroups(skewed, ["k"], ["n"], max_rows=limit)
    assert groups.split == (limit == 100)
    got = groups.with_columns(**{name: make() for name, make in OPS.items()})
    assert {tuple(r) for r in got.collect()} == by_hand([tuple(r) for r in skewed.collect()])


def test_runs_are_even(spark, skewed):
    groups = OrderedGroups(skewed, ["k"], ["n"], max_rows=100)
    biggest = groups.df.filter("_run >= 0").groupBy("_run").count().agg(F.max("count")).first()[0]
    assert biggest < 400  # the hot key alone has about 1500 rows


def test_resumed_groups(spark, skewed):
    seq = OrderedGroups(skewed, ["k"], ["n"], max_rows=100)
    once = seq.with_columns(keep_run=True, a=Lag(F.col("v")))
    twice = seq.resume(once.filter("n % 2 = 0")).with_columns(b=Lag(F.col("n")))
    plain = OrderedGroups(skewed, ["k"], ["n"]).with_columns(a=Lag(F.col("v"))).filter("n % 2 = 0")
    plain = OrderedGroups(plain, ["k"], ["n"]).with_columns(b=Lag(F.col("n")))
    assert sorted(map(str, twice.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_spread_join(spark, skewed, how):
    per_key = skewed.groupBy("k").agg(F.sum("v").alias("s")).filter("k <> 'k3'")
    assert hot_keys(skewed.select("k"), 200).count() == 1
    got = join_on_key(skewed, per_key, ["k"], how, max_rows=200)
    want = skewed.join(per_key, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("present", [True, False])
def test_spread_filter(spark, skewed, present):
    wanted = spark.createDataFrame([("hot",), ("k3",), ("k3",)], "k string")
    got = rows_with_key(skewed, wanted, ["k"], present, max_rows=200)
    assert sorted(map(str, got.collect())) == sorted(map(str, skewed.join(
        wanted, "k", "left_semi" if present else "left_anti").collect()))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def roles(spark, sf_dir):
    return Roles(spark, sf_dir)


def test_cost_history_of_hot_products(roles):
    args = (roles.items, roles.invoices, roles.ledger, ITEM_ORDER)
    same(cost.cmp_history(*args, max_rows=20), cost.cmp_history(*args))


def test_cost_at_sale_of_hot_products(roles):
    sales = roles.sales.withColumnRenamed("sold_at", "moved_at")
    args = (sales, purchase_costs(roles), "product_id", "moved_at")
    same(cost.cost_at_sale(*args, max_rows=10), cost.cost_at_sale(*args))


def test_average_with_sales_of_hot_products(roles):
    cols = ["product_id", *MOVE_ORDER, F.round(F.col("average_cost") + 1e-7, 3).alias("average")]
    moves = stock_moves(roles)
    same(cost.average_with_sales(moves, "product_id", MOVE_ORDER, max_rows=15).select(*cols),
         cost.average_with_sales(moves, "product_id", MOVE_ORDER).select(*cols))


def test_extraction_of_long_documents(roles):
    lines, rule = invoice_lines(roles), rules(roles)
    same(extract.text_items(lines, rule, max_rows=10), extract.text_items(lines, rule))


def test_layout_of_long_pages(spark):
    rnd = random.Random(2)
    rows = [(d, 1, n, float(rnd.randrange(400)), float(rnd.randrange(3000)) / 4, f"w{n}") for d in range(3) for n in range(400)]
    tokens = spark.createDataFrame(rows, "doc_id int, page int, n int, x double, y double, text string")
    same(layout.rows_by_gap(tokens, 2.0, max_rows=50), layout.rows_by_gap(tokens, 2.0))
    same(layout.columns_of(tokens, 3.0, max_rows=50), layout.columns_of(tokens, 3.0))


def test_positions_of_long_invoices(roles):
    args = (roles.items, ["invoice_id"], ITEM_ORDER)
    same(row_numbers(*args, max_rows=3), row_numbers(*args))


def test_only_hot_keys_are_cut(spark, skewed):
    groups = OrderedGroups(skewed, ["k"], ["n"], max_rows=100)
    runs = {r.k: r.runs for r in groups.df.groupBy("k").agg(F.collect_set("_run").alias("runs")).collect()}
    assert [k for k, v in runs.items() if v != [-1]] == ["hot"] and len(runs["hot"]) > 5


def test_look_in_a_sample(spark, monkeypatch):
    """With a share below 1 the sample decides what is split, over rows in any order."""
    from costloom.operators import keyed
    monkeypatch.setattr(keyed, "SAMPLED_ROWS", 50)
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"),
        F.col("id").alias("n"), (F.col("id") % 17).alias("v")).repartition(9, F.xxhash64("n"))
    assert [r.k for r in hot_keys(rows.select("k"), 1000).collect()] == ["hot"]
    groups = OrderedGroups(rows, ["k"], ["n"], max_rows=1000)
    assert groups.split
    same(groups.with_columns(before=Lag(F.col("v")), total=RunningSum(F.col("v"))),
         OrderedGroups(rows, ["k"], ["n"]).with_columns(before=Lag(F.col("v")), total=RunningSum(F.col("v"))))
    per_key = rows.groupBy("k").agg(F.max("v").alias("top"))
    for _ in range(3):
        assert join_on_key(rows, per_key, ["k"], "inner", max_rows=1000).count() == 40_000


def test_ledger_row_of_many_skus(spark):
    """Many small SKUs that meet in one register row are one large group."""
    items = spark.range(600).select(
        F.col("id").alias("invoice_id"), F.lit(1).alias("line_no"), F.lit(1).alias("supplier_id"), F.lit(1).alias("part_id"),
        F.concat(F.lit("s"), F.col("id") % 200).alias("sku"), F.lit(2.0).alias("quantity"), (F.col("id") + 1.0).alias("unit_price"), F.lit(1.0).alias("total"))
    invoices = spark.range(600).select(F.col("id").alias("invoice_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("invoice_date"), F.lit(0.0).alias("shipping_fee"))
    cell = "/".join(f"S{i}" for i in range(200))
    ledger = spark.createDataFrame([(2, "A", cell, None, 1.0, None, 5.0, None)], "row_index int, sku_internal string, supplier_skus string, cmp double, qty_prev double, qty_in double, price_prev double, price_new double")
    assert cost.ledger_rows(items, ledger).groupBy("row_index").count().collect() == [(2, 600)]
    args = (items, invoices, ledger, ["line_no"])
    same(cost.cmp_history(*args, max_rows=50), cost.cmp_history(*args))


def test_jobs_while_a_plan_is_built(spark, roles):
    """One look for hot keys per join or ordering, and nothing else."""
    sc = spark.sparkContext
    sc.setJobGroup("building", "building")
    cost.current_cmp(roles.items, roles.invoices, roles.ledger, ITEM_ORDER)
    jobs = sc.statusTracker().getJobIdsForGroup("building")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6
