"""Scalar functions against known vectors."""

import pytest
from pyspark.sql import functions as F

from costloom.functions import dates, numbers, text
from costloom.functions.falsy import first_text, first_truthy, number_prefix, round_half_up
from costloom.operators import allocate


def one(spark, value, fn, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(fn(F.col("v")).alias("o")).first().o


STRICT = [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1234,56", 1234.56), ("1234.56", 1234.56), ("1.000", 1000.0),
          ("1,000", 1000.0), ("0,795", 0.795), ("-123.45", -123.45), ("123.45-", -123.45), ("1 234,56 €", 1234.56),
          ("EUR 12", 12.0), ("abc", 0.0), ("", 0.0), (None, 0.0), ("1,000,000", 1e6), ("12d", 0.0), ("$5", 0.0)]
UNIFIED = [("1.000", 1.0), ("0,795", 795.0), ("2,9000", 2.9), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("25 267,18", 25267.18),
           ("125267,18%", 125267.18), ("1 234,56", 1234.56), ("£ 5", 5.0), ("", 0.0), (None, 0.0), ("x", 0.0), ("1,234,567", 1234567.0),
           ("-3,5", -3.5), ("12-", 0.0)]
PRICE = [("1.352,00", 1352.0), ("1352,00", 1352.0), ("1,234.56", 1234.56), ("1,234", 1234.0), ("€ 9,5", 9.5), ("-4,25", -4.25),
         ("abc", None), ("", None), (None, None), ("1,234.5", 1.0), ("1.234,5", 1.23), ("12.345", 12.35), ("-0.125", -0.12)]


@pytest.mark.parametrize("raw,want", STRICT)
def test_strict_eu(spark, raw, want):
    assert one(spark, raw, numbers.strict_eu) == want


@pytest.mark.parametrize("raw,want", UNIFIED)
def test_unified(spark, raw, want):
    assert one(spark, raw, numbers.unified) == want


@pytest.mark.parametrize("raw,want", PRICE)
def test_price(spark, raw, want):
    assert one(spark, raw, numbers.price) == want


@pytest.mark.parametrize("raw,want", [("12.3456", 12.3456), ("12.34567", 12.3457), ("12,3456", 123456.0)])
def test_price_four_places(spark, raw, want):
    assert one(spark, raw, lambda c: numbers.price(c, 4)) == want


@pytest.mark.parametrize("raw,want", [("15,00", 15), ("15 pcs", 15), ("pcs", None), ("-3", -3)])
def test_whole_quantity(spark, raw, want):
    assert one(spark, raw, numbers.whole_quantity) == want


@pytest.mark.parametrize("raw,want", [("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("215", "215.00"), ("215,5", "215.50"), ("x", "0.00")])
def test_grouped_amount(spark, raw, want):
    assert str(one(spark, raw, numbers.grouped_amount)) == want


@pytest.mark.parametrize("raw,want", [("30.10.2024", "2024-10-30"), ("30/10/2024", "2024-10-30"), ("2024-10-30", "2024-10-30"),
                                      ("invalid", None), ("31.02.2024", None), ("30.10/2024", None)])
def test_parse_date(spark, raw, want):
    got = one(spark, raw, dates.parse_date)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize("raw,want", [("5 mai 2024", "2024-05-05"), ("05-may-2024", "2024-05-05"),
                                      ("7.8.24", "2024-08-07"), ("31-02-2024", "2024-02-31"), ("2024/1/2", "2024-01-02"), ("2024-01", None),
                                      ("12 décembre 2023", "2023-12-12"), ("1 okt 2023", "2023-10-01"), ("1..2024", "2024-00-01")])
def test_normalize_date(spark, raw, want):
    assert one(spark, raw, dates.normalize_date) == want


@pytest.mark.parametrize("raw,want", [("RRaaww", "Raw"), ("99", "9"), ("aab", "ab"), ("aaa", "aa"), ("", ""), (None, "")])
def test_undouble(spark, raw, want):
    assert one(spark, raw, text.undouble) == want


@pytest.mark.parametrize("raw,want", [("99", "99"), ("1144", "14"), ("FFllaagg", "Flag"), ("aa", "aa"), ("book", "book"), ("PPrriiccee HHTT", "Price HT"),
                                      ("PPrriiccee x", "Price x"), ("a", "a"), (None, None)])
def test_undouble_guarded(spark, raw, want):
    assert one(spark, raw, text.undouble_guarded) == want


def pseudo(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return "X_" + format(abs(h), "X")[:8]


@pytest.mark.parametrize("raw", ["", "a", "Whey protein 2kg", "éclair", "x" * 300])
def test_pseudo_sku(spark, raw):
    assert one(spark, raw, lambda c: text.pseudo_sku(c, "X_")) == pseudo(raw)


def test_sku_texts(spark):
    assert one(spark, "  a\t b \n", text.normalize_sku).strip() == "A B"
    assert one(spark, " a;b ,,C|", text.split_skus) == ["A", "B", "C"]
    assert one(spark, None, text.split_skus) == []


def test_file_and_json_texts(spark):
    assert one(spark, "a b(1).pdf", text.safe_file_name) == "a_b_1_.pdf"
    assert one(spark, 'log\n{"a": {"b": 1}}\nend', text.json_object_text) == '{"a": {"b": 1}}'
    assert one(spark, "none", text.json_object_text) is None
    assert one(spark, 'x\n{"a": 1}\n{"b": 2}\nend', text.last_json_line) == '{"b": 2}'
    assert one(spark, "<a&b>", text.escape_html) == "&lt;a&amp;b&gt;"
    assert one(spark, "see AB-12 and XYZ9", text.longest_code) == "AB-12"


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(0.0, 5.0), (float("nan"), 5.0), (None, 5.0), (2.0, 5.0)], "a double, b double")
    assert [r.o for r in df.select(first_truthy(F.col("a"), F.col("b")).alias("o")).collect()] == [5.0, 5.0, 5.0, 2.0]
    assert one(spark, "", lambda c: first_text(c, F.lit("x"))) == "x"
    assert one(spark, "0", lambda c: first_text(c, F.lit("x"))) == "0"
    assert [one(spark, t, number_prefix) for t in ("12abc", " -.5x", "abc", "", "1e3")] == [12.0, -0.5, None, None, 1000.0]
    assert one(spark, -0.125, lambda c: round_half_up(c, 2), "double") == -0.12


def test_money_rules(spark):
    price, total = allocate.line_discount(F.lit(10.0), F.lit(12.5), F.lit(3.0))
    row = spark.range(1).select(price.alias("p"), total.alias("t"), allocate.margin_percent(F.lit(5.99), F.lit(3.20)).alias("m"),
                                allocate.margin_percent(F.lit(0.0), F.lit(1.0)).alias("z")).first()
    assert (float(row.p), float(row.t)) == (8.75, 26.25)
    assert abs(row.m - 46.58) < 0.01 and row.z is None


@pytest.mark.parametrize("price,cost,want", [(5.99, 3.20, 46.6), (6.49, 3.50, 46.1), (2.99, 1.20, 59.9)])
def test_known_margins(spark, price, cost, want):
    got = spark.range(1).select(allocate.margin_percent(F.lit(price), F.lit(cost)).alias("m")).first().m
    assert abs(got - want) < 0.1
