"""Vendor rules: JSON files -> a DataFrame the extraction joins with documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "array<struct<name string, regex string, `group` int, type string, target string>>"
COLUMNS = "array<struct<name string, `index` int, regex_group int, type string>>"
RULE_SCHEMA = f"""
vendor struct<name string, currency string, language string>,
preprocess string,
header struct<fields {FIELD}>,
table struct<strategy string, start_marker string, end_marker string, row_pattern string,
  row_pattern_alt string, columns {COLUMNS}, columns_alt {COLUMNS}, row_validator_regex string,
  header_keywords array<string>, min_columns int>,
footer struct<fields {FIELD}>,
flags struct<merge_two_lines boolean, merge_negative boolean, first_of_equal_rows boolean,
  missing_total_is_zero boolean>
"""


def java_regex(pattern):
    """Named groups and the end anchor in the spelling of the JVM."""
    return F.replace(F.replace(pattern, F.lit("(?P<"), F.lit("(?<")), F.lit(r"\Z"), F.lit(r"\z"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.json`` rule files of a folder, one row per vendor, defaults filled in."""
    return with_defaults(spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path))


def with_defaults(rules: DataFrame) -> DataFrame:
    t, v = F.col("table"), F.col("vendor")
    none = F.array()

    def fields(c, default_type):
        return F.coalesce(F.transform(c, lambda f: F.struct(
            f["name"].alias("name"), java_regex(f["regex"]).alias("regex"),
            F.coalesce(f["group"], F.lit(1)).alias("group"),
            F.coalesce(f["type"], F.lit(default_type)).alias("type"),
            F.coalesce(f["target"], F.lit("metadata")).alias("target"))), none)

    def columns(c):
        return F.coalesce(F.transform(c, lambda x: F.struct(
            x["name"].alias("name"), x["index"].alias("index"), x["regex_group"].alias("regex_group"),
            F.coalesce(x["type"], F.lit("string")).alias("type"))), none)

    def flag(name):
        return F.coalesce(F.col(f"flags.{name}"), F.lit(False)).alias(name)

    return rules.select(
        F.lower(F.trim(v["name"])).alias("vendor"),
        F.coalesce(v["currency"], F.lit("EUR")).alias("currency"),
        F.coalesce(v["language"], F.lit("fr")).alias("language"),
        F.coalesce("preprocess", F.lit("")).alias("preprocess"),
        fields(F.col("header.fields"), "string").alias("header"),
        F.coalesce(t["strategy"], F.lit("pdfplumber_table")).alias("strategy"),
        java_regex(t["start_marker"]).alias("start_marker"), java_regex(t["end_marker"]).alias("end_marker"),
        java_regex(t["row_pattern"]).alias("row_pattern"), java_regex(t["row_pattern_alt"]).alias("row_pattern_alt"),
        columns(t["columns"]).alias("columns"), columns(t["columns_alt"]).alias("columns_alt"),
        java_regex(t["row_validator_regex"]).alias("row_validator"),
        F.coalesce(t["header_keywords"], none.cast("array<string>")).alias("header_keywords"),
        F.coalesce(t["min_columns"], F.lit(0)).alias("min_columns"),
        fields(F.col("footer.fields"), "number").alias("footer"),
        flag("merge_two_lines"), flag("merge_negative"), flag("first_of_equal_rows"), flag("missing_total_is_zero"))
