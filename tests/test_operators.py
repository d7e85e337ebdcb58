"""Operators in isolation: null-aware anti join, lookup joins, period predicates, layout."""

from __future__ import annotations

import datetime as dt

from conftest import rows

from pyspark.sql import functions as F

from tradelens.functions.layout import display_header
from tradelens.functions.period import Period, in_period, in_period_by_day
from tradelens.operators.anti import not_in
from tradelens.operators.lookup import lookup_join
from tradelens.plans.bundle import column_layout_profile, header_manifest, render_report


def _codes(spark, values):
    return spark.createDataFrame([(v,) for v in values], "code string")


def _not_in(spark, probe, values):
    got = not_in(_codes(spark, probe), "code", _codes(spark, values), "code")
    return sorted((r["code"] for r in got.collect()), key=lambda x: (x is None, x))


def test_not_in_matches_sql_semantics(spark):
    assert _not_in(spark, ["a", "b", None], ["a"]) == ["b"]          # null probe dropped
    assert _not_in(spark, ["a", "b", None], []) == ["a", "b", None]  # empty list keeps all
    assert _not_in(spark, ["a", "b"], ["a", None]) == []              # null in list → nothing
    assert _not_in(spark, ["a", "b"], [None, None]) == []
    assert _not_in(spark, ["a", "a", "c"], ["b", "b"]) == ["a", "a", "c"]


def test_not_in_agrees_with_spark_sql(spark):
    probe = _codes(spark, ["x", "y", None, "z"])
    for values in (["x"], ["x", None], [], [None]):
        vals = _codes(spark, values)
        probe.createOrReplaceTempView("p")
        vals.createOrReplaceTempView("v")
        expected = sorted(map(str, (r[0] for r in spark.sql(
            "SELECT code FROM p WHERE code NOT IN (SELECT code FROM v)").collect())))
        assert sorted(map(str, _not_in(spark, ["x", "y", None, "z"], values))) == expected


def test_lookup_join_null_split_equals_plain_left_join(spark):
    fact = spark.createDataFrame([(1, 10), (None, 20), (2, 30), (None, 40), (9, 50)],
                                 "k bigint, v int")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k bigint, name string")
    for options in ({}, {"broadcast": True}, {"spread": ("v",)}, {"spread": ("v",), "hot": (0, 1)}):
        got = sorted(rows(lookup_join(fact, dim, "k", "left", **options)), key=lambda r: r["v"])
        assert [(r["v"], r["name"]) for r in got] == \
            [(10, "one"), (20, None), (30, "two"), (40, None), (50, None)]


def test_hot_keys_are_spread_and_still_match(spark):
    fact = spark.range(3000).select((F.col("id") % 3 - 1).alias("k"), F.col("id").alias("v"))
    dim = spark.createDataFrame([(0, "zero"), (0, "null"), (1, "one"), (5, "five")], "k bigint, name string")
    got = lookup_join(fact, dim, "k", "left", spread=("v",), hot=(0, -1))
    want = fact.join(dim, "k", "left")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_missing_columns_raise_unless_optional(spark):
    import pytest

    from tradelens.sources.contract import SCHEMAS, conform

    bills = spark.createDataFrame([], SCHEMAS["stock_bill"])
    with pytest.raises(ValueError, match="use_id"):
        conform(bills.drop("use_id"), "stock_bill")
    assert conform(bills.drop("memo"), "stock_bill").schema == SCHEMAS["stock_bill"]


def test_parquet_loading_raises_other_errors(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from tradelens.sources.tables import load_parquet_tables

    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        load_parquet_tables(spark, str(tmp_path), ["goods"])
    assert load_parquet_tables(spark, str(tmp_path), ["bill_type_en"]).bill_type_en.count() == 8
    (tmp_path / "bill_type_en").mkdir()
    (tmp_path / "bill_type_en" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        load_parquet_tables(spark, str(tmp_path), ["bill_type_en"])


def test_jdbc_options_and_refusal(spark):
    import pytest

    from tradelens.sources.contract import SCHEMAS
    from tradelens.sources.tables import load_jdbc_tables

    class Reader:
        def __init__(self):
            self.options = {}

        def format(self, name):
            self.options["format"] = name
            return self

        def option(self, key, value):
            self.options[key] = value
            return self

        def load(self):
            name = self.options["dbtable"].removeprefix("erp.")
            read[name] = self.options
            return spark.createDataFrame([], SCHEMAS[name])

    class Session:
        read = property(lambda self: Reader())
        createDataFrame = staticmethod(spark.createDataFrame)

    read: dict = {}
    names = {"goods": "erp.goods", "stock_line": "erp.stock_line"}
    with pytest.raises(ValueError, match="stock_line"):
        load_jdbc_tables(Session(), "jdbc:x", names)
    t = load_jdbc_tables(Session(), "jdbc:x", names, {"user": "u"}, {"stock_line": ("bill_id", 1, 100, 8)})
    assert set(t) == {"goods", "stock_line", "bill_type_en"}
    assert read["goods"] == {"format": "jdbc", "url": "jdbc:x", "dbtable": "erp.goods", "user": "u"}
    assert read["stock_line"] == {"format": "jdbc", "url": "jdbc:x", "dbtable": "erp.stock_line", "user": "u",
                                  "partitionColumn": "bill_id", "lowerBound": "1", "upperBound": "100",
                                  "numPartitions": "8"}
    load_jdbc_tables(Session(), "jdbc:x", names, single_connection=["stock_line"])


def test_small_ratios_are_not_rounded_away(spark):
    from tradelens.functions import expressions as X

    df = spark.createDataFrame([(4, 10_000_000), (5, 0), (None, 3)], "n bigint, d bigint")
    got = df.select(X.ratio_or_zero("n", "d").alias("z"), X.ratio_or_null("n", "d").alias("x")).collect()
    assert [tuple(r) for r in got] == [(4e-7, 4e-7), (0.0, None), (None, None)]


def test_python_text_of_doubles_and_times(spark):
    from tradelens.functions.layout import python_text
    from pyspark.sql import types as T

    values = [0.0, -0.5, 1.0, 12.25, 1.234e-07, 0.0001, 0.00012, 9.999e-05, 1e7, 12345678.5, 1e15, 1.5e16, 1e20, -2e-300,
              123456789012345.6, float("nan"), float("inf"), float("-inf"), 1 / 3, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.orderBy("i").select(python_text(F.col("v"), T.DoubleType()).alias("t")).collect()
    assert [r.t for r in got] == [str(v) for v in values]
    times = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 500000)]
    df = spark.createDataFrame([(t,) for t in times], "v timestamp_ntz")
    assert [r.t for r in df.select(python_text(F.col("v"), T.TimestampNTZType()).alias("t")).collect()] == \
        [str(t) for t in times]


def test_display_headers_in_csv(spark, tmp_path):
    from tradelens.plans.bundle import with_display_headers

    df = spark.createDataFrame([(1, 2, 3, "a")], "bill_name_1 int, bill_name_2 int, qty_label_1 int, qty_label_2 string")
    assert with_display_headers(df).columns == ["Bill_Name", "Bill_Name ", "", " "]


def test_period_bounds(spark):
    p = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    ts = [dt.datetime(2023, 12, 31, 23, 59, 59), dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1),
          dt.datetime(2024, 2, 1, 0, 0, 1), dt.datetime(2024, 2, 1, 23, 59), dt.datetime(2024, 2, 2)]
    df = spark.createDataFrame([(t,) for t in ts], "d timestamp_ntz")
    f1 = [r.d for r in df.filter(in_period("d", p)).collect()]
    f2 = [r.d for r in df.filter(in_period_by_day("d", p)).collect()]
    assert f1 == ts[1:3]
    assert f2 == ts[1:5]


def test_m19_layout_width(spark):
    df = spark.createDataFrame([(111,), (None,)], "qty bigint")
    (r,) = column_layout_profile(df).collect()
    assert r["header"] == "Qty" and r["width"] == 1329


def test_layout_width_header_floor(spark):
    df = spark.createDataFrame([("",)], "x string")
    (r,) = column_layout_profile(df).collect()
    assert r["width"] == 700


def test_headers_and_rendering(spark):
    assert display_header("bill_name_2") == "Bill_Name"
    assert display_header("qty_label_1") == ""
    assert display_header("product_code") == "Product_Code"
    df = spark.createDataFrame([(dt.datetime(1997, 1, 5, 13, 0), 3)], "bill_date timestamp_ntz, n int")
    assert render_report(df).collect()[0]["bill_date"] == "05/01/1997"
    man = header_manifest(spark, {"R": df}).collect()
    assert [(m["position"], m["header"]) for m in man] == [(0, "Bill_Date"), (1, "N")]
    assert render_report(df).select(F.col("n")).collect()[0][0] == 3


def test_left_join_split_hot_right_equals_left_join(spark):
    from tradelens.operators.lookup import left_join_split_hot_right

    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k bigint, l string")
    right = spark.createDataFrame([(1, 10)] * 50 + [(2, 20), (2, 21), (9, 90)], "k bigint, r int")
    got = sorted((repr(tuple(r)) for r in left_join_split_hot_right(left, right, ["k"]).collect()))
    want = sorted(repr(tuple(r)) for r in left.join(right, ["k"], "left").collect())
    assert got == want and len(got) == 50 + 2 + 1 + 1
