import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.clean import (
    default_if_blank, lenient_timestamp, month_key, month_label, numeric0, to_number0,
    transaction_status, value_or, wall_clock,
)
from innsight.functions.formats import fixed, one_decimal_pct, pct, thousands

# Literals and the value a lenient reader (pandas ``to_numeric(errors="coerce")``
# then ``fillna(0)``) gives them.
TEXT_NUMBERS = [
    ("12", 12.0), (" 7 ", 7.0), ("-3.5", -3.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0),
    ("1d", 0.0), ("2f", 0.0), ("n/a", 0.0), ("", 0.0), (None, 0.0), ("abc", 0.0),
    ("1e400", 0.0), ("nan", 0.0), ("inf", float("inf")), ("-Infinity", float("-inf")), ("1_000", 0.0),
]


def test_numeric0_text(spark):
    df = spark.createDataFrame([(s,) for s, _ in TEXT_NUMBERS], "x string")
    got = [r[0] for r in df.select(numeric0(F.col("x"), T.StringType())).collect()]
    assert got == [v for _, v in TEXT_NUMBERS]


def test_numeric0_typed(spark):
    df = spark.createDataFrame([(1, 2.5), (None, float("nan")), (3, None)], "i int, d double")
    out = to_number0(df, ["i", "d", "absent"]).collect()
    assert [(r.i, r.d) for r in out] == [(1, 2.5), (0, 0.0), (3, 0.0)]
    assert dict(to_number0(df, ["i"]).dtypes)["i"] == "int"
    with pytest.raises(KeyError):
        to_number0(df, ["absent"], only_present=False)


def test_value_or(spark):
    df = spark.createDataFrame([(None, 5.0), (0.0, 6.0), (float("nan"), 7.0), (2.0, 8.0)], "v double, f double")
    assert [r[0] for r in df.select(value_or(F.col("v"), F.col("f"))).collect()] == [5.0, 6.0, 7.0, 2.0]


def test_month_key_and_label(spark):
    df = spark.createDataFrame([(202401,), (199912,)], "m int")
    got = df.select(month_label(month_key(F.col("m"), T.IntegerType())).alias("l")).collect()
    assert [r.l for r in got] == ["2024-01", "1999-12"]


def test_bad_months_are_null_and_fail_where_required(spark):
    from innsight.functions.clean import require_months

    df = spark.createDataFrame([(202413, 1), (None, 2), (202401, 3)], "m int, v int")
    assert [r[0] is None for r in df.select(month_key(F.col("m"), T.IntegerType())).collect()] == [True, True, False]
    for some in (df.filter("v = 1"), df.filter("v = 2")):
        with pytest.raises(Exception, match="bad month key"):
            require_months(some, "m").collect()
    with pytest.raises(Exception, match="bad month key"):
        require_months(df, "m").filter("v = 3").select("v").collect()  # neither the pick nor the pruned column hides it
    assert require_months(df.filter("v = 3"), "m").count() == 1


def test_product_months_and_nan(spark):
    from innsight.plans import product as prod

    nan = float("nan")
    cols = ("BOOKED_MONTH int, ITEM_NAME string, PRODUCT_CATEGORY string, VIEWED double, TRANSACTIONS int, ITEMSPURCHASED int, "
            "CONVERSION double, ATTENDANCE int, VALUE double, VALUE_ADDED double, CANCELLED int")
    rows = [(202401, "a", "d", 4.0, 1, 1, 25.0, 2, None, nan, 0), (202401, "b", "d", nan, 1, 1, nan, 2, 1.5, 9.0, 0),
            (202402, "c", "d", 2.0, 1, 1, 50.0, 2, 0.0, 7.25, 0)]
    df = spark.createDataFrame(rows, cols)
    total = prod.product_total(df).first()
    assert (total["Net Value"], total.View) == (8.75, 6.0)
    assert [r["Item Name"] for r in prod.product_performance(df).collect()] == ["a", "c", "b"]  # no views: last
    bad = df.unionByName(spark.createDataFrame([(209913, "z", "d", 1.0, 1, 1, 1.0, 1, 1.0, 1.0, 0)], cols))
    for report in (prod.product_total(bad), prod.product_total(bad, {"Item Name": ["a"]}), prod.product_performance(bad, {"Booked Year Month": ["2024-01"]})):
        with pytest.raises(Exception, match="bad month key"):
            report.collect()
    assert prod.product_total(bad, on_bad_month="null").first().View == 7.0
    assert [tuple(r) for r in prod.bad_months(bad.withColumn("t", F.lit("x")), ["t"]).collect()] == [("x", 1)]


def test_exact_sums_do_not_depend_on_order(spark):
    from innsight.operators.measures import exact_sum0

    vals = [0.1] * 10 + [1e17, 49.125, None]
    for order in (vals, vals[::-1]):
        df = spark.createDataFrame([(v,) for v in order], "v double").repartition(3)
        assert df.select(exact_sum0("v")).first()[0] == 1e17 + 50.125


def test_lenient_timestamp_formats(spark):
    df = spark.createDataFrame([("20240105",), ("2024-01-05 10:00:00",), ("garbage",), (None,)], "d string")
    got = [r[0] for r in df.select(lenient_timestamp(F.col("d"), T.StringType())).collect()]
    assert got == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5, 10), None, None]


def test_wall_clock_keeps_written_time(spark):
    df = spark.createDataFrame([("2024-01-01T23:30:00+02:00",)], "t string")
    assert df.select(wall_clock(F.col("t"))).first()[0] == dt.datetime(2024, 1, 1, 23, 30)


def test_transaction_status(spark):
    rows = [(9, "charge"), (None, "refund"), (1, None), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "s int, a string")
    got = [r[0] for r in df.select(transaction_status(F.col("s"), F.col("a"))).collect()]
    assert got == ["Refunded", "Refunded", "Charged", "Charged", "Refunded"]
    # text status compares as a number: '9.0' is refunded too
    df2 = spark.createDataFrame([("9.0",), ("9",), ("x",)], "s string")
    got2 = [r[0] for r in df2.select(transaction_status(F.col("s"), F.lit(None).cast("string"))).collect()]
    assert got2 == ["Refunded", "Refunded", "Charged"]


def test_default_if_blank(spark):
    df = spark.createDataFrame([("", "k"), (None, "k"), ("L", "k")], "l string, k string")
    assert [r[0] for r in df.select(default_if_blank(F.col("l"), F.col("k"))).collect()] == ["k", "k", "L"]


def test_formats_match_python(spark):
    ratios = [0.0, 0.12345, 0.5, 1.0, 0.00125, 2 / 3, 12.5]
    df = spark.createDataFrame([(r,) for r in ratios], "r double")
    got = df.select(pct(F.col("r")).alias("p"), fixed(F.col("r"), 2).alias("f")).collect()
    assert [g.p for g in got] == [f"{r:.2%}" for r in ratios]
    assert [g.f for g in got] == [f"{r:.2f}" for r in ratios]
    big = spark.createDataFrame([(1234567,)], "n bigint").select(thousands(F.col("n"))).first()[0]
    assert big == f"{1234567:,}"


def test_one_decimal_pct(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 5.0), (5.0, 4.0)], "p double, v double")
    got = [r[0] for r in df.select(one_decimal_pct(F.col("p") / F.col("v"))).collect()]
    assert got == ["33.3%", "0.0%", "125.0%"]
