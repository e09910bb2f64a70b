"""Edge rows for the per-transaction encoders (FIXTURES.md part 3)."""
import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import encode as E


def _one_col(spark, values, expr, typ="double"):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_amount_bin_matches_digitize(spark):
    vals = [0.0, 0.5, 1.0, 4.99, 10000.0, 1e9, 75.0, 74.99, 20.0, 3000.01]
    got = _one_col(spark, vals, E.amount_bin_index)
    want = [int(np.digitize(abs(v), E.AMOUNT_EDGES)) for v in vals]
    assert got == want
    assert got[:6] == [1, 1, 2, 2, 20, 20]


def test_amount_bin_raw_inf_nan(spark):
    assert _one_col(spark, [math.inf, math.nan], E.amount_bin_index) == [21, 21]
    assert _one_col(spark, [math.inf, math.nan, None], E.amount_bin_token) == ["<AMOUNT_20>", "[UNK]", "[UNK]"]


def test_amount_ranges(spark):
    assert _one_col(spark, [10, 10.01, -50, 1000, 1000.01], E.amount_range_6) == \
        ["0-10", "10-50", "10-50", "500-1000", "1000+"]
    assert _one_col(spark, [99.99, 100, 500, -7], E.amount_range_3) == ["0-100", "100-500", "500+", "0-100"]


def test_sign(spark):
    assert _one_col(spark, [0.0, -0.01, math.nan, None], E.sign_token) == \
        ["<INFLOW>", "<OUTFLOW>", "<OUTFLOW>", "<OUTFLOW>"]


def test_weekday_sunday(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 1, 1, 10, 0),)], "d timestamp_ntz")
    r = df.select(E.weekday_token("d"), E.weekday_name("d"), E.month_token("d"), E.day_token("d")).first()
    assert list(r) == ["<WEEKDAY_6>", "sunday", "<MONTH_1>", "<DAY_1>"]


def test_pretokenize(spark):
    df = spark.createDataFrame([("Netflix.com PG&E McDonald's",), (None,), ("café au lait",)], "s string")
    got = [r[0] for r in df.select(E.pretokenize("s")).collect()]
    assert got[0] == ["Netflix", ".", "com", "PG", "&", "E", "McDonald", "'", "s"]
    assert got[1] == []
    assert got[2] == ["café", "au", "lait"]


def test_tagged_string(spark):
    df = spark.createDataFrame([("out", 50.0, 10, 5, 7, "sunday", "netflix.com")],
                               "type string, amount double, hour int, day int, month int, day_week string, merchant string")
    r = df.select(E.tagged_transaction_string("type", "amount", "hour", "day", "month", "day_week", "merchant")).first()[0]
    assert r == "<out><amount:0-100><hour:10><day:5><month:7><day_week:sunday>netflix.com"


def test_spaced_string(spark):
    df = spark.createDataFrame([("card", -30.0, dt.datetime(2023, 3, 7), "Uber Trip")],
                               "origin string, amount double, d timestamp_ntz, description string")
    r = df.select(E.spaced_transaction_string("origin", "amount", "d", "description")).first()[0]
    assert r == "<card> <OUTFLOW> <AMOUNT_10-50> <MONTH_3> <DAY_7> <WEEKDAY_1> Uber Trip [SEP]"


def test_format_tokens(spark):
    df = spark.createDataFrame([(["Uber", "Trip"], [300, 301])], "t array<string>, i array<int>")
    assert df.select(E.format_tokens("t", "i")).first()[0] == "Uber(300) Trip(301)"
