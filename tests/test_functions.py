"""P-family, S6 and F7 edge cases (FIXTURES.md §C)."""

from pyspark.sql import functions as F

from prepkit.functions.columns import (col, malformed_number, parse_number, percent_label,
                                       round_half_even, sig_round)
from prepkit.operators.features import bin_right_closed


def test_quoting_handles_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`PM2.5` double, `Fecha y hora` double")
    assert df.select(col("PM2.5"), col("Fecha y hora")).first() == (1.0, 2.0)


def test_na_tokens_and_malformed_S6(spark):
    df = spark.createDataFrame([("",), ("NA",), ("NaN",), ("null",), ("1.5",), ("abc",)], "v string")
    got = [r[0] for r in df.select(parse_number(F.col("v"))).collect()]
    assert got == [None, None, None, None, 1.5, None]
    bad = df.agg(F.count_if(malformed_number(F.col("v")))).first()[0]
    assert bad == 1


def test_round_half_even_P9(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(round_half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, 0.0]


def test_round_half_even_scaled_like_numpy(spark):
    import numpy as np
    vals = [109480.665, 0.125, 2.675, 1.005, 16118.505]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(round_half_even(F.col("x"), 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_percent_label_P10(spark):
    df = spark.createDataFrame([(12.5,), (0.0,), (100.0 / 3,)], "x double")
    assert [r[0] for r in df.select(percent_label(F.col("x"))).collect()] == ["12.5 %", "0.0 %", "33.33 %"]


def test_bin_right_closed_F7(spark):
    vals = [-1.0, 0.0, 0.1, 50.0, 50.1, 100.0, 1e9, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    lab = bin_right_closed(F.col("x"), [0, 50, 100, float("inf")], ["Buena", "Regular", "Mala"])
    assert [r[0] for r in df.select(lab).collect()] == [None, None, "Buena", "Buena", "Regular",
                                                        "Regular", "Mala", None]


def test_sig_round(spark):
    df = spark.createDataFrame([(123456.789123456,), (0.000123456789123,), (0.0,), (None,), (-2.5e-7,)], "x double")
    got = [r[0] for r in df.select(sig_round(F.col("x"), 6)).collect()]
    assert got == [123457.0, 0.000123457, 0.0, None, -2.5e-7]
