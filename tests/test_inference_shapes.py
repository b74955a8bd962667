"""Type inference casts only cells that look like their type, and finds the types that the casts alone do."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from prepkit.sources import csv

ODD = ["12", "+5", "-5", " 12 ", "\t12\n", "12\x7f", "12\x00", "\x0012", "\x8512", "12\xa0", "1\x85", "１２", "١٢", "12.", "12.3", ".5", "5.", ".", "+", "-", "", "--5", "- 5", "1 2", "1_000", "1,000",
       "12L", "1e3", "1E-3", "1e", "1e+", "e5", ".e5", "5.e5", "1d", "1f", "1D", "5.d", "1e5f", "1e5 f", "0x10", "0x1p3", "0x.8p1", "0X1P3", "-0x1p1", "0x", "inf", "+inf", "iNf",
       "-Infinity", "infinity", "infinityd", "NaN", "nan", "+nan", "-NaN", "NaNf", "9223372036854775807", "9223372036854775808", "1e400", "1994", "1994-03-04", "1994-13-04",
       "1994-03-04T01:02:03.5", "04/03/1994", "123456", "294247", "294248", "+294248", "-290307", "-290308", "299999", "300000", "999999-01-01", "0300000", "1234567", " 300000", "N", "Norte"]


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp_ntz"])
def test_a_look_at_the_cell_changes_no_cast(spark, kind):
    df = spark.createDataFrame([(v,) for v in ODD], "v string").select("v", F.trim("v").alias("cell"))
    rows = df.select("v", csv._is_no(F.col("cell"), kind).alias("no"), F.col("cell").try_cast(kind).isNull().alias("plain")).collect()
    assert [r.v for r in rows if r.no != r.plain] == [] and {r.plain for r in rows} == {True, False}


def test_cells_that_are_no_numbers_cost_no_exceptions(spark):
    def seconds(cell):
        raw = spark.range(0, 800_000, 1, 4).select(*[F.expr(cell).alias(c) for c in "abc"])
        times = []
        for _ in range(3):
            start = time.perf_counter()
            csv.infer_types(raw)
            times.append(time.perf_counter() - start)
        return min(times)

    assert seconds("concat('A', id)") < 4 * seconds("concat('', 1000 + id % 9000)")
    assert seconds("concat('', 300000 + id % 600000)") < 4 * seconds("concat('', 1000 + id % 9000)")
