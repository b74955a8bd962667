
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SENSOR_COLS
from prepkit.operators import profile as prof
from prepkit.operators import setops, stats
from prepkit.operators.features import IQRClipper, Standardizer, assign_split
from prepkit.operators.impute import ChainedImputer
from prepkit.operators.quantiles import exact_quantiles

small_floats = st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False).map(lambda v: round(v, 2)))
rows_strategy = st.lists(st.tuples(small_floats, small_floats, st.sampled_from(["a", "b", None])),
                         min_size=1, max_size=40)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(rows=rows_strategy)
def test_duplicates_equal_rows_minus_distinct(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double, s string")
    r = prof.duplicate_count(df).first()
    assert r["n_duplicates"] == len(rows) - setops.distinct_rows(df).count()
    assert r["n_duplicates"] == len(rows) - len(set(rows))


@SETTINGS
@given(rows=rows_strategy)
def test_null_pct_in_range_and_exact(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double, s string")
    for r in prof.null_profile(df).collect():
        assert 0.0 <= r["null_pct"] <= 100.0
        idx = ["x", "y", "s"].index(r["column_name"])
        assert r["null_count"] == sum(1 for row in rows if row[idx] is None)


@SETTINGS
@given(rows=rows_strategy, probs=st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), min_size=1, max_size=3, unique=True))
def test_refined_quantiles_equal_numpy(spark, rows, probs):
    df = spark.createDataFrame(rows, "x double, y double, s string")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs).collect()}
    vals = np.array([r[0] for r in rows if r[0] is not None])
    for p in probs:
        if len(vals) == 0:
            assert got[p] is None
        else:
            assert got[p] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


@SETTINGS
@given(rows=rows_strategy)
def test_clip_within_fences_and_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double, s string")
    clip = IQRClipper(["x"]).fit(df)
    out = clip.transform(df)
    lo, hi = clip.fences["x"][3], clip.fences["x"][4]
    vals = [r["x"] for r in out.collect()]
    assert [v is None for v in vals] == [r[0] is None for r in rows]
    if lo is not None:
        assert all(lo <= v <= hi for v in vals if v is not None)
    assert [r["x"] for r in clip.transform(out).collect()] == vals


def test_standardised_moments_and_symmetric_correlation(sensor):
    cols = ["NO", "NO2", "NOX", "TOUT", "RH", "PM10"]
    z = Standardizer(cols).fit(sensor).transform(sensor)
    m = z.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
              *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    for i in range(len(cols)):
        assert abs(m[f"m{i}"]) < 1e-12 and m[f"s{i}"] == pytest.approx(1.0, rel=1e-12)
    corr = {(r["col_i"], r["col_j"]): r["value"] for r in stats.corr_matrix(sensor, cols).collect()}
    for a in cols:
        assert corr[(a, a)] == 1.0
        for b in cols:
            assert corr[(a, b)] == corr[(b, a)]


def _rows(df, ndigits=9):
    def norm(v):
        return round(v, ndigits) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("op", ["quality", "nulls", "dups", "central", "corr", "cov", "split", "fences", "impute"])
def test_partition_invariance(sensor, op):
    cols = [c for c in SENSOR_COLS if c != "SO2"]

    def run(df):
        if op == "quality":
            return prof.quality_by_source(df.withColumn("anio", F.lit(2022)), "anio")
        if op == "nulls":
            return prof.null_profile(df)
        if op == "dups":
            return prof.duplicate_count(df)
        if op == "central":
            return stats.central_measures(df, cols)
        if op == "corr":
            return stats.corr_matrix(df, cols)
        if op == "cov":
            return stats.cov_matrix(df, cols)
        if op == "split":
            return assign_split(df, ["Estacion", "Fecha y hora"]).select("Estacion", "Fecha y hora", "split")
        if op == "fences":
            return IQRClipper(cols).fit(df).fences_frame(df.sparkSession)
        return ChainedImputer(cols).fit_transform(df).select(*[F.col(f"`{c}`") for c in cols])

    assert _rows(run(sensor.repartition(1))) == _rows(run(sensor.repartition(7)))
