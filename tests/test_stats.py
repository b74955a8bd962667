"""A10–A19, P13 and the scalable exact-quantile path."""

import math

import numpy as np
import pytest

import prepkit.operators.quantiles as qm
from prepkit.operators import stats
from prepkit.operators.features import Standardizer
from prepkit.operators.quantiles import exact_quantiles
from prepkit.sinks.files import write_stage


def test_central_measures_A11_A14_A16(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    r = stats.central_measures(df, ["x"]).first()
    assert r["median"] == 2.5 and r["mean"] == 4.0 and r["half_range"] == 4.5
    q = {row["p"]: row["value"] for row in exact_quantiles(df, ["x"], [0.25, 0.75]).collect()}
    assert q == {0.25: 1.75, 0.75: 4.75}
    df2 = spark.createDataFrame([(2.0,), (10.0,)], "x double")
    assert stats.central_measures(df2, ["x"]).first()["half_range"] == 4.0


def test_quantiles_equal_numpy_whatever_the_shape(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(100, 30, 20000), np.full(9000, 42.0), rng.exponential(5, 3000) * 1e300])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "x double, g int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    monkeypatch.setattr(qm, "INSIDE", 20)       # brackets are narrowed first, as at scale
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)
    for r in exact_quantiles(df, ["x"], [0.5], by=["g"]).collect():
        sub = vals[np.arange(len(vals)) % 3 == r["g"]]
        assert r["value"] == pytest.approx(float(np.median(sub)), rel=1e-12)


def test_quantiles_of_missing_kinds_end_in_few_passes(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    vals = [nan, inf, -inf, None, *[float(v) for v in range(12_000)], 1e308, -1e308]
    df = spark.createDataFrame([(v, v is None) for v in vals], "x double, g boolean")
    monkeypatch.setattr(qm, "INSIDE", 10)
    stages = []
    monkeypatch.setattr(qm, "write_stage", lambda d, name: stages.append(name) or write_stage(d, name))
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0]).collect()}
    here = sorted(v for v in vals if v is not None and v == v)
    assert got[0.0] == -inf and got[1.0] == inf and got[0.5] == np.median(here)
    assert stages.count("quantile-counts") <= 4
    assert {r["value"] for r in exact_quantiles(df, ["x"], [0.5], by=["g"]).where("g").collect()} == {None}


def test_many_groups_stay_in_spark(spark):
    df = spark.range(300_000).selectExpr("id div 3 as g", "cast(id as double) as x")
    got = exact_quantiles(df, ["x"], [0.5], by=["g"])
    assert got.where("value = g * 3 + 1").count() == 100_000


def test_integral_measures_stay_exact(spark):
    df = spark.createDataFrame([(2**53 + 1, 1), (2**53 + 3, None)], "a bigint, b int")
    got = {r["column_name"]: r for r in stats.central_measures(df).collect()}
    assert (got["a"]["max"], got["a"]["min"], got["b"]["max"]) == (2**53 + 3, 2**53 + 1, 1)


def test_corr_pairwise_and_zero_variance_A18(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, None, 5.0), (3.0, 4.0, 5.0), (4.0, 3.0, 5.0)],
                               "a double, b double, k double")
    m = {(r["col_i"], r["col_j"]): r["value"] for r in stats.corr_matrix(df, ["a", "b", "k"]).collect()}
    assert m[("a", "b")] == pytest.approx(0.785714285714, rel=1e-9)
    assert m[("a", "b")] == m[("b", "a")] and m[("a", "a")] == 1.0
    assert m[("k", "k")] is None and m[("a", "k")] is None


def test_cov_propagates_nulls_A17(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None), (3.0, 4.0)], "a double, b double")
    m = {(r["col_i"], r["col_j"]): r["value"] for r in stats.cov_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "a")] == pytest.approx(2.0 / 3.0) and m[("a", "b")] is None


def test_standardised_covariance_is_correlation(sensor):
    cols = ["NO", "NOX", "TOUT", "RH"]
    complete = sensor.dropna(subset=cols)
    z = Standardizer(cols).fit(complete).transform(complete)
    cov = {(r["col_i"], r["col_j"]): r["value"] for r in stats.cov_matrix(z, cols).collect()}
    cor = {(r["col_i"], r["col_j"]): r["value"] for r in stats.corr_matrix(complete, cols).collect()}
    for k, v in cor.items():
        assert cov[k] == pytest.approx(v, abs=1e-9)


def test_center_and_labels_P13_A19(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "a double, b double")
    c = stats.center(df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in c) == [-1.0, 1.0]
    lab = {(r["col_i"], r["col_j"]): r["label"] for r in
           stats.corr_labels(stats.corr_matrix(df, ["a", "b"])).collect()}
    assert lab[("a", "b")] == "1.00"


def test_compare_stages_A20(spark):
    a = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    b = spark.createDataFrame([(1.0,), (None,)], "x double")
    got = {r["stage"]: r for r in stats.compare_stages({"before": a, "after": b}).collect()}
    assert got["before"]["mean"] == 2.0 and got["after"]["mean"] == 1.0
    assert not math.isnan(got["after"]["median"])
