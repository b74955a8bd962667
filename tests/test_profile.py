"""U1, U2, A1–A9, O1–O3, F9."""

import pytest
from pyspark.sql import functions as F

from prepkit.operators import profile as prof
from prepkit.operators import setops
from prepkit.operators.projection import drop_checked, move_to_front, select_by_position


def test_union_by_name_widens_and_fills_U1(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([(2.5, "x")], "a double, b string")
    u = setops.union_by_name({"s1": a, "s2": b}, tag_column="src")
    assert dict(u.dtypes) == {"a": "double", "src": "string", "b": "string"}
    rows = sorted(u.collect(), key=lambda r: r["a"])
    assert rows[0]["b"] is None and rows[0]["src"] == "s1" and rows[1]["b"] == "x"


def test_distinct_null_and_signed_zero_U2_A5(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (0.0, 1), (-0.0, 1)], "x double, y int")
    assert setops.distinct_rows(df).count() == 2
    r = prof.duplicate_count(df).first()
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (4, 2, 2)


def test_duplicates_equal_rows_minus_distinct(sensor):
    r = prof.duplicate_count(sensor).first()
    assert r["n_duplicates"] == 5
    assert r["n_rows"] - setops.distinct_rows(sensor).count() == r["n_duplicates"]


def test_quality_counts_union_nulls_A2_A6(spark, sensor):
    q = prof.quality_by_source(sensor.withColumn("anio", F.lit(2022)), "anio").first()
    pdf = sensor.toPandas()
    assert q["total_rows"] == len(pdf)
    assert q["null_cells"] == int(pdf.isna().sum().sum())


def test_rank_and_best_source_O1_O2(spark):
    q = spark.createDataFrame([(2020, 5), (2021, None), (2022, 3), (2023, 3)], "anio int, null_cells int")
    assert [r["anio"] for r in prof.rank_sources(q).collect()] == [2022, 2023, 2020, 2021]
    assert prof.best_source(q).first()["anio"] == 2022


def test_null_profile_P10(spark):
    df = spark.createDataFrame([(None,)] + [(1.0,)] * 7, "x double")
    r = prof.null_pct_labels(prof.null_profile(df)).first()
    assert r["null_pct_label"] == "12.5 %"
    df2 = spark.createDataFrame([(1.0,)] * 3, "x double")
    assert prof.null_pct_labels(prof.null_profile(df2)).first()["null_pct_label"] == "0.0 %"


def test_constant_columns_F9(sensor):
    got = {r["column_name"]: r["is_constant"] for r in prof.constant_columns(sensor).collect()}
    assert got["RAINF"] is True and got["PM10"] is False


def test_shape_schema_head(spark, sensor):
    s = prof.shape(sensor).first()
    assert s["n_cols"] == len(sensor.columns) and s["n_rows"] == sensor.count()
    sp = {r["column_name"]: r for r in prof.schema_profile(sensor).collect()}
    assert sp["PM2.5"]["dtype"] == "double"
    assert sp["SO2"]["non_null_count"] == sensor.where(F.col("SO2").isNotNull()).count()
    h = prof.head(sensor, 5, ["Fecha y hora", "Estacion"]).collect()
    assert len(h) == 5 and h[0]["Estacion"] == "A"
    g = {r["column_name"]: r for r in prof.glimpse(sensor, 3, ["Fecha y hora", "Estacion"]).collect()}
    assert g["Estacion"]["first_values"] == "A, B, C"


def test_projection_helpers_P2_P4_P5(spark):
    df = spark.createDataFrame([(0, 1.0, "x")], "idx int, `PM2.5` double, s string")
    with pytest.raises(KeyError):
        drop_checked(df, ["nope"])
    assert select_by_position(df, 1).columns == ["PM2.5", "s"]
    assert move_to_front(df, ["s"]).columns == ["s", "idx", "PM2.5"]


def test_empty_table_has_no_null_share_A4(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert [(r["null_count"], r["null_pct"]) for r in prof.null_profile(empty).collect()] == [(0, None), (0, None)]


def test_union_of_integers_stays_exact_U1(spark):
    big = spark.createDataFrame([(2**53 + 1,)], "k bigint")
    out = setops.union_by_name([big, spark.createDataFrame([(1,)], "k int")])
    assert dict(out.dtypes) == {"k": "bigint"} and out.agg(F.max("k")).first()[0] == 2**53 + 1


def test_understand_scans_its_table_once_W2(spark, tmp_path, monkeypatch):
    from prepkit.operators import profile as prof
    from prepkit.plans import workflows
    spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, 0.5)], "a long, b string, `c d` double").write.parquet(str(tmp_path / "t"))
    df, plans, write = spark.read.parquet(str(tmp_path / "t")), [], workflows.write_stage
    monkeypatch.setattr(workflows, "write_stage", lambda d, *a, **k: plans.append(d._jdf.queryExecution().toString()) or write(d, *a, **k))
    u = workflows.understand(df)
    assert sum(str(tmp_path) in p for p in plans) == 1
    assert all(str(tmp_path) not in u[k]._jdf.queryExecution().toString() for k in u)
    assert tuple(u["shape"].first()) == (3, 3) and tuple(u["duplicates"].first()) == (3, 2, 1)
    assert {r.column_name: (r.non_null_count, r.dtype) for r in u["schema"].collect()} == {"a": (3, "bigint"), "b": (2, "string"), "c d": (1, "double")}
    assert {r.column_name: r.null_pct_label for r in u["null_pct"].collect()} == {"a": "0.0 %", "b": "33.33 %", "c d": "66.67 %"}
    assert u["distinct"].columns == df.columns and u["distinct"].count() == 2
    empty = workflows.understand(df.limit(0))
    assert tuple(empty["shape"].first()) == (0, 3) and prof.COPIES not in empty["distinct"].columns
