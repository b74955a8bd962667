"""Workbook source, CSV scans, keyed yearly batches."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import sensor_rows
from prepkit.operators import profile as prof
from prepkit.plans.workflows import consolidate_sources
from prepkit.sinks.files import write_csv, write_csv_indexed
from prepkit.sources.batch import read_keyed_sources
from prepkit.sources.csv import malformed_counts, read_csv
from prepkit.sources.workbook import read_workbooks
from xlsx_writer import write_xlsx

COLS = ["Fecha y hora", "CO", "NO", "SO2", "PM10", "PM2.5"]


def _sheets(rows, year):
    out = {}
    for st in ("A", "B", "C"):
        cols = [c for c in COLS if not (st == "B" and c == "SO2")]
        body = [[r[c].replace(year=year) if c == "Fecha y hora" else r[c] for c in cols]
                for r in rows if r["Estacion"] == st][:40]
        if st == "C" and body:
            body[0][cols.index("CO")] = "NA"          # NA token in a number column
        out[st] = [cols] + body
    return out


@pytest.fixture(scope="module")
def workbooks():
    d = tempfile.mkdtemp(prefix="wb-fixture-")
    rows = sensor_rows()
    for year in (2021, 2023):
        write_xlsx(os.path.join(d, f"BD {year}.xlsx"), _sheets(rows, year))
    return d


def test_workbook_all_sheets_union_S1_U1_P1(spark, workbooks):
    df = read_workbooks(spark, [os.path.join(workbooks, "BD 2021.xlsx")], sheet_column="Estacion")
    assert set(COLS) <= set(df.columns) and "Estacion" in df.columns
    assert df.count() == 120
    assert df.where("Estacion = 'B'").where(F.col("SO2").isNotNull()).count() == 0
    first = df.where("Estacion = 'A'").first()
    assert first["Fecha y hora"].startswith("2021-01-01")


def test_workbook_declared_schema_and_first_sheet_S7(spark, workbooks):
    ddl = ("`Fecha y hora` timestamp_ntz, CO double, NO double, SO2 double, PM10 double, `PM2.5` double, "
           "sheet string, file string")
    df = read_workbooks(spark, [os.path.join(workbooks, "BD 2021.xlsx")], schema=ddl)
    assert dict(df.dtypes)["Fecha y hora"] == "timestamp_ntz"
    c = df.where("sheet = 'C'").orderBy("Fecha y hora").first()
    assert c["CO"] is None                                  # "NA" → NULL
    assert c["Fecha y hora"] == dt.datetime(2021, 1, 1, 0, 0)
    one = read_workbooks(spark, [os.path.join(workbooks, "BD 2021.xlsx")], schema=ddl, sheet=0)
    assert one.select("sheet").distinct().collect()[0][0] == "A"


def test_yearly_workbooks_skip_missing_W1_S2_S3(spark, workbooks):
    ddl = ("`Fecha y hora` timestamp_ntz, CO double, NO double, SO2 double, PM10 double, `PM2.5` double, "
           "Estacion string, file string")
    out_root = tempfile.mkdtemp(prefix="unified-")
    res = consolidate_sources(
        spark, os.path.join(workbooks, "BD {year}.xlsx"), range(2020, 2026),
        lambda paths: read_workbooks(spark, paths, schema=ddl, sheet_column="Estacion"),
        path_column="file", exclude=["file"], output_root=out_root)
    assert res.skipped == [2020, 2022, 2024, 2025]
    q = {r["anio"]: r for r in res.quality.collect()}
    assert set(q) == {2021, 2023} and q[2021]["total_rows"] == 120
    pdf = res.data.where("anio = 2021").drop("file", "anio").toPandas()
    assert q[2021]["null_cells"] == int(pdf.isna().sum().sum())
    assert res.best.first()["anio"] in (2021, 2023)
    assert q[2021]["output_path"] == out_root + "/anio=2021"
    back = read_csv(spark, q[2021]["output_path"], ddl.replace(", file string", ""))
    assert back.count() == 120


def test_csv_wrong_delimiter_fails_S5(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, "y")], "row_id bigint, v double, s string")
    path = write_csv_indexed(df, os.path.join(d, "t"), sep=",")
    ok = read_csv(spark, path, "row_id bigint, v double, s string", sep=",")
    assert sorted(map(tuple, ok.collect())) == [(1, 2.5, "x"), (2, None, "y")]
    with pytest.raises(Exception):
        read_csv(spark, path, "row_id bigint, v double, s string", sep=";").collect()


def test_csv_na_tokens_and_malformed_S6(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as fh:
        fh.write("a,b\n1.5,x\nNA,y\nNaN,NA\nabc,z\n,w\n")
    df = read_csv(spark, p, "a double, b string")
    assert [tuple(r) for r in df.collect()] == [(1.5, "x"), (None, "y"), (None, None), (None, "z"), (None, "w")]
    assert malformed_counts(spark, p, "a double, b string").first()["malformed"] == 1


def test_keyed_csv_sources_K1_S2(spark):
    d = tempfile.mkdtemp(prefix="years-")
    df = spark.range(30).select((F.col("id") % 3 + 2020).alias("anio"), (F.col("id") * 0.5).alias("v"))
    write_csv(df, d, partition_by=["anio"])
    back, skipped = read_keyed_sources(spark, d + "/anio={year}", range(2019, 2024),
                                       lambda paths: read_csv(spark, paths, "v double"))
    assert skipped == [2019, 2023]
    got = prof.quality_by_source(back, "anio").orderBy("anio").collect()
    assert [(r["anio"], r["total_rows"]) for r in got] == [(2020, 10), (2021, 10), (2022, 10)]


@pytest.mark.parametrize("shared,date1904,custom", [(True, False, False), (False, True, True), (True, True, False)])
def test_workbook_encodings(spark, shared, date1904, custom):
    d = tempfile.mkdtemp(prefix="wb-enc-")
    t0 = dt.datetime(2022, 3, 4, 5, 0)
    rows = [["Fecha y hora", "PM10", "Nota"], [t0, 12.5, "ok"], [t0 + dt.timedelta(hours=1), None, "NA"],
            [t0 + dt.timedelta(hours=2), 7.0, "ok"]]
    path = write_xlsx(os.path.join(d, "w.xlsx"), {"Norte": rows, "Sur": rows[:2]},
                      shared=shared, date1904=date1904, custom_date=custom)
    df = read_workbooks(spark, [path], schema="`Fecha y hora` timestamp_ntz, PM10 double, Nota string, "
                                              "sheet string, file string")
    got = sorted((r["sheet"], r["Fecha y hora"], r["PM10"], r["Nota"]) for r in df.collect())
    assert got == [("Norte", t0, 12.5, "ok"), ("Norte", t0 + dt.timedelta(hours=1), None, None),
                   ("Norte", t0 + dt.timedelta(hours=2), 7.0, "ok"), ("Sur", t0, 12.5, "ok")]
    inferred = read_workbooks(spark, [path])
    assert dict(inferred.dtypes)["Fecha y hora"] == "string"
    assert inferred.where("sheet = 'Sur'").first()["Fecha y hora"] == "2022-03-04 05:00:00"


def test_workbook_file_uri_and_glob(spark, workbooks):
    df = read_workbooks(spark, ["file://" + os.path.join(workbooks, "BD 20*.xlsx")],
                        schema="`Fecha y hora` timestamp_ntz, PM10 double, sheet string, file string")
    assert df.count() == 240
    assert {r["file"].rsplit("/", 1)[-1] for r in df.select("file").distinct().collect()} == {"BD 2021.xlsx", "BD 2023.xlsx"}


def test_names_with_spaces_and_globs_S2(spark):
    d = tempfile.mkdtemp(prefix="years-")
    for y in (2021, 2023):
        write_csv(spark.createDataFrame([(y * 1.0,)], "v double"), os.path.join(d, f"BD {y} a+b.csv"))
    for name in ("BD {year} a+b.csv", "B* {year} a?b.csv"):
        back, skipped = read_keyed_sources(spark, d + "/" + name, range(2020, 2025), lambda paths: read_csv(spark, paths, "v double"))
        # Spark puts part files below the named folder: the key is in the folder's name
        assert skipped == [2020, 2022, 2024]
        assert sorted((r["anio"], r["v"]) for r in back.collect()) == [(2021, 2021.0), (2023, 2023.0)]


def test_csv_text_fidelity_K1_S4(spark):
    rows = [(1, " padded "), (2, 'q"uote'), (3, "two\nlines"), (4, "a,b"), (5, 'say ""hi""'), (6, "plain")]
    path = os.path.join(tempfile.mkdtemp(prefix="csv-"), "t")
    df = spark.createDataFrame(rows, "k bigint, s string")
    write_csv(df.coalesce(1), path)
    assert sorted(map(tuple, read_csv(spark, path, "k bigint, s string", multi_line=True).collect())) == rows
    import pandas as pd
    part = next(f for f in os.listdir(path) if f.startswith("part"))
    assert [tuple(r) for r in pd.read_csv(os.path.join(path, part)).itertuples(index=False)] == rows


def test_infer_schema_S4(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="csv-"), "x.csv")
    with open(p, "w") as fh:
        fh.write("a,b,c,d,e,f\n1,1.5,x,2020-01-01 10:00:00,true,\n2,NA,3,,False,\n9007199254740993,2,y,2021-05-06 00:00:00,true,\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "timestamp_ntz", "e": "boolean", "f": "double"}
    assert df.agg(F.max("a")).first()[0] == 9007199254740993
    got = {r["column_name"]: r["malformed"] for r in malformed_counts(spark, p, "a bigint, b bigint, c double, d string, e string, f double").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "f": 0}
