"""Yearly files whose columns differ, one output per year, and time layouts found from the data."""

import datetime as dt

import pytest

from prepkit.functions.columns import infer_time_format, parse_inferred
from prepkit.operators.projection import add_time_features
from prepkit.plans.workflows import consolidate_sources
from prepkit.sinks.files import write_sources, written_sources
from prepkit.sources.batch import read_keyed_csv
from prepkit.sources.csv import read_csv, read_csv_union


def _file(path, text):
    path.write_text(text)
    return str(path)


def test_columns_dropped_and_reordered_S2_U1(spark, tmp_path):
    _file(tmp_path / "BD 2020.csv", "a,b,c\n1,x,2.5\nNA,y,3\n")
    _file(tmp_path / "BD 2021.csv", "a,c\n7,4\n")
    _file(tmp_path / "BD 2022.csv", "c,d,a\n5.5,2022-01-02 03:04:05,9\n")
    template, keys = f"{tmp_path}/BD {{year}}.csv", range(2019, 2023)
    want = {(2020, 1, "x", 2.5, None), (2020, None, "y", 3.0, None), (2021, 7, None, 4.0, None), (2022, 9, None, 5.5, dt.datetime(2022, 1, 2, 3, 4, 5))}
    for options in ({}, {"schema": "a bigint, b string, c double, d timestamp_ntz"}):
        df, skipped = read_keyed_csv(spark, template, keys, **options)
        assert skipped == [2019] and dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "timestamp_ntz", "anio": "bigint"}
        assert {(r.anio, r.a, r.b, r.c, r.d) for r in df.collect()} == want


def test_one_type_over_all_sources_and_undeclared_columns(spark, tmp_path):
    one, two = _file(tmp_path / "1.csv", "v\n1\n2\n"), _file(tmp_path / "2.csv", "v,w\n2.5,k\n")
    assert dict(read_csv_union(spark, [one, two]).dtypes) == {"v": "double", "w": "string"}
    with pytest.raises(ValueError, match="does not declare.*w"):
        read_csv_union(spark, [one, two], schema="v double")
    df = read_csv_union(spark, [one], schema="v double, gone string")
    assert [tuple(r) for r in df.orderBy("v").collect()] == [(1.0, None), (2.0, None)]


def test_header_cells_with_newlines(spark, tmp_path):
    path = _file(tmp_path / "n.csv", '"a\nb",c\n"1\n2",3\n')
    got = read_csv_union(spark, [path], multi_line=True)
    assert got.columns == ["a\nb", "c"] and tuple(got.first()) == ("1\n2", 3)
    assert read_csv(spark, path, multi_line=True).columns == ["a\nb", "c"]


def test_a_source_replaces_itself_alone_K1(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([(2020, 1), (2020, 2), (2021, 3), (2022, 4)], "anio bigint, v int")
    write_sources(rows, root)
    write_sources(rows.where("anio = 2021").union(rows.where("anio = 2021")), root, keys=[2021, 2022])      # 2022 has no rows any more
    assert {(r.anio, r.n_rows) for r in written_sources(spark, root).collect()} == {(2020, 2), (2021, 2)}
    back, skipped = read_keyed_csv(spark, root + "/anio={year}", [2020, 2021, 2022])
    assert skipped == [2022] and sorted((r.anio, r.v) for r in back.collect()) == [(2020, 1), (2020, 2), (2021, 3), (2021, 3)]
    with pytest.raises(ValueError, match="not of this run"):
        write_sources(rows, root, keys=[2020])
    with pytest.raises(ValueError, match="rows without"):
        write_sources(spark.createDataFrame([(None, 1)], "anio bigint, v int"), root)


def test_consolidating_some_years_leaves_the_others_W1(spark, tmp_path):
    for y in (2020, 2021):
        _file(tmp_path / f"BD {y}.csv", f"v\n{y}\n")
    root, template = str(tmp_path / "out"), f"{tmp_path}/BD {{year}}.csv"
    reader = lambda paths: read_csv(spark, paths, "v bigint")       # noqa: E731
    consolidate_sources(spark, template, [2019, 2020, 2021], reader, output_root=root)
    _file(tmp_path / "BD 2021.csv", "v\n1\n2\n")
    consolidate_sources(spark, template, [2021, 2022], reader, output_root=root)
    assert {(r.anio, r.n_rows) for r in written_sources(spark, root).collect()} == {(2020, 1), (2021, 2)}


@pytest.mark.parametrize("cells,want", [
    (["2022-01-02 03:04:05", "2022-12-31 23:59:59"], "yyyy-M-d H:mm:ss"), (["01/02/2022 3:04", "02/01/2022 3:04"], "M/d/yyyy H:mm"),
    (["01/02/2022 3:04", "13/01/2022 3:04"], "d/M/yyyy H:mm"), (["1/2/2022 3:04 PM", None, "NA"], "M/d/yyyy h:mm a"), ([None, ""], "yyyy-M-d")])
def test_layouts_P6(spark, cells, want):
    df = spark.createDataFrame([(c,) for c in cells], "`Fecha y hora` string")
    assert infer_time_format(df, "Fecha y hora") == want


def test_no_layout_fits(spark):
    df = spark.createDataFrame([("2022-01-02",), ("2022-01-03",), ("soon",)], "t string")
    with pytest.raises(ValueError, match="'yyyy-M-d' comes closest, with 1 of 3"):
        parse_inferred(df, ["t"])


def test_month_and_hour_of_a_found_layout_P7_P8(spark):
    df = spark.createDataFrame([("25/12/2021 07:30",), ("01/02/2022 18:00",), (None,)], "t string")
    got = {(r.t, r.Mes, r.Hora) for r in add_time_features(df, "t", fmt="infer").collect()}
    assert got == {(dt.datetime(2021, 12, 25, 7, 30), 12, 7), (dt.datetime(2022, 2, 1, 18), 2, 18), (None, None, None)}
