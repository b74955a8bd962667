"""End to end: the analysis notebook and the hold-out script on fixture
workbooks in the reference's sensor layout."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SENSOR_COLS, sensor_rows
from prepkit.plans.air_quality import normalize_readings, run_holdout, run_study
from prepkit.plans.workflows import BIN_OUT
from xlsx_writer import write_xlsx

LAYOUT = ["Fecha y hora"] + SENSOR_COLS + ["RAINF"]


@pytest.fixture(scope="module")
def study_books():
    d = tempfile.mkdtemp(prefix="study-")
    rows = sensor_rows()
    for year, drop_every in ((2021, 3), (2022, 0), (2023, 5)):
        sheets = {}
        for st in ("A", "B", "C"):
            cols = [c for c in LAYOUT if not (st == "B" and c == "SO2")]
            body = []
            for i, r in enumerate(x for x in rows if x["Estacion"] == st):
                vals = [r[c].replace(year=year) if c == "Fecha y hora" else r[c] for c in cols]
                if drop_every and i % drop_every == 0:
                    vals[cols.index("TOUT")] = None           # extra gaps in the other years
                body.append(vals)
            sheets[st] = [cols] + body
        write_xlsx(os.path.join(d, f"BD {year}.xlsx"), sheets, shared=True)
    return d


def test_analysis_notebook_end_to_end(spark, study_books):
    out = run_study(spark, os.path.join(study_books, "BD {year}.xlsx"), range(2020, 2026),
                    output_root=tempfile.mkdtemp(prefix="unified-"))
    assert out["skipped"] == [2020, 2024, 2025]
    assert out["best_year"] == 2022                           # fewest missing cells
    ranked = [r["anio"] for r in out["quality"].collect()]
    assert ranked[0] == 2022 and len(ranked) == 3
    assert out["understand"]["duplicates"].first()["n_duplicates"] == 5
    imputed = out["imputed"]
    feats = out["imputer"].columns
    assert "RAINF" not in imputed.columns and {"Mes", "Hora", "Estacion_B", "Estacion_C"} <= set(feats)
    left = imputed.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(feats)]).first()
    assert sum(left) == 0                                     # no gaps remain
    clean = out["clean"]
    assert BIN_OUT in clean.columns and clean.columns[0] == "Fecha y hora"
    labels = {r[0] for r in clean.select(BIN_OUT).distinct().collect()}
    assert labels <= {"Buena", "Regular", "Mala", None}
    z = clean.agg(F.avg("PM10").alias("m"), F.stddev_pop("PM10").alias("s")).first()
    assert abs(z["m"]) < 1e-9 and z["s"] == pytest.approx(1.0, rel=1e-9)
    corr = out["stats"]["corr"].collect()
    k = len({r["col_i"] for r in corr})
    assert len(corr) == k * k and k >= 8


def test_holdout_script_end_to_end(spark, sensor):
    complete = normalize_readings(sensor, skip=["Estacion"])
    out = run_holdout(complete)
    t = out["test_imputed"]
    assert t.columns[0] == "row_id"
    assert 0.1 * complete.count() < t.count() < 0.3 * complete.count()
    nums = [c for c in t.columns if c != "row_id"]
    assert t.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in nums]).first() == tuple([0] * len(nums))
    assert all(float(v).is_integer() for r in t.select(*[F.col(f"`{c}`") for c in nums]).collect() for v in r)
    stages = {r["stage"] for r in out["check"]["measures"].collect()}
    assert stages == {"original", "imputed"}
    assert out["post"]["corr"].count() == len(nums) ** 2
