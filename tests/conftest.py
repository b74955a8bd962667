from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prepkit.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", app="prepkit-tests", shuffle_partitions=8)
    yield s


def sensor_rows(stations=("A", "B", "C"), hours=240):
    """FIXTURES.md §B: a small sensor table built by arithmetic only.

    Station B lacks SO2 (union null fill), ~10% gaps in four columns in many
    patterns, RAINF all 0.0, NO/NO2/NOX strongly correlated, one row with
    every reading missing, five exact duplicate rows (one with gaps)."""
    import datetime as dt
    rows = []
    base = dt.datetime(2022, 1, 1)
    for s_i, st in enumerate(stations):
        for h in range(hours):
            k = s_i * hours + h
            no = 5.0 + (k * 7 % 23) * 0.5
            no2 = 10.0 + (k * 11 % 19) * 0.4
            nox = no + no2 + ((k * 13 % 7) - 3) * 0.05
            pm10 = 20.0 + (k * 17 % 97) * 1.1
            pm25 = 0.45 * pm10 + (k % 5) * 0.3
            o3 = 30.0 + (k * 3 % 41) * 0.7
            co = 0.2 + (k * 5 % 13) * 0.05
            tout = 15.0 + (h % 24) * 0.5 + s_i
            rh = 80.0 - (h % 24) * 1.2
            so2 = None if st == "B" else 2.0 + (k % 11) * 0.2
            rec = {"Fecha y hora": base + dt.timedelta(hours=h), "Estacion": st,
                   "CO": co, "NO": no, "NO2": no2, "NOX": nox, "O3": o3, "SO2": so2,
                   "PM10": pm10, "PM2.5": pm25, "TOUT": tout, "RH": rh, "RAINF": 0.0}
            if k % 10 == 3:
                rec["PM10"] = None
            if k % 9 == 4:
                rec["O3"] = None
            if k % 11 == 5:
                rec["NO2"] = None
            if k % 13 == 6:
                rec["CO"] = None
            rows.append(rec)
    allmiss = dict(rows[7])
    for c in ("CO", "NO", "NO2", "NOX", "O3", "SO2", "PM10", "PM2.5", "TOUT", "RH"):
        allmiss[c] = None
    rows[7] = allmiss
    rows += [dict(rows[i]) for i in (1, 2, 3, 5, 13)]   # 13 has PM10 gap
    return rows


SENSOR_DDL = ("`Fecha y hora` timestamp_ntz, Estacion string, CO double, NO double, NO2 double, "
              "NOX double, O3 double, SO2 double, PM10 double, `PM2.5` double, TOUT double, "
              "RH double, RAINF double")
SENSOR_COLS = ["CO", "NO", "NO2", "NOX", "O3", "SO2", "PM10", "PM2.5", "TOUT", "RH"]


@pytest.fixture(scope="session")
def sensor(spark):
    rows = sensor_rows()
    names = [c.strip("`").split("` ")[0] if c.startswith("`") else c.split(" ")[0]
             for c in (p.strip() for p in SENSOR_DDL.split(","))]
    data = [tuple(r[n] for n in names) for r in rows]
    return spark.createDataFrame(data, SENSOR_DDL)
