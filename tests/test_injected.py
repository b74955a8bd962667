"""Rows that the driver tables lack (another year and flag, NULL and NaN cells),
injected into a copy of them: the queries still match their oracles."""

import os

import numpy as np
import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from tools.check_oracle import digest  # noqa: E402


@pytest.fixture(scope="module")
def injected(tmp_path_factory):
    d = tmp_path_factory.mktemp("injected")
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        df = pd.read_parquet(f"{SF_SMALL}/{t}.parquet")
        if t == "lineitem":
            extra = df.head(8).copy()
            extra["l_shipdate"] = extra["l_shipdate"] + pd.DateOffset(years=40)
            extra.loc[extra.index[:4], "l_returnflag"] = "X"
            extra.loc[extra.index[4:], "l_returnflag"] = None
            extra.loc[extra.index[:3], "l_quantity"] = np.nan
            df = pd.concat([df, extra], ignore_index=True)
        path = os.path.join(d, f"{t}.parquet")
        df.to_parquet(path, coerce_timestamps="us")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return str(d), con


@pytest.mark.parametrize("name", ["yearly_sources", "skipped_sources", "consolidated", "tagged_union", "null_profile", "null_pct_label",
                                  "dedupe_rows", "quality_by_year", "central_measures", "standardise", "impute_one_gap"])
def test_query_matches_oracle(spark, injected, name):
    d, con = injected
    df = queries()[name](spark, d)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    assert digest(df.columns, rows)[0] == digest(ocols, res.fetchall())[0]
