"""The driver's correctness gate, in-suite: every registered query against
its DuckDB oracle on sf0.001 (row count, column names, value multiset)."""

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from prepkit.plans.standins import TABLES  # noqa: E402
from tools.check_oracle import digest  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only_queries_run(spark, name):
    assert queries()[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["anio", "total_rows", "null_cells"]
    rows = df.collect()
    assert rows and [r["null_cells"] for r in rows] == sorted(r["null_cells"] for r in rows)
