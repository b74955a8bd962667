"""Stand-ins for the reference's measurement tables, derived by Spark from
the given driver tables (the reference ships no data).

``readings`` maps ``lineitem`` onto the sensor layout of the reference:

=================  =================  =======================================
reference          stand-in           note
=================  =================  =======================================
``Fecha y hora``   ``l_shipdate``     TIMESTAMP_NTZ
``Estacion``       ``l_returnflag``   3 stations
year of workbook   ``year(l_shipdate)`` 7 yearly sources
readings           ``l_quantity`` …   DOUBLE, with sentinel values as NULL
=================  =================  =======================================

Missing readings come from sentinel values, the way a logger marks "no
reading": quantity at the top of its scale (50) and zero discount / tax are
turned into NULL with ``nullif``.  That yields 8 missingness patterns and
different null counts per year, over the whole table, identically in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normalize_nan

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
READING_KEYS = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]

# Sentinel → NULL rules of the stand-in (same text in SQL).
SENTINELS = {"l_quantity": 50.0, "l_discount": 0.0, "l_tax": 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, with NaN read as missing like every scan of the library."""
    return normalize_nan(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = [F.col(k) for k in READING_KEYS]
    for m in MEASURES:
        c = F.col(m)
        if m in SENTINELS:
            c = F.nullif(c, F.lit(SENTINELS[m]))
        cols.append(c.alias(m))
    return li.select(*cols)


def readings_sql() -> str:
    """The same stand-in as a SQL subquery body."""
    parts = list(READING_KEYS)
    for m in MEASURES:
        parts.append(f"NULLIF({m}, CAST({SENTINELS[m]!r} AS DOUBLE)) AS {m}" if m in SENTINELS else m)
    return f"SELECT {', '.join(parts)} FROM lineitem"


def with_year(df: DataFrame, ts: str = "l_shipdate", name: str = "anio") -> DataFrame:
    return df.withColumn(name, F.year(F.col(ts)).cast("bigint"))
