"""P1–P5, P7–P8 at DataFrame level: tagging, checked drops, positional
projection, column moves and derived time features.  All are pure
projections (no shuffle); Catalyst prunes unused columns down to the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, hour_of, month_of, parse_inferred, parse_timestamp


def tag(df: DataFrame, name: str, value) -> DataFrame:
    """Constant source tag (e.g. the station / sheet name; None: NULL)."""
    return df.withColumn(name, F.lit(value) if value is not None else F.lit(None).cast("string"))


def drop_checked(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop named columns; an unknown name is an error (Spark's ``drop``
    silently ignores it)."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}; available: {df.columns}")
    return df.drop(*names)


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Project a list of (possibly dotted) column names."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[col(n) for n in names])


def select_by_position(df: DataFrame, start: int = 1, stop: int | None = None) -> DataFrame:
    """Keep columns ``[start:stop]`` by position (``columns[1:]`` drops a
    leading index column)."""
    return df.select(*[col(n) for n in df.columns[start:stop]])


def move_to_front(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """P5: reorder so ``names`` come first.  Values travel with their row,
    never by position."""
    rest = [c for c in df.columns if c not in set(names)]
    return df.select(*[col(n) for n in list(names) + rest])


def add_time_features(df: DataFrame, ts: str, month: str = "Mes", hour: str = "Hora",
                      fmt: str | None = None, strict: bool = True) -> DataFrame:
    """Parse ``ts`` to TIMESTAMP_NTZ (when it is text; ``fmt`` is its
    pattern, ISO by default, ``"infer"`` finds it from all rows) and append month and hour columns."""
    c = col(ts)
    dtype = dict(df.dtypes)[ts]
    if dtype == "string" and fmt == "infer":
        df = parse_inferred(df, [ts])
        c = col(ts)
    elif dtype == "string":
        df = df.withColumn(ts, parse_timestamp(c, fmt, strict))
        c = col(ts)
    return df.withColumn(month, month_of(c)).withColumn(hour, hour_of(c))
