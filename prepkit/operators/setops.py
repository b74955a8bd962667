"""U1 (tagged union by name) and U2 (exact de-duplication)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from .projection import tag


def _widest(types: list[T.DataType]) -> T.DataType:
    """int + bigint → bigint (exact); int + float → double; any string → string
    (the scan should have normalised text cells to numbers before the union)."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType)) for t in types):
        return T.TimestampNTZType()
    return T.StringType()


def union_by_name(parts: Sequence[DataFrame] | Mapping[str, DataFrame],
                  tag_column: str | None = None) -> DataFrame:
    """Bag union over the outer set of columns, NULL where a part lacks a
    column, mixed numeric types widened (integral ones to BIGINT, else to DOUBLE).

    ``parts`` may be a mapping ``tag -> DataFrame``; the tag is then written
    to ``tag_column`` (P1).  The union is a narrow operation: no shuffle.
    """
    if isinstance(parts, Mapping):
        if tag_column is None:
            raise ValueError("tag_column is required when parts is a mapping")
        parts = [tag(df, tag_column, k) for k, df in parts.items()]
    parts = list(parts)
    if not parts:
        raise ValueError("nothing to union")
    order: list[str] = []
    types: dict[str, list[T.DataType]] = {}
    for df in parts:
        for f in df.schema.fields:
            if f.name not in types:
                order.append(f.name)
                types[f.name] = []
            types[f.name].append(f.dataType)
    target = {n: _widest(ts) for n, ts in types.items()}
    aligned = []
    for df in parts:
        have = set(df.columns)
        aligned.append(df.select(*[
            (col(n).cast(target[n]) if n in have else F.lit(None).cast(target[n])).alias(n)
            for n in order]))
    return reduce(lambda a, b: a.unionByName(b), aligned)


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact de-duplication over all columns (NULL == NULL, NaN == NaN,
    0.0 == -0.0).  One hash shuffle on the row; partial aggregation on the
    map side collapses repeated rows first, so a hot duplicate group costs
    one row per task, not one row per copy."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
