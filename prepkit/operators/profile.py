"""Quality profiling: A1–A9, A15, F9 report, O1–O3.

Every profile is ONE aggregation pass (all statistics fused in one ``agg``)
and returns a small tidy DataFrame.  Per-column results are unpivoted with
``inline(array(struct ...))`` so the output has one row per column and a
stable schema whatever the input width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, percent_label


def row_nulls(cols: Sequence[str]) -> Column:
    """Number of NULL cells in a row over ``cols`` (one codegen'd sum)."""
    if not cols:
        return F.lit(0).cast("bigint")
    terms = [col(c).isNull().cast("bigint") for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def quality_by_source(df: DataFrame, key: str = "anio",
                      cols: Sequence[str] | None = None,
                      path_column: str | None = None) -> DataFrame:
    """A1 + A2 + A6: per source (year) ``total_rows`` and ``null_cells``,
    counting NULLs over every column of the source's union (so NULLs created
    by the union count too).  One ``groupBy(key)``: partial aggregation on
    the map side, so a source holding most rows costs nothing extra.

    ``path_column`` (optional) carries the written output path (A6's
    "generated file")."""
    cols = [c for c in (cols or df.columns) if c != key and c != path_column]
    aggs = [F.count(F.lit(1)).alias("total_rows"),
            F.sum(row_nulls(cols)).alias("null_cells")]
    if path_column:
        aggs.append(F.first(col(path_column), ignorenulls=True).alias(path_column))
    return df.groupBy(col(key)).agg(*aggs)


def rank_sources(quality: DataFrame, key: str = "anio",
                 by: str = "null_cells") -> DataFrame:
    """O1: ascending by ``by`` with missing last; the key breaks ties."""
    return quality.orderBy(col(by).asc_nulls_last(), col(key).asc())


def best_source(quality: DataFrame, key: str = "anio", by: str = "null_cells") -> DataFrame:
    """O2: the source with the fewest missing cells (ties → smallest key),
    computed rather than hard-coded.  One-row result."""
    rank = F.struct(col(by).isNull(), col(by), col(key))   # missing counts last
    return quality.agg(F.min_by(col(key), rank).alias(key), F.min(col(by)).alias(by))


def column_counts(df: DataFrame, cols: Sequence[str] | None = None, copies: str | None = None) -> DataFrame:
    """``ordinal, column_name, dtype, n_rows, non_null_count`` of each column: the
    one pass that A3, A4, A7 and A8 share.  ``copies`` names the column that says how often a row
    stands in the table that is described (see :func:`row_groups`); it is not described itself."""
    types = dict(df.dtypes)
    cols = [c for c in (cols or df.columns) if c != copies]
    n = F.lit(1) if copies is None else col(copies)
    wide = df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("__n"),
                  *[F.coalesce(F.sum(F.when(col(c).isNotNull(), n)), F.lit(0)).alias(f"__c{i}") for i, c in enumerate(cols)])
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                 F.col("__n").alias("n_rows"), F.col(f"__c{i}").alias("non_null_count"))
        for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """A3 + A4: per column ``null_count`` and ``null_pct`` (of all rows; NULL
    without rows), plus the column's ``ordinal``.  One pass."""
    counts = counts if counts is not None else column_counts(df, cols)
    nulls = F.col("n_rows") - F.col("non_null_count")
    return counts.select("ordinal", "column_name", nulls.alias("null_count"), F.try_divide(nulls * 100.0, F.col("n_rows")).alias("null_pct"))


def null_pct_labels(profile: DataFrame) -> DataFrame:
    """P10 over A4: ``'12.5 %'`` labels."""
    return profile.select("ordinal", "column_name",
                          percent_label(F.col("null_pct")).alias("null_pct_label"))


def shape(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(n_rows, n_cols)`` as a one-row DataFrame."""
    if counts is not None:
        return counts.agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def schema_profile(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Column, non-null count, Spark type name.  One pass."""
    counts = counts if counts is not None else column_counts(df)
    return counts.select("ordinal", "column_name", "non_null_count", "dtype")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """O3: first ``n`` rows under an explicit order (Spark has no implicit
    row order).  Executed as a per-partition top-n then a final top-n
    (``TakeOrderedAndProject``), never a full sort."""
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(n)


def glimpse(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Per column its type and first ``n`` values (under ``order_by``)
    as text, plus the table's row count.  Only the top ``n`` rows (a
    per-partition top-n, then a final top-n) are gathered."""
    top = head(df, n, order_by)
    fields = df.schema.fields
    keys = [col(c).alias(f"__o{i}") for i, c in enumerate(order_by)]

    def first_values(i: int):
        v = F.coalesce(col(fields[i].name).cast("string"), F.lit("NULL"))
        entries = F.array_sort(F.collect_list(F.struct(*keys, v.alias("__v"))))
        return F.array_join(F.transform(entries, lambda s: s.getField("__v")), ", ")

    firsts = top.agg(*[first_values(i).alias(f"__f{i}") for i in range(len(fields))])
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ordinal"),
                 F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"__f{i}").alias("first_values"))
        for i, f in enumerate(fields)])
    return firsts.select(n_rows.alias("n_rows"), F.inline(rows))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """A5: rows, distinct rows and duplicate rows (= rows − distinct rows).

    One shuffle of the *distinct* row groups: rows are counted per group with
    map-side partial aggregation, so many copies of one row (a hot group)
    collapse before the shuffle."""
    return duplicates_of(row_groups(df, subset))


#: The column of :func:`row_groups` that counts a row's copies.
COPIES = "__copies"


def row_groups(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Each distinct row once, with how often it is there (``COPIES``): A5 and U2 in one shuffle."""
    return df.groupBy(*[col(c) for c in (subset or df.columns)]).agg(F.count(F.lit(1)).alias(COPIES))


def duplicates_of(groups: DataFrame) -> DataFrame:
    """A5 from :func:`row_groups`."""
    return groups.agg(F.sum(COPIES).cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                      F.sum(F.col(COPIES) - 1).cast("bigint").alias("n_duplicates"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """F9 report: a column is constant when all its non-null values are
    equal (``min == max``), or it is entirely NULL.  One pass, no distinct
    counting."""
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        mn, mx = F.min(col(c)), F.max(col(c))
        aggs.append(F.count(col(c)).alias(f"__n{i}"))
        aggs.append(F.coalesce(mn == mx, F.lit(True)).alias(f"__k{i}"))
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ordinal"),
                 F.lit(c).alias("column_name"),
                 F.col(f"__n{i}").alias("non_null_count"),
                 F.col(f"__k{i}").alias("is_constant"))
        for i, c in enumerate(cols)])
    return wide.select(F.inline(rows))
