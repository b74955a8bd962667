"""Central measures, quantiles, covariance and correlation.

Design rules:
* every statistic family is ONE fused aggregation over the input (partial
  aggregation per task, a tiny final merge) and comes back tidy:
  ``(column_name, statistic...)`` or ``(col_i, col_j, value)``;
* NaN never reaches an aggregate (scan-boundary normalisation), and every
  division that can see a zero goes through ``try_divide`` → NULL;
* exact quantiles go through :mod:`prepkit.operators.quantiles`, which bounds
  the memory any single task needs.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, nan_to_null, numeric_columns
from ..session import ship_package
from .quantiles import quantiles_with_moments
from .setops import union_by_name


def central_measures(df: DataFrame, cols: Sequence[str] | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact median, max, min and half-range
    (``(max - min) / 2``, the reference's "rango medio") for every numeric
    column, NULLs skipped.  Optional grouping keys ``by`` (A20 uses a stage
    tag).  Result: one row per (group, column).

    Count, sum, min and max come from the first pass of the exact-median
    computation, so the whole table of measures costs the median's passes
    only (the mean is ``sum / count``, as Spark's ``avg``).  ``max`` and ``min``
    are BIGINT if all columns are integral, else DOUBLE."""
    by = list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    found = quantiles_with_moments(df, cols, [0.5], by=by)
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(
        *[col(k) for k in by], F.col("cid").cast("bigint").alias("ordinal"), F.get(names, F.col("cid")).alias("column_name"),
        F.try_divide("sum", "n").alias("mean"), F.get("value", F.lit(0)).alias("median"), F.col("mx").alias("max"), F.col("mn").alias("min"),
        ((F.col("mx") - F.col("mn")) / 2).alias("half_range"))


def compare_stages(stages: Mapping[str, DataFrame], cols: Sequence[str] | None = None,
                   stage_column: str = "stage") -> DataFrame:
    """The same central measures on several inputs (e.g. original and
    imputed), as one union + one grouped pass instead of one pass per input."""
    u = union_by_name(stages, tag_column=stage_column)
    if cols is None:
        cols = numeric_columns(u, exclude=[stage_column])
    return central_measures(u, cols, by=[stage_column])


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments of every two columns ``i <= j`` over the rows that have both:
    ``i, j, rows, n, sx, sy, sxx, syy, sxy, scale`` (sums about the columns' means;
    ``scale`` is the larger squared mean).

    One JVM aggregate finds the means, one Arrow pass multiplies matrices (a
    task sends one row per pair), and Spark adds them up.  The work per row does
    not depend on how many columns whole-stage code generation can hold."""
    cols = list(cols)
    ship_package(df.sparkSession)
    x = df.select(*[nan_to_null(col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])
    row = x.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))]).first()
    centre = np.array([0.0 if m is None else m for m in row], dtype=np.float64)
    at_i, at_j = np.triu_indices(len(cols))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((6, len(cols), len(cols)))
        for b in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64) - centre
            have = ~np.isnan(z)
            z, have = np.where(have, z, 0.0), have.astype(np.float64)
            rows += len(z)
            total += (have.T @ have, z.T @ have, have.T @ z, (z * z).T @ have, have.T @ (z * z), z.T @ z)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at_i, pa.int32()), pa.array(at_j, pa.int32()), pa.array([rows] * len(at_i), pa.int64()), *[pa.array(t[at_i, at_j]) for t in total]],
            names=["i", "j", "rows", *_SUMS])

    parts = x.mapInArrow(sums, "i int, j int, rows long, " + ", ".join(f"{c} double" for c in _SUMS))
    squares = F.array(*[F.lit(float(c * c)) for c in centre])
    return (parts.groupBy("i", "j").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in _SUMS])
            .withColumn("scale", F.greatest(F.get(squares, F.col("i")), F.get(squares, F.col("j")))))


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _cells(moments: DataFrame, cols: Sequence[str], value: Column) -> DataFrame:
    """Both orders of each pair, tidy, in matrix order."""
    names = F.array(*[F.lit(c) for c in cols])
    upper = moments.select("i", "j", value.alias("value"))
    both = upper.union(upper.where("i <> j").select(F.col("j"), F.col("i"), "value"))
    return (both.orderBy("i", "j").select(F.get(names, F.col("i")).alias("col_i"), F.get(names, F.col("j")).alias("col_j"), "value"))


def _centred(a: str, x: str, y: str) -> Column:
    return F.try_divide(F.col(a) - F.try_divide(F.col(x) * F.col(y), F.col("n")), F.col("n"))


def cov_matrix(df: DataFrame, cols: Sequence[str], propagate_nulls: bool = True, moments: DataFrame | None = None) -> DataFrame:
    """Population covariance matrix (ddof 0), tidy ``(col_i, col_j,
    value)`` over all ordered pairs.  With ``propagate_nulls`` (reference
    parity: the centred matrix product turns a single missing value into a
    missing row/column) a pair touching a column with any NULL is NULL."""
    cols = list(cols)
    value = _centred("sxy", "sx", "sy")
    if propagate_nulls:
        value = F.when(F.col("n") == F.col("rows"), value)
    return _cells(moments if moments is not None else pair_moments(df, cols), cols, value)


def corr_matrix(df: DataFrame, cols: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """Pearson correlation on pairwise-complete rows, tidy
    ``(col_i, col_j, value)``.  A column without variance gives NULL for all its
    pairs and its diagonal."""
    cols = list(cols)
    vx, vy = _centred("sxx", "sx", "sx"), _centred("syy", "sy", "sy")
    least = F.col("scale") * 1e-26        # what rounding leaves of a constant column's variance
    value = F.when((vx > least) & (vy > least), F.when(F.col("i") == F.col("j"), F.lit(1.0))
                   .otherwise(_centred("sxy", "sx", "sy") / F.sqrt(vx * vy)))
    return _cells(moments if moments is not None else pair_moments(df, cols), cols, value)


def corr_labels(corr: DataFrame, digits: int = 2) -> DataFrame:
    """Annotated cells, ``label = format(r, '.2f')`` (the heatmap's
    text); the drawing itself is not built."""
    return corr.withColumn("label", F.format_number(F.col("value"), digits))


def column_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Fit step of P13: one aggregate row, collected (p numbers)."""
    row = df.agg(*[F.avg(col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"__m{i}"] for i, c in enumerate(cols)}


def center(df: DataFrame, cols: Sequence[str], means: Mapping[str, float | None] | None = None,
           keep: Sequence[str] = ()) -> DataFrame:
    """Subtract each column's mean (aligned by name).  The fitted means
    are p literals, so the transform is a pure projection."""
    means = dict(means) if means is not None else column_means(df, cols)
    return df.select(*[col(k) for k in keep],
                     *[(col(c).cast("double") - F.lit(means[c])).alias(c) for c in cols])
