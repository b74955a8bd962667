"""Fit/transform feature operators: F1, F4, F5–F8.

``fit`` runs one aggregation and returns a small, JSON-able parameter object
(the only values that reach the driver); ``transform`` is a pure projection
with those parameters as literals, so it stays lazy, codegen'd and
partition-local.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip_lower, clip_upper, col, nan_to_null
from .quantiles import exact_quantiles, order_statistic

# --------------------------------------------------------------------- F1


@dataclass
class OneHot:
    """dummy columns ``<col><sep><value>`` for the sorted distinct
    non-null values, the first dropped (``drop_first``), appended at the end;
    the source column is removed.  NULL → all false.

    Not ML's ``StringIndexer + OneHotEncoder`` (frequency order, drops the
    *last* level, vector output).  The category list is a fitted parameter and a
    column each: beyond ``max_categories`` distinct values ``fit`` fails, having
    collected one more than that."""

    column: str
    drop_first: bool = True
    sep: str = "_"
    max_categories: int = 10_000
    categories: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> "OneHot":
        least = df.select(col(self.column).alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").limit(self.max_categories + 1)
        vals = least.collect()          # a top-n of each task, then of all: never a sort of all values
        if len(vals) > self.max_categories:
            raise ValueError(f"{self.column}: more than {self.max_categories} categories")
        self.categories = [r["v"] for r in vals]
        return self

    @property
    def output_columns(self) -> list[str]:
        cats = self.categories[1:] if self.drop_first else self.categories
        return [f"{self.column}{self.sep}{v}" for v in cats]

    def transform(self, df: DataFrame) -> DataFrame:
        cats = self.categories[1:] if self.drop_first else self.categories
        keep = [col(c) for c in df.columns if c != self.column]
        dummies = [F.coalesce(col(self.column) == F.lit(v), F.lit(False)).alias(name)
                   for v, name in zip(cats, self.output_columns)]
        return df.select(*keep, *dummies)

    def to_dict(self) -> dict:
        return asdict(self)


# --------------------------------------------------------------------- F4


def split_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """Leading 32 bits of ``md5('<seed>:<key>')`` as a fraction in [0, 1).
    Deterministic, independent of partitioning and reproducible in SQL."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def assign_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42,
                 column: str = "split", exact: bool = False) -> DataFrame:
    """tag each row ``'test'`` (hash fraction < ``test_size``) or
    ``'train'``.  Unlike ``randomSplit`` the membership does not depend on
    the partition layout, so re-running after a lost executor gives the same
    split.  ``exact``: see :func:`train_test_split`."""
    if exact:
        tagged, is_test = _exact_test_predicate(df, keys, test_size, seed)
        return (tagged.withColumn(column, F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
                .drop("__h"))
    return df.withColumn(column, F.when(split_hash(keys, seed) < test_size, F.lit("test"))
                         .otherwise(F.lit("train")))


def train_test_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2,
                     seed: int = 42, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """disjoint, exhaustive ``(train, test)``.

    ``exact=True`` puts exactly ``ceil(test_size * n)`` rows in test (as a
    shuffling split does): the rows with the smallest leading 60 bits of the
    key hash.  The threshold is an exact order statistic, found with the number
    of rows and never by a global sort or a single-partition window.  Rows whose keys are identical share
    their fate, so with duplicate keys the count can exceed the target by
    the size of one tied group."""
    if not exact:
        h = split_hash(keys, seed)
        return df.where(h >= test_size), df.where(h < test_size)
    tagged, is_test = _exact_test_predicate(df, keys, test_size, seed)
    test = tagged.where(is_test).drop("__h")
    train = tagged.where(~is_test).drop("__h")
    return train, test


def _exact_test_predicate(df: DataFrame, keys: Sequence[str], test_size: float, seed: int):
    tagged = df.withColumn("__h", _hash_60(keys, seed))
    _, last = order_statistic(tagged, "__h", test_size)
    return tagged, F.lit(False) if last is None else F.col("__h") <= F.lit(last)


def _hash_60(keys: Sequence[str], seed: int) -> Column:
    """The leading 60 bits of the key hash (15 hex digits, so always positive)."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


# --------------------------------------------------------------------- F5/F6


@dataclass
class IQRClipper:
    """F5 + F6: fences ``Q1 - k·IQR`` and ``Q3 + k·IQR`` from exact
    interpolated quartiles (all columns in one quantile computation); values
    outside are replaced by the fence, NULL stays NULL.  The fences are
    computed before any replacement."""

    columns: list[str]
    k: float = 1.5
    fences: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "IQRClipper":
        rows = exact_quantiles(df, self.columns, [0.25, 0.75]).collect()
        q = {(r["column_name"], r["p"]): r["value"] for r in rows}
        self.fences = {}
        for c in self.columns:
            q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
            if q1 is None:
                self.fences[c] = (None, None, None, None, None)
                continue
            iqr = q3 - q1
            self.fences[c] = (q1, q3, iqr, q1 - self.k * iqr, q3 + self.k * iqr)
        return self

    def fences_frame(self, spark) -> DataFrame:
        rows = [(i, c, *self.fences[c]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(
            rows, "ordinal bigint, column_name string, q1 double, q3 double, iqr double, "
                  "lower_fence double, upper_fence double")

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.fences and self.fences[c][0] is not None:
                lo, hi = self.fences[c][3], self.fences[c][4]
                # upper first, then lower; NULL falls through both
                out.append(clip_lower(clip_upper(col(c), F.lit(hi)), F.lit(lo)).alias(c))
            else:
                out.append(col(c))
        return df.select(*out)


# --------------------------------------------------------------------- F7


def bin_right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """label by right-closed intervals ``(e0, e1], (e1, e2], ...``;
    values ≤ e0, above the last edge, NULL or NaN → NULL.  (ML's ``Bucketizer``
    is left-closed and would put the edge value in the next bin.)"""
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly len(edges) - 1 labels")
    expr, c = None, nan_to_null(c)
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = c > F.lit(lo)
        if not math.isinf(hi):
            cond = cond & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def unbinned_count(df: DataFrame, value_col: str, label_col: str) -> DataFrame:
    """Rows with a value but no label (≤ the first edge or above the last):
    values the bins silently turn into missing labels.  One aggregate."""
    return df.agg(F.count_if(col(value_col).isNotNull() & col(label_col).isNull()).alias("unbinned"),
                  F.count(col(value_col)).alias("with_value"))


# --------------------------------------------------------------------- F8


@dataclass
class Standardizer:
    """F8: ``(x - mean) / std`` with the **population** std (ddof 0); a
    zero-variance column is divided by 1; NULL stays NULL.  (ML's
    ``StandardScaler`` uses the sample std and vector input.)"""

    columns: list[str]
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "Standardizer":
        aggs = []
        for i, c in enumerate(self.columns):
            x = nan_to_null(col(c).cast("double"))
            aggs += [F.avg(x).alias(f"__m{i}"), F.stddev_pop(x).alias(f"__s{i}")]
        row = df.agg(*aggs).first()
        self.params = {c: (row[f"__m{i}"], row[f"__s{i}"]) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.params:
                m, s = self.params[c]
                div = 1.0 if (s is None or s == 0.0) else s
                out.append(((col(c).cast("double") - F.lit(m)) / F.lit(div)).alias(c))
            else:
                out.append(col(c))
        return df.select(*out)
