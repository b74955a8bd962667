"""Exact, linearly interpolated quantiles that scale.

Every wanted order statistic is kept between two values of its column.  The
first pass takes them from Spark's bounded-memory ``percentile_approx`` a little
below and above the wanted share, with count, minimum, maximum and sum.  Each
further pass counts, in one grouped aggregate, the values below the bracket
and the distinct values inside it; if those are more than ``INSIDE`` a pass of
``percentile_approx`` over the values inside narrows the bracket first, about a
thousandfold, whatever the range of the values.  Everything stays in Spark,
grouped or not: what reaches the driver is one number a pass.

A value that a third of all rows share is one counted row per task.  NaN counts
as missing, and ±Infinity sorts at the ends like any other value.

Interpolation follows Spark's ``percentile``: position ``h = (n - 1) p``,
``(ceil(h) - h) * x[floor(h)] + (h - floor(h)) * x[ceil(h)]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, nan_to_null
from ..sinks.files import write_stage

#: Distinct values of a bracket that one row may gather.
INSIDE = 100_000
#: ``percentile_approx`` is off by one in so many ranks at most.
ACCURACY = 10_000
#: Shares at which a bracket that is still too wide is cut.
_GRID = [i / 1000 for i in range(1001)]


def _tall(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, cid, v): the values of all columns below each other, without missing
    ones; BIGINT if all columns are integral, so that large ones stay exact, else DOUBLE."""
    if all(isinstance(df.schema[c].dataType, T.IntegralType) for c in cols):
        x = [col(c).cast("bigint") for c in cols]
    else:
        x = [nan_to_null(col(c).cast("double")) for c in cols]
    cells = F.array(*[F.struct(F.lit(i).alias("cid"), x[i].alias("v")) for i in range(len(cols))])
    return df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.inline(cells)).where("v is not null")


def _join(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL."""
    on = None
    right = right.select(*[F.col(n).alias(f"__{n}") for n in names], *[F.col(n) for n in right.columns if n not in names])
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"__{n}"))
        on = same if on is None else on & same
    return left.join(right, on).drop(*[f"__{n}" for n in names])


def _ranked(tall: DataFrame, stats: DataFrame, keys: list[str], wanted: Sequence[tuple[float, Column]]) -> DataFrame:
    """(keys, cid, t, x_lo, x_hi): for each (share, position) of ``wanted`` the
    values at the floor and at the ceiling of its position, a column over ``n``.
    ``stats`` has n, mn, mx and ``q``, two approximate values per wanted share."""
    group = [*keys, "cid"]
    last = len(_GRID) - 1
    few = F.col("n") <= ACCURACY       # of few values one rank is a larger share than the margin
    brackets = stats.select(*group, F.inline(F.array(*[
        F.struct(F.lit(t).alias("t"), at.alias("h"),
                 F.when(few | F.lit(share - 4 / ACCURACY <= 0), F.col("mn")).otherwise(F.get("q", F.lit(2 * t))).alias("lo"),
                 F.when(few | F.lit(share + 4 / ACCURACY >= 1), F.col("mx")).otherwise(F.get("q", F.lit(2 * t + 1))).alias("hi"))
        for t, (share, at) in enumerate(wanted)])))
    one = [*group, "t"]
    while True:
        inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        hits = _join(tall, brackets, group)
        counts = write_stage(
            hits.where("v <= hi").groupBy(*one, F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
            .agg(F.count(F.lit(1)).alias("c")), "quantile-counts")
        most = counts.where("v is not null").groupBy(*one).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
        if most <= INSIDE:
            break
        # the shares of the wanted positions inside the bracket, cut at the grid's approximate values around them
        size = counts.groupBy(*one).agg(F.sum(F.when(F.col("v").isNull(), F.col("c"))).alias("below"), F.sum(F.when(F.col("v").isNotNull(), F.col("c"))).alias("n_in"))
        grid = hits.where(inside).groupBy(*one).agg(F.percentile_approx("v", _GRID, ACCURACY).alias("grid"))
        # (grid places of the wanted ranks, from the rank before the floor to the one after the ceiling)
        below = F.coalesce("below", F.lit(0))
        first = F.floor((F.floor("h") - below) / F.col("n_in") * last).cast("int") - 2
        final = F.ceil((F.ceil("h") - below + 1) / F.col("n_in") * last).cast("int") + 2
        brackets = write_stage(_join(_join(brackets, size, one), grid, one).select(
            *one, "h",
            F.when(first < 0, F.col("lo")).otherwise(F.get("grid", F.greatest(F.lit(0), first))).alias("lo"),
            F.when(final > last, F.col("hi")).otherwise(F.get("grid", F.least(F.lit(last), final))).alias("hi")), "quantile-brackets")
    counts = _join(counts, brackets, one)
    to = F.sum("c").over(Window.partitionBy(*one).orderBy(F.asc_nulls_first("v")))
    counts = counts.withColumn("to", to)
    # a position outside its bracket would be Spark's sketch breaking its promise: fail, never guess
    held = (F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("to"))), F.lit(0)) <= F.floor(F.first("h"))) & (F.max("to") > F.ceil(F.first("h")))
    return counts.groupBy(*one).agg(
        F.min(F.when(F.col("to") > F.floor("h"), F.col("v"))).alias("x_lo"),
        F.min(F.when(F.col("to") > F.ceil("h"), F.col("v"))).alias("x_hi"),
        F.assert_true(held, "an order statistic lies outside its bracket").alias("checked")).where("checked is null").drop("checked")


def _start(tall: DataFrame, keys: list[str], shares: Sequence[float]) -> DataFrame:
    near = [min(1.0, max(0.0, s + d)) for s in shares for d in (-4 / ACCURACY, 4 / ACCURACY)]
    return tall.groupBy(*keys, "cid").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"), F.sum(F.col("v").cast("double")).alias("sum"),
        F.percentile_approx("v", near, ACCURACY).alias("q"))


def quantiles_with_moments(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cid, n, mn, mx, sum, value)``: a row for every group and column
    (``cid`` its place in ``cols``), ``value`` the array of quantiles; a column
    without values in a group has n = 0 and NULLs."""
    cols, by, probs = list(cols), list(by), [float(p) for p in probs]
    if any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError(f"probabilities out of range: {probs}")
    keys = [f"k{i}" for i in range(len(by))]
    tall = _tall(df, cols, by)
    stats = write_stage(_start(tall, keys, probs), "quantile-start")
    found = _ranked(tall, stats, keys, [(p, (F.col("n") - 1) * F.lit(p)) for p in probs])
    h = (F.col("n") - 1) * F.get(F.array(*[F.lit(p) for p in probs]), F.col("t"))
    a, b = F.col("x_lo"), F.col("x_hi")
    value = F.when(a == b, a).otherwise((F.ceil(h) - h) * a + (h - F.floor(h)) * b)
    values = (_join(found, stats.select(*keys, "cid", "n"), [*keys, "cid"]).groupBy(*keys, "cid")
              .agg(F.sort_array(F.collect_list(F.struct("t", value.alias("value")))).alias("value")))
    full = _join(stats.drop("q"), values.withColumn("value", F.col("value.value")), [*keys, "cid"])
    groups = df.select(*[col(k).alias(f"k{i}") for i, k in enumerate(by)]).distinct() if by else df.sparkSession.range(1).select()
    every = groups.withColumn("cid", F.explode(F.array(*[F.lit(i) for i in range(len(cols))])))
    on = None
    right = full.select(*[F.col(n).alias(f"__{n}") for n in (*keys, "cid")], "n", "mn", "mx", "sum", "value")
    for n in (*keys, "cid"):
        same = F.col(n).eqNullSafe(F.col(f"__{n}"))
        on = same if on is None else on & same
    return every.join(right, on, "left").select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(by)], "cid", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mn", "mx", "sum", "value")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Tidy ``(by..., column_name, p, value)``; missing values (NULL, NaN) are
    skipped; a column with no values gives NULL."""
    wide = quantiles_with_moments(df, cols, probs, by)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.get("value", F.lit(j)).alias("value")) for j, p in enumerate(probs)])
    return wide.select(*[col(k) for k in by], F.get(F.array(*[F.lit(c) for c in cols]), F.col("cid")).alias("column_name"), F.inline(rows))


def order_statistic(df: DataFrame, column: str, share: float) -> tuple[int, float | None]:
    """How many values a column has, n, and the one of rank ``ceil(share * n)``
    (from 1; NULL if that is 0 or there are none)."""
    tall = _tall(df, [column], [])
    stats = write_stage(_start(tall, [], [share]), "quantile-start")
    first = stats.first()
    if first is None or share <= 0:
        return (first["n"] if first else 0), None
    found = _ranked(tall, stats, [], [(share, (F.ceil(F.col("n") * F.lit(share)) - 1).cast("double"))]).first()
    return first["n"], found["x_lo"]
