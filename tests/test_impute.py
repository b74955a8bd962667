"""The Spark pattern-Gram imputer against the row-wise NumPy
oracle (tests/reference_impute.py), plus the contract properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SENSOR_COLS
from prepkit.operators.features import train_test_split
from prepkit.operators.impute import ChainedImputer
from reference_impute import RowwiseImputer

COLS = [c for c in SENSOR_COLS if c != "SO2"] + ["Hora"]


def _prepared(sensor):
    return sensor.withColumn("Hora", F.hour(F.col("`Fecha y hora`")).cast("double"))


def _matrix(df, cols):
    return df.select(*[F.col(f"`{c}`") for c in cols]).toPandas().to_numpy(dtype=float, na_value=np.nan)


def test_fit_transform_matches_rowwise_F2(sensor):
    df = _prepared(sensor).repartition(4).cache()
    x = _matrix(df, COLS)
    imp = ChainedImputer(COLS, max_iter=10).fit(df)
    got = _matrix(imp.transform(df), COLS)
    ref = RowwiseImputer(max_iter=10).fit(x)
    assert imp.n_iter_ == ref.n_iter
    assert not np.isnan(got).any()
    obs = ~np.isnan(x)
    assert np.array_equal(got[obs], x[obs])                     # observed cells bit-identical
    np.testing.assert_allclose(got, ref.fitted, rtol=1e-8, atol=1e-8)


def test_train_test_and_unseen_patterns_F3(spark, sensor):
    df = _prepared(sensor).withColumn("rk", F.monotonically_increasing_id())
    df = df.cache()
    train, test = train_test_split(df, ["Estacion", "Fecha y hora"], 0.2, 42)
    imp = ChainedImputer(COLS).fit(train)
    # a pattern that never occurs in train: PM10 and TOUT missing together
    extra = test.limit(3).withColumn("PM10", F.lit(None).cast("double")).withColumn("TOUT", F.lit(None).cast("double"))
    t = test.unionByName(extra)
    x = _matrix(t, COLS)
    got = _matrix(imp.transform(t), COLS)
    ref = RowwiseImputer().fit(_matrix(train, COLS))
    np.testing.assert_allclose(got, ref.transform(x), rtol=1e-8, atol=1e-8)
    assert not np.isnan(got).any()


def test_complete_table_unchanged(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), float(i % 3)) for i in range(50)], "a double, b double, c double")
    out = ChainedImputer(["a", "b", "c"]).fit_transform(df)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_entirely_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    with pytest.raises(ValueError):
        ChainedImputer(["a", "b"]).fit(df)


def test_pass_through_and_persistence(sensor):
    df = _prepared(sensor)
    imp = ChainedImputer(COLS).fit(df)
    again = ChainedImputer.from_json(imp.to_json())
    a = _matrix(imp.transform(df), COLS)
    b = _matrix(again.transform(df), COLS)
    assert np.array_equal(a, b)
    assert imp.transform(df).columns == df.columns


def test_distributed_rounds_equal_driver_rounds(sensor):
    df = _prepared(sensor)
    local = ChainedImputer(COLS).fit(df)
    dist = ChainedImputer(COLS, grams="cluster").fit(df)
    assert dist.n_patterns_ == local.n_patterns_ and dist.n_iter_ == local.n_iter_
    a = _matrix(local.transform(df), COLS)
    b = _matrix(dist.transform(df), COLS)
    np.testing.assert_allclose(a, b, rtol=1e-10, atol=1e-10)


def test_more_than_62_columns(spark):
    rng = np.random.default_rng(11)
    n, p = 300, 70
    base = rng.normal(size=(n, 5))
    x = base @ rng.normal(size=(5, p)) + 0.3 * rng.normal(size=(n, p)) + 10.0
    x[rng.random((n, p)) < 0.04] = np.nan
    cols = [f"c{j}" for j in range(p)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x],
                               ", ".join(f"{c} double" for c in cols))
    # driver rounds (3 rounds), then Spark-side rounds (1 round: one job per column)
    for grams, rounds in (("driver", 3), ("cluster", 1)):
        ref = RowwiseImputer(max_iter=rounds).fit(x)
        imp = ChainedImputer(cols, max_iter=rounds, grams=grams).fit(df)
        got = _matrix(imp.transform(df), cols)
        assert imp.n_iter_ == ref.n_iter
        np.testing.assert_allclose(got, ref.fitted, rtol=1e-8, atol=1e-8)


def test_many_patterns_give_the_row_wise_result(spark):
    """More than 50,000 distinct patterns, on the driver's path; nothing is switched or refused."""
    rng = np.random.default_rng(5)
    n, p = 60_000, 18
    x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, p)) + 0.2 * rng.normal(size=(n, p))
    x[rng.random((n, p)) < 0.5] = np.nan
    df = spark.createDataFrame(__import__("pandas").DataFrame(x, columns=[f"c{j}" for j in range(p)]))
    imp = ChainedImputer(df.columns, max_iter=2).fit(df)
    assert imp.n_patterns_ > 50_000
    got = _matrix(imp.transform(df), df.columns)
    ref = RowwiseImputer(max_iter=2).fit(x)
    order = lambda m: m[np.lexsort(m.T)]
    np.testing.assert_allclose(order(got), order(ref.fitted), rtol=1e-7, atol=1e-7)


def test_infinite_value_names_its_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("-inf"), 3.0), (2.0, None)], "a double, b double")
    with pytest.raises(ValueError, match="infinite.*a"):
        ChainedImputer(["a", "b"]).fit(df)


def test_pass_through_columns_are_not_touched(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.2)], "a double, b double").selectExpr(
        "*", "timestamp_ntz'9999-12-31 23:59:59' as t", "array(named_struct('k', 1, 'z', 'y')) as nested", "cast(null as bigint) as nothing")
    out = ChainedImputer(["a", "b"]).fit_transform(df)
    assert out.schema == df.schema and out.where("b is null").count() == 0
    assert out.where("t = timestamp_ntz'9999-12-31 23:59:59' and nested[0].z = 'y' and nothing is null").count() == 4


def test_wide_rows_stay_within_the_task_bound(spark):
    import prepkit.operators.impute as im
    rng = np.random.default_rng(2)
    p = 200
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, p)) + rng.normal(size=(400, p))
    x[rng.random((400, p)) < 0.02] = np.nan
    df = spark.createDataFrame(__import__("pandas").DataFrame(x, columns=[f"c{j}" for j in range(p)]))
    out = ChainedImputer(df.columns, max_iter=1).fit_transform(df)
    assert out.where(" or ".join(f"{c} is null" for c in df.columns)).count() == 0
    assert im._HELD_BYTES // (8 * (p + 1) ** 2) >= 1


def test_batches_with_and_without_gaps_have_one_schema(spark):
    """A non-nullable key and boolean beside the imputed columns; batches of three
    rows, so that some have no gap at all."""
    df = spark.range(0, 60, 1, 2).select("id", (F.col("id").bitwiseAND(F.lit(1)) == 0).alias("even"), (F.col("id") % 7).cast("double").alias("a"),
                                         F.when(F.col("id") < 40, (F.col("id") % 5).cast("double")).alias("b"))
    assert not df.schema["id"].nullable and not df.schema["even"].nullable
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = ChainedImputer(["even", "a", "b"]).fit_transform(df).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.id for r in got] == list(range(60)) and all(r.b is not None for r in got)
    assert [r.b for r in got[:40]] == [float(i % 5) for i in range(40)]


def test_the_rounds_are_alike_wherever_they_run(sensor):
    """A task more than there are patterns in some places, so that tasks without rows take part too."""
    df = _prepared(sensor).repartition(4).cache()
    one = ChainedImputer(COLS, grams="driver", max_iter=2).fit(df)
    assert ChainedImputer(COLS, max_iter=2).fit(df).rounds_ == one.rounds_          # few patterns: "auto" is the driver
    for other in (ChainedImputer(COLS, grams="barrier", barrier_tasks=3, max_iter=2), ChainedImputer(COLS, driver_bytes=1, barrier_tasks=1, max_iter=2),
                  ChainedImputer(COLS, grams="cluster", max_iter=2)):
        other.fit(df)
        assert (other.n_iter_, other.n_patterns_, other.order_) == (one.n_iter_, one.n_patterns_, one.order_)
        for ours, theirs in zip(other.rounds_, one.rounds_):
            for (j, w), (k, v) in zip(ours, theirs):
                assert j == k
                np.testing.assert_allclose(w, v, rtol=1e-9, atol=1e-9)


def test_barrier_fit_takes_three_actions_and_few_patterns_more_tasks(spark):
    df = spark.range(0, 400, 1, 3).select((F.col("id") % 11).cast("double").alias("a"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("double")).alias("b"),
                                          F.when(F.col("id") % 5 > 0, (F.col("id") % 13).cast("double")).alias("c"))
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # else each shuffle of an action is a job
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        imp = ChainedImputer(["a", "b", "c"], grams="barrier", barrier_tasks=6, max_iter=3).fit(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert imp.n_patterns_ == 4 and len(tracker.getJobIdsForGroup("fit")) <= 3
    ref = RowwiseImputer(max_iter=3).fit(_matrix(df, ["a", "b", "c"]))
    np.testing.assert_allclose(_matrix(imp.transform(df), ["a", "b", "c"]), ref.fitted, rtol=1e-8, atol=1e-8)


def test_the_driver_gets_weights_only(spark, monkeypatch):
    """Thousands of patterns: what the barrier stage returns has a row per regression."""
    p = 12
    df = spark.range(0, 12_000, 1, 4).select(*[F.when(F.xxhash64("id", F.lit(i)) % 3 != 0, (F.pmod(F.xxhash64("id", F.lit(100 + i)), F.lit(1000)) / 10.0 + F.col("id") % 5)).alias(f"c{i}") for i in range(p)])
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    imp = ChainedImputer([f"c{i}" for i in range(p)], max_iter=1, driver_bytes=1 << 20).fit(df)
    monkeypatch.undo()
    assert imp.n_patterns_ > 2000 and max(map(len, seen)) == p
