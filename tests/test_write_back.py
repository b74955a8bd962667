"""Imputed hold-out rows rejoin their source by key: values, mask, plan and refusals."""

import os
import re

import pytest
from pyspark.sql import functions as F

from prepkit.plans import workflows
from prepkit.session import stage_scope
from prepkit.sinks.files import write_bucketed


def _source(spark, n=400):
    x = F.col("id").cast("double")
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("row_id"), x.alias("a"),
                                 F.when(F.col("id") % 7 == 0, None).otherwise(2 * x + F.col("id") % 3).alias("b"))


def test_values_and_mask(spark):
    source = write_bucketed(_source(spark), "by-key", ["row_id"])
    imputed, _ = workflows.impute_holdout(source, keys=["row_id"], drop=[], round_output=False)
    back = workflows.write_back(source, imputed)
    assert back.columns == ["row_id", "a", "a_imputed", "a_filled", "b", "b_imputed", "b_filled"]
    truth = {r.row_id: r for r in _source(spark).collect()}
    rows = back.collect()
    assert 0 < len(rows) == imputed.count() < 200
    for r in rows:
        t = truth[r.row_id]
        assert (r.a, r.a_imputed, r.a_filled) == (t.a, t.a, False)
        assert r.b == t.b and r.b_filled == (t.b is None) and r.b_imputed is not None
        assert r.b_filled or r.b_imputed == r.b
    assert any(r.b_filled for r in rows)
    whole = workflows.write_back(source, imputed, columns=["b"], how="left")
    assert whole.count() == 400 and whole.where("b_imputed is not null").count() == len(rows)
    assert whole.where("b_filled and b_imputed is null").count() == 0 and whole.where("b_filled is null").count() == 0


def test_the_bucketed_side_is_not_shuffled(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        source = write_bucketed(_source(spark), "by-key", ["row_id"])
        imputed, _ = workflows.impute_holdout(source, keys=["row_id"], drop=[])
        plan = workflows.write_back(source, imputed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "SortMergeJoin" in plan      # the imputed rows alone
    assert "Bucketed: true" in plan


def test_keys_must_be_of_one_row(spark):
    source = _source(spark, 20)
    ready = source.fillna(0.0)
    with pytest.raises(ValueError, match="of source"):
        workflows.write_back(source.unionAll(source.limit(1)), ready)
    with pytest.raises(ValueError, match="of imputed"):
        workflows.write_back(source, ready.unionAll(ready.limit(1)))
    with pytest.raises(ValueError, match="None"):
        workflows.write_back(source.withColumn("row_id", F.when(F.col("a") > 0, F.col("row_id"))), ready)
    with pytest.raises(KeyError, match="nope"):
        workflows.write_back(source, ready, columns=["nope"])
    assert workflows.write_back(source.limit(0), ready).count() == 0


def test_a_bucketed_stage_ends_with_its_scope(spark):
    before = len(spark.catalog.listTables())
    with stage_scope(spark):
        stage = write_bucketed(_source(spark, 30), "by-key", ["row_id"], buckets=3)
        folder = os.path.dirname(stage.inputFiles()[0].removeprefix("file://"))
        assert len(stage.inputFiles()) == 3 and os.path.isdir(folder)
        assert len(spark.catalog.listTables()) == before + 1
    assert len(spark.catalog.listTables()) == before and not os.path.exists(folder)
