"""Where stages go, and how they are removed."""

import os
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest

from __spark_entry__ import queries
from conftest import SF_SMALL
from prepkit import session
from prepkit.sinks.files import write_stage


def _fake(conf=None, checkpoint=None, master="yarn"):
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k, d=None: None),
                              getCheckpointDir=lambda: checkpoint, setCheckpointDir=lambda d: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: conf))


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            session.shared_dir(_fake(master=master))
    assert session.shared_dir(_fake(conf="hdfs://a/b")) == "hdfs://a/b"
    assert session.shared_dir(_fake(checkpoint="hdfs://c/d")) == "hdfs://c/d"
    assert os.path.isdir(session.shared_dir(_fake(master="local[2]")))


def test_stages_can_be_dropped(spark):
    write_stage(spark.range(3), "one")
    path = session._MADE[-1]
    assert os.path.isdir(path)
    assert session.drop_scratch(spark) >= 1 and not os.path.exists(path)


def test_stages_end_with_their_scope(spark):
    write_stage(spark.range(3), "outside")
    outside = session._MADE[-1]
    with pytest.raises(KeyError), session.stage_scope(spark):
        outer = write_stage(spark.range(5), "outer")
        with session.stage_scope(spark):
            write_stage(spark.range(7), "inner")
            inner = session._MADE[-1]
            assert os.path.isdir(inner)
        assert not os.path.exists(inner) and outer.count() == 5
        raise KeyError("the block fails")
    assert session._MADE[-1] == outside and os.path.isdir(outside)


def test_threads_keep_their_own_stages(spark):
    def work(n):
        with session.stage_scope(spark):
            stage = write_stage(spark.range(n), f"thread-{n}")
            return stage.count()

    with session.stage_scope(spark), ThreadPoolExecutor(3) as pool:
        kept = write_stage(spark.range(11), "kept")
        assert list(pool.map(work, range(1, 7))) == list(range(1, 7))
        assert kept.count() == 11


@pytest.mark.parametrize("name", ["impute_fit_transform", "understand", "holdout_write_back", "replaced_source", "two_gaps_check"])
def test_a_query_in_a_scope_leaves_no_stage(spark, name):
    before = set(os.listdir(session.shared_dir(spark)))
    made = len(session._MADE)
    with session.stage_scope(spark):
        assert queries()[name](spark, SF_SMALL).count() > 0
        assert len(session._MADE) > made
    left = set(os.listdir(session.shared_dir(spark))) - before
    assert len(session._MADE) == made and not [x for x in left if "-" in x and not _is_checkpoints(x)]


def _is_checkpoints(name):
    """Spark's own folder of reliable checkpoints, named by a whole UUID."""
    return len(name) == 36 and name.count("-") == 4
