"""Session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: every
intermediate that must outlive a job (checkpoints, written stage tables,
CSV round trips) goes under the folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests)
do we pick a temporary folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_LOCAL_SHARED: str | None = None
_SHIPPED: set[str] = set()
_MADE: list[str] = []
_TABLES: dict[str, str] = {}        # bucketed stages: folder -> name in the catalog
_SCOPE: ContextVar[list[str] | None] = ContextVar("stages of the innermost scope", default=None)


def get_session(master: str | None = None, app: str = "prepkit",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    * UTC session time zone, so ``TIMESTAMP_NTZ`` and ``TIMESTAMP`` agree;
    * AQE on (coalesces small shuffles, splits skewed partitions);
    * ANSI mode left at its default (on): bad casts fail loudly, tolerant
      variants use ``try_cast`` explicitly;
    * Spark UI off (no server is started).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared scratch area: ``spark.checkpoint.dir``.

    Read from the session (the setting, or ``setCheckpointDir``); set our own
    only where it is unset and the master is local (tests).  Anywhere else a
    folder of the driver's would be one that executors cannot see: an error.  The same folder is registered as the RDD checkpoint dir so
    ``DataFrame.checkpoint()`` works."""
    global _LOCAL_SHARED
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no JVM context on the client
        sc = None
    d = None
    try:
        d = spark.conf.get(_CKPT_KEY, None)
    except Exception:
        d = None
    if not d and sc is not None:
        d = sc.getConf().get(_CKPT_KEY, None)
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that all executors share")
        if _LOCAL_SHARED is None:
            _LOCAL_SHARED = tempfile.mkdtemp(prefix="prepkit-shared-")
        d = _LOCAL_SHARED
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared scratch area."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _MADE.append(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def name_stage(path: str, table: str) -> None:
    """Remember that the catalog knows a stage by a name, which goes with its files."""
    _TABLES[path] = table


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete stages and forget their names in the catalog; how many were there."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for path in dict.fromkeys(paths):
        if table := _TABLES.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(conf).delete(at, True))
        if path in _MADE:
            _MADE.remove(path)
    return gone


def drop_scratch(spark: SparkSession) -> int:
    """Delete every stage and file set this driver has put below the shared folder
    so far (results that still read them must be written first); how many."""
    return drop_paths(spark, list(_MADE))


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """The stages that a block makes go when it ends, also by an error::

        with stage_scope(spark):
            prepare_and_impute(df)[0].write.parquet(out)

    Results are lazy and read their stages, so they must be written (or collected) inside.
    Scopes nest, an inner one ends its own stages only; each thread has its own, so jobs that run
    side by side do not take each other's stages away."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        drop_paths(spark, mine)


def checkpoint(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never ``localCheckpoint``:
    a lost executor would lose the data)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (executors).

    Stages that run our Python code on executors (``mapInPandas``, the
    workbook data source) need the package there; a driver-side ``sys.path``
    entry does not reach them.  The package is zipped once per application
    and added with ``addPyFile``, which distributes it to every executor
    (a no-op concern when the package is installed on the cluster)."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:       # Spark Connect: ship with the session's artifacts instead
        return
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="prepkit-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("prepkit", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
