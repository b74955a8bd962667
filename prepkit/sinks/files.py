"""K1–K3: file sinks and durable stage hand-off.

Spark writes a directory of part files (one per task, in parallel); the
path is a directory, not a single file.  Stage tables go to the shared
scratch area (``spark.checkpoint.dir``), never to a machine-local folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import name_stage, scratch_path


#: Where a folder of keyed sources keeps the list of what it holds (scans pass over such names).
MANIFEST = "_sources"


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite",
              partition_by: Sequence[str] = (), replace_partitions: bool = False) -> str:
    """K1: header, missing → empty field, no index column.  Text is written as it
    is: white space stays, quotes are doubled, and a cell with a newline is quoted
    (read it with ``multi_line``).  With ``replace_partitions`` only the partitions that
    ``df`` has rows for are overwritten."""
    w = (df.write.mode(mode).option("header", True).option("sep", sep)
         .option("nullValue", "").option("emptyValue", '""').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if replace_partitions:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.csv(path)
    return path


def write_sources(df: DataFrame, root: str, key: str = "anio", sep: str = ",", keys: Iterable | None = None) -> str:
    """K1 by source: a folder of CSV files per key below ``root``, each replaced as a
    whole and alone; what other runs wrote for other keys stays.

    ``keys`` names the sources of this run (default: those with rows); one without rows is emptied.  The
    manifest, a small Parquet table beside the folders, has the rows of each source
    (:func:`written_sources`); it is written last, so a run that breaks off is not listed as done.
    ``df`` is read twice (the counts, then the rows): hand in a written stage where it is dear.  A NULL key is an error."""
    spark = df.sparkSession
    counts = write_stage(df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n_rows")), "source-counts")
    if counts.where(col(key).isNull()).limit(1).count():
        raise ValueError(f"rows without {key!r}")
    if keys is not None:
        given = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], df.select(col(key)).schema)
        if (other := counts.join(given, key, "left_anti").limit(1).collect()):
            raise ValueError(f"rows of a source that is not of this run: {other[0][key]!r}")
        for (k,) in given.join(counts, key, "left_anti").collect():
            _delete(spark, f"{root}/{key}={k}")
            _delete(spark, f"{root}/{MANIFEST}/{key}={k}")
    write_csv(df, root, sep=sep, partition_by=[key], replace_partitions=True)
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{root}/{MANIFEST}")
    return root


def written_sources(spark: SparkSession, root: str) -> DataFrame:
    """The sources below ``root`` that are written whole: ``n_rows`` and the key."""
    return spark.read.parquet(f"{root.rstrip('/')}/{MANIFEST}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_csv_indexed(df: DataFrame, path: str, index: str = "row_id", sep: str = ",",
                      mode: str = "overwrite") -> str:
    """K2: CSV whose first column is the row key (``index`` must exist)."""
    if index not in df.columns:
        raise KeyError(f"index column {index!r} not in {df.columns}")
    ordered = df.select(col(index), *[col(c) for c in df.columns if c != index])
    return write_csv(ordered, path, sep=sep, mode=mode)


def write_stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """K3: durable hand-off between stages as Parquet in the shared scratch
    area; returns the re-read DataFrame (lineage cut, survives lost
    executors)."""
    path = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """K3 by key: a stage that lies hashed and sorted by ``keys``, one file a bucket (default: the session's
    shuffle partitions).  It is shuffled once, here; joins and groupings by ``keys`` do not move it again.
    Buckets are known to Spark's catalog only, so the stage is a table of its own name there, with its files in
    the shared folder; :func:`~prepkit.session.stage_scope` and ``drop_scratch`` end both."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    title = re.sub(r"\W", "_", path.rsplit("/", 1)[-1]).lower()
    name_stage(path, title)
    (df.repartition(buckets, *[col(k) for k in keys]).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(title))
    return spark.table(title)
