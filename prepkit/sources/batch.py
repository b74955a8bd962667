"""S2 + S3: a batch of keyed sources (one per year) read as ONE scan.

The path template is resolved on the driver with the Hadoop file system
(metadata only: existence / glob per key), absent sources are reported
instead of silently skipped, and the present ones are read in a single
multi-path scan.  The key (year) is recovered per row from the file path
(``_metadata.file_path``), so no driver loop touches data.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import read_csv_union, source_path


@dataclass
class ResolvedSources:
    present: list[tuple[object, str]]   # (key, path)
    skipped: list[object]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    st = fs.globStatus(p)
    return st is not None and len(st) > 0


def resolve_sources(spark: SparkSession, template: str, keys: Iterable,
                    placeholder: str = "year") -> ResolvedSources:
    """Format ``template`` (e.g. ``/data/BD_{year}``) for every key and split
    into present and skipped sources (S3)."""
    present, skipped = [], []
    for k in keys:
        p = template.format(**{placeholder: k})
        if path_exists(spark, p):
            present.append((k, p))
        else:
            skipped.append(k)
    return ResolvedSources(present, skipped)


def key_from_path(template: str, placeholder: str = "year", path_column: str | None = None):
    """Column expression extracting the key from the row's source path
    (``_metadata.file_path`` for file sources, or ``path_column`` for sources
    that emit it themselves), using the template's last path component as
    the pattern; ``*`` and ``?`` in it match as in a glob.  Spark's file paths are
    percent-encoded (a space is ``%20``) and decoded first."""
    last = template.rstrip("/").split("/")[-1]
    pat = re.escape(last).replace(re.escape("{" + placeholder + "}"), r"(\d+)").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    src = F.col(path_column) if path_column else source_path()
    return F.regexp_extract(src, pat, 1)


def read_keyed_sources(spark: SparkSession, template: str, keys: Iterable,
                       reader: Callable[[list[str]], DataFrame], key: str = "anio",
                       placeholder: str = "year", key_type: str = "bigint",
                       require_any: bool = True,
                       path_column: str | None = None) -> tuple[DataFrame | None, list]:
    """Read every present source in one scan; return ``(df, skipped_keys)``.

    ``reader(paths)`` builds the scan (CSV, Parquet, ...); it must be a
    file source so ``_metadata`` is available."""
    res = resolve_sources(spark, template, keys, placeholder)
    if not res.present:
        if require_any:
            raise FileNotFoundError(f"no source found for {template} over the given keys")
        return None, res.skipped
    paths = [p for _, p in res.present]
    df = reader(paths)
    df = df.withColumn(key, key_from_path(template, placeholder, path_column).cast(key_type))
    return df, res.skipped


def read_keyed_csv(spark: SparkSession, template: str, keys: Iterable, key: str = "anio", **options) -> tuple[DataFrame, list]:
    """S2–S4 + U1: the present yearly CSV sources, whose columns may differ from year
    to year, as one table with the key; and the skipped keys.  ``options`` are those of
    :func:`prepkit.sources.csv.read_csv_union`."""
    df, skipped = read_keyed_sources(spark, template, keys, lambda paths: read_csv_union(spark, paths, with_path="__path", **options),
                                     key=key, path_column="__path")
    return df.drop("__path"), skipped


def skipped_frame(spark: SparkSession, skipped: Sequence, key: str = "anio") -> DataFrame:
    """The skipped-source report as a DataFrame."""
    return spark.createDataFrame([(int(k),) for k in skipped], f"{key} bigint")
