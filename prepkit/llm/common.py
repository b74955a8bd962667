"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from prepkit.session import drop_paths, scratch_path

#: ASCII white space of the text contracts: tab to carriage return, and space.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a Java regular-expression class of everything else (a word).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: later
    steps reuse the rows, and a lost executor does not lose them.

    ``release`` lets go of the shuffle files behind it at once: Spark deletes them
    when the driver has collected its garbage, which may otherwise be long after."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    if release:
        del df
        gc.collect()
        back.sparkSession.sparkContext._jvm.System.gc()
    return back


def drop_stages(*stages: DataFrame) -> None:
    """Delete what ``stage`` wrote; nothing may read these any more."""
    for df in stages:
        drop_paths(df.sparkSession, [df.staged_at])


def row_key(name: str) -> Column:
    """An id as a string that is never NULL."""
    c = F.col(f"`{name}`")
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("i"), c.cast("string")))


def row_digest(df: DataFrame) -> Column:
    """A digest of a whole row (maps, which Spark does not hash, left out)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])


def join_rows(df: DataFrame, found: DataFrame, id_col: str, text: Column, *order: str, first: Sequence[Column] = ()) -> DataFrame:
    """Each row of ``df`` with each row of ``found`` about it.  ``found`` has
    ``__llm_key`` (``row_key`` of the id), ``__llm_copy`` (``xxhash64`` of ``text``) and
    ``order``; the first row of ``df`` with one id and text takes the first in ``found``.
    Rows of ``df`` come by ``first``, then by a digest of all their columns, so reruns
    agree.  Texts are shuffled once: the numbers and the join share their partitioning."""
    alike = Window.partitionBy("__llm_key", "__llm_copy")
    rows = df.withColumns({"__llm_key": row_key(id_col), "__llm_copy": F.xxhash64(text)}).withColumn(
        "__llm_n", F.row_number().over(alike.orderBy(*first, row_digest(df))))
    found = found.withColumn("__llm_m", F.dense_rank().over(alike.orderBy(*[F.col(c) for c in order])))
    return rows.join(found, ["__llm_key", "__llm_copy"]).where("__llm_n - __llm_m = 0")
