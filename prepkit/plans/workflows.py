"""The reference's workflows W1–W8, composed from the operators.

Each function takes DataFrames (never files it must find by itself, except
W1's source template) and returns DataFrames or small fitted parameters.
Defaults follow the reference's sensor layout; every name is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns, round_half_even
from ..operators import profile as prof
from ..operators import setops, stats
from ..operators.features import (IQRClipper, OneHot, Standardizer, bin_right_closed, train_test_split,
                                  unbinned_count)
from ..operators.impute import ChainedImputer
from ..operators.projection import add_time_features, drop_checked, move_to_front, select_by_position
from ..sinks.files import write_csv, write_csv_indexed, write_sources, write_stage
from ..sources.batch import read_keyed_sources

# Column roles of the reference's air-quality tables.
TIME_COL = "Fecha y hora"
STATION_COL = "Estacion"
NO_VARIANCE_COLS = ["RAINF"]
OUTLIER_COLS = ["PM10", "PM2.5", "O3", "CO"]
SCALED_COLS = ["CO", "NO", "NO2", "NOX", "O3", "PM10", "PM2.5", "PRS", "RH", "SR", "TOUT", "WSR", "WDR"]
BIN_COL = "PM10"
BIN_EDGES = [0.0, 50.0, 100.0, float("inf")]
BIN_LABELS = ["Buena", "Regular", "Mala"]
BIN_OUT = "Calidad_Aire_PM10"


# ------------------------------------------------------------------ W1


@dataclass
class Consolidated:
    data: DataFrame          # all present sources, tagged with the key
    quality: DataFrame       # A6, ranked (O1)
    best: DataFrame          # O2, one row
    skipped: list            # S3 report


def consolidate_sources(spark: SparkSession, template: str, keys, reader: Callable[[list[str]], DataFrame],
                        key: str = "anio", path_column: str | None = None,
                        exclude: Sequence[str] = (), output_root: str | None = None) -> Consolidated:
    """One scan over every present yearly source, per-source quality
    summary, ranking and the most complete source.  ``exclude`` names
    bookkeeping columns (e.g. the file path) left out of the null count.

    With ``output_root`` the unified rows are written as CSV, one directory
    per key (K1, written in parallel by every task), and the summary gains
    the ``output_path`` of each source's directory.  Each source replaces its own
    directory alone, so a run over some keys leaves the others' output."""
    keys = list(keys)
    df, skipped = read_keyed_sources(spark, template, keys, reader, key=key, path_column=path_column)
    cols = [c for c in df.columns if c != key and c not in set(exclude)]
    quality = prof.quality_by_source(df, key, cols=cols)
    if output_root:
        write_sources(df.drop(*[c for c in exclude if c in df.columns]), output_root, key, keys=[k for k in keys if k not in skipped])
        quality = quality.withColumn(
            "output_path", F.concat(F.lit(output_root.rstrip("/") + f"/{key}="), col(key).cast("string")))
    return Consolidated(df, prof.rank_sources(quality, key), prof.best_source(quality, key), skipped)


# ------------------------------------------------------------------ W2


def understand(df: DataFrame) -> dict[str, DataFrame]:
    """Shape, schema profile, null percentages (labelled), duplicate count, and
    the ``distinct`` rows for W3, all from one scan of ``df``.

    The rows are grouped once and each distinct one is written with its number of copies.
    The profile is an aggregate of that stage, weighted by the copies: unlike counters that
    run along with a scan (``observe``), it counts nothing twice when a lost executor's tasks run again."""
    groups = write_stage(prof.row_groups(df), "distinct-rows")
    counts = write_stage(prof.column_counts(groups, copies=prof.COPIES), "column-counts")
    return {"shape": prof.shape(df, counts), "schema": prof.schema_profile(df, counts),
            "null_pct": prof.null_pct_labels(prof.null_profile(df, counts=counts)),
            "duplicates": prof.duplicates_of(groups), "distinct": groups.drop(prof.COPIES)}


# ------------------------------------------------------------------ W3


@dataclass
class Prepared:
    data: DataFrame          # imputer input (pass-through columns kept)
    features: list[str]      # imputed / predictor columns
    encoder: OneHot


def prepare(df: DataFrame, time_col: str = TIME_COL, station_col: str = STATION_COL,
            drop: Sequence[str] = NO_VARIANCE_COLS, month: str = "Mes", hour: str = "Hora",
            keep: Sequence[str] = (), stage: bool = True, time_format: str | None = None, distinct: bool = False) -> Prepared:
    """W3 up to the imputer: de-duplicate, drop the no-variance columns,
    parse time and derive month/hour, one-hot the station (first level
    dropped).  The timestamp stays as a pass-through column (never detached
    and re-attached by position).

    With ``stage`` the de-duplicated table is written once to the shared
    folder (one shuffle in total, durable against lost executors); the
    encoder is fitted on the stage and applied lazily on top of it, so the
    imputer's passes re-read the stage instead of re-running the shuffle.
    ``distinct`` says that ``df`` is so already (W2's ``distinct`` rows)."""
    d = df if distinct else setops.distinct_rows(df)
    d = drop_checked(d, list(drop)) if drop else d
    d = add_time_features(d, time_col, month, hour, time_format)
    if stage:
        d = write_stage(d, "prepared")
    enc = OneHot(station_col).fit(d)
    d = enc.transform(d)
    passthrough = [time_col, *keep]
    features = [c for c in d.columns if c not in passthrough]
    d = d.select(*[col(c) for c in passthrough],
                 *[col(c).cast("double").alias(c) for c in features])
    return Prepared(d, features, enc)


def prepare_and_impute(df: DataFrame, **kw) -> tuple[DataFrame, ChainedImputer]:
    """:func:`prepare` then chained-equation imputation fitted and
    applied on the same rows (F2)."""
    prep = prepare(df, **kw)
    imp = ChainedImputer(prep.features).fit(prep.data)
    return imp.transform(prep.data), imp


# ------------------------------------------------------------------ W4


def clean_and_transform(df: DataFrame, outlier_cols: Sequence[str] = OUTLIER_COLS,
                        bin_col: str = BIN_COL, edges: Sequence[float] = BIN_EDGES,
                        labels: Sequence[str] = BIN_LABELS, bin_out: str = BIN_OUT,
                        scaled_cols: Sequence[str] = SCALED_COLS, output_path: str | None = None) -> tuple[DataFrame, dict]:
    """IQR fences on the input, clip, bin the clipped (unscaled) value,
    then standardise with moments of the clipped data.  Two aggregations
    (quartiles; moments) and one projection.  ``params["unbinned"]`` (lazy)
    counts values that no bin takes (e.g. an imputed PM10 ≤ 0).  With
    ``output_path`` the result is written there as CSV (K1)."""
    clip = IQRClipper(list(outlier_cols)).fit(df)
    c = clip.transform(df)
    c = c.withColumn(bin_out, bin_right_closed(col(bin_col), edges, labels))
    scaler = Standardizer([s for s in scaled_cols if s in c.columns]).fit(c)
    out = scaler.transform(c)
    if output_path:
        write_csv(out, output_path)
    return out, {"fences": clip.fences, "scaler": scaler.params,
                                 "unbinned": unbinned_count(c, bin_col, bin_out)}


# ------------------------------------------------------------------ W5 / W7


def correlate(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Covariance (population), correlation and its labelled cells."""
    moments = write_stage(stats.pair_moments(df, cols), "pair-moments")     # one pass for both
    corr = stats.corr_matrix(df, cols, moments=moments)
    return {"cov": stats.cov_matrix(df, cols, moments=moments), "corr": corr, "labels": stats.corr_labels(corr)}


def post_imputation_stats(df: DataFrame) -> dict[str, DataFrame]:
    """Drop the leading index column by position, then W5 on the rest.  The rows
    are written once: their moments take two passes, and an imputed table would be imputed in each."""
    data = write_stage(select_by_position(df, 1), "post-imputation")
    return correlate(data, data.columns)


# ------------------------------------------------------------------ W6


def impute_holdout(df: DataFrame, keys: Sequence[str], drop: Sequence[str] = (TIME_COL, STATION_COL),
                   test_size: float = 0.2, seed: int = 42, round_output: bool = True,
                   index: str = "row_id", output_path: str | None = None) -> tuple[DataFrame, ChainedImputer]:
    """Drop the non-numeric columns, split train/test deterministically,
    fit on train, impute test, optionally round half-even (the reference
    rounds every cell), with the row key first.  ``keys`` should identify a row.
    With ``output_path`` the result is written there as CSV, key first (K2)."""
    key = (col(keys[0]).cast("string") if len(keys) == 1
           else F.concat_ws(":", *[col(k).cast("string") for k in keys]))
    d = df.withColumn(index, key)
    train, test = train_test_split(d, [index], test_size, seed)
    train, test = (drop_checked(part, list(drop)) if drop else part for part in (train, test))
    features = [c for c in test.columns if c != index]
    imp = ChainedImputer(features).fit(train)
    out = imp.transform(test)
    if round_output:
        out = out.select(col(index), *[round_half_even(col(c)).alias(c) for c in features])
    out = move_to_front(out, [index])
    if output_path:
        write_csv_indexed(out, output_path, index=index)
    return out, imp


def write_back(source: DataFrame, imputed: DataFrame, index: str = "row_id", columns: Sequence[str] | None = None,
               how: str = "inner") -> DataFrame:
    """W6 brought back to its source by the retained key: for each of ``columns`` (default: all of ``imputed``)
    the source's value, ``<c>_imputed`` and the mask ``<c>_filled`` (missing in the source, filled now).

    ``how="inner"`` gives the rows of ``imputed``; ``"left"`` gives all of ``source``, with NULL as imputed value and false
    as mask where a row was not imputed.  Hand in ``source`` as a bucketed stage
    (:func:`~prepkit.sinks.files.write_bucketed`): then only the imputed rows are shuffled.  A key that is NULL or
    not of one row, in either table, is an error; a source row of an unknown key cannot arise from :func:`impute_holdout`,
    so imputed rows without a source row are left out."""
    columns = [c for c in imputed.columns if c != index] if columns is None else list(columns)
    for name, df in (("source", source), ("imputed", imputed)):
        unknown = [c for c in [index, *columns] if c not in df.columns]
        if unknown:
            raise KeyError(f"columns not in {name}: {unknown}")
    imputed = write_stage(imputed.select(col(index), *[col(c).alias(f"{c}_imputed") for c in columns]), "to-write-back")
    for name, df in (("source", source), ("imputed", imputed)):
        again = df.groupBy(col(index)).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | col(index).isNull()).limit(1).collect()
        if again:
            raise ValueError(f"key {again[0][0]!r} is not of one row of {name}")
    both = source.join(imputed, index, how)
    return both.select(col(index), *[e for c in columns for e in (
        col(c), col(f"{c}_imputed"), (col(c).isNull() & col(f"{c}_imputed").isNotNull()).alias(f"{c}_filled"))])


# ------------------------------------------------------------------ W8


def imputation_check(original: DataFrame, imputed: DataFrame, stage: bool = True) -> dict[str, DataFrame]:
    """Null counts left after imputation and central measures of both
    inputs side by side (one grouped computation).  The measures make
    several passes (exact medians), so an imputed table is staged once in
    the shared folder rather than re-imputed per pass."""
    if stage:
        imputed = write_stage(imputed, "imputed")
    num = [c for c in numeric_columns(imputed) if c in original.columns]
    return {"nulls": prof.null_profile(imputed),
            "measures": stats.compare_stages({"original": original.select(*[col(c) for c in num]),
                                              "imputed": imputed.select(*[col(c) for c in num])})}
