"""The reference's two studies, end to end, on yearly sensor workbooks.

``run_study`` follows the analysis notebook: consolidate the yearly
workbooks (W1), pick the most complete year — computed, where the notebook
hard-codes it — describe it (W2), prepare and impute it (W3), clip, bin and
standardise (W4) and correlate (W5).  ``run_holdout`` follows the hold-out
script and its two consumers: impute a 20 % split fitted on the rest (W6),
then the post-imputation statistics (W7) and the before/after check (W8).

Every step returns DataFrames; nothing is collected except fitted
parameters and the one number "best year".
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import col, parse_number, parse_timestamp
from ..sinks.files import write_stage
from ..sources.workbook import read_workbooks
from .workflows import (SCALED_COLS, STATION_COL, TIME_COL, clean_and_transform, consolidate_sources,
                        correlate, imputation_check, impute_holdout, post_imputation_stats,
                        prepare_and_impute, understand)


def normalize_readings(df: DataFrame, time_col: str = TIME_COL, text_cols: Sequence[str] = (STATION_COL,),
                       skip: Sequence[str] = (), time_format: str | None = None) -> DataFrame:
    """S6 over a text-typed scan: the timestamp parsed, every other column a
    DOUBLE with NA tokens / malformed text → NULL."""
    out = []
    for c in df.columns:
        if c == time_col:
            dtype = dict(df.dtypes)[c]
            out.append((parse_timestamp(col(c), time_format) if dtype == "string" else col(c)).alias(c))
        elif c in text_cols or c in skip:
            out.append(col(c))
        else:
            out.append(parse_number(col(c)).alias(c))
    return df.select(*out)


def run_study(spark: SparkSession, template: str, years: Iterable[int] = range(2020, 2026),
              output_root: str | None = None, schema=None, time_format: str | None = None) -> dict:
    """W1 → W5 over workbooks ``template.format(year=...)`` (one sheet per
    station).  With a ``schema`` (the sheets' columns, then STATION_COL and
    ``file``) no workbook is opened on the driver.  ``output_root`` takes the
    unified years and, below ``clean``, the final table."""
    w1 = consolidate_sources(
        spark, template, years,
        lambda paths: read_workbooks(spark, paths, schema=schema, sheet_column=STATION_COL),
        path_column="file", exclude=["file"], output_root=output_root)
    best = w1.best.first()["anio"]
    year = normalize_readings(w1.data.where(col("anio") == best).drop("anio", "file"), time_format=time_format)
    described = understand(year)
    imputed, imputer = prepare_and_impute(described["distinct"], distinct=True)     # W2 has the distinct rows
    # W4 makes several passes (quartiles, moments): impute once, then re-read
    imputed = write_stage(imputed, "imputed")
    clean, params = clean_and_transform(imputed, output_path=output_root and f"{output_root.rstrip('/')}/clean")
    scaled = [c for c in SCALED_COLS if c in clean.columns]
    return {"quality": w1.quality, "best_year": best, "skipped": w1.skipped, "understand": described,
            "imputed": imputed, "imputer": imputer, "clean": clean, "params": params,
            "stats": correlate(clean, scaled)}


def run_holdout(complete: DataFrame, keys: Sequence[str] = (TIME_COL, STATION_COL),
                test_size: float = 0.2, seed: int = 42, output_path: str | None = None) -> dict:
    """W6 → W7, W8 on a complete (gapped) table: the time and station
    columns form the row key and are dropped from the model."""
    test_imputed, imputer = impute_holdout(complete, keys=list(keys), drop=list(keys),
                                           test_size=test_size, seed=seed, output_path=output_path)
    numeric = complete.drop(*keys)
    return {"test_imputed": test_imputed, "imputer": imputer,
            "post": post_imputation_stats(test_imputed),
            "check": imputation_check(numeric, test_imputed.drop("row_id"))}
