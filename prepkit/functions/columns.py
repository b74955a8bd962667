"""Column expressions (P-family) and the quoting / missing-value helpers.

All helpers return ``pyspark.sql.Column`` built from built-in functions, so
they stay inside whole-stage codegen.  Column names in the source data carry
spaces and dots (``Fecha y hora``, ``PM2.5``): always go through :func:`col`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The missing-value tokens a CSV reader of the reference's
# stack treats as NA by default (must match for identical null counts).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def q(name: str) -> str:
    """Back-quote a column name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """``F.col`` that is safe for names such as ``PM2.5`` or ``Fecha y hora``."""
    return F.col(q(name))


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """The columns a ``numeric_only=True`` reduction would use."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and f.name not in ex]


# --- S6 / §1.4: one missing-value concept -------------------------------

def nan_to_null(c: Column) -> Column:
    """NaN → NULL (Spark's ``isNull`` does not see NaN; aggregates would
    return NaN).  Applied at every scan boundary."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def normalize_nan(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in every float/double column (or ``cols``)."""
    fl = {f.name for f in df.schema.fields
          if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = set(cols) & fl if cols is not None else fl
    if not targets:
        return df
    return df.select(*[nan_to_null(col(c)).alias(c) if c in targets else col(c)
                       for c in df.columns])


def parse_number(c: Column, tokens: Iterable[str] = NA_TOKENS,
                 dtype: str = "double") -> Column:
    """Text cell → number.  NA tokens (after trimming) → NULL, malformed
    text → NULL (``try_cast``), NaN → NULL."""
    s = F.trim(c.cast("string"))
    v = F.when(s.isin(list(tokens)), F.lit(None)).otherwise(s)
    num = v.try_cast(dtype)
    if dtype in ("double", "float"):
        num = nan_to_null(num)
    return num


def malformed_number(c: Column, tokens: Iterable[str] = NA_TOKENS,
                     dtype: str = "double") -> Column:
    """True when a text cell is neither an NA token nor a valid number."""
    s = F.trim(c.cast("string"))
    return (s.isNotNull() & ~s.isin(list(tokens))
            & s.try_cast(dtype).isNull())


# --- P6–P8: time --------------------------------------------------------

def parse_timestamp(c: Column, fmt: str | None = None, strict: bool = True) -> Column:
    """Text → TIMESTAMP_NTZ.  ``strict`` raises on unparseable values
    (ANSI cast), otherwise unparseable → NULL."""
    if isinstance(c, Column) and fmt is None:
        return c.cast("timestamp_ntz") if strict else c.try_cast("timestamp_ntz")
    if strict:
        return F.to_timestamp_ntz(c, F.lit(fmt))
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


#: Layouts that :func:`infer_time_format` tries, in this order; where a day and a month could be
#: either, all rows decide, and month first where they leave it open.
TIME_FORMATS = tuple(f"{date}{time}" for date in ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy")
                     for time in ("", " H:mm", " H:mm:ss", " H:mm:ss.SSSSSS", "'T'H:mm:ss", " h:mm a", " h:mm:ss a"))


#: What a letter run of a format can stand for in a cell; a cell of another shape need not be parsed.
_SHAPES = {"yyyy": r"\d{4}", "MMM": r"\p{L}+\.?", "MM": r"\d{2}", "dd": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "SSSSSS": r"\d{6}",
           "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "h": r"\d{1,2}", "a": "[AaPp][Mm]", "'T'": "T"}


def _shape(fmt: str) -> str:
    """A pattern that every cell of this format matches."""
    parts = re.split("('T'|yyyy|MMM|MM|dd|mm|ss|SSSSSS|[MdHha])", fmt)
    return "^" + "".join(_SHAPES.get(p) or re.escape(p) for p in parts) + "$"


def infer_time_format(df: DataFrame, name: str, formats: Iterable[str] = TIME_FORMATS, tokens: Iterable[str] = NA_TOKENS) -> str:
    """The first of ``formats`` that every cell of a text column has, NA tokens
    apart.  One aggregate counts, for each format, the cells that do not parse.  An error names the
    column and the format that comes closest if none fits; a column without cells has the first."""
    formats, cell = list(formats), F.trim(col(name))
    there = col(name).isNotNull() & ~cell.isin(list(tokens))
    fits = [F.when(cell.rlike(_shape(f)), F.try_to_timestamp(cell, F.lit(f)).isNotNull()).otherwise(False) for f in formats]
    *wrong, n = df.agg(*[F.count_if(there & ~f) for f in fits], F.count_if(there)).first()
    least = min(wrong)
    best = formats[wrong.index(least)]
    if least:
        raise ValueError(f"no time format fits column {name!r}: {best!r} comes closest, with {least} of {n} cells left")
    return best


def parse_inferred(df: DataFrame, names: Iterable[str], tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Text columns as TIMESTAMP_NTZ, each by the format that all its cells have; NA tokens are NULL."""
    tokens = list(tokens)
    found = {n: infer_time_format(df, n, tokens=tokens) for n in names}
    return df.withColumns({n: parse_timestamp(F.when(~F.trim(col(n)).isin(tokens), F.trim(col(n))), f) for n, f in found.items()})


def month_of(c: Column) -> Column:
    """Month 1–12."""
    return F.month(c)


def hour_of(c: Column) -> Column:
    """Hour 0–23."""
    return F.hour(c)


# --- P9–P12: numbers ----------------------------------------------------

def round_half_even(c: Column, scale: int = 0) -> Column:
    """banker's rounding as NumPy's ``round``: scale by ``10**scale``,
    round half to even, scale back (``round(2.5) == 2``).  Spark's
    ``bround(x, 2)`` instead rounds the exact decimal expansion, which
    differs from NumPy on values such as 109480.665."""
    if scale == 0:
        return F.bround(c, 0)
    f = F.lit(float(10 ** scale))
    return F.bround(c * f, 0) / f


def round_half_up(c: Column, scale: int = 0) -> Column:
    """Half-away-from-zero rounding with the same scale-then-round recipe."""
    if scale == 0:
        return F.round(c, 0)
    f = F.lit(float(10 ** scale))
    return F.round(c * f, 0) / f


def percent_label(c: Column, digits: int = 2) -> Column:
    """P10: ``12.5`` → ``'12.5 %'`` (rounded half-even, shortest text)."""
    return F.concat(round_half_even(c, digits).cast("string"), F.lit(" %"))


def clip_upper(c: Column, hi) -> Column:
    """Values above ``hi`` become ``hi``; NULL stays NULL, and NaN (which
    Spark sorts above all numbers) is missing too, so it becomes NULL."""
    c = nan_to_null(c)
    return F.when(c > hi, hi).otherwise(c)


def clip_lower(c: Column, lo) -> Column:
    c = nan_to_null(c)
    return F.when(c < lo, lo).otherwise(c)


def sig_round(c: Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (presentation of statistics
    whose magnitude is data dependent).  Only exact powers of ten are used as
    scale factors, so the result is reproducible in any engine."""
    a = F.abs(c)
    e = F.floor(F.log10(a))
    k = F.lit(digits - 1) - e
    up = F.pow(F.lit(10.0), k)
    down = F.pow(F.lit(10.0), -k)
    r = F.when(k >= 0, F.round(c * up) / up).otherwise(F.round(c / down) * down)
    return F.when(c.isNull() | (c == 0), c + F.lit(0.0)).otherwise(r)


def sig_round_sql(expr: str, digits: int = 9) -> str:
    """The same rounding as SQL text (used by the DuckDB oracle)."""
    x = f"({expr})"
    k = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} + CAST(0.0 AS DOUBLE) "
            f"WHEN {k} >= 0 THEN round({x} * pow(10.0, {k})) / pow(10.0, {k}) "
            f"ELSE round({x} / pow(10.0, -{k})) * pow(10.0, -{k}) END)")
