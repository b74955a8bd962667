"""Delimited text scans with a declared schema.

Every column is first read as text under the declared name, then converted:
NA tokens → NULL, numbers via ``try_cast`` (malformed text → NULL, countable
with :func:`malformed_counts`), NaN → NULL, timestamps via cast.  The header
is checked against the declared names (``enforceSchema=false``), so a file
read with the wrong delimiter fails instead of silently giving all-NULL rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NA_TOKENS, col, malformed_number, parse_number


def as_schema(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromDDL(schema)


def _convert(c, dt: T.DataType, tokens: Sequence[str], strict_time: bool):
    tok = list(tokens)
    if isinstance(dt, T.StringType):
        return F.when(c.isin(tok), F.lit(None)).otherwise(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return parse_number(c, tok, "double").cast(dt)
    if isinstance(dt, T.NumericType):
        return parse_number(c, tok, dt.simpleString())
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        v = F.when(F.trim(c).isin(tok), F.lit(None)).otherwise(F.trim(c))
        return v.cast(dt) if strict_time else v.try_cast(dt)
    if isinstance(dt, T.BooleanType):
        v = F.lower(F.trim(c))
        return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)
    return c.try_cast(dt)


def read_text_table(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str],
                    sep: str = ",", header: bool = True, check_header: bool = True, multi_line: bool = False) -> DataFrame:
    """The raw all-text scan (declared names, no conversion).  ``multi_line`` takes
    quoted cells with newlines; each file is then read by one task."""
    raw_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    r = (spark.read.schema(raw_schema).option("header", header).option("sep", sep)
         .option("enforceSchema", not (check_header and header))
         .option("nullValue", None).option("emptyValue", "").option("escape", '"').option("multiLine", multi_line)
         .option("mode", "FAILFAST"))
    return r.csv(list(paths) if not isinstance(paths, str) else paths)


def infer_schema(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", na_tokens: Iterable[str] = NA_TOKENS,
                 multi_line: bool = False) -> T.StructType:
    """A type for each column of files with a header: BIGINT, DOUBLE, TIMESTAMP_NTZ
    or BOOLEAN if every cell that is not missing is one, else STRING; a column
    without cells is DOUBLE.  One aggregate over all rows."""
    names = header_of(spark, paths, sep, multi_line)
    return infer_types(read_text_table(spark, paths, names, sep, multi_line=multi_line), na_tokens)


def header_of(spark: SparkSession, path: str | Sequence[str], sep: str = ",", multi_line: bool = False) -> list[str]:
    """The column names in a source's first line (a small job that reads one record)."""
    return spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line).csv(path).columns


#: What a cell must look like for a cast to succeed (white space and control characters around it aside).  A cast
#: that fails costs an exception in the JVM, ten times and more what the look does; the cast still decides.
_SHAPES = {"bigint": r"^[^\x21-\x7e]*[-+]?[0-9]+[^\x21-\x7e]*$",
           "double": r"^[^\x21-\x7e]*[-+]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[dDfF]?[^\x21-\x7e]*$|0[xX]|[iI][nN][fF]|[nN][aA][nN])"}
#: Years of six digits beyond the last of a timestamp.
_NO_YEAR = "^[-+]?(29[5-9]|[3-9][0-9]{2})[0-9]{3}"


def _is_no(cell: Column, kind: str) -> Column:
    """Whether a cell that is there cannot be read as a ``kind``."""
    shape = ~cell.rlike(_NO_YEAR) if kind == "timestamp_ntz" else cell.rlike(_SHAPES[kind])
    return F.when(shape, cell.try_cast(kind)).isNull()


def infer_types(raw: DataFrame, na_tokens: Iterable[str] = NA_TOKENS, *more: DataFrame) -> T.StructType:
    """The types of an all-text table's columns, see :func:`infer_schema`.  ``more`` tables with the
    same columns count too, each by its own aggregate beside its scan."""
    names = raw.columns
    kinds = ("bigint", "double", "timestamp_ntz", "boolean")
    aggs = []
    for i, n in enumerate(names):
        cell = F.trim(col(n))
        there = col(n).isNotNull() & ~cell.isin(list(na_tokens))
        flag = F.lower(cell).isin("true", "false")
        aggs += [F.count_if(there & (flag if k == "boolean" else _is_no(cell, k))).alias(f"{k}{i}") for k in kinds]
        aggs.append(F.count_if(there).alias(f"n{i}"))
    row = reduce(DataFrame.union, [part.agg(*aggs) for part in (raw, *more)]).groupBy().sum().toDF(*raw.agg(*aggs).columns).first()

    def kind(i: int) -> str:
        if not row[f"n{i}"]:
            return "double"
        if row[f"boolean{i}"] == row[f"n{i}"]:
            return "boolean"
        return next((k for k in kinds[:3] if not row[f"{k}{i}"]), "string")

    return T.StructType([T.StructField(n, T._parse_datatype_string(kind(i))) for i, n in enumerate(names)])


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None,
             sep: str = ",", header: bool = True, na_tokens: Iterable[str] = NA_TOKENS,
             strict_time: bool = True, check_header: bool = True,
             with_path: str | None = None, multi_line: bool = False) -> DataFrame:
    """S4 (comma) / S5 (any delimiter) + S6 (NA normalisation).

    Without a ``schema`` the types are inferred from all rows.  ``with_path`` adds
    the source file path as a column (for P1 tagging)."""
    schema = infer_schema(spark, paths, sep, na_tokens, multi_line) if schema is None else as_schema(schema)
    raw = read_text_table(spark, paths, schema.names, sep, header, check_header, multi_line)
    out = [_convert(col(f.name), f.dataType, list(na_tokens), strict_time).alias(f.name)
           for f in schema.fields]
    if with_path:
        out.append(F.col("_metadata.file_path").alias(with_path))
    return raw.select(*out)


def malformed_counts(spark: SparkSession, paths, schema: T.StructType | str, sep: str = ",",
                     header: bool = True, na_tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """Per numeric column, how many cells were neither NA tokens nor numbers
    (of the column's type; they become NULL in :func:`read_csv`).  One pass."""
    schema = as_schema(schema)
    raw = read_text_table(spark, paths, schema.names, sep, header)
    num = [f for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    if not num:
        return spark.createDataFrame([], "column_name string, malformed bigint")
    wide = raw.agg(*[F.count_if(malformed_number(col(f.name), list(na_tokens), f.dataType.simpleString())).alias(f"__m{i}")
                     for i, f in enumerate(num)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"__m{i}").alias("malformed"))
        for i, f in enumerate(num)])))


def read_csv_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None = None, sep: str = ",",
                   na_tokens: Iterable[str] = NA_TOKENS, strict_time: bool = True, multi_line: bool = False, with_path: str | None = None) -> DataFrame:
    """S4 + U1: sources whose columns differ or come in another order, as one table.

    A source is a path (file, folder or glob) whose files share a header.  Sources are
    grouped by their list of columns; each group is one scan, and the groups' union
    has every column, in the order in which the sources first show them, NULL where a
    source lacks it.  Types are declared by ``schema`` (of all columns that any
    source has; one that none has is NULL) or inferred from the rows of all groups together, so that a column
    is one type everywhere.  ``with_path`` adds the decoded source path."""
    groups: dict[tuple, list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(header_of(spark, path, sep, multi_line)), []).append(path)
    names = list(dict.fromkeys(n for g in groups for n in g))
    if schema is not None:
        schema = as_schema(schema)
        if unknown := [n for n in names if n not in schema.names]:
            raise ValueError(f"columns that the schema does not declare: {unknown}")
        names = schema.names
    parts = []
    for own, members in groups.items():
        part = read_text_table(spark, members, own, sep, multi_line=multi_line)
        found = [col(n) if n in own else F.lit(None).cast("string").alias(n) for n in names]
        parts.append(part.select(*found, *([source_path().alias(with_path)] if with_path else [])))
    raw = reduce(DataFrame.union, parts)
    if schema is None:
        cells, *more = [part.select(*[col(n) for n in names]) for part in parts]
        schema = infer_types(cells, na_tokens, *more)
    out = [_convert(col(f.name), f.dataType, list(na_tokens), strict_time).alias(f.name) for f in schema.fields]
    return raw.select(*out, *([col(with_path)] if with_path else []))


def source_path():
    """The path of a row's file, decoded (Spark's are percent-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
