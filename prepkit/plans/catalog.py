"""Registered queries over the driver tables and their SQL oracles.

Each query runs the library operator over WHOLE tables (no id subsets, no row
caps; the only ``limit`` is the head/glimpse operator itself).  Computed
doubles whose last bits depend on summation order are rounded identically on
both sides: bounded values (correlations, z-scores, centred values) to a
fixed number of decimals, unbounded ones (means, covariances, quantiles) to 9
significant digits with :func:`sig_round`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col, normalize_nan, parse_inferred, round_half_even, round_half_up, sig_round, sig_round_sql
from ..operators import features as feat
from ..operators import profile as prof
from ..operators import projection as proj
from ..operators import setops, stats
from ..operators.impute import ChainedImputer
from ..operators.quantiles import quantiles_with_moments
from . import workflows
from ..session import scratch_path
from ..sinks.files import write_bucketed, write_csv, write_csv_indexed, write_sources, write_stage, written_sources
from ..sources.batch import read_keyed_csv, read_keyed_sources, skipped_frame
from ..sources.csv import malformed_counts, read_csv
from .standins import MEASURES, READING_KEYS, readings, readings_sql, table, with_year

Query = Callable[[SparkSession, str], DataFrame]

READ_COLS = READING_KEYS + MEASURES
DUP_COLS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
               "event_type": "string", "value": "double", "props": "string"}
AIR_EDGES, AIR_LABELS = workflows.BIN_EDGES, workflows.BIN_LABELS

WITH_READINGS = f"WITH readings AS ({readings_sql()})"


def _round_sql(expr: str, k: int) -> str:
    """Half-away rounding to ``k`` decimals: scale, round, scale back."""
    f = f"CAST({float(10 ** k)!r} AS DOUBLE)"
    # + 0.0 turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    return f"(round(({expr}) * {f}) / {f} + CAST(0.0 AS DOUBLE))"


def _nullsum_sql(cols):
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)


# ------------------------------------------------------------------ W1


def q_quality_by_year(spark, d):
    r = with_year(readings(spark, d))
    return prof.rank_sources(prof.quality_by_source(r, "anio"))


SQL_QUALITY = f"""{WITH_READINGS}
SELECT CAST(year(l_shipdate) AS BIGINT) AS anio, COUNT(*) AS total_rows,
       CAST(SUM({_nullsum_sql(READ_COLS)}) AS BIGINT) AS null_cells
FROM readings GROUP BY 1 ORDER BY null_cells, anio"""


def q_best_year(spark, d):
    r = with_year(readings(spark, d))
    return prof.best_source(prof.quality_by_source(r, "anio"))


SQL_BEST = f"""SELECT anio, null_cells FROM ({SQL_QUALITY}) q ORDER BY null_cells, anio LIMIT 1"""


def _tagged_union(spark, d):
    """A part per station that the data has (station N lacks l_tax)."""
    r = readings(spark, d)
    parts = {}
    for (flag,) in r.select("l_returnflag").distinct().orderBy(F.asc_nulls_last("l_returnflag")).collect():
        part = r.where(F.col("l_returnflag").eqNullSafe(F.lit(flag)))
        parts[flag] = part.drop("l_tax") if flag == "N" else part
    # the part that lacks a column does not come first, so that the column order is the table's
    return setops.union_by_name(dict(sorted(parts.items(), key=lambda p: p[0] == "N")), tag_column="station")


SQL_UNION_BODY = """SELECT *, l_returnflag AS station FROM readings WHERE l_returnflag IS DISTINCT FROM 'N'
UNION ALL BY NAME SELECT * EXCLUDE (l_tax), l_returnflag AS station FROM readings WHERE l_returnflag = 'N'"""
SQL_UNION = f"{WITH_READINGS}\n{SQL_UNION_BODY}"
UNION_COLS = READ_COLS + ["station"]


def q_tagged_union(spark, d):
    return _tagged_union(spark, d)


# ------------------------------------------------------------------ W2


def q_null_profile(spark, d):
    return prof.null_profile(_tagged_union(spark, d))


def _null_profile_sql():
    sel = []
    for i, c in enumerate(UNION_COLS):
        sel.append(f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, "
                   f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
                   f"CAST(count(*) - count({c}) AS DOUBLE) * CAST(100.0 AS DOUBLE) / CAST(count(*) AS DOUBLE) AS null_pct FROM u")
    return f"{WITH_READINGS}, u AS ({SQL_UNION_BODY})\n" + "\nUNION ALL ".join(sel)


def q_null_pct_label(spark, d):
    return prof.null_pct_labels(prof.null_profile(_tagged_union(spark, d)))


SQL_NULL_LABEL = (f"SELECT ordinal, column_name, CAST(round_even(null_pct * CAST(100.0 AS DOUBLE), 0) / CAST(100.0 AS DOUBLE) AS VARCHAR) || ' %' "
                  f"AS null_pct_label FROM ({_null_profile_sql()}) p")


def q_shape(spark, d):
    return prof.shape(table(spark, d, "events"))


SQL_SHAPE = f"SELECT COUNT(*) AS n_rows, CAST({len(EVENT_COLS)} AS BIGINT) AS n_cols FROM events"


def q_schema_profile(spark, d):
    return prof.schema_profile(table(spark, d, "events"))


SQL_SCHEMA = "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, COUNT({c}) AS non_null_count, "
    f"'{EVENT_TYPES[c]}' AS dtype FROM events" for i, c in enumerate(EVENT_COLS))


def q_head5(spark, d):
    return prof.head(table(spark, d, "events"), 5, ["event_id"])


SQL_HEAD5 = "SELECT * FROM events ORDER BY event_id LIMIT 5"


def q_glimpse(spark, d):
    return prof.glimpse(table(spark, d, "events"), 5, ["event_id"])


SQL_GLIMPSE = ("WITH t AS (SELECT * FROM events ORDER BY event_id LIMIT 5), n AS (SELECT COUNT(*) AS n_rows FROM events)\n"
               + "\nUNION ALL ".join(
                   f"SELECT n_rows, CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, '{EVENT_TYPES[c]}' AS dtype, "
                   f"(SELECT string_agg(coalesce(CAST({c} AS VARCHAR), 'NULL'), ', ' ORDER BY event_id) FROM t) AS first_values FROM n"
                   for i, c in enumerate(EVENT_COLS)))


def _repeated(spark, d):
    """Whole readings, with every row of station R there twice (a logger's repeated export)."""
    r = readings(spark, d)
    return r.union(r.where("l_returnflag = 'R'"))


WITH_REPEATED = f"{WITH_READINGS}, repeated AS (SELECT * FROM readings UNION ALL SELECT * FROM readings WHERE l_returnflag = 'R')"


def q_dup_count_rows(spark, d):
    return prof.duplicate_count(_repeated(spark, d))


SQL_DUP_ROWS = (f"{WITH_REPEATED}\nSELECT CAST(SUM(k) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct, "
                f"CAST(SUM(k - 1) AS BIGINT) AS n_duplicates FROM (SELECT COUNT(*) AS k FROM repeated "
                f"GROUP BY {', '.join(READ_COLS)}) g")


def q_dedupe_rows(spark, d):
    return setops.distinct_rows(_repeated(spark, d))


SQL_DEDUPE_ROWS = f"{WITH_REPEATED}\nSELECT DISTINCT * FROM repeated"


def q_understand(spark, d):
    """W2 as composed, over a table with repeated rows: shape, types, null labels and duplicates in one tidy table."""
    u = workflows.understand(_repeated(spark, d))
    dup = u["duplicates"].select("n_distinct", "n_duplicates")
    return (u["schema"].join(u["null_pct"], ["ordinal", "column_name"])
            .select("*", *[u["shape"].select(c).scalar().alias(c) for c in ("n_rows", "n_cols")], *[dup.select(c).scalar().alias(c) for c in dup.columns]))


def _understand_sql():
    types = {"l_orderkey": "bigint", "l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
    sel = "\nUNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, count({c}) AS non_null_count, '{types.get(c, 'double')}' AS dtype, "
        f"CAST(round_even((count(*) - count({c})) * CAST(100.0 AS DOUBLE) / count(*) * CAST(100.0 AS DOUBLE), 0) / CAST(100.0 AS DOUBLE) AS VARCHAR) || ' %' "
        f"AS null_pct_label, count(*) AS n_rows, CAST({len(READ_COLS)} AS BIGINT) AS n_cols FROM repeated" for i, c in enumerate(READ_COLS))
    return f"{WITH_REPEATED}, d AS (SELECT count(*) AS n_distinct FROM (SELECT DISTINCT * FROM repeated) r)\nSELECT p.*, n_distinct, n_rows - n_distinct AS n_duplicates FROM ({sel}) p, d"


def q_dup_count(spark, d):
    return prof.duplicate_count(readings(spark, d).select(*DUP_COLS))


SQL_DUP = (f"{WITH_READINGS}\nSELECT CAST(SUM(k) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct, "
           f"CAST(SUM(k - 1) AS BIGINT) AS n_duplicates FROM (SELECT COUNT(*) AS k FROM readings "
           f"GROUP BY {', '.join(DUP_COLS)}) g")


def q_dedupe(spark, d):
    return setops.distinct_rows(readings(spark, d).select(*DUP_COLS))


SQL_DEDUPE = f"{WITH_READINGS}\nSELECT DISTINCT {', '.join(DUP_COLS)} FROM readings"


# ------------------------------------------------------------------ W3 pieces


def q_time_features(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts")
    out = proj.add_time_features(ev, "ts", "mes", "hora")
    return out.select("event_id", "ts", F.col("mes").cast("bigint").alias("mes"),
                      F.col("hora").cast("bigint").alias("hora"))


SQL_TIME = ("SELECT event_id, ts, CAST(month(ts) AS BIGINT) AS mes, CAST(hour(ts) AS BIGINT) AS hora "
            "FROM events")


def q_time_features_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    out = proj.add_time_features(o, "o_orderdate", "mes", "hora")
    return out.select("o_orderkey", "o_orderdate", F.col("mes").cast("bigint").alias("mes"),
                      F.col("hora").cast("bigint").alias("hora"))


SQL_TIME_ORDERS = ("SELECT o_orderkey, o_orderdate, CAST(month(o_orderdate) AS BIGINT) AS mes, "
                   "CAST(hour(o_orderdate) AS BIGINT) AS hora FROM orders")


def q_project_drop(spark, d):
    o = table(spark, d, "orders")
    o = proj.drop_checked(o, ["o_custkey"])          # P2
    o = proj.select_by_position(o, 1)                # P4: all but the first column
    return proj.move_to_front(o, ["o_orderdate"])    # P5


SQL_PROJECT = "SELECT o_orderdate, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def q_one_hot(spark, d):
    ev = table(spark, d, "events")
    return feat.OneHot("event_type").fit(ev).transform(ev)


# The oracle hard-codes the sorted categories of events.event_type; the
# Spark side fits them from the data.
_ONE_HOT_CATS = ["error", "purchase", "signup", "view"]
SQL_ONE_HOT = ("SELECT event_id, ts, user_id, value, props, "
               + ", ".join(f"coalesce(event_type = '{v}', false) AS event_type_{v}" for v in _ONE_HOT_CATS)
               + " FROM events")


def q_split_train_test(spark, d):
    ev = table(spark, d, "events").select("event_id")
    return feat.assign_split(ev, ["event_id"], 0.2, 42)


SQL_SPLIT = ("SELECT event_id, CASE WHEN CAST(('0x' || substr(md5('42:' || CAST(event_id AS VARCHAR)), 1, 8)) "
             "AS BIGINT) / CAST(4294967296.0 AS DOUBLE) < CAST(0.2 AS DOUBLE) THEN 'test' ELSE 'train' END AS split "
             "FROM events")


def q_split_exact(spark, d):
    ev = table(spark, d, "events").select("event_id")
    return feat.assign_split(ev, ["event_id"], 0.2, 42, exact=True)


_HEX = "md5('42:' || CAST(event_id AS VARCHAR))"
SQL_SPLIT_EXACT = (f"WITH h AS (SELECT event_id, CAST(('0x' || substr({_HEX}, 1, 8)) AS BIGINT) AS h1, "
                   f"CAST(('0x' || substr({_HEX}, 9, 8)) AS BIGINT) AS h2 FROM events), "
                   "r AS (SELECT event_id, row_number() OVER (ORDER BY h1, h2) AS rn FROM h), "
                   "n AS (SELECT count(*) AS n FROM events) "
                   "SELECT event_id, CASE WHEN rn <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split "
                   "FROM r, n")


# ------------------------------------------------------------------ W4 / W8


def _round_stats(df, cols):
    return df.select(*[sig_round(col(c)).alias(c) if c in cols else col(c) for c in df.columns])


def q_central_measures(spark, d):
    r = readings(spark, d)
    cols = ["l_orderkey", "l_linenumber"] + MEASURES
    return _round_stats(stats.central_measures(r, cols), ["mean", "median"])


def _central_sql(source: str, cols, stage: str | None = None):
    sel = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        st = f"'{stage}' AS stage, " if stage else ""
        sel.append(f"SELECT {st}CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, "
                   f"{sig_round_sql(f'avg({x})')} AS mean, {sig_round_sql(f'quantile_cont({x}, 0.5)')} AS median, "
                   f"max({x}) AS max, min({x}) AS min, (max({x}) - min({x})) / 2 AS half_range FROM {source}")
    return "\nUNION ALL ".join(sel)


SQL_CENTRAL = f"{WITH_READINGS}\n" + _central_sql("readings", ["l_orderkey", "l_linenumber"] + MEASURES)


def q_before_after(spark, d):
    stages = {"original": table(spark, d, "lineitem").select(*MEASURES),
              "gapped": readings(spark, d).select(*MEASURES)}
    return _round_stats(stats.compare_stages(stages, MEASURES), ["mean", "median"])


SQL_BEFORE_AFTER = (f"{WITH_READINGS}\n" + _central_sql("lineitem", MEASURES, "original")
                    + "\nUNION ALL " + _central_sql("readings", MEASURES, "gapped"))


def q_iqr_fences(spark, d):
    r = readings(spark, d)
    f = feat.IQRClipper(MEASURES).fit(r).fences_frame(spark)
    return _round_stats(f, ["q1", "q3", "iqr", "lower_fence", "upper_fence"])


def _fences_sql():
    sel = []
    for i, c in enumerate(MEASURES):
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        k = "CAST(1.5 AS DOUBLE)"
        sel.append(f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, {sig_round_sql(q1)} AS q1, "
                   f"{sig_round_sql(q3)} AS q3, {sig_round_sql(f'{q3} - {q1}')} AS iqr, "
                   f"{sig_round_sql(f'{q1} - {k} * ({q3} - {q1})')} AS lower_fence, "
                   f"{sig_round_sql(f'{q3} + {k} * ({q3} - {q1})')} AS upper_fence FROM readings")
    return f"{WITH_READINGS}\n" + "\nUNION ALL ".join(sel)


SQL_FENCES = _fences_sql()


def q_iqr_clip(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    clipper = feat.IQRClipper(["value"]).fit(ev)
    out = clipper.transform(ev)
    return out.select("event_id", sig_round(F.col("value")).alias("value"))


SQL_CLIP = ("WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), "
            "g AS (SELECT q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS hi FROM f), "
            "c AS (SELECT event_id, CASE WHEN value > hi THEN hi ELSE value END AS v, lo FROM events, g) "
            f"SELECT event_id, {sig_round_sql('CASE WHEN v < lo THEN lo ELSE v END')} AS value FROM c")


def q_bin_right_closed(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    return ev.withColumn("calidad_aire", feat.bin_right_closed(F.col("value"), AIR_EDGES, AIR_LABELS))


SQL_BIN = ("SELECT event_id, value, CASE WHEN value > 0 AND value <= 50 THEN 'Buena' "
           "WHEN value > 50 AND value <= 100 THEN 'Regular' WHEN value > 100 THEN 'Mala' END AS calidad_aire "
           "FROM events")


def q_standardise(spark, d):
    r = readings(spark, d)
    z = feat.Standardizer(MEASURES).fit(r).transform(r)
    # z-scores inherit last-ulp differences of mean/std between engines:
    # presented at 6 decimals on both sides.
    return z.select(*READING_KEYS, *[round_half_up(col(c), 6).alias(c) for c in MEASURES])


SQL_STANDARDISE = (f"{WITH_READINGS}, m AS (SELECT "
                   + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)
                   + " FROM readings)\nSELECT " + ", ".join(READING_KEYS) + ", "
                   + ", ".join(f"{_round_sql(f'({c} - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END)', 6)} AS {c}"
                               for c in MEASURES)
                   + " FROM readings, m")


def q_constant_columns(spark, d):
    ev = proj.add_time_features(table(spark, d, "events"), "ts", "mes", "hora")
    return prof.constant_columns(ev)


_CONST_COLS = EVENT_COLS + ["mes", "hora"]
SQL_CONSTANT = ("WITH e AS (SELECT *, month(ts) AS mes, hour(ts) AS hora FROM events)\n" + "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, COUNT({c}) AS non_null_count, "
    f"coalesce(min({c}) = max({c}), true) AS is_constant FROM e" for i, c in enumerate(_CONST_COLS)))


# ------------------------------------------------------------------ W5 / W7


def q_cov_matrix(spark, d):
    li = table(spark, d, "lineitem")
    return _round_stats(stats.cov_matrix(li, MEASURES), ["value"])


# The reference correlates 13 columns; so many are derived from the readings here.
WIDE = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "t": "l_tax", "qp": "l_quantity * l_extendedprice",
        "qd": "l_quantity * l_discount", "qt": "l_quantity * l_tax", "pd": "l_extendedprice * l_discount",
        "pt": "l_extendedprice * l_tax", "dt": "l_discount * l_tax", "qq": "l_quantity * l_quantity",
        "dd": "l_discount * l_discount", "tt": "l_tax * l_tax"}


def q_cov_matrix_13(spark, d):
    li = table(spark, d, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in WIDE.items()])
    return stats.cov_matrix(li, list(WIDE)).select("col_i", "col_j", sig_round(F.col("value"), 6).alias("value"))


def q_corr_matrix_13(spark, d):
    r = readings(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in WIDE.items()])
    return stats.corr_matrix(r, list(WIDE)).select("col_i", "col_j", round_half_up(F.col("value"), 9).alias("value"))


def _wide_sql(source):
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in WIDE.items()) + f" FROM {source}"


def _pairs_sql(source, cell, cols=MEASURES):
    sel = []
    for a in cols:
        for b in cols:
            sel.append(f"SELECT '{a}' AS col_i, '{b}' AS col_j, {cell(a, b)} AS value FROM {source}")
    return "\nUNION ALL ".join(sel)


SQL_COV = _pairs_sql("lineitem", lambda a, b: sig_round_sql(
    f"CASE WHEN count(*) = count({a}) AND count(*) = count({b}) THEN covar_pop({a}, {b}) END"))


def _corr_cell(a, b):
    if a == b:
        return f"CASE WHEN var_pop({a}) > 0 THEN CAST(1.0 AS DOUBLE) END"
    return (f"covar_pop({a}, {b}) / NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
            f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0)")


SQL_COV_13 = f"WITH w AS ({_wide_sql('lineitem')})\n" + _pairs_sql("w", lambda a, b: sig_round_sql(
    f"CASE WHEN count(*) = count({a}) AND count(*) = count({b}) THEN covar_pop({a}, {b}) END", 6), list(WIDE))


def q_corr_matrix(spark, d):
    c = stats.corr_matrix(readings(spark, d), MEASURES)
    return c.select("col_i", "col_j", round_half_up(F.col("value"), 9).alias("value"))


SQL_CORR = f"{WITH_READINGS}\n" + _pairs_sql("readings", lambda a, b: _round_sql(_corr_cell(a, b), 9))


SQL_CORR_13 = (f"{WITH_READINGS}, w AS ({_wide_sql('readings')})\n"
               + _pairs_sql("w", lambda a, b: _round_sql(_corr_cell(a, b), 9), list(WIDE)))


def q_corr_labels(spark, d):
    c = stats.corr_labels(stats.corr_matrix(readings(spark, d), MEASURES))
    return c.select("col_i", "col_j", round_half_up(F.col("value"), 9).alias("value"), "label")


SQL_CORR_LABELS = f"{WITH_READINGS}\n" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS col_i, '{b}' AS col_j, {_round_sql(_corr_cell(a, b), 9)} AS value, "
    f"printf('%.2f', {_corr_cell(a, b)}) AS label FROM readings" for a in MEASURES for b in MEASURES)


def q_center(spark, d):
    r = readings(spark, d)
    c = stats.center(r, MEASURES, keep=READING_KEYS)
    return c.select(*READING_KEYS, *[round_half_up(col(m), 6).alias(m) for m in MEASURES])


SQL_CENTER = (f"{WITH_READINGS}, m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in MEASURES)
              + " FROM readings)\nSELECT " + ", ".join(READING_KEYS) + ", "
              + ", ".join(f"{_round_sql(f'{c} - m_{c}', 6)} AS {c}" for c in MEASURES) + " FROM readings, m")


def q_round_even(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.bround(F.col("l_quantity") / 4.0, 0).alias("quarter_qty"),
                     F.bround(F.col("l_extendedprice") / 100.0, 0).alias("price_hundreds"),
                     F.bround(F.col("l_extendedprice") * (1 - F.col("l_discount")), 0).alias("net_price"),
                     round_half_even(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 2)
                     .alias("charge"))


SQL_ROUND_EVEN = ("SELECT l_orderkey, l_linenumber, round_even(l_quantity / CAST(4.0 AS DOUBLE), 0) AS quarter_qty, "
                  "round_even(l_extendedprice / CAST(100.0 AS DOUBLE), 0) AS price_hundreds, "
                  "round_even(l_extendedprice * (1 - l_discount), 0) AS net_price, "
                  "round_even(l_extendedprice * (1 - l_discount) * (1 + l_tax) * CAST(100.0 AS DOUBLE), 0) / CAST(100.0 AS DOUBLE) AS charge FROM lineitem")


# ------------------------------------------------------------------ sources / sinks


def q_csv_roundtrip(spark, d):
    """K2 → S5/S6 → P4: orders written with ';' and a leading row key, read
    back with the declared schema, the key dropped by position."""
    o = table(spark, d, "orders")
    path = scratch_path(spark, "orders-csv")
    write_csv_indexed(o.withColumn("row_id", F.col("o_orderkey")), path, index="row_id", sep=";")
    ddl = "row_id bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in o.schema.fields)
    back = read_csv(spark, path, ddl, sep=";")
    return proj.select_by_position(back, 1)


SQL_CSV = "SELECT * FROM orders"


def _yearly(spark, d):
    """K1 per year → S2/S3: one directory per year, read back over the data's
    years and two more on either side; absent years are skipped and reported, the
    year comes from the path."""
    _, years, ddl, root = _consolidation(spark, d)
    return read_keyed_sources(spark, root + "/anio={year}", years, lambda paths: read_csv(spark, paths, ddl), key="anio")


def q_yearly_sources(spark, d):
    return _yearly(spark, d)[0]


def q_skipped_sources(spark, d):
    return skipped_frame(spark, _yearly(spark, d)[1])


SQL_SKIPPED = """WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS anio FROM lineitem)
SELECT g AS anio FROM (SELECT unnest(generate_series((SELECT min(anio) - 2 FROM y), (SELECT max(anio) + 2 FROM y))) AS g)
WHERE g NOT IN (SELECT anio FROM y)"""


def q_consolidated(spark, d):
    """W1 as composed: the quality summary with each year's written folder (below the root)."""
    _, years, ddl, root = _consolidation(spark, d)
    out = scratch_path(spark, "unified")
    done = workflows.consolidate_sources(spark, root + "/anio={year}", years, lambda paths: read_csv(spark, paths, ddl), output_root=out)
    return done.quality.withColumn("output_path", F.replace("output_path", F.lit(out), F.lit("")))


def _consolidation(spark, d):
    r = with_year(readings(spark, d))
    root = scratch_path(spark, "yearly") + "/BD por anio"       # a name with spaces, as the reference has
    write_csv(r, root, partition_by=["anio"])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in r.drop("anio").schema.fields)
    first, last = r.agg(F.min("anio"), F.max("anio")).first()
    return r, range(first - 2, last + 3), ddl, root


SQL_CONSOLIDATED = f"SELECT anio, total_rows, null_cells, '/anio=' || anio AS output_path FROM ({SQL_QUALITY}) q"


def q_yearly_headers(spark, d):
    """S2 + U1: yearly CSVs whose columns differ — a year that lacks a column, and years with the columns
    in another order — read as one table, the types inferred over all of them."""
    r = with_year(readings(spark, d))
    root = scratch_path(spark, "headers")
    years = [y for (y,) in r.select("anio").distinct().orderBy("anio").collect()]
    for kind, part in {0: r.drop("l_tax"), 1: r.select(*reversed(r.columns)), 2: r}.items():
        write_sources(part.where(F.pmod("anio", F.lit(3)) == kind), root, keys=[y for y in years if y % 3 == kind])
    out, _ = read_keyed_csv(spark, root + "/anio={year}", years)
    return out.select("anio", *READ_COLS)


SQL_YEARLY_HEADERS = (f"{WITH_READINGS}\nSELECT CAST(year(l_shipdate) AS BIGINT) AS anio, {', '.join(c for c in READ_COLS if c != 'l_tax')}, "
                      "CASE WHEN year(l_shipdate) % 3 <> 0 THEN l_tax END AS l_tax FROM readings")


def _rewritten(spark, d) -> tuple[str, list]:
    """All years written, then one of them again, with other values."""
    r = with_year(readings(spark, d))
    root = scratch_path(spark, "sources")
    write_sources(r, root)
    years = [y for (y,) in written_sources(spark, root).select("anio").orderBy("anio").collect()]
    again = r.where(F.col("anio") == years[0]).where("l_returnflag <> 'A'").withColumn("l_quantity", F.col("l_quantity") + 1)
    write_sources(again, root, keys=years[:1])
    return root, years


def q_replaced_source(spark, d):
    """K1: a re-run replaces its own year alone; the others' output stays."""
    root, years = _rewritten(spark, d)
    return read_keyed_csv(spark, root + "/anio={year}", years)[0].select("anio", *READ_COLS)


def q_written_sources(spark, d):
    """The manifest after that re-run."""
    root, _ = _rewritten(spark, d)
    return written_sources(spark, root).select(F.col("anio").cast("bigint").alias("anio"), "n_rows")


_REWRITTEN = f"""{WITH_READINGS}, tagged AS (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS anio FROM readings),
kept AS (SELECT * REPLACE (CASE WHEN anio = first THEN l_quantity + 1 ELSE l_quantity END AS l_quantity)
         FROM tagged, (SELECT min(anio) AS first FROM tagged) f WHERE anio <> first OR l_returnflag <> 'A')"""
SQL_REPLACED = f"{_REWRITTEN}\nSELECT anio, {', '.join(READ_COLS)} FROM kept"
SQL_WRITTEN = f"{_REWRITTEN}\nSELECT anio, count(*) AS n_rows FROM kept GROUP BY anio"

# layouts of one timestamp: Spark's pattern and the strptime one
TIME_LAYOUTS = {"iso": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), "day_first": ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
                "month_first": ("M/d/yyyy h:mm a", "%-m/%-d/%Y %-I:%M %p")}


def q_time_layouts(spark, d):
    """Text timestamps in three layouts, each found from all rows of its column; NA tokens are missing."""
    ev = table(spark, d, "events").select("event_id", *[
        F.when(F.col("event_id") % 97 == 5, F.lit("N/A")).otherwise(F.date_format("ts", spark_format)).alias(c) for c, (spark_format, _) in TIME_LAYOUTS.items()])
    return parse_inferred(ev, list(TIME_LAYOUTS))


SQL_TIME_LAYOUTS = ("SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 97 <> 5 THEN strptime(strftime(ts, '{f}'), '{f}') END AS {c}"
                                                    for c, (_, f) in TIME_LAYOUTS.items()) + " FROM events")


def q_csv_text_roundtrip(spark, d):
    """K1 → S4 with cells that need care: outer white space, quotes, separators,
    newlines, and a type for each column inferred from all rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", *[F.expr(e).alias(c) for c, e in CSV_TEXTS.items()])
    path = scratch_path(spark, "texts-csv")
    write_csv(o, path)
    return read_csv(spark, path, multi_line=True)


CSV_TEXTS = {"padded": "concat(' ', o_orderpriority, '  ')", "quoted": "concat('say ', chr(34), o_orderstatus, chr(34))",
             "split": "concat(o_orderstatus, ',', chr(10), o_orderpriority)"}
SQL_CSV_TEXTS = "SELECT o_orderkey, o_totalprice, " + ", ".join(f"{e} AS {c}" for c, e in CSV_TEXTS.items()) + " FROM orders"


def q_malformed(spark, d):
    """Cells that are no number of their column's type, counted per column."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("whole"), F.col("o_orderstatus").alias("status"))
    path = scratch_path(spark, "malformed-csv")
    write_csv(o, path)
    return malformed_counts(spark, path, "o_orderkey bigint, whole bigint, status double")


SQL_MALFORMED = """SELECT 'o_orderkey' AS column_name, CAST(0 AS BIGINT) AS malformed FROM orders HAVING count(*) >= 0
UNION ALL SELECT 'whole', count(o_totalprice) FROM orders
UNION ALL SELECT 'status', count(o_orderstatus) FROM orders"""


SQL_YEARLY = f"{WITH_READINGS}\nSELECT *, CAST(year(l_shipdate) AS BIGINT) AS anio FROM readings"


# ------------------------------------------------------------------ W3 / W4 / W6–W8

PREP_KEEP = ["l_orderkey", "l_linenumber", "l_linestatus"]
BAND_EDGES = [0.0, 10.0, 25.0, float("inf")]
BAND_LABELS = ["low", "mid", "high"]


def q_impute_fit_transform(spark, d):
    """Dedupe → time features → one-hot station → chained imputation
    fitted and applied on the same rows (F2).  Rows-only check (no SQL)."""
    out, _imp = workflows.prepare_and_impute(readings(spark, d), time_col="l_shipdate",
                                             station_col="l_returnflag", drop=[], keep=PREP_KEEP)
    return out


def _holdout_input(spark, d, measures=MEASURES):
    """Readings under a key that identifies each row: READING_KEYS and, of rows
    that share them, a number."""
    same = Window.partitionBy(*READING_KEYS).orderBy(*[F.asc_nulls_last(m) for m in MEASURES])
    r = readings(spark, d).withColumn("copy", F.row_number().over(same))
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in READING_KEYS], F.col("copy").cast("string"))
    return r.select(key.alias("row_id"), *measures)


SQL_KEYED = (f"SELECT *, concat_ws(':', {', '.join(READING_KEYS)}, row_number() OVER (PARTITION BY {', '.join(READING_KEYS)} "
             f"ORDER BY {', '.join(f'{m} NULLS LAST' for m in MEASURES)})) AS row_id FROM readings")

# One gapped column and a complete one: the Bayesian ridge is scalar, so its evidence
# iteration is a recursion over six sums, and later rounds change nothing.
ONE_GAP = ["l_extendedprice", "l_quantity"]


def _one_gap_sql(fit: str, apply: str, rows: str) -> str:
    """CTEs ending in ``fitted``: ``rows`` of ``apply`` with l_quantity filled from the fit on ``fit``."""
    return f"""obs AS (SELECT l_extendedprice AS x, l_quantity AS y FROM {fit} WHERE l_quantity IS NOT NULL),
mean AS (SELECT avg(x) AS mx, avg(y) AS my, CAST(count(*) AS DOUBLE) AS n FROM obs),
mom AS (SELECT n, mx, my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy
        FROM obs, mean GROUP BY n, mx, my),
ridge(it, a, l, w, done) AS (
  SELECT 0, 1 / (syy / n + 2.220446049250313e-16), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), false FROM mom
  UNION ALL
  SELECT it + 1, (n - g + 2e-6) / (greatest(syy - 2 * c * sxy + c * c * sxx, 0) + 2e-6), (g + 2e-6) / (c * c + 2e-6), c,
         it <> 0 AND abs(w - c) < 1e-3
  FROM (SELECT it, w, n, sxx, sxy, syy, sxy / (sxx + l / a) AS c, a * sxx / (l + a * sxx) AS g FROM ridge, mom
        WHERE NOT done AND it < 300) s),
coef AS (SELECT sxy / (sxx + l / a) AS b FROM ridge, mom ORDER BY it DESC LIMIT 1),
fitted AS (SELECT {rows}, l_extendedprice, coalesce(l_quantity, my + b * (l_extendedprice - mx)) AS l_quantity FROM {apply}, mom, coef)"""


def q_impute_one_gap(spark, d):
    """F2, one gapped column: fitted and applied on the same rows."""
    r = readings(spark, d).select(*READING_KEYS, *ONE_GAP)
    out = ChainedImputer(ONE_GAP).fit_transform(r)
    return out.select(*READING_KEYS, "l_extendedprice", round_half_up(F.col("l_quantity"), 6).alias("l_quantity"))


SQL_ONE_GAP = (f"WITH RECURSIVE readings AS ({readings_sql()}), " + _one_gap_sql("readings", "readings", ", ".join(READING_KEYS))
               + f"\nSELECT {', '.join(READING_KEYS)}, l_extendedprice, {_round_sql('l_quantity', 6)} AS l_quantity FROM fitted")


def q_impute_one_gap_holdout(spark, d):
    """W6 with F3 and F4: fitted on the hash split's train part, applied on its test part, rounded."""
    return workflows.impute_holdout(_holdout_input(spark, d, ONE_GAP), keys=["row_id"], drop=[])[0]


_SPLIT = "CAST(('0x' || substr(md5('42:' || row_id), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) < CAST(0.2 AS DOUBLE)"
_HOLDOUT_SQL = (f"WITH RECURSIVE readings AS ({readings_sql()}), keyed AS ({SQL_KEYED}), train AS (SELECT * FROM keyed WHERE NOT {_SPLIT}), "
                f"test AS (SELECT * FROM keyed WHERE {_SPLIT}), " + _one_gap_sql("train", "test", "row_id")
                + ", held AS (SELECT row_id, round_even(l_extendedprice, 0) AS l_extendedprice, round_even(l_quantity, 0) AS l_quantity FROM fitted)")
SQL_ONE_GAP_HOLDOUT = f"{_HOLDOUT_SQL}\nSELECT * FROM held"


def q_post_one_gap_cov(spark, d):
    """W7 on W6's output: the leading key dropped by position, then the covariance table."""
    out = workflows.post_imputation_stats(q_impute_one_gap_holdout(spark, d))["cov"]
    return _round_stats(out, ["value"])


# Two gapped columns beside a complete one, in units of like size.  Rows of one pattern
# have one affine state, so a round needs the sums of three patterns only (both there; either missing); its two
# Bayesian ridges run as one recursion, a step per evidence iteration, with the 2x2 eigenvalues written out.
TWO_GAPS = ["price", "quantity", "tax"]


def _two_gap_rows(df: DataFrame) -> DataFrame:
    """The readings in thousands (price) and percent (tax)."""
    new = {"price": F.col("l_extendedprice") / 1000, "quantity": F.col("l_quantity"), "tax": F.col("l_tax") * 100}
    return df.select(*[c for c in df.columns if c not in MEASURES], *[v.alias(k) for k, v in new.items()])


def _two_gap_sql(fit: str, apply: str, rows: str) -> str:
    """CTEs ending in ``fitted``: ``rows`` of ``apply`` and price x, quantity y, tax z, with y and z
    filled from the fit on ``fit``.  ``y = d0 + dx x + dz z`` and ``z = c0 + cx x + cy y``, all about the means."""
    sums = {"n": "1", "x": "x", "y": "y", "z": "z", "xx": "x * x", "xy": "x * y", "xz": "x * z", "yy": "y * y", "yz": "y * z", "zz": "z * z"}
    where = {"a": "y IS NOT NULL AND z IS NOT NULL", "b": "y IS NOT NULL AND z IS NULL", "c": "y IS NULL AND z IS NOT NULL"}
    moments = ", ".join(f"coalesce(CAST(sum({e}) FILTER ({w}) AS DOUBLE), 0) AS {g}_{k}" for g, w in where.items() for k, e in sums.items())

    def regress(s: int) -> str:
        """The next regression's raw sums: predictors x and q (the other gapped column, filled by w where missing), target r."""
        q, r, g, w = ("z", "y", "b", ("c0", "cx", "cy")) if s == 1 else ("y", "z", "c", ("d0", "dx", "dz"))
        w0, w1, w2 = w
        return (f"SELECT t, {s} AS s, c0, cx, cy, d0, dx, dz, a_n + {g}_n AS n, a_x + {g}_x AS s1, a_{q} + {w0} * {g}_n + {w1} * {g}_x + {w2} * {g}_{r} AS s2, "
                f"a_{r} + {g}_{r} AS sr, a_xx + {g}_xx AS s11, a_x{q} + {w0} * {g}_x + {w1} * {g}_xx + {w2} * {g}_x{r} AS s12, "
                f"a_{q}{q} + {w0} * {w0} * {g}_n + {w1} * {w1} * {g}_xx + {w2} * {w2} * {g}_{r}{r} + 2 * {w0} * {w1} * {g}_x + 2 * {w0} * {w2} * {g}_{r} "
                f"+ 2 * {w1} * {w2} * {g}_x{r} AS s22, a_x{r} + {g}_x{r} AS s1r, a_yz + {w0} * {g}_{r} + {w1} * {g}_x{r} + {w2} * {g}_{r}{r} AS s2r, "
                f"a_{r}{r} + {g}_{r}{r} AS srr")

    def start(source: str) -> str:
        """Centre the sums and begin the evidence iteration."""
        centred = ("n, s1 / n AS m1, s2 / n AS m2, sr / n AS mr, s11 - s1 * s1 / n AS v11, s12 - s1 * s2 / n AS v12, s22 - s2 * s2 / n AS v22, "
                   "s1r - s1 * sr / n AS u1, s2r - s2 * sr / n AS u2, srr - sr * sr / n AS vr")
        return (f"SELECT t, s, 0 AS it, 1 / (vr / n + 2.220446049250313e-16) AS a, CAST(1 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS o1, CAST(0 AS DOUBLE) AS o2, "
                f"false AS done, c0, cx, cy, d0, dx, dz, n, m1, m2, mr, v11, v12, v22, u1, u2, vr "
                f"FROM (SELECT t, s, c0, cx, cy, d0, dx, dz, {centred} FROM ({source}) raw) about")

    # the weights at the precisions a and l; the eigenvalues of the predictors' moments, the smaller one without cancellation
    solve = ("SELECT *, ((v22 + k) * u1 - v12 * u2) / det AS b1, ((v11 + k) * u2 - v12 * u1) / det AS b2, big, "
             "greatest(CASE WHEN big > 0 THEN (v11 * v22 - v12 * v12) / big ELSE 0 END, 0) AS small "
             "FROM (SELECT *, (v11 + k) * (v22 + k) - v12 * v12 AS det, (v11 + v22 + sqrt((v11 - v22) * (v11 - v22) + 4 * v12 * v12)) / 2 AS big "
             "FROM (SELECT *, l / a AS k FROM step) ratio) roots")
    iterate = ("SELECT t, s, it + 1, (n - g + 2e-6) / (greatest(vr - 2 * (b1 * u1 + b2 * u2) + b1 * b1 * v11 + 2 * b1 * b2 * v12 + b2 * b2 * v22, 0) + 2e-6), "
               "(g + 2e-6) / (b1 * b1 + b2 * b2 + 2e-6), b1, b2, it >= 299 OR (it <> 0 AND abs(o1 - b1) + abs(o2 - b2) < 1e-3), c0, cx, cy, d0, dx, dz, "
               "n, m1, m2, mr, v11, v12, v22, u1, u2, vr "
               "FROM (SELECT *, a * big / (l + a * big) + a * small / (l + a * small) AS g FROM solved WHERE NOT done) gains")
    finish = ("SELECT CASE WHEN s = 2 THEN t + 1 ELSE t END AS t, 3 - s AS s, "
              + ", ".join(f"CASE WHEN s = {s} THEN {new} ELSE {old} END AS {old}" for s, names in ((2, ("c0", "cx", "cy")), (1, ("d0", "dx", "dz")))
                          for old, new in zip(names, ("mr - m1 * b1 - m2 * b2", "b1", "b2"))) + " FROM solved WHERE done")
    following = " UNION ALL ".join(start(f"{regress(s)} FROM done_{s}, mom") for s in (1, 2))
    return f"""mean AS (SELECT avg(price) AS mx, avg(quantity) AS my, avg(tax) AS mz, 1e-3 * greatest(max(abs(price)), max(abs(quantity)), max(abs(tax))) AS thr FROM {fit}),
about AS (SELECT price - mx AS x, quantity - my AS y, tax - mz AS z FROM {fit}, mean),
mom AS (SELECT {moments} FROM about),
step AS (
  {start(f"{regress(1)} FROM (SELECT 1 AS t, " + ", ".join(f"CAST(0 AS DOUBLE) AS {w}" for w in ("c0", "cx", "cy", "d0", "dx", "dz")) + ") zero, mom")}
  UNION ALL
  (WITH solved AS ({solve}), done_any AS ({finish}), done_1 AS (SELECT * FROM done_any WHERE s = 1 AND t <= 10), done_2 AS (SELECT * FROM done_any WHERE s = 2),
   last AS (SELECT * FROM done_any WHERE s = 1 AND t > 10)
  {iterate}
  UNION ALL {following}
  UNION ALL SELECT t, s, 0, 1, 1, 0, 0, NULL, c0, cx, cy, d0, dx, dz, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM last)),
weights AS (SELECT t - 1 AS t, c0, cx, cy, d0, dx, dz FROM step WHERE it = 0 AND s = 1 AND t > 1
            UNION ALL SELECT 0, 0, 0, 0, 0, 0, 0),
twice AS (
  SELECT 0 AS t, CAST(0 AS DOUBLE) AS y0, CAST(0 AS DOUBLE) AS y1, CAST(0 AS DOUBLE) AS z0, CAST(0 AS DOUBLE) AS z1
  UNION ALL
  SELECT t, y0, y1, c0 + cy * y0, cx + cy * y1 FROM (
    SELECT w.t, c0, cx, cy, d0 + dz * z0 AS y0, dx + dz * z1 AS y1 FROM twice b JOIN weights w ON w.t = b.t + 1) n),
plan AS (SELECT w.*, y0, y1, z0, z1 FROM weights w JOIN twice USING (t)),
moved AS (
  SELECT n.t, max(CASE WHEN y IS NULL AND z IS NULL THEN abs(n.y0 - o.y0 + (n.y1 - o.y1) * x) + abs(n.z0 - o.z0 + (n.z1 - o.z1) * x)
                       WHEN y IS NULL THEN abs(n.d0 - o.d0 + (n.dx - o.dx) * x + (n.dz - o.dz) * z)
                       ELSE abs(n.c0 - o.c0 + (n.cx - o.cx) * x + (n.cy - o.cy) * y) END) AS most
  FROM about, plan n JOIN plan o ON o.t = n.t - 1 WHERE y IS NULL OR z IS NULL GROUP BY n.t),
stop AS (SELECT coalesce(min(t) FILTER (coalesce(most, 0) < thr), 10) AS t FROM (SELECT p.t, most FROM plan p LEFT JOIN moved USING (t) WHERE p.t > 0) r, mean),
fitted AS (
  SELECT {rows}, price, coalesce(quantity, my + CASE WHEN tax IS NULL THEN y0 + y1 * (price - mx) ELSE d0 + dx * (price - mx) + dz * (tax - mz) END) AS quantity,
         coalesce(tax, mz + CASE WHEN quantity IS NULL THEN z0 + z1 * (price - mx) ELSE c0 + cx * (price - mx) + cy * (quantity - my) END) AS tax
  FROM {apply}, mean, plan JOIN stop USING (t))"""


def q_impute_two_gaps(spark, d):
    """F2, two gapped columns: several rounds, fitted and applied on the same rows."""
    r = _two_gap_rows(readings(spark, d))
    out = ChainedImputer(TWO_GAPS).fit_transform(r)
    return out.select(*READING_KEYS, *[round_half_up(F.col(c), 6).alias(c) for c in TWO_GAPS])


_SCALED = "l_extendedprice / 1000 AS price, l_quantity AS quantity, l_tax * 100 AS tax"
SQL_TWO_GAPS = (f"WITH RECURSIVE readings AS ({readings_sql()}), scaled AS (SELECT {', '.join(READING_KEYS)}, {_SCALED} FROM readings), "
                + _two_gap_sql("scaled", "scaled", ", ".join(READING_KEYS))
                + f"\nSELECT {', '.join(READING_KEYS)}, {', '.join(f'{_round_sql(c, 6)} AS {c}' for c in TWO_GAPS)} FROM fitted")


def _two_gap_holdout(spark, d):
    """W6 unrounded: fitted on the split's train part, applied on its test part."""
    return workflows.impute_holdout(_two_gap_rows(_holdout_input(spark, d)), keys=["row_id"], drop=[], round_output=False)[0]


def q_impute_two_gaps_holdout(spark, d):
    """W6 with F3 and F4, two gapped columns; all replayed rounds act on the test rows."""
    out = _two_gap_holdout(spark, d)
    return out.select("row_id", *[round_half_up(F.col(c), 6).alias(c) for c in TWO_GAPS])


_TWO_GAPS_HELD = (f"WITH RECURSIVE readings AS ({readings_sql()}), keyed AS ({SQL_KEYED}), scaled AS (SELECT row_id, {_SCALED} FROM keyed), "
                  f"train AS (SELECT * FROM scaled WHERE NOT {_SPLIT}), test AS (SELECT * FROM scaled WHERE {_SPLIT}), "
                  + _two_gap_sql("train", "test", "row_id"))
SQL_TWO_GAPS_HOLDOUT = f"{_TWO_GAPS_HELD}\nSELECT row_id, {', '.join(f'{_round_sql(c, 6)} AS {c}' for c in TWO_GAPS)} FROM fitted"


def q_holdout_write_back(spark, d):
    """W6 by its retained key: source value, imputed value and mask of every held-out cell; the source lies in buckets of the key."""
    source = write_bucketed(_two_gap_rows(_holdout_input(spark, d)), "readings-by-key", ["row_id"])
    imputed = workflows.impute_holdout(source, keys=["row_id"], drop=[], round_output=False)[0]
    back = workflows.write_back(source, imputed, index="row_id")
    return back.select(*[c if c == "row_id" or c.endswith("_filled") else round_half_up(F.col(c), 6).alias(c) for c in back.columns])


SQL_HOLDOUT_WRITE_BACK = (f"{_TWO_GAPS_HELD}\nSELECT f.row_id, " + ", ".join(
    f"{_round_sql(f't.{c}', 6)} AS {c}, {_round_sql(f'f.{c}', 6)} AS {c}_imputed, t.{c} IS NULL AS {c}_filled" for c in TWO_GAPS)
    + " FROM fitted f JOIN test t ON t.row_id = f.row_id")


def q_post_two_gaps_corr(spark, d):
    """W7 on an imputed hold-out with several gaps: the correlation table."""
    out = workflows.post_imputation_stats(_two_gap_holdout(spark, d))["corr"]
    return out.select(*[round_half_up(F.col(c), 9).alias(c) if c == "value" else col(c) for c in out.columns])


def q_two_gaps_check(spark, d):
    """W8 after a several-gap imputation: the measures of the gapped rows and of the imputed ones."""
    src = _two_gap_rows(readings(spark, d).select(*MEASURES))
    measures = workflows.imputation_check(src, ChainedImputer(TWO_GAPS).fit_transform(src))["measures"]
    numbers = ["mean", "median", "max", "min", "half_range"]
    return measures.select(*[round_half_up(col(c), 6).alias(c) if c in numbers else col(c) for c in measures.columns])


def _two_gaps_measures(source: str, stage: str) -> str:
    numbers = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "max": "max({0})", "min": "min({0})", "half_range": "(max({0}) - min({0})) / 2"}
    return "\nUNION ALL ".join(
        f"SELECT '{stage}' AS stage, CAST({i} AS BIGINT) AS ordinal, '{c}' AS column_name, "
        + ", ".join(f"{_round_sql(e.format(c), 6)} AS {n}" for n, e in numbers.items()) + f" FROM {source}" for i, c in enumerate(TWO_GAPS))


SQL_TWO_GAPS_CHECK = (f"WITH RECURSIVE readings AS ({readings_sql()}), scaled AS (SELECT {_SCALED} FROM readings), "
                      + _two_gap_sql("scaled", "scaled", "0 AS k") + f"\n{_two_gaps_measures('scaled', 'original')}\nUNION ALL "
                      + _two_gaps_measures("fitted", "imputed"))


def q_imputation_nulls(spark, d):
    """Missing cells left per column after imputation, and how many observed cells changed."""
    src = readings(spark, d).select(*MEASURES, *[F.col(m).alias(f"was_{m}") for m in MEASURES])
    out = write_stage(ChainedImputer(MEASURES).fit_transform(src), "imputed")
    changed = out.agg(*[F.count_if(F.col(f"was_{m}") != F.col(m)).alias(m) for m in MEASURES])
    changed = changed.select(F.inline(F.array(*[F.struct(F.lit(m).alias("column_name"), F.col(m).alias("changed")) for m in MEASURES])))
    left = workflows.imputation_check(out.select(*[F.col(f"was_{m}").alias(m) for m in MEASURES]), out.select(*MEASURES), stage=False)["nulls"]
    return left.join(changed, "column_name")


SQL_IMPUTATION_NULLS = "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{m}' AS column_name, CAST(0 AS BIGINT) AS null_count, CAST(0 AS DOUBLE) AS null_pct, "
    f"CAST(0 AS BIGINT) AS changed" for i, m in enumerate(MEASURES))


def q_central_measures_bigint(spark, d):
    """A12–A13 above 2^53 stay exact, for all numeric columns of the table."""
    o = table(spark, d, "orders").selectExpr("o_orderkey + 9007199254740993 AS big", "o_custkey", "o_orderstatus")
    return stats.central_measures(o).select("column_name", "max", "min")


SQL_CENTRAL_BIGINT = """SELECT 'big' AS column_name, max(o_orderkey + 9007199254740993) AS max, min(o_orderkey + 9007199254740993) AS min FROM orders
UNION ALL SELECT 'o_custkey', max(o_custkey), min(o_custkey) FROM orders"""


def q_missing_kinds(spark, d):
    """A3, A11, A16 and F7 over a column that has NaN and both infinities beside numbers."""
    ev = normalize_nan(table(spark, d, "events").select(F.expr(ODD_VALUE).alias("value")))
    low, mid, high = (F.col("value")[i] for i in range(3))
    q = quantiles_with_moments(ev, ["value"], [0.25, 0.5, 0.75]).select(sig_round(low).alias("q1"), sig_round(mid).alias("median"), sig_round(high).alias("q3"), "mn", "mx")
    nulls = prof.null_profile(ev).select("null_count")
    bins = ev.agg(F.count_if(feat.bin_right_closed(F.col("value"), AIR_EDGES, AIR_LABELS) == "Mala").alias("worst"))
    both = q.select("*", nulls.scalar().alias("null_count"), bins.scalar().alias("worst"))
    return both


ODD_VALUE = ("CASE WHEN event_id % 10 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 10 = 1 THEN CAST('Infinity' AS DOUBLE) "
             "WHEN event_id % 10 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END")
SQL_MISSING_KINDS = f"""WITH e AS (SELECT CASE WHEN isnan(v) THEN NULL ELSE v END AS value FROM (SELECT {ODD_VALUE} AS v FROM events) o)
SELECT {sig_round_sql('quantile_cont(value, 0.25)')} AS q1, {sig_round_sql('quantile_cont(value, 0.5)')} AS median,
       {sig_round_sql('quantile_cont(value, 0.75)')} AS q3, min(value) AS mn, max(value) AS mx,
       count(*) - count(value) AS null_count, count(*) FILTER (value > 100) AS worst FROM e"""


def q_impute_train_test(spark, d):
    """Deterministic 80/20 split, fit on train, impute test, round
    half-even, row key first (F3, F4, P9, K2 layout).  Rows-only check."""
    out, _imp = workflows.impute_holdout(_holdout_input(spark, d), keys=["row_id"], drop=[])
    return out


def q_post_imputation_corr(spark, d):
    """W7 on W6's output: the leading key dropped by position, then the
    correlation table."""
    out, _imp = workflows.impute_holdout(_holdout_input(spark, d), keys=["row_id"], drop=[])
    return workflows.post_imputation_stats(out)["corr"]


def q_imputation_check(spark, d):
    """Central measures of the gapped input next to the imputed one."""
    src = readings(spark, d).select(*MEASURES)
    imputed = ChainedImputer(MEASURES).fit_transform(src)
    return workflows.imputation_check(src, imputed)["measures"]


def q_clean_transform(spark, d):
    """W4 on the stand-in: fences → clip → right-closed bins of the clipped,
    unscaled quantity → population z-scores from the clipped data."""
    r = readings(spark, d)
    out, _params = workflows.clean_and_transform(
        r, outlier_cols=MEASURES, bin_col="l_quantity", edges=BAND_EDGES, labels=BAND_LABELS,
        bin_out="quantity_band", scaled_cols=MEASURES)
    return out.select(*READING_KEYS, *[round_half_up(col(c), 6).alias(c) for c in MEASURES], "quantity_band")


def _clean_sql():
    k = "CAST(1.5 AS DOUBLE)"
    q = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in MEASURES)
    f = ", ".join(f"q1_{c} - {k} * (q3_{c} - q1_{c}) AS lo_{c}, q3_{c} + {k} * (q3_{c} - q1_{c}) AS hi_{c}"
                  for c in MEASURES)
    clip = ", ".join(f"CASE WHEN (CASE WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END) < lo_{c} THEN lo_{c} "
                     f"ELSE (CASE WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END) END AS {c}" for c in MEASURES)
    m = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)
    z = ", ".join(f"{_round_sql(f'({c} - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END)', 6)} AS {c}"
                  for c in MEASURES)
    band = ("CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 25 "
            "THEN 'mid' WHEN l_quantity > 25 THEN 'high' END")
    return (f"{WITH_READINGS}, q AS (SELECT {q} FROM readings), f AS (SELECT {f} FROM q), "
            f"c AS (SELECT {', '.join(READING_KEYS)}, {clip} FROM readings, f), m AS (SELECT {m} FROM c)\n"
            f"SELECT {', '.join(READING_KEYS)}, {z}, {band} AS quantity_band FROM c, m")


SQL_CLEAN = _clean_sql()


QUERIES: dict[str, Query] = {
    "quality_by_year": q_quality_by_year,
    "best_year": q_best_year,
    "tagged_union": q_tagged_union,
    "null_profile": q_null_profile,
    "null_pct_label": q_null_pct_label,
    "shape": q_shape,
    "schema_profile": q_schema_profile,
    "head5": q_head5,
    "glimpse": q_glimpse,
    "understand": q_understand,
    "dup_count": q_dup_count,
    "dedupe": q_dedupe,
    "time_features": q_time_features,
    "time_features_orders": q_time_features_orders,
    "project_drop": q_project_drop,
    "one_hot": q_one_hot,
    "split_train_test": q_split_train_test,
    "split_exact": q_split_exact,
    "central_measures": q_central_measures,
    "before_after": q_before_after,
    "iqr_fences": q_iqr_fences,
    "iqr_clip": q_iqr_clip,
    "bin_right_closed": q_bin_right_closed,
    "standardise": q_standardise,
    "constant_columns": q_constant_columns,
    "cov_matrix": q_cov_matrix,
    "corr_matrix": q_corr_matrix,
    "corr_labels": q_corr_labels,
    "cov_matrix_13": q_cov_matrix_13,
    "corr_matrix_13": q_corr_matrix_13,
    "center": q_center,
    "round_even": q_round_even,
    "csv_roundtrip": q_csv_roundtrip,
    "yearly_sources": q_yearly_sources,
    "skipped_sources": q_skipped_sources,
    "consolidated": q_consolidated,
    "yearly_headers": q_yearly_headers,
    "replaced_source": q_replaced_source,
    "written_sources": q_written_sources,
    "time_layouts": q_time_layouts,
    "csv_text_roundtrip": q_csv_text_roundtrip,
    "malformed": q_malformed,
    "dup_count_rows": q_dup_count_rows,
    "dedupe_rows": q_dedupe_rows,
    "impute_one_gap": q_impute_one_gap,
    "impute_one_gap_holdout": q_impute_one_gap_holdout,
    "post_one_gap_cov": q_post_one_gap_cov,
    "impute_two_gaps": q_impute_two_gaps,
    "impute_two_gaps_holdout": q_impute_two_gaps_holdout,
    "holdout_write_back": q_holdout_write_back,
    "post_two_gaps_corr": q_post_two_gaps_corr,
    "two_gaps_check": q_two_gaps_check,
    "imputation_nulls": q_imputation_nulls,
    "central_measures_bigint": q_central_measures_bigint,
    "missing_kinds": q_missing_kinds,
    "clean_transform": q_clean_transform,
    "impute_fit_transform": q_impute_fit_transform,
    "impute_train_test": q_impute_train_test,
    "post_imputation_corr": q_post_imputation_corr,
    "imputation_check": q_imputation_check,
}

ORACLE: dict[str, str] = {
    "quality_by_year": SQL_QUALITY,
    "best_year": SQL_BEST,
    "tagged_union": SQL_UNION,
    "null_profile": _null_profile_sql(),
    "null_pct_label": SQL_NULL_LABEL,
    "shape": SQL_SHAPE,
    "schema_profile": SQL_SCHEMA,
    "head5": SQL_HEAD5,
    "glimpse": SQL_GLIMPSE,
    "understand": _understand_sql(),
    "dup_count": SQL_DUP,
    "dedupe": SQL_DEDUPE,
    "time_features": SQL_TIME,
    "time_features_orders": SQL_TIME_ORDERS,
    "project_drop": SQL_PROJECT,
    "one_hot": SQL_ONE_HOT,
    "split_train_test": SQL_SPLIT,
    "split_exact": SQL_SPLIT_EXACT,
    "central_measures": SQL_CENTRAL,
    "before_after": SQL_BEFORE_AFTER,
    "iqr_fences": SQL_FENCES,
    "iqr_clip": SQL_CLIP,
    "bin_right_closed": SQL_BIN,
    "standardise": SQL_STANDARDISE,
    "constant_columns": SQL_CONSTANT,
    "cov_matrix": SQL_COV,
    "corr_matrix": SQL_CORR,
    "corr_labels": SQL_CORR_LABELS,
    "cov_matrix_13": SQL_COV_13,
    "corr_matrix_13": SQL_CORR_13,
    "center": SQL_CENTER,
    "round_even": SQL_ROUND_EVEN,
    "csv_roundtrip": SQL_CSV,
    "yearly_sources": SQL_YEARLY,
    "skipped_sources": SQL_SKIPPED,
    "consolidated": SQL_CONSOLIDATED,
    "yearly_headers": SQL_YEARLY_HEADERS,
    "replaced_source": SQL_REPLACED,
    "written_sources": SQL_WRITTEN,
    "time_layouts": SQL_TIME_LAYOUTS,
    "csv_text_roundtrip": SQL_CSV_TEXTS,
    "malformed": SQL_MALFORMED,
    "dup_count_rows": SQL_DUP_ROWS,
    "dedupe_rows": SQL_DEDUPE_ROWS,
    "impute_one_gap": SQL_ONE_GAP,
    "impute_one_gap_holdout": SQL_ONE_GAP_HOLDOUT,
    "post_one_gap_cov": f"{_HOLDOUT_SQL}\n" + _pairs_sql("held", lambda a, b: sig_round_sql(f"covar_pop({a}, {b})"), ONE_GAP),
    "impute_two_gaps": SQL_TWO_GAPS,
    "impute_two_gaps_holdout": SQL_TWO_GAPS_HOLDOUT,
    "holdout_write_back": SQL_HOLDOUT_WRITE_BACK,
    "post_two_gaps_corr": f"{_TWO_GAPS_HELD}\n" + _pairs_sql("fitted", lambda a, b: _round_sql(_corr_cell(a, b), 9), TWO_GAPS),
    "two_gaps_check": SQL_TWO_GAPS_CHECK,
    "imputation_nulls": SQL_IMPUTATION_NULLS,
    "central_measures_bigint": SQL_CENTRAL_BIGINT,
    "missing_kinds": SQL_MISSING_KINDS,
    "clean_transform": SQL_CLEAN,
}
