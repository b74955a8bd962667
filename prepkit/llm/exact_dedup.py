"""Operator 9: exact duplicates by content sort (DataFrame functions only).

Texts are normalised (ASCII white space deleted) and dealt into ranges by sampled
splitters.  The order is that of the first ``HEAD`` characters, then a digest of
the whole normalised text, then the text itself and the id: splitters stay short
however long the texts are, equal texts are neighbours, and a text that a third of
all rows share spreads over as many ranges as its rows need.

Each range is sorted externally.  A row starts a new run when its whole text
differs from its neighbour's.  Where a range ends, its last text is compared in
full with the first of the next range that has rows: equal ones are one run.  Runs
are then numbered through by prefix sums over the ranges, and a run's parts, one
row per range, give its size and the row that stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from prepkit.llm.common import SPACES, join_rows, row_key, stage

#: Code points of the normalised text that come before its digest in the order.
HEAD = 32
#: Text of a range, the most ranges (beyond, ranges grow), and rows sampled for each.
RANGE_BYTES, RANGES, SAMPLED = 16 << 20, 20_000, 30


def normalised(text: Column) -> Column:
    """``text`` (NULL: empty) without ASCII white space."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _at() -> Column:
    """The place in the order, as far as splitters know it."""
    return F.struct(F.substring("norm", 1, HEAD).alias("head"), F.col("sha"), F.col("id"))


def _places(base: DataFrame, ranges: int | None) -> tuple[int, Column]:
    """How many ranges there are, and the range of a row: the number of splitters that are not above it.

    Rows are sampled in proportion to their bytes, ``SAMPLED`` a range; at most
    ``RANGES`` short splitters come to the driver."""
    size = F.octet_length("text") + 64
    total = base.agg(F.sum(size)).first()[0] or 0
    ranges = ranges or min(RANGES, max(1, -(-total // RANGE_BYTES)))
    if ranges == 1 or not total:
        return 1, F.lit(0)
    some = (base.where(F.rand(9) < size * F.lit(ranges * SAMPLED / total))
            .withColumn("norm", normalised(F.col("text"))).withColumn("sha", F.sha2("norm", 256))
            .agg(F.sort_array(F.collect_list(_at())).alias("s")))
    n = F.size("s")
    picks = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("s", F.floor(i * n / F.lit(ranges)).cast("int")))
    picks = some.select(F.when(n > 0, F.array_distinct(picks)).otherwise(F.array_compact(picks)).alias("s"))
    split = F.from_json(F.lit(picks.select(F.to_json("s")).first()[0]), picks.schema["s"].dataType)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length()))])
    key = _at()
    # binary search: a step is taken if the splitter it passes is not above the row
    return ranges, F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(split)) & (F.get(split, at + step - 1) <= key), at + step).otherwise(at))


def sorted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """A row per input row as the sort leaves it, written to the shared folder: ``id, points,
    sha``, its range ``part``, its ``place`` there and the ``run`` of equal neighbours (both
    from 1), and, in a range's first and last row alone, the whole text: ``first``, ``last``."""
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n, part = _places(base, ranges)
    rows = (base.select("id", F.char_length("text").alias("points"), normalised(F.col("text")).alias("norm"))
            .withColumns({"sha": F.sha2("norm", 256), "head": F.substring("norm", 1, HEAD)}).withColumn("part", part.cast("int")))
    order = Window.partitionBy("part").orderBy("head", "sha", "norm", "id")
    before, after = F.lag("norm").over(order), F.lead("part").over(order)
    seen = (rows.repartitionById(n, F.col("part"))
            .select("id", "points", "sha", "part", "norm", F.row_number().over(order).alias("place"),
                    F.sum(F.when(before == F.col("norm"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
                    after.isNull().alias("end")))
    return stage(seen.select("id", "points", F.unhex("sha").alias("sha"), "part", "place", "run", F.when(F.col("place") == 1, F.col("norm")).alias("first"),
                             F.when(F.col("end"), F.col("norm")).alias("last")), "exact-sorted")


def _numbered(rows: DataFrame) -> DataFrame:
    """For each range, what its run numbers are raised by so that runs are numbered through
    and a run that goes on in the next range keeps its number there."""
    line = Window.orderBy("part")       # one short row a range
    last = rows.where("last is not null").select("part", F.col("run").cast("long").alias("runs"), "last")
    near = last.select("part", "runs", F.lag("part").over(line).alias("left"))
    meet = (near.join(rows.where("first is not null").select("part", "first"), "part")
            .join(last.select(F.col("part").alias("left"), "last"), "left", "left")
            .select("part", "runs", F.coalesce(F.col("first") == F.col("last"), F.lit(False)).cast("long").alias("same")))
    return meet.select("part", (F.sum(F.col("runs") - F.col("same")).over(line) - F.col("runs")).alias("raise"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their normalised texts are equal byte by byte; NULL
    counts as empty, and all empty texts are one group.  The row with the most
    code points in its original text stays, then the smallest id (a NULL id
    last).  Rows repeated with one id keep exactly one of them.  Other columns
    are ignored; an empty table gives no rows.  The number of ``ranges`` follows
    from the bytes of the texts unless it is given.
    """
    rows = sorted_runs(df, id_col, text_col, ranges)
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "part", "place"))
    parts = rows.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    parts = parts.join(_numbered(rows), "part").withColumn("group", F.col("run") + F.col("raise"))
    group = Window.partitionBy("group")     # one row a range of the text
    whole = parts.select("part", "run", F.sum("n").over(group).alias("total"), F.min("best").over(group).alias("best"))
    return rows.join(whole, ["part", "run"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("total").alias("group_size"),
        ((F.col("part") == F.col("best.part")) & (F.col("place") == F.col("best.place"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    One row of each group stays, that which ``exact_groups`` keeps; of rows with
    one id and one normalised text, one of those with the most code points.
    """
    base = df.withColumn("__llm_points", F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    norm = F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256))
    keep = exact_groups(df, id_col, text_col, ranges).where("kept").select(
        row_key(id_col).alias("__llm_key"), F.xxhash64(F.unhex("text_sha256")).alias("__llm_copy"), F.lit(0).alias("__llm_at"))
    found = join_rows(base, keep, id_col, norm, "__llm_at", first=[F.desc("__llm_points")])
    return found.select(*[F.col(f"`{c}`") for c in df.columns])
