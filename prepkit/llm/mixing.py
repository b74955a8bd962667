"""Operator 10: mixing sources to target weights.

The words of each source, in a fixed pseudorandom document order, are packed
into blocks of ``block_words``.  A source whose target is ``q`` passes and
``r`` words gets slots for every block ``q`` times and for as many blocks of
a ``q+1``-th pass as hold ``r`` words (the last one is taken in part), so
that a target is met to the word.  Each pass visits the blocks through its
own pseudorandom permutation of block indexes.  The slots are dealt to
output shards of ``shard_words`` words: the source counts of a shard are a
multinomial draw by the slots that each source has left (so that the totals
stay on target).  Slots and document pieces meet in a join on
(source, block index).

Nothing grows on the driver but one entry per source and per (shard, source).
Documents of a hot source are spread over hashed chunks for the prefix sums
and over blocks for the join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from prepkit.llm.common import SPACES, WORD, join_rows, row_key, stage, text_of
from prepkit.session import ship_package

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share ``sum(sizes)`` by ``weights``; a target stops at ``most`` times its
    source's size and the excess is shared again by weight among the others."""
    left, out, rest = set(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    while left:
        unit = rest / sum(weights[i] for i in left)
        full = {i for i in left if weights[i] * unit > most * sizes[i]}
        if not full:
            for i in left:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        left -= full
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` (or its inverse) at the
    indexes ``i``: a four-round Feistel network over an even number of bits,
    walked until the value is below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = _mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & int(_MASK)))

    def turn(v: np.ndarray) -> np.ndarray:
        a, b = v >> shift, v & low
        with np.errstate(over="ignore"):
            for k in keys[::-1] if inverse else keys:
                a, b = (b ^ (_mix64(a + k) & low), a) if inverse else (b, a ^ (_mix64(b + k) & low))
        return (a << shift) | b

    out = turn(np.asarray(i, dtype=np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = turn(out[far])
    return out.astype(np.int64)


class SourcePlan:
    """How often each block of one source is taken: every block ``passes``
    times, and the first ``extra`` blocks of one more permuted pass."""

    def __init__(self, number: int, size: int, target: float, block: int, seed: int):
        want = round(target)
        self.number, self.size, self.block, self.seed = number, size, block, seed
        self.blocks = -(-size // block)
        self.passes, self.rest = divmod(want, size) if size else (0, 0)
        self.short = size - (self.blocks - 1) * block if size else 0
        self.at = 0      # where the last pass meets the short block
        self.extra = 0
        if self.rest:
            self.at = int(permute(np.array([self.blocks - 1]), self.blocks, self.key(self.passes), inverse=True)[0])
            gap = block - self.short
            whole = -(-self.rest // block)
            self.extra = whole if self.at >= whole else -(-(self.rest + gap) // block)
        self.slots = self.passes * self.blocks + self.extra

    def key(self, turn: int) -> int:
        return (self.seed * 1_000_003 + self.number * 8191 + turn) & 0x7FFFFFFFFFFFFFFF

    def taken(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block index, pass and words taken of the slots ``lo`` to ``hi``."""
        slot = np.arange(lo, hi, dtype=np.int64)
        turn, place = slot // self.blocks, slot % self.blocks
        index = np.empty_like(slot)
        for t in np.unique(turn):
            on = turn == t
            index[on] = permute(place[on], self.blocks, self.key(int(t)))
        words = np.where(index == self.blocks - 1, self.short, self.block)
        before = place * self.block - np.where(place > self.at, self.block - self.short, 0)
        return index, turn, np.where(turn < self.passes, words, np.clip(self.rest - before, 0, words))


def shard_counts(slots: Sequence[int], per_shard: int, seed: int | tuple[int, ...]) -> Iterator[np.ndarray]:
    """Multinomial source counts per output shard, drawn by the slots that each
    source has left; what a draw takes beyond that goes to the others."""
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    while (total := int(left.sum())) > 0:
        want = min(per_shard, total)
        draw = np.minimum(rng.multinomial(want, left / total), left)
        for k in np.argsort(draw - left, kind="stable"):
            if (short := want - int(draw.sum())) <= 0:
                break
            draw[k] += min(short, int(left[k] - draw[k]))
        left = left - draw
        yield draw


def _starts(parts: DataFrame, together: int = 4096) -> DataFrame:
    """``base``: the words of a source in the chunks before each chunk (src, chunk, words).  Sums of ranges of ``together``
    chunks go first, then the chunks of each range by themselves, so no task holds all chunks of a hot source."""
    parts = parts.withColumn("range", F.floor(F.col("chunk") / together))
    ranges = parts.groupBy("src", "range").agg(F.sum("words").alias("all"))
    ranges = ranges.select("src", "range", (F.sum("all").over(Window.partitionBy("src").orderBy("range")) - F.col("all")).alias("before"))
    inside = Window.partitionBy("src", "range").orderBy("chunk")
    parts = parts.withColumn("base", F.sum("words").over(inside) - F.col("words"))
    return parts.join(ranges, ["src", "range"]).select("src", "chunk", "words", (F.col("base") + F.col("before")).alias("base"))


class Mix:
    """The plan of a mix over ``docs``.  ``taken()`` has a row per document,
    ``texts()`` the mixed documents themselves.

    A word is a run of anything but ASCII white space.  NULL and empty texts
    have size 0 and are taken 0 times.  Sources in code-point order, NULL
    last, weigh ``weights`` in turn.  Rows with one id are separate documents.
    Equal inputs give equal mixes, however the rows are partitioned.  An empty
    table gives an empty mix; other columns do not matter.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: Sequence[float] = (5, 2, 1), most: float = 3.0, block_words: int = 128,
                 shard_words: int = 1 << 23, chunk_docs: int = 512, seed: int = 20):
        spark = docs.sparkSession
        ship_package(spark)
        self.id_col = id_col
        src = F.col(f"`{source_col}`").cast("string")
        sized = stage(docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src)).alias("src"),
            F.xxhash64(text_of(text_col)).alias("copy"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size")),
            "mix-sizes")
        rows = sized.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
        rows.sort(key=lambda r: (r["src"] == "n", r["src"]))
        goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
        self.plans = [SourcePlan(i, r["size"], goal[i], block_words, seed) for i, r in enumerate(rows)]
        chunks = max(1, -(-sum(r["n"] for r in rows) // chunk_docs))

        # start of each document in its source: prefix sums over hashed chunks, then within a chunk
        sized = sized.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(chunks)))
        parts = sized.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
        info = spark.createDataFrame(
            [(r["src"], p.number, p.size, g) for r, p, g in zip(rows, self.plans, goal)],
            "src string, number int, source_size long, target double")
        parts = _starts(parts).join(info, "src")
        inside = Window.partitionBy("src", "chunk").orderBy(F.asc_nulls_last("id"), "size", "copy").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        self.placed = stage(
            sized.withColumn("end", F.sum("size").over(inside)).join(parts, ["src", "chunk"])
            .select("id", "copy", "size", "number", "source_size", "target", (F.col("base") + F.col("end") - F.col("size")).alias("start")),
            "mix-placed")
        self.slots = self._slots(spark, block_words, max(1, shard_words // block_words), seed)
        self.block = block_words

    def _slots(self, spark, block: int, per_shard: int, seed: int) -> DataFrame:
        """shard, number, block_index, turn, words: one row per slot of the mix.

        Shards are drawn in two steps: the driver draws groups of as many shards as there
        are groups, tasks draw the shards of a group from what the group was given."""
        plans, slots = self.plans, [p.slots for p in self.plans]
        together = max(1, math.isqrt(sum(slots) // per_shard))       # shards of a group
        done, groups = np.zeros(len(plans), dtype=np.int64), []
        for g, draw in enumerate(shard_counts(slots, together * per_shard, seed)):
            groups.append((g, done.tolist(), draw.tolist()))
            done += draw

        def deal(batches):
            for b in batches:
                for g, at, draw in b.itertuples(index=False):
                    at, rows = np.array(at, dtype=np.int64), []
                    for shard, part in enumerate(shard_counts(draw, per_shard, (seed, g))):
                        rows += [(g * together + shard, i, int(at[i]), int(at[i] + part[i])) for i in np.flatnonzero(part).tolist()]
                        at += part
                    yield pd.DataFrame(rows, columns=["shard", "number", "lo", "hi"])

        def fill(batches):
            for b in batches:
                for shard, i, lo, hi in b.itertuples(index=False):
                    for a in range(lo, hi, 65536):
                        index, turn, words = plans[i].taken(a, min(hi, a + 65536))
                        yield pd.DataFrame({"shard": shard, "number": np.int32(i), "block_index": index, "turn": turn, "words": words})

        tasks = max(1, min(len(groups) * together * len(plans), max(8, int(done.sum()) // 200_000)))
        dealt = spark.createDataFrame(groups, "g long, done array<long>, draw array<long>").mapInPandas(deal, "shard long, number int, lo long, hi long")
        return dealt.repartition(tasks, "shard", "number").mapInPandas(
            fill, "shard long, number int, block_index long, turn long, words long")

    def pieces(self) -> DataFrame:
        """A row for each part of a document that a slot takes: id, number, start
        (identifies the document in its source), turn, shard, first and last word
        in the document, both counted from 0, the last exclusive."""
        b = F.lit(self.block)
        cut = self.placed.where("size > 0").select(
            "id", "number", "start", "size",
            F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block_index"))
        lo = F.greatest(F.col("start"), F.col("block_index") * b)
        hi = F.least(F.col("start") + F.col("size"), F.col("block_index") * b + F.col("words"))
        # Spark's size estimate of the slots is that of their ranges: never broadcast them
        return (cut.join(self.slots.hint("merge"), ["number", "block_index"]).where(hi > lo)
                .select("id", "number", "start", "turn", "shard", (lo - F.col("start")).alias("first"), (hi - F.col("start")).alias("last")))

    def taken(self) -> DataFrame:
        """id, size, source_size, target, taken: one row per document."""
        sums = self.pieces().groupBy("number", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
        return (self.placed.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
                .join(sums.withColumnRenamed("start", "at"), ["number", "at"], "left")
                .select(F.col("id").alias(self.id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")))

    def texts(self, docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
        """The mixed documents: a row of ``docs`` once for each pass that takes any of
        it, with all its columns; the text of a document taken in part is cut to the
        words taken (with the white space between them) and ``chars_col`` follows.
        ``docs`` are the rows the mix was planned on."""
        names = docs.columns
        spans = (self.pieces().groupBy("number", "start", "turn")
                 .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))
        # empty documents start where the next one does, and are never taken
        taken = (self.placed.where("size > 0").join(spans, ["number", "start"])
                 .select(row_key("id").alias("__llm_key"), F.col("copy").alias("__llm_copy"), F.col("number").alias("__llm_number"),
                         F.col("start").alias("__llm_start"), F.col("spans").alias("__llm_spans"),
                         (F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"]) == F.col("size")).alias("__llm_whole")))
        rows = join_rows(docs, stage(taken, "mix-taken", release=True), self.id_col, text_of(text_col), "__llm_number", "__llm_start")
        whole, part = rows.where("__llm_whole"), rows.where("not __llm_whole")
        new = {text_col: _cut(F.col(f"`{text_col}`"), F.col("__llm_spans"))}
        part = part.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in names])
        if chars_col in names:
            part = part.withColumn(chars_col, F.char_length(f"`{text_col}`").cast(docs.schema[chars_col].dataType))
        return whole.select(*[f"`{c}`" for c in names]).unionByName(part)


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The words of ``text`` that ``spans`` (first and last word) cover."""
    word, out = re.compile(f"[^{SPACES}]+"), []
    for t, parts in zip(text, spans):
        at, kept, runs = [m.span() for m in word.finditer(t)], [], []
        for s in parts:
            if runs and runs[-1][1] == s["first"]:
                runs[-1][1] = s["last"]
            else:
                runs.append([s["first"], s["last"]])
        for a, b in runs:
            kept.append(t[at[a][0]:at[b - 1][1]])
        out.append("\n".join(kept))
    return pd.Series(out)
