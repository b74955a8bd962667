"""Operator 7: line dedup by an exact set-similarity join (DataFrame functions only).

A line is the set of its words.  Words are ordered by rarity: a fixed number of
hashed buckets is counted over the whole corpus, and a word's code is its
bucket's count (on a log scale) followed by 56 bits of its digest, so equal words
have equal codes and rare ones come first.  Any total order keeps the join
exact; a good one keeps it small.

Lines with one word set are one class, the first of which (by document id, then
line) stands for it.  A class sends the codes of its prefix, the
``n - ceil(t n) + 1`` rarest, with its length, the code's position and a 128-bit
parity map of all codes.  Two classes meet in an equal join on a code when length
and position leave room for similarity ``t`` and their parity maps do not differ in
more bits than the sets may differ in words.  Jaccard is then verified on the
whole word sets of the pairs that are left.  A line goes if an earlier one is similar.

``documents`` counts every link.  ``texts`` needs no links, only whether a class has an
earlier similar one: classes meet their codes' earliest classes in rounds, and one that
has found a match takes no part in the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from prepkit.llm.common import SPACES, WORD, drop_stages, join_rows, row_key, stage

#: Buckets of the rarity count (a fixed size, whatever the corpus).
BUCKETS = 1 << 17
#: What a class brings where it meets others on a code: its number, length and parity map of 128 bits.
MET = ("at", "n", "parity", "half")


def words_of(line: Column) -> Column:
    """The words of a line: runs of anything but ASCII white space."""
    for c in SPACES[1:]:
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def _rarity(lines: DataFrame) -> Column:
    """A level for each bucket, by the number of its words in all lines: a constant array."""
    counts = (lines.select(F.explode(words_of(F.col("body"))).alias("w"))
              .groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
              .select("bucket", F.least(F.lit(124), F.floor(F.log2("n") * 3)).cast("int").alias("level")).collect())
    levels = [0] * BUCKETS
    for bucket, level in counts:
        levels[bucket] = level
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<int>")


def codes_of(line: Column, levels: Column) -> Column:
    """The codes of a line's word set, the rarest first."""
    def code(w: Column) -> Column:
        h = F.xxhash64(w)
        level = F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")
        return F.call_function("shiftleft", level, F.lit(56)).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.array_distinct(F.transform(words_of(line), code)))


def _keys() -> list[Column]:
    """The class of a line with these codes: two digests of the word set."""
    return [F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(1), F.col("codes")).alias("k2")]


class LineDedup:
    """The similar lines of ``df``.

    Lines are cut at newlines; words are runs of anything but ASCII white space,
    compared byte by byte.  Lines of fewer than ``min_words`` distinct words (blank
    ones too) are left alone.  NULL texts are one blank line.  Rows come in the
    order of their ids (NULL first); of rows that share an id the one read first
    comes first.  Other columns do not matter, and an empty table gives nothing.
    Pairs are found (by ``texts``) and verified in ``rounds`` parts, one after another.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: float = 0.8, min_words: int = 1,
                 rounds: int = 6):
        if not 0.5 < t <= 1:
            raise ValueError("t must be above 0.5 and at most 1")
        self.df, self.id_col, self.text_col, self.t, self.rounds = df, id_col, text_col, t, rounds
        self.numbered: list[DataFrame] = []
        rows = _rows(df, id_col, text_col)
        self.levels = _rarity(rows.select(F.posexplode(F.split("text", "\n")).alias("line", "body")))
        n, long = F.size("codes"), F.size("codes") >= min_words
        k1, k2 = _keys()

        def parity_of(codes: Column) -> Column:
            return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(
                F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))))

        parity, half = parity_of(F.col("codes")), parity_of(F.filter("codes", lambda c: c.bitwiseAND(F.lit(64)) == 0))
        lines = (rows.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
                 .select("id", "row", "copy", "line", codes_of(F.col("body"), self.levels).alias("codes")))
        self.lines = stage(lines.select(
            "id", "row", "copy", "line", n.alias("n"), F.when(long, k1).alias("k1"), F.when(long, k2).alias("k2"), F.when(long, parity).alias("parity"), F.when(long, half).alias("half"),
            F.when(long, F.slice("codes", F.lit(1), n - F.ceil(n * F.lit(t) - 1e-9).cast("int") + 1)).alias("prefix")), "line-codes")

    def _classes(self) -> DataFrame:
        """The classes, each by its first line, numbered (``at``) in the order of those."""
        classes = stage(
            self.lines.where("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "row", "line", "n", "parity", "half", "prefix")).alias("c"))
            .select("k1", "k2", "c.*").repartitionByRange("id", "row", "line").sortWithinPartitions("id", "row", "line")
            .withColumn("at", F.monotonically_increasing_id()), "line-classes", release=True)
        self.numbered.append(classes)
        return classes

    def candidates(self, classes: DataFrame) -> DataFrame:
        """Pairs of classes, the earlier first, that pass the prefix, length, position and (128 bits) parity filters."""
        codes = classes.select(*MET, F.posexplode("prefix").alias("pos", "code"))
        a = codes.select("code", *[F.col(c).alias(f"a_{c}") for c in (*MET, "pos")])
        b = codes.select("code", *[F.col(c).alias(f"b_{c}") for c in (*MET, "pos")])
        return self._near(a.join(b, "code").where((F.col("a_at") < F.col("b_at")) & self._able())).distinct()

    def _near(self, pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
        """The ``pairs`` whose parity maps of 128 bits, in two halves, do not differ in more bits than the
        sets may differ in words: long lines often pass one of 64 bits by chance.  Pairs that meet on a code
        bring their maps, so those that fail never leave that join; others take them from ``classes``."""
        for side in "ab" if classes is not None else "":
            pairs = pairs.join(classes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("at", "n", "parity", "half")]), f"{side}_at")
        one, whole = F.col("a_half").bitwiseXOR(F.col("b_half")), F.col("a_parity").bitwiseXOR(F.col("b_parity"))
        return pairs.where(F.bit_count(one) + F.bit_count(whole.bitwiseXOR(one)) <= F.col("a_n") + F.col("b_n") - 2 * self._need()).select("a_at", "b_at")

    def _need(self) -> Column:
        """The words that similar sets of these sizes have in common at least."""
        return F.ceil((F.col("a_n") + F.col("b_n")) * F.lit(self.t / (1 + self.t)) - 1e-9)

    def _able(self) -> Column:
        """The length, position and parity filters of a pair that shares a prefix code."""
        both, need = F.col("a_n") + F.col("b_n"), self._need()
        return ((F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(self.t) - 1e-9)
                & (F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) >= need)
                & (F.bit_count(F.col("a_parity").bitwiseXOR(F.col("b_parity"))) <= both - 2 * need))

    def _similar(self) -> Column:
        common = F.size(F.array_intersect("a_codes", "b_codes"))
        return common >= F.lit(self.t) * (F.size("a_codes") + F.size("b_codes") - common) - 1e-9

    def links(self, classes: DataFrame) -> DataFrame:
        """The pairs of classes (a_at, b_at; the earlier first) whose whole word sets have a Jaccard
        similarity of ``t`` or more.  Words are compared by their codes (56 bits and the level)."""
        pairs = stage(self.candidates(classes), "line-candidates", release=True)
        wanted = pairs.select(F.col("a_at").alias("at")).union(pairs.select("b_at")).distinct()
        named = stage(classes.select("at", "id", "line", "k1", "k2").join(wanted, "at"), "line-wanted", release=True)
        found = stage(self._word_sets(named).join(named.select("at", "k1", "k2"), ["k1", "k2"]).select("at", "codes"), "line-words", release=True)
        drop_stages(named)
        rounds = self._in_rounds(pairs, found)
        drop_stages(pairs, found)
        return reduce(DataFrame.union, rounds)

    def _word_sets(self, named: DataFrame) -> DataFrame:
        """The whole word sets (k1, k2, codes) of the lines in ``named`` (id, line), coded once more."""
        at = named.groupBy(F.col("id").alias("of")).agg(F.collect_set("line").alias("wanted"))
        rows = _rows(self.df, self.id_col, self.text_col).select("id", F.col("text").alias("whole"))
        return (rows.join(at, F.col("id").eqNullSafe(F.col("of")))
                .select("wanted", F.posexplode(F.split("whole", "\n")).alias("line", "body")).where("array_contains(wanted, line)")
                .select(codes_of(F.col("body"), self.levels).alias("codes")).select(*_keys(), "codes").dropDuplicates(["k1", "k2"]))

    def _postings(self, classes: DataFrame, part: int) -> DataFrame:
        """The prefix codes of the classes with their ``rank`` among a code's classes,
        the earliest 0; codes of one class are left out.  Ranks are prefix sums over
        chunks of neighbouring classes, so a frequent code is never one task's list.
        Codes come in ``rounds`` parts, which bounds what ranking shuffles at a time."""
        one = classes.select(F.shiftright("at", 33).alias("chunk"), *MET, F.posexplode("prefix").alias("pos", "code"))
        one = one.where(F.pmod(F.xxhash64("code"), F.lit(self.rounds)) == part)
        code = Window.partitionBy("code")
        sums = (one.groupBy("code", "chunk").agg(F.count(F.lit(1)).alias("here"))
                .select("code", "chunk", F.sum("here").over(code).alias("all"),
                        (F.sum("here").over(code.orderBy("chunk")) - F.col("here")).alias("before")).where("all > 1"))
        local = F.row_number().over(Window.partitionBy("code", "chunk").orderBy("at")) - 1
        return one.withColumn("local", local).join(sums, ["code", "chunk"]).select(
            "code", *MET, "pos", (F.col("before") + F.col("local")).alias("rank"), F.lit(True).alias("alive"))

    def later_classes(self, first: int = 4, factor: int = 128) -> DataFrame:
        """The classes (k1, k2) that have a similar class with an earlier first line.

        One earlier class is enough, so no list of all links is made: live classes meet
        the ``first`` earliest of each of their codes, those without a match the next
        ``factor`` times as many, until no code has more.  The variants of one line go in
        the first round, however many they are.  Each round codes the lines that it
        compares from the texts, so rounds are few."""
        classes = self._classes()
        n_classes = classes.count()
        postings = [stage(self._postings(classes, i), "line-postings", release=True) for i in range(self.rounds)]
        low, high = 0, first
        words: list[DataFrame] = []
        gone: list[DataFrame] = []
        while reduce(DataFrame.union, postings).where(F.col("alive") & (F.col("rank") > low)).limit(1).count():
            parts = []
            for some in postings:
                a = some.where(F.col("rank") < high).select("code", *[F.col(c).alias(f"a_{c}") for c in ("rank", *MET, "pos")])
                b = some.where("alive").select("code", *[F.col(c).alias(f"b_{c}") for c in ("rank", *MET, "pos")])
                parts.append(stage(self._near(a.join(b, "code").where((F.col("a_rank") < F.col("b_rank")) & self._able())).distinct(),
                                   "line-part", release=True))
            pairs = stage(reduce(DataFrame.union, parts).distinct(), "line-round", release=True)
            drop_stages(*parts)
            wanted = pairs.select(F.col("a_at").alias("at")).union(pairs.select("b_at")).distinct()
            for known in words:
                wanted = wanted.join(known, "at", "left_anti")
            named = stage(classes.select("at", "id", "line", "k1", "k2").join(wanted, "at"), "line-named", release=True)
            words.append(stage(self._word_sets(named).join(named.select("at", "k1", "k2"), ["k1", "k2"]).select("at", "codes"),
                               "line-words", release=True))
            drop_stages(named)
            found = self._in_rounds(pairs, reduce(DataFrame.union, words), "b_at", parts=-(-4 * pairs.count() // max(1, n_classes)))
            gone.append(stage(reduce(DataFrame.union, found).select(F.col("b_at").alias("at")).distinct(), "line-later", release=True))
            drop_stages(pairs, *found)
            low, high = high, high * factor
            for i, some in enumerate(postings):      # all that later rounds read
                rest = some.where(F.col("rank") >= low).join(gone[-1].withColumn("gone", F.lit(True)), "at", "left")
                postings[i] = stage(rest.select("code", *MET, "pos", "rank", (F.col("alive") & F.col("gone").isNull()).alias("alive")),
                                    "line-postings", release=True)
                drop_stages(some)
        drop_stages(*postings, *words)
        if not gone:
            return classes.select("k1", "k2").limit(0)
        return classes.select("at", "k1", "k2").join(reduce(DataFrame.union, gone), "at").select("k1", "k2").distinct()

    def _in_rounds(self, pairs: DataFrame, sets: DataFrame, *kept: str, parts: int | None = None) -> list[DataFrame]:
        """The similar ones of ``pairs`` (a_at, b_at), or what is ``kept`` of them once each.  A pair's two
        word sets (at, codes) meet by shuffling them with the pair: in ``rounds``, or ``parts`` if they are
        fewer, to bound what is on disk at a time."""
        out, parts = [], min(self.rounds, max(1, self.rounds if parts is None else parts))
        for i in range(parts):
            part = pairs.where(F.pmod(F.xxhash64("a_at"), F.lit(parts)) == i)
            for side in "ab":
                part = part.join(sets.select(F.col("at").alias(f"{side}_at"), F.col("codes").alias(f"{side}_codes")), f"{side}_at")
            part = part.where(self._similar())
            out.append(stage(part.select(*kept).distinct() if kept else part.select("a_at", "b_at"), "line-links", release=True))
        return out

    def judged(self) -> DataFrame:
        """Each line (id, row, copy, line): whether it is ``removed``, and its ``links`` to other classes."""
        classes = self._classes()
        links = self.links(classes)
        # counted as the links are read: they need meet nothing else, since a class knows if it is the later one
        near = reduce(DataFrame.union, [links.groupBy(F.col(side).alias("at")).agg(F.count(F.lit(1)).alias("links"), F.lit(side == "b_at").alias("later"))
                                        for side in ("a_at", "b_at")]).groupBy("at").agg(F.sum("links").alias("links"), F.max("later").alias("later"))
        info = classes.select("at", "k1", "k2", F.struct("id", "row", "line").alias("first")).join(near, "at", "left").drop("at")
        at = F.struct("id", "row", "line")
        return (self.lines.join(info, ["k1", "k2"], "left")
                .select("id", "row", "copy", "line", F.coalesce(F.col("later") | (F.col("first") < at), F.col("first") < at, F.lit(False)).alias("removed"),
                        F.coalesce("links", F.lit(0)).alias("links")))

    def documents(self) -> DataFrame:
        """A row per input row: the id, ``copy`` (a digest of its text), ``row``,
        ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0), ``n_links``."""
        return (self.judged().groupBy("id", "row", "copy")
                .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("removed").alias("n_removed"),
                     F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed"), F.sum("links").alias("n_links"))
                .withColumnRenamed("id", self.id_col))

    def removals(self) -> DataFrame:
        """The rows that lose lines: ``id, row, copy, removed`` (line numbers), without
        the links that ``judged`` counts."""
        known = self.lines.where("k1 is not null")
        at = F.struct("id", "row", "line")
        info = (known.groupBy("k1", "k2").agg(F.min(at).alias("first"))
                .join(self.later_classes().withColumn("later", F.lit(True)), ["k1", "k2"], "left"))
        return (known.join(info, ["k1", "k2"]).where(F.coalesce("later", F.lit(False)) | (F.col("first") < at))
                .groupBy("id", "row", "copy").agg(F.sort_array(F.collect_list("line")).alias("removed")))

    def texts(self, chars_col: str | None = "n_chars") -> DataFrame:
        """The rows of ``df`` without the removed lines, with all their columns;
        ``chars_col`` follows the text.  Rows that had words and lose all go."""
        names = self.df.columns
        gone = stage(self.removals().withColumnRenamed("id", "of"), "line-gone", release=True)
        drop_stages(*self.numbered)
        rows = self.lines.where("line = 0").select("id", "row", "copy")
        cut = rows.join(gone.select("of", "row", "removed"), "row", "left").select(
            row_key("id").alias("__llm_key"), F.col("copy").alias("__llm_copy"), F.col("row").alias("__llm_row"),
            F.coalesce("removed", F.array().cast("array<int>")).alias("__llm_removed"))
        cut = stage(cut, "line-removals", release=True)
        text = F.coalesce(F.col(f"`{self.text_col}`"), F.lit(""))
        rows = join_rows(self.df, cut, self.id_col, text, "__llm_row")
        kept = F.array_join(F.filter(F.split(f"`{self.text_col}`", "\n"), lambda x, i: ~F.array_contains(F.col("__llm_removed"), i)), "\n")
        some = F.size("__llm_removed") > 0
        new = {self.text_col: F.when(some, kept).otherwise(F.col(f"`{self.text_col}`"))}
        out = rows.select(*[new.get(n, F.col(f"`{n}`")).alias(n) for n in names], some.alias("__llm_cut"))
        out = out.where(~F.col("__llm_cut") | F.col(f"`{self.text_col}`").rlike(WORD))
        if chars_col in names:
            kind = self.df.schema[chars_col].dataType
            out = out.withColumn(chars_col, F.when(F.col("__llm_cut"), F.char_length(f"`{self.text_col}`").cast(kind)).otherwise(F.col(f"`{chars_col}`")))
        return out.select(*[f"`{n}`" for n in names])
