"""Operator 12: the prefix trie of conversations, by union-find over sorted neighbours.

A conversation is the row of its turns' digests (128 bits of role and text), joined to
one key.  Conversations are range-partitioned and sorted by key, then id, so that a
hot conversation or a hot first turn spreads over neighbouring partitions.  Within a
partition every row begins as a component, whose top is the node of the whole row;
the edges between neighbours are taken in descending order of their longest common prefix (LCP),
and the union of two components makes, or joins, the branching node at that depth.
The nodes in between, with one child each, are the rows' own prefixes and are passed on the way up.

A node whose members all lie inside its partition is finished there.  What is left
of a partition is its outline, the prefixes of its first and of its last row,
with what hangs below each contracted to sums.  Outlines are merged on the nodes' digests:
every sum counts what begins (nodes) or ends (leaves) in its partition, after what an outline shares
with its neighbours is taken off, so sums of a node add up over any number of partitions.

A conversation is one row: 16 bytes and a number for each turn, no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from prepkit.llm.common import stage
from prepkit.session import ship_package

#: Bytes of a turn's digest.
WIDTH = 16
#: Ids of one fragment of a list of ids that spans partitions.
FRAGMENT = 500


def conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: ``conv_id`` (long) and ``turns``, an array of (digest, size)
    in order of the turn (NULL first); turns that share a number are in order of role,
    then of the digest.  ``size`` is the text's code points.  NULL roles and texts are
    empty strings, repeated rows are repeated turns, rows without a conversation id belong to none and go."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turns = df.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("size")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grouped.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def share_heads(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation
    ``c - c % every`` (all that there are of them, none where it does not exist), h being the CRC-32
    of c in decimal modulo ``most``."""
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, max(most - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = convs.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left")
    none = F.slice("turns", 1, 0)
    head = F.when(h > 0, F.coalesce(F.slice("head", F.lit(1), h), none)).otherwise(none)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """The LCP of two keys, in turns."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // WIDTH
    at = 0
    while a[at:at + WIDTH] == b[at:at + WIDTH]:
        at += WIDTH
    return at // WIDTH


class Forest:
    """The trie of sorted rows (ids, keys, sizes of the turns): union-find over the
    neighbours' LCP edges, the deepest first.  ``nodes`` gets, for each node that is done:
    (first row, last row, depth, smallest id, members, children, leaves, saved, first and
    number of the rows that end there, number of the node, number of its parent)."""

    def __init__(self, ids: list[int], keys: list[bytes], sizes: list[list[int]]):
        n = len(ids)
        self.ids, self.sizes, self.root, self.alias, self.nodes = ids, sizes, list(range(n)), list(range(n)), []
        # of the component that a row stands for: (first, last, depth, smallest, members, children, leaves below, saved below, ends from, ends, number)
        self.top: list = [(i, i, len(keys[i]) // WIDTH, ids[i], 1, 0, 0, 0, i, 1, i) for i in range(n)]
        depth = [_common(keys[i], keys[i + 1]) for i in range(n - 1)]
        for i in sorted(range(n - 1), key=depth.__getitem__, reverse=True):
            a, b = self._find(self.root, i), self._find(self.root, i + 1)
            self._rise(a, depth[i])
            self._rise(b, depth[i])
            x, y = self.top[a], self.top[b]
            # rows that end at a node come before all that go on from it
            ends = (x[8], x[9] + y[9]) if x[9] else (y[8], y[9])
            self.top[a] = (x[0], y[1], depth[i], min(x[3], y[3]), x[4] + y[4], x[5] + y[5], x[6] + y[6], x[7] + y[7], *ends, x[10])
            self.alias[y[10]] = x[10]
            self.root[b], self.top[b] = a, None
        if n:
            r = self._find(self.root, 0)
            self._rise(r, 0)
            self._done(self.top[r], -1)

    @staticmethod
    def _find(parent: list[int], i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _done(self, t: tuple, above: int) -> tuple[int, int]:
        first, last, depth, least, members, children, leaves, saved, ends_at, ends, number = t
        leaves = leaves if children else 1
        saved += (members - 1) * (self.sizes[first][depth - 1] if depth else 0)
        self.nodes.append((first, last, depth, least, members, children, leaves, saved, ends_at, ends, number, above))
        return leaves, saved

    def _rise(self, r: int, depth: int) -> None:
        """Pass the nodes of a component's top row up to ``depth``."""
        t = self.top[r]
        while t[2] > depth:
            above = len(self.alias)
            self.alias.append(above)
            leaves, saved = self._done(t, above)
            t = (t[0], t[1], t[2] - 1, t[3], t[4], 1, leaves, saved, 0, 0, above)
        self.top[r] = t

    def number(self, i: int) -> int:
        return self._find(self.alias, i)


#: What a partition hands on: finished nodes (0), its outline (1), ids that end at outline nodes (2).
FOREST = ("kind int, p int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string, left boolean, right boolean, full boolean, size long, upto long, at long, ids string")
_NAMES = [x.split()[0] for x in FOREST.split(", ")]
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition: its sorted rows (conv_id, key, sizes) to rows of FOREST."""
    ids, keys, sizes = [], [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        keys += b.column(1).to_pylist()
        sizes += b.column(2).to_pylist()
    if not ids:
        return
    forest, p, last_row = Forest(ids, keys, sizes), TaskContext.get().partitionId(), len(ids) - 1
    at = {forest.number(x[10]): x for x in forest.nodes}
    upto = [0]
    for s in sizes[0]:
        upto.append(upto[-1] + s)

    def digest(x: tuple, depth: int) -> bytes:
        return hashlib.md5(keys[x[0]][:depth * WIDTH]).digest()

    def rows() -> Iterator[tuple]:
        for x in forest.nodes:
            first, last, depth, least, members, children, leaves, saved, ends_at, ends, _, above = x
            left, right = first == 0, last == last_row
            over = at[forest.number(above)] if above >= 0 else None
            numbers = (members, children, leaves, saved)
            if left or right:
                own = digest(x, depth)
                yield (1, p, own, digest(x, depth - 1) if depth else None, least, depth, None, *numbers, None, left, right,
                       right and depth * WIDTH == len(keys[last_row]), sizes[first][depth - 1] if depth else 0, upto[depth] if left else 0, None, None)
                for lo in range(ends_at, ends_at + ends, FRAGMENT):
                    yield (2, p, own, *[None] * 14, lo, ",".join(map(str, ids[lo:min(lo + FRAGMENT, ends_at + ends)])))
            else:
                opened = over[0] == 0 or over[1] == last_row
                yield (0, p, None, digest(x, depth - 1) if opened else None, least, depth, None if opened else over[3], *numbers,
                       hashlib.sha256(",".join(map(str, ids[ends_at:ends_at + ends])).encode()).hexdigest(), *[None] * 7)

    held = []
    for r in rows():
        held.append(r)
        if len(held) == 10_000:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [_TYPES[x.split()[1]] for x in FOREST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of ids (node, ids), in order, to a digest per node."""
    node, digest, done = None, None, []
    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key != node:
                if digest:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest:
        done.append((node, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.binary(), pa.string()))], names=["node", "ends_sha256"])


class PrefixTrie:
    """The prefix trie of conversations (``conv_id`` long, unique and not NULL; ``turns``,
    an array of (digest: 32 hex digits, size)), such as ``conversations`` gives.

    A node is a distinct sequence of first turns; the root is the empty one.
    Conversations without turns (an empty or NULL array) are members of the root and end there.  An empty table has no nodes.  Other columns do not matter.
    """

    def __init__(self, convs: DataFrame):
        ship_package(convs.sparkSession)
        key = F.coalesce(F.unhex(F.array_join("turns.digest", "")), F.lit(b""))
        rows = convs.select("conv_id", key.alias("key"), F.coalesce(F.col("turns.size"), F.array().cast("array<long>")).alias("sizes"))
        self.rows = stage(rows, "trie-rows")

    def forests(self) -> DataFrame:
        in_order = self.rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
        return in_order.mapInArrow(_forests, FOREST)

    def nodes(self) -> DataFrame:
        """A row per node: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id`` (the
        parent's; NULL for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (nodes without
        children in its subtree, itself included), ``saved_tokens`` (over its subtree, (n_convs - 1) times the
        code points of a node's last text), ``ends_sha256`` (of the ids of the members that have no further turn,
        ascending, joined by commas)."""
        forest = stage(self.forests(), "trie-forests")
        outline = forest.where("kind = 1")
        span = outline.groupBy("node").agg(F.min("p").alias("first_p"), F.max("p").alias("last_p"))
        mine = Window.partitionBy("p")
        before, shared = F.col("left") & (F.col("p") > F.col("first_p")), F.col("left") & (F.col("depth") <= F.col("lcp"))
        known = (outline.join(span, "node")
                 .withColumns({"lcp": F.coalesce(F.max(F.when(before, F.col("depth"))).over(mine), F.lit(-1)), "lcp_upto": F.max(F.when(before, F.col("upto"))).over(mine),
                               "goes_on": F.max(F.col("full") & (F.col("last_p") > F.col("p"))).over(mine)}))
        # take off what the first row shares with the partition before, and the last row's leaf where the next one goes on from it
        parts = known.select("p", "node", "parent", "conv_id", "depth", "n_convs",
                             (F.col("n_children") - (F.col("left") & (F.col("depth") < F.col("lcp"))).cast("long")).alias("n_children"),
                             (F.col("n_leaves") - (F.col("right") & F.col("goes_on")).cast("long")).alias("n_leaves"),
                             (F.col("saved_tokens") + F.when(shared, F.col("lcp_upto") - F.col("upto") + F.col("size")).otherwise(0)).alias("saved_tokens"))
        merged = stage(parts.groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"),
                                                                    *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]), "trie-outline")
        least = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("over"))
        ids = forest.where("kind = 2").repartition("node").sortWithinPartitions("node", "p", "at").select("node", "ids")
        ends = ids.mapInArrow(_joined_ids, "node binary, ends_sha256 string")
        opened = (merged.join(least, "parent", "left").join(ends, "node", "left")
                  .select("conv_id", "depth", F.col("over").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                          F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
        # a finished node below an outline node asks its own partition's outline for its parent
        there = outline.select("p", F.col("node").alias("parent")).join(least, "parent")
        closed = forest.where("kind = 0")
        below = closed.where("parent is not null").join(there, ["p", "parent"]).withColumn("parent_conv_id", F.col("over"))
        inside = closed.where("parent is null")
        names = opened.columns
        return opened.union(inside.select(names)).union(below.select(names))
