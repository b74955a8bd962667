"""Operator 11: byte-level BPE encoding and decoding with overlapping chunks.

Texts up to a chunk's length are encoded where they lie.  A longer text is cut into
chunks of ``chunk`` code points, each with the next ``overlap`` code points behind it,
which are dealt over the cluster and pre-tokenised in parallel.  Pre-tokens are
found from left to right and never look back, so two neighbouring streams that have
one boundary in common agree from there on: the first such boundary in the overlap
is where the chunks are stitched.  The pieces between stitches are then encoded in
parallel, and decoding concatenates the raw bytes of their ids.

A stitch must leave both sides' pre-tokens as they are in the whole text: white space
looks ahead (``\\s+(?!\\S)``), so there is none right before a stitch, and boundaries in
the last ``MARGIN`` code points of a chunk, where a pre-token may still change, do not count.
Where an overlap holds no stitch (one pre-token spans it), the rest of that text is
one piece: whole, if not parallel.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from prepkit.llm.common import stage, text_of
from prepkit.llm.packing import slices
from prepkit.session import ship_package

#: Code points before a chunk's end whose pre-tokens the text behind may change.
MARGIN = 8
#: The library's own matcher overflows its stack on runs of white space some times longer than this.
LONGEST_SPACE = 65_536


class Codec:
    """Ids of texts and bytes of ids, by a file of ranks and a pattern of pre-tokens."""

    def __init__(self, ranks: str, pattern: str | None):
        import public_tokenizers
        import regex
        import tiktoken
        path = ranks if "/" in ranks else public_tokenizers.path(ranks)
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN if pattern is None else pattern
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {i: b for b, i in table.items()}
        self.pattern, self.spaces = regex.compile(pattern), regex.compile(rf"\s{{{LONGEST_SPACE}}}")

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= LONGEST_SPACE and self.spaces.search(text):
            ids = [i for m in self.pattern.finditer(text) for i in self.library._encode_single_piece(m.group().encode())]
        else:
            ids = self.library.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]


@lru_cache(maxsize=2)
def codec(ranks: str, pattern: str | None) -> Codec:
    """One codec a worker, as long as it lives."""
    return Codec(ranks, pattern)


class BytePairs:
    """The byte-level BPE of ``df``'s texts.

    ``ranks`` names a file of ranks (a path, or a file of ``public_tokenizers``), ``pattern``
    the pre-tokens (those of ``public_tokenizers`` by default).  NULL texts are empty and have no ids.  Rows that share an id,
    NULL ids too, are texts of their own; other columns do not matter; an empty table
    gives no rows.  No special tokens: their strings are ordinary text.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = "byte_bpe_50k.tiktoken",
                 pattern: str | None = None, chunk: int = 32_768, overlap: int = 1024):
        if chunk < 1 or overlap <= MARGIN:
            raise ValueError(f"chunk must be positive and overlap above {MARGIN}")
        ship_package(df.sparkSession)
        self.docs = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
        self.id_col, self.kind = id_col, self.docs.schema["id"].dataType.simpleString()
        self.ranks, self.pattern, self.chunk, self.overlap = ranks, pattern, chunk, overlap
        self.fits = F.char_length("text") <= chunk + overlap

    # ------------------------------------------------------------ long texts
    def chunks(self) -> DataFrame:
        """The overlapping chunks of the texts longer than one: row, id, chunk (from 0), start, last, body."""
        size, overlap = self.chunk, self.overlap

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                for key, text, row in zip(*(b.column(k) for k in range(3))):
                    text, starts = text.as_py(), []
                    starts = list(range(0, len(text), size))
                    if len(starts) > 1 and len(text) - starts[-1] <= overlap:
                        starts.pop()            # the chunk before holds it whole
                    last = starts[-1]
                    for lo in range(0, len(starts), 256):
                        part = starts[lo:lo + 256]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row.as_py()] * len(part), pa.int64()), pa.array([key.as_py()] * len(part), b.schema.field(0).type),
                             pa.array([s // size for s in part], pa.int64()), pa.array(part, pa.int64()), pa.array([s == last for s in part]),
                             pa.array([text[s:] if s == last else text[s:s + size + overlap] for s in part], pa.string())],
                            names=["row", "id", "chunk", "start", "last", "body"])

        long = self.docs.where(~self.fits).withColumn("row", F.monotonically_increasing_id())
        return long.mapInArrow(cut, f"row long, id {self.kind}, chunk long, start long, last boolean, body string").repartition("row", "chunk")

    def stitches(self, chunks: DataFrame) -> DataFrame:
        """Where each chunk's own part begins and ends: row, chunk, piece (from 0), parts
        (chunks of the piece), from, to (code points of the text; NULL: its end)."""
        ranks, pattern, size, overlap = self.ranks, self.pattern, self.chunk, self.overlap

        def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = codec(ranks, pattern)
            for b in batches:
                heads, tails = [], []
                for start, last, body in zip(b.column("start").to_pylist(), b.column("last").to_pylist(), b.column("body").to_pylist()):
                    ends = own.boundaries(body)
                    heads.append([start, *(start + e for e in ends if e < overlap)])
                    sure = len(body) - MARGIN
                    tails.append([] if last else [start + e for e in ends if size <= e <= sure and not body[e - 1].isspace()])
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("chunk"), b.column("start"), *(pa.array(x, pa.list_(pa.int64())) for x in (heads, tails))],
                    names=["row", "chunk", "start", "head", "tail"])

        found = chunks.select("row", "chunk", "start", "last", "body").mapInArrow(
            streams, "row long, chunk long, start long, head array<long>, tail array<long>")
        order = Window.partitionBy("row").orderBy("chunk")
        met = found.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
        met = met.withColumn("lost", F.max((F.col("chunk") > 0) & F.col("cut").isNull()).over(order))
        met = met.withColumn("cut", F.when(~F.col("lost"), F.col("cut")))
        met = met.withColumn("piece", F.count("cut").over(order))
        begin = F.coalesce("cut", "start")
        return met.select("row", "chunk", "piece", F.count(F.lit(1)).over(Window.partitionBy("row", "piece")).alias("parts"),
                          begin.alias("from"), F.lead(begin).over(order).alias("to"))

    def cut_pieces(self) -> DataFrame:
        """The pieces of the long texts: row, id, piece, body."""
        chunks = stage(self.chunks(), "bpe-chunks")
        own = chunks.join(self.stitches(chunks), ["row", "chunk"])
        begin = F.col("from") - F.col("start")
        length = F.coalesce(F.col("to") - F.col("from"), F.char_length("body"))
        parts = stage(own.select("row", "id", "piece", "chunk", "parts", F.substring("body", begin.cast("int") + 1, length.cast("int")).alias("body")), "bpe-parts")
        whole = parts.where("parts = 1").select("row", "id", "piece", "body")
        merged = parts.where("parts > 1").groupBy("row", "id", "piece").agg(F.sort_array(F.collect_list(F.struct("chunk", "body"))).alias("own"))
        return whole.union(merged.select("row", "id", "piece", F.array_join("own.body", "").alias("body")))

    # ------------------------------------------------------------ ids
    def _ids(self, rows: DataFrame) -> DataFrame:
        """Rows of id, body and others: ``body`` gives way to ``ids``, 32-bit little-endian numbers."""
        ranks, pattern = self.ranks, self.pattern
        others = [c for c in rows.columns if c not in ("id", "body")]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = codec(ranks, pattern)
            for b in slices(batches):
                ids = [own.encode(t.as_py()).tobytes() for t in b.column("body")]
                yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in others), pa.array(ids, pa.binary())], names=["id", *others, "ids"])

        schema = ", ".join([f"id {self.kind}", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others), "ids binary"])
        return rows.select("id", "body", *others).mapInArrow(encode, schema)

    def short_ids(self) -> DataFrame:
        return self._ids(self.docs.where(self.fits).select("id", F.col("text").alias("body")))

    def long_ids(self) -> DataFrame:
        return self._ids(self.cut_pieces())

    def encoded(self) -> DataFrame:
        """A row per piece: the id column, ``row`` (tells long texts apart; NULL for a text
        of one piece that was encoded where it lay), ``piece`` (from 0) and ``ids`` (binary: 32-bit little-endian numbers)."""
        short = self.short_ids().select("id", F.lit(None).cast("long").alias("row"), F.lit(0).cast("long").alias("piece"), "ids")
        return short.union(self.long_ids().select("id", "row", "piece", "ids")).withColumnRenamed("id", self.id_col)

    def digests(self) -> DataFrame:
        """A row per text: the id column, ``n_tokens``, ``ids_sha256`` (of the ids as
        little-endian 32-bit numbers), ``decoded_sha256`` (of the bytes they stand for).
        A digest is sequential: the pieces of a long text stream through one task in order."""
        ranks, pattern = self.ranks, self.pattern

        def table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
            key, n, ids, back = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in ids]),
                                               pa.array([h.hexdigest() for h in back])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = codec(ranks, pattern)
            for b in batches:
                rows = []
                for key, ids in zip(b.column("id").to_pylist(), b.column("ids")):
                    ids = np.frombuffer(ids.as_buffer(), dtype="<u4")
                    rows.append((key, len(ids), hashlib.sha256(ids), hashlib.sha256(own.decode(ids))))
                if rows:
                    yield table(rows, b.schema.field("id").type)

        def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, at, state, kind = codec(ranks, pattern), None, None, None
            for b in batches:
                done, kind = [], b.schema.field("id").type
                for row, key, ids in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), b.column("ids")):
                    if state is None or row != at:
                        if state is not None:
                            done.append(state)
                        at, state = row, [key, 0, hashlib.sha256(), hashlib.sha256()]
                    ids = np.frombuffer(ids.as_buffer(), dtype="<u4")
                    state[1] += len(ids)
                    state[2].update(ids)
                    state[3].update(own.decode(ids))
                if done:
                    yield table(done, kind)
            if state is not None:
                yield table([state], kind)

        schema = f"id {self.kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        in_order = self.long_ids().repartition("row").sortWithinPartitions("row", "piece")
        return self.short_ids().mapInArrow(whole, schema).union(in_order.mapInArrow(streamed, schema)).withColumnRenamed("id", self.id_col)


def decode(encoded: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", ids_col: str = "ids", into: str = "bytes") -> DataFrame:
    """``encoded`` with the raw bytes of each row's ids (a text is the concatenation of
    its pieces' bytes, in order) in place of the ids.  NULL ids give NULL; an empty table no rows."""
    ship_package(encoded.sparkSession)
    names = [c if c != ids_col else into for c in encoded.columns]
    at = encoded.columns.index(ids_col)
    numbered = encoded.toDF(*[f"v{k}" for k in range(len(names))])
    schema = ", ".join(f"v{k} {f.dataType.simpleString()}" for k, f in enumerate(numbered.schema.fields))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, None)
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([None if not x.is_valid else own.decode(np.frombuffer(x.as_buffer(), dtype="<u4")) for x in columns[at]], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return numbered.mapInArrow(back, schema).toDF(*names)
