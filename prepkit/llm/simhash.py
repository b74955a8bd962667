"""Operator 6: SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint is cut into three segments of at most 23 bits.  The binary
Golay code [23, 12, 7] is perfect: every 23-bit word lies within three bits of
exactly one codeword, whose 12-bit index is the word's own key.  The indices to
which the word and its 23 one-bit neighbours decode, one or six in number, are
its near keys: words that differ in one bit or none have the own key of either
among the near keys of the other.

Fingerprints that differ in at most three bits have (pigeonhole) a segment
with the most errors, beside which the other two hold one error each at most.
So for each pair of segments the left side sends (near key, own key), the right
side (own key, near key), 24 bits in all, and an equal join meets every link;
the whole distance is verified in the join.  Equal fingerprints are one node.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from prepkit.llm.common import join_rows, row_key, stage, text_of
from prepkit.llm.components import components
from prepkit.session import ship_package

#: The generator polynomial of the Golay code; first bit and length of each segment.
GENERATOR, SEGMENTS = 0b110001110101, ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (0, 2), (1, 2))
#: Bits of each byte value, the lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11 bits of a word, and for
    each syndrome the six error patterns (the first is the word's own; repeated
    where there are fewer) whose removal gives its near codewords."""
    def remainder(x: int) -> int:
        while x.bit_length() > 11:
            x ^= GENERATOR << (x.bit_length() - 12)
        return x

    one = [remainder(1 << i) for i in range(23)]
    low, high = (np.array([0], dtype=np.int64) for _ in range(2))
    for i in range(12):
        low = np.concatenate((low, low ^ one[i]))
    for i in range(12, 23):
        high = np.concatenate((high, high ^ one[i]))
    lead = {0: 0}
    for i in range(23):
        lead[one[i]] = 1 << i
        for j in range(i):
            lead[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                lead[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    near = np.empty((2048, 6), dtype=np.int64)
    for s in range(2048):
        found = dict.fromkeys([lead[s], *[1 << i ^ lead[s ^ one[i]] for i in range(23)]])
        near[s] = [*found, *[lead[s]] * (6 - len(found))]
    return low, high, near


def near_keys(words: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit words, six a word: the first is its own."""
    low, high, near = golay()
    return (words[:, None] ^ near[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def segment(prints: np.ndarray, i: int) -> np.ndarray:
    first, bits = SEGMENTS[i]
    return ((prints.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, 64 bits; 0 for a text without words."""
    words = text.lower().split()       # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()[shingle - 1:] or [len(whole)]
    one = xxhash.xxh64_intdigest
    h = np.array([one(whole[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")
    lanes = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(((ones.ravel() * 2 > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``copy`` (a digest of the text) and ``print`` (signed 64 bits) of each row; NULL texts are empty."""
    ship_package(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(text_col)).alias("copy"), text_of(text_col).cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints.view(np.int64))], names=["id", "copy", "print"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, copy long, print long")


def _keys(prints: DataFrame, left: bool) -> DataFrame:
    """``key, print``: the keys of one side of the join, for each pair of segments."""
    def run(batches):
        for b in batches:
            p = b.column(0).to_numpy()
            near = [near_keys(segment(p, i)) for i in range(3)]
            for n, (i, j) in enumerate(_PAIRS):
                many, own = (near[i], near[j][:, :1]) if left else (near[j], near[i][:, :1])
                key = (n << 24) | (many << 12 | own if left else own << 12 | many)
                fresh = np.ones(key.shape, dtype=bool)
                fresh[:, 1:] = many[:, 1:] != many[:, :1]
                yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), pa.array(np.repeat(p, 6)[fresh.ravel()])], names=["key", "print"])

    return prints.select("print").mapInArrow(run, "key long, print long")


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """``a, b``: the pairs of distinct fingerprints that differ in ``bits`` bits or
    fewer (three at most), a < b; a pair may be repeated."""
    if bits > 3:
        raise ValueError("the segments' pigeonhole covers three bits")
    left, right = _keys(prints, True).withColumnRenamed("print", "a"), _keys(prints, False).withColumnRenamed("print", "b")
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42,
                    bits: int = 3) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id whose fingerprint is reachable by links.

    NULL texts are empty; texts without words have fingerprint 0, linked like any
    other.  Rows that share an id are separate rows.  NULL ids are never the
    smallest (a component of NULL ids alone has NULL).  An empty table gives no
    rows; other columns are ignored.
    """
    docs, nodes = _grouped(df, id_col, text_col, shingle, seed, bits)
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = nodes.join(least, "component").select("print", "component_id")
    return docs.join(named, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, seed: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, copy, print, row), staged, and the distinct fingerprints: the
    smallest id of each (``first``), its first row (``head``) and its component."""
    docs = stage(fingerprints(df, id_col, text_col, shingle, seed).withColumn("row", F.monotonically_increasing_id()), "simhash-prints")
    head = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row", "copy")
    nodes = stage(docs.groupBy("print").agg(F.min("id").alias("first"), F.min(head).alias("head")), "simhash-nodes")
    group = components(links(nodes, bits), "a", "b")
    return docs, nodes.join(group, F.col("print") == F.col("node"), "left").select(
        "print", "first", "head", F.coalesce("component", "print").alias("component"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: one of each component, that
    with the smallest id (NULL last), of rows that share it the one read first.  Rows
    alike in id and text are one another's copies, of which any may be the one."""
    _, nodes = _grouped(df, id_col, text_col, shingle, 42, bits)
    keep = nodes.groupBy("component").agg(F.min("head").alias("head")).select(
        F.col("head.id").alias("__id"), F.col("head.copy").alias("__llm_copy"), F.col("head.row").alias("__llm_row"))
    keep = stage(keep.select(row_key("__id").alias("__llm_key"), "__llm_copy", "__llm_row"), "simhash-kept")
    return join_rows(df, keep, id_col, text_of(text_col), "__llm_row").select(*[f"`{n}`" for n in df.columns])
