"""Byte-level BPE: the library's ids for whole texts, over chunks of any size, and the way back."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm.bpe import BytePairs, codec, decode
from prepkit.llm.queries import op11_byte_bpe

SCHEMA = "doc_id long, text string, ids int, row string, piece double, body string, chunk int"


def plain(text) -> tuple:
    own = codec("byte_bpe_50k.tiktoken", None)
    ids = own.library.encode_ordinary(text or "")
    assert own.library.decode_bytes(ids) == (text or "").encode()
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def texts() -> list:
    rng = random.Random(3)
    parts = ["a", "it's", "'ll", " ", "  ", "\n", "\n\n ", "\t", "123", "é", "😀", "日本", "...", "<|endoftext|>", "don't", " ", " ", "'", "l"]
    mixed = ["".join(rng.choice(parts) for _ in range(n)) for n in (5, 40, 300, 301, 900, 2500)]
    return [None, "", " ", "\n", "a", *mixed, "x" * 700, " " * 700, "ab " * 400, "'" * 500 + "ll" * 200, "word" + " " * 300 + "\n" * 90 + "end",
            "é" * 400 + " b" * 300, "a b c " * 60 + "y" * 500 + " tail of it" * 60, mixed[3], mixed[3]]


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1024), (64, 24), (17, 9), (100, 100)])
def test_ids_and_bytes_of_whole_texts(spark, chunk, overlap):
    rows = [(i, t, 1, "r", 2.0, "b", 3) for i, t in enumerate(texts())] + [(None, "no id " * 30, 1, "r", 2.0, "b", 3), (3, "again " * 40, 1, "r", 2.0, "b", 3)]
    found = BytePairs(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk, overlap=overlap)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.digests().collect())
    assert got == Counter((i, *plain(t)) for i, t, *_ in rows)


def test_long_texts_are_cut_and_stitched(spark):
    text = "some words, and 12 more; " * 2000
    found = BytePairs(spark.createDataFrame([(1, text), (2, "z" * 5000 + text)], "doc_id long, text string"), chunk=1000, overlap=100)
    pieces = found.encoded()
    n = {r.doc_id: r["count"] for r in pieces.groupBy("doc_id").count().collect()}
    assert n[1] >= 49 and n[2] < n[1]           # no stitch inside one long pre-token: the rest is one piece
    back = decode(pieces).orderBy("doc_id", "piece").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "bytes"))).alias("all"))
    assert {r.doc_id: b"".join(p.bytes for p in r["all"]).decode() for r in back.collect()} == {1: text, 2: "z" * 5000 + text}


def test_white_space_beyond_the_librarys_stack():
    own = codec("byte_bpe_50k.tiktoken", None)
    for text in ("a" + " " * 70_000 + "b", "\n" * 66_000 + " x"):
        assert own.encode(text).tolist() == own.library.encode_ordinary(text)
    assert own.decode(own.encode(" " * 1_000_000 + "x")) == (" " * 1_000_000 + "x").encode()


def test_an_empty_table(spark):
    assert BytePairs(spark.createDataFrame([], SCHEMA)).digests().count() == 0
    assert BytePairs(spark.createDataFrame([], SCHEMA), chunk=10, overlap=9).encoded().count() == 0


def test_the_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = Counter((r.doc_id, *plain(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in op11_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
