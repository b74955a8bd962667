"""Search of many documents: shards searched as one, queries that share products, bundles searched in two turns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prepkit.llm import bm25
from prepkit.llm.bm25 import DIGITS, Shard, Terms, _in_order, _pack

K, K1, B = 5, 1.2, 0.75


def texts_of(n, seed=3):
    rng = np.random.default_rng(seed)
    kinds = ["", "é", "z"]
    return [" ".join(f"{kinds[i % 3]}{int(x) % 3_000}" for x in rng.zipf(1.25, size=int(rng.integers(0, 120)))) for i in range(n)]


def packed(texts, name):
    digest, ends = Terms().of(pa.array(texts))
    return _pack([f"{name}{i}" for i in range(len(texts))], [digest], [np.diff(ends, prepend=0)]), np.split(digest, ends[:-1])


def test_merged_shards_find_what_scoring_all_documents_finds():
    parts = [texts_of(n, seed) for seed, n in enumerate((700, 1, 400, 900))]
    rows, docs = zip(*[packed(t, f"{p}-") for p, t in enumerate(parts)])
    ids, docs = [f"{p}-{i}" for p, t in enumerate(parts) for i in range(len(t))], [d for some in docs for d in some]
    mean = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in np.unique(d).tolist())
    queries = [(q := np.unique(docs[i]), np.array([np.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in q.tolist()])) for i in range(0, len(docs), 40)]
    shard = Shard(*bm25.merge(list(rows)), mean, K1, B)
    assert shard.n == len(docs) and sorted(shard.ids.tolist()) == sorted(ids)
    for (query, idf), (places, scores) in zip(queries, shard.search(queries, K), strict=True):
        tf = np.array([[np.count_nonzero(d == t) for t in query] for d in docs]).reshape(len(docs), -1)
        norm = K1 * (1 - B + B * np.array([len(d) for d in docs]) / mean)
        want = np.round((tf * (K1 + 1) / (tf + norm[:, None]) * idf).sum(axis=1), DIGITS)
        last = max(np.sort(want)[-K], 1e-6)
        assert dict(zip(shard.ids[places].tolist(), np.round(scores, DIGITS - 1))) == {i: np.round(s, DIGITS - 1) for i, s in zip(ids, want) if s >= last}


def test_queries_share_the_products_of_a_block():
    row, docs = packed(texts_of(2_000), "")
    shard = Shard(*row, 60.0, K1, B)
    queries = [(np.unique(d), np.ones(len(np.unique(d)))) for d in docs[:256]]
    calls, plain = [], shard._often
    shard._often = lambda blocks, query, weight: calls.append(len(np.unique(query))) or plain(blocks, query, weight)
    shard.search(queries, K)
    assert len(calls) <= 6 and calls[0] > 200        # a few steps, in each of which queries go through a block together


def test_bundles_hold_as_many_documents_as_places_and_words():
    shards = [(p, t, 9_000, 100_000) for p in range(200) for t in range(2)] + [(200, 0, 3, 30_000_000), (201, 0, 60_000, 10)]
    held = bm25._bundles(shards, 2)
    assert [x[:2] for x in held] == [x[:2] for x in shards]
    numbers = [x[2] for x in held]
    assert numbers[0] == 0 and all(b - a in (0, 1) for a, b in zip(numbers, numbers[1:]))
    size = Counter()
    for (_, _, n, _), number in zip(shards, numbers):
        size[number] += n
    assert max(size.values()) <= 1 << 16 and numbers[-1] < len(shards) / 1.5
    assert bm25._bundles([], 2) == []
    assert len({x[2] for x in bm25._bundles([(p, 0, 10, 100) for p in range(32)], 2)}) == bm25.SPREAD      # few shards are spread


@pytest.mark.parametrize("spread", [1, 3])
def test_two_turns_find_what_one_finds(spark, monkeypatch, spread):
    texts = texts_of(900) + [None, "", "same words here"] + ["same words here"] * 12
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(12, "doc_id")
    docs = docs.unionByName(docs.where("doc_id < 30"))
    asked = F.col("doc_id") % 9 == 0
    whole = sorted(map(tuple, bm25.search(docs, asked, k=3).collect()), key=repr)
    monkeypatch.setattr(bm25, "SPREAD", spread)
    monkeypatch.setattr(bm25, "SHARD_DOCS", 20)
    frequency, shards = bm25._statistics(bm25.build_index(docs))
    assert max(x[2] for x in bm25._bundles(shards, 2)) + 1 > spread * 3 // 2
    assert sorted(map(tuple, bm25.search(docs, asked, k=3).collect()), key=repr) == whole and len(whole) > 250


def test_words_have_one_digest_wherever_they_stand():
    long = ["x" * n for n in (63, 64, 65, 200)] + ["y" * 64 + e for e in "ab"]
    words = ["a", "b", "ab", "ba", "aa", "a\0", "é", "É", "日本", "none"] + long
    texts = pa.array(["", "  ", " ".join(words), "\n".join(reversed(words)) + "\t"]).slice(1)
    digest, ends = Terms().of(texts)
    assert ends.tolist() == [0, len(words), 2 * len(words)] and (digest[:len(words)] == digest[len(words):][::-1]).all()
    assert len(np.unique(digest[:len(words)])) == len({w.lower() for w in words})
    many = [f"{a}{b}" for a in range(400) for b in range(400)]
    digest, ends = Terms().of(pa.array([" ".join(many)]))
    assert len(np.unique(digest)) == len(set(many)) and ends.tolist() == [len(many)]


def test_keys_are_in_order_with_frequencies_of_any_size():
    rng = np.random.default_rng(1)
    for most, width in ((1, 20), (1 << 10, 40), (1 << 31, 40), (7, 0)):
        key = rng.choice(1 << width, size=500 if width else 1, replace=False).astype(np.uint64) if width < 30 else np.unique(rng.integers(0, 1 << width, size=600).astype(np.uint64))
        rng.shuffle(key)
        tf = rng.integers(1, most + 1, size=len(key)).astype(np.uint32)
        got, with_it = _in_order(key, tf)
        order = np.argsort(key)
        assert (got == key[order]).all() and (with_it == tf[order]).all()
