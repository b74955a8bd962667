"""A shard's index is packed, and its frequent terms' cells held, in memory of a few arrays of its words."""

from __future__ import annotations

import tracemalloc

import numpy as np

from prepkit.llm.bm25 import Shard, _pack


def shard_words():
    rng = np.random.default_rng(3)
    lengths = np.full(4_000, 250)
    return (rng.zipf(1.2, size=int(lengths.sum())) % 200_000 + 1).astype(np.uint64), lengths


def test_packing_holds_few_arrays_of_a_shards_words():
    words, lengths = shard_words()
    parts, ids = np.array_split(words, 50), [str(i) for i in range(len(lengths))]
    parts = [p.copy() for p in parts]
    tracemalloc.start()
    try:
        _pack(ids, parts, [lengths])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print(peak / len(words))
    assert peak < 48 * len(words)


def test_frequent_terms_take_the_bytes_that_their_counts_need():
    words, lengths = shard_words()
    shard = Shard(*_pack([str(i) for i in range(len(lengths))], [words], [lengths]), 250.0, 1.2, 0.75)
    assert shard.dense.dtype.itemsize == 1 and shard.tf.max() < 256
    many = np.concatenate((np.full(300, 7), np.full(70_000, 9))).astype(np.uint64)
    shard = Shard(*_pack(["a"], [many], [np.array([len(many)])]), 250.0, 1.2, 0.75)
    (docs, scores), = shard.search([(np.array([7, 9], dtype=np.uint64), np.array([1.0, 1.0]))], 3)
    norm = 1.2 * (0.25 + 0.75 * len(many) / 250)
    assert docs.tolist() == [0] and scores.tolist() == [round(300 * 2.2 / (300 + norm) + 70_000 * 2.2 / (70_000 + norm), 6)]


def test_a_shard_is_built_in_few_bytes_a_posting():
    words, lengths = shard_words()
    row = _pack([str(i) for i in range(len(lengths))], [words], [lengths])
    postings = len(row[4]) // 2
    assert len(row[5]) == postings * (1 if np.frombuffer(row[5], dtype=f"u{len(row[5]) // postings}").max() < 256 else 2)
    tracemalloc.start()
    try:
        shard = Shard(*row, 250.0, 1.2, 0.75)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    cells = shard.dense.nbytes + shard.short.nbytes
    assert (kept - cells) / postings < 15 and (peak - cells) / postings < 25      # 18 and 29 with wide runs and all impacts at once
    # blocks' maxima are those of the whole postings at once
    whole = np.maximum.reduceat(shard.impact(shard.tf, shard.norm[shard.block, shard.lane]), shard.run[:-1].astype(np.int64))
    assert np.allclose(shard.run_max, whole, rtol=1e-6)
