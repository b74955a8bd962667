"""The Golay keys, the pigeonhole and the components, against brute force."""

from __future__ import annotations

import numpy as np

from prepkit.llm.components import components
from prepkit.llm.simhash import _PAIRS, golay, links, near_keys, segment


def test_the_code_is_perfect():
    _, _, near = golay()
    weights = np.bitwise_count(near[:, 0].astype(np.uint64))
    assert np.bincount(weights.astype(int)).tolist() == [1, 23, 253, 1771]
    assert {len(set(row)) for row in near.tolist()} == {1, 6}


def test_words_one_bit_apart_share_an_own_key():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    keys = near_keys(words)
    for bit in range(23):
        other = near_keys(words ^ (1 << bit))
        assert (keys == other[:, :1]).any(axis=1).all() and (other == keys[:, :1]).any(axis=1).all()


def test_every_pair_within_three_bits_meets():
    rng = np.random.default_rng(2)
    a = rng.integers(-2**63, 2**63 - 1, 50_000)
    flips = np.zeros(len(a), dtype=np.uint64)
    for _ in range(3):
        flips |= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    met = np.zeros(len(a), dtype=bool)
    for i, j in _PAIRS:
        left, right = (near_keys(segment(a, k)) for k in (i, j)), (near_keys(segment(b, k)) for k in (i, j))
        (a_i, a_j), (b_i, b_j) = left, right
        met |= (a_i == b_i[:, :1]).any(axis=1) & (b_j == a_j[:, :1]).any(axis=1)
    assert met.all()


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-2**63, 2**63 - 1, 20)
    prints = {int((np.array([c]).view(np.uint64) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 4)).astype(np.uint64), initial=np.uint64(0))).view(np.int64)[0])
              for c in centres for _ in range(12)}
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    assert {tuple(r) for r in links(df).collect()} == want and want


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + k) for k in range(1, 400)]
    loops = [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + hub + loops, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(301)}, **{1000 + k: 1000 for k in range(400)}, 6000: 6000, 6001: 6000}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
