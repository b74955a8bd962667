"""Starts by ranges of chunks, and shards drawn group by group."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from prepkit.llm.mixing import Mix, _starts


def test_starts_are_prefix_sums_whatever_the_range(spark):
    rng = np.random.default_rng(11)
    rows = [(s, int(c), int(rng.integers(0, 50))) for s, n in (("hot", 900), ("b", 40), ("n", 1)) for c in rng.choice(2_000, size=n, replace=False)]
    df = spark.createDataFrame(rows, "src string, chunk long, words long")
    want, at = {}, defaultdict(int)
    for s, c, w in sorted(rows):
        want[s, c] = at[s]
        at[s] += w
    for together in (1, 7, 4096):
        assert {(r.src, r.chunk): r.base for r in _starts(df, together).collect()} == want
    assert _starts(df.limit(0)).count() == 0


def test_every_slot_is_in_one_shard_and_shards_are_full(spark):
    rows = [(i, " ".join(["w"] * (i % 23)), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(docs, block_words=4, shard_words=64)
    slots = mix.slots.collect()
    for plan in mix.plans:
        _, turn, words = plan.taken(0, plan.slots)
        index = plan.taken(0, plan.slots)[0]
        assert Counter((s.block_index, s.turn, s.words) for s in slots if s.number == plan.number) == Counter(zip(index.tolist(), turn.tolist(), words.tolist()))
    sizes = Counter(s.shard for s in slots)
    assert len(sizes) > 20 and max(sizes.values()) == 16
    assert sorted(sizes) == list(range(len(sizes))) and sum(n < 16 for n in sizes.values()) <= 1      # whole groups: only the last is short
    # a shard's sources follow the mix: the hot one has a like share everywhere
    share = sum(s.number == 0 for s in slots) / len(slots)
    per = [np.mean([s.number == 0 for s in slots if s.shard == k]) for k in sizes]
    assert abs(np.mean(per) - share) < 0.1 and np.std(per) < 0.3
    assert Counter(mix.slots.collect()) == Counter(Mix(docs.repartition(7), block_words=4, shard_words=64).slots.collect())
