"""The prefix trie against a dictionary of prefixes, over any number of partitions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from prepkit.llm.queries import op12_prefix_trie
from prepkit.llm.trie import PrefixTrie, conversations, share_heads

SCHEMA = "conv_id long, turn long, role string, text string, key string, p int, node binary, depth string, turns int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows) -> dict[int, list]:
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in by.items()}


def rebuilt(convs) -> dict[int, list]:
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(convs) -> Counter:
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(own) - 1) * (len(node[-1][1]) if node else 0)
    return Counter((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids.get(node, ())), leaves[node], saved[node],
                    hashlib.sha256(",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node)).encode()).hexdigest()) for node, own in members.items())


@pytest.fixture(params=[1, 3, 40])
def parts(spark, request):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], str(request.param))
    spark.conf.set(keys[1], "false")
    yield request.param
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def some_rows(seed: int, n: int) -> list:
    rng, out = random.Random(seed), []
    for c in range(0, n * 7, 7):
        if rng.random() < 0.3:
            turns = [("user", "hot"), ("assistant", "same for all")]            # a hot conversation
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["a", "bb", "ccc", "é😀", None])) for _ in range(rng.choice([1, 2, 3, 4, 9]))]
        out += [(c, t if rng.random() < 0.95 else None, *x) for t, x in enumerate(turns)]
    out += [(100, t, "user", f"turn {t // 3}") for t in range(120)]              # a long one
    out += [(None, 0, "user", "nobody's"), (-5, 0, "user", "hot"), (7, 0, "user", "repeated"), (7, 0, "user", "repeated")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes(spark, parts, seed):
    rows = some_rows(seed, 150)
    df = spark.createDataFrame([(*r, "k", 1, b"n", "d", 2) for r in rows], SCHEMA).repartition(5)
    own = sequences(rows)
    assert Counter(map(tuple, PrefixTrie(conversations(df)).nodes().select(NAMES).collect())) == plain(own)
    df = df.where("conv_id is null or conv_id >= 0")     # the remainder of a negative id is another convention
    own.pop(-5)
    got = PrefixTrie(share_heads(conversations(df))).nodes()
    assert got.columns == NAMES and Counter(map(tuple, got.collect())) == plain(rebuilt(own))


def test_copies_of_one_conversation_over_many_partitions(spark, parts):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    got = PrefixTrie(conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).nodes()
    assert Counter(map(tuple, got.collect())) == plain(sequences(rows))


def test_conversations_without_turns_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations(empty).count() == 0 and PrefixTrie(share_heads(conversations(empty))).nodes().count() == 0
    some = spark.createDataFrame([(1, []), (2, None), (3, [("ab" * 16, 5)])], "conv_id long, turns array<struct<digest:string,size:long>>")
    got = {r.depth: r for r in PrefixTrie(some).nodes().collect()}
    assert (got[0].n_convs, got[0].n_children, got[0].n_leaves, got[0].ends_sha256) == (3, 1, 1, hashlib.sha256(b"1,2").hexdigest())
    assert (got[1].conv_id, got[1].parent_conv_id, got[1].n_convs) == (3, 1, 1)


def test_the_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, op12_prefix_trie(spark, sf).select(NAMES).collect())) == plain(rebuilt(sequences(rows)))
