"""Block-max pruning: what a shard's search skips, and that it finds the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from prepkit.llm.bm25 import BLOCK, DIGITS, Shard, Terms, _pack

K, MEAN_K1_B = 10, (1.2, 0.75)


def shard_of(texts):
    digest, ends = Terms().of(pa.array(texts))
    length = np.diff(ends, prepend=0)
    mean = len(digest) / len(texts)
    return Shard(*_pack([str(i) for i in range(len(texts))], [digest], [length]), mean, *MEAN_K1_B), np.split(digest, ends[:-1]), mean


def plain(docs, mean, query, idf):
    k1, b = MEAN_K1_B
    out = []
    for words in docs:
        tf = (words[:, None] == query[None, :]).sum(axis=0)
        out.append(round(float((tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean)) * idf).sum()), DIGITS))
    return np.array(out)


def asked(docs, at):
    terms, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    idf = dict(zip(terms.tolist(), np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))))
    return [(np.unique(docs[i]), np.array([idf[t] for t in np.unique(docs[i]).tolist()])) for i in at]


def test_pruned_search_finds_what_scoring_all_documents_finds():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts = [t or "" for t in texts]
    shard, docs, mean = shard_of(texts)
    queries = asked(docs, range(0, len(texts), 100))
    found = shard.search(queries, K)
    for (query, idf), (places, scores) in zip(queries[:8], found):
        want = plain(docs, mean, query, idf)
        last = np.sort(want)[-K]
        assert sorted(shard.ids[places].tolist()) == sorted(str(i) for i in np.flatnonzero((want >= max(last, 1e-6))))
        assert np.allclose(np.sort(scores)[::-1][:K], np.sort(want)[::-1][:K])
    # each query skips blocks and rare postings by its own threshold, whatever is asked with it
    assert shard.all_blocks == len(queries) * -(-len(texts) // BLOCK)
    print("blocks", shard.blocks / shard.all_blocks, "postings", shard.postings / shard.all_postings)
    assert shard.blocks < 0.6 * shard.all_blocks and shard.postings < shard.all_postings
    read = shard.blocks
    alone, _, _ = shard_of(texts)
    for q in queries:
        alone.search([q], K)
    assert alone.blocks == read


def test_a_floor_from_an_earlier_shard_is_kept_to():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, size=rng.integers(0, 60)) % 997) for _ in range(3_000)]
    shard, docs, mean = shard_of(texts)
    queries = asked(docs, range(0, 3_000, 250))
    free = shard.search(queries, K)
    read, shard.blocks = shard.blocks, 0
    floor = np.array([np.sort(s)[-3] if len(s) >= 3 else 0.0 for _, s in free])
    held = shard.search(queries, K, floor)
    for (a, x), (b, y), f in zip(free, held, floor):
        assert set(a[x >= f].tolist()) <= set(b.tolist())
    assert shard.blocks <= read
    for (query, idf), (places, scores) in zip(queries, free):
        want = plain(docs, mean, query, idf)
        last = np.sort(want)[-K]
        assert sorted(shard.ids[places].tolist()) == sorted(str(i) for i in np.flatnonzero((want >= last) & (want > 0)))


def test_shards_without_documents_words_or_matches():
    shard, _, _ = shard_of(["", ""])
    nothing = (np.array([7], dtype=np.uint64), np.array([1.0]))
    assert [len(d) for d, _ in shard.search([nothing, (nothing[0][:0], nothing[1][:0])], K)] == [0, 0]
    shard, docs, _ = shard_of(["only one"] * 3)
    (places, scores), = shard.search([(docs[0], np.ones(2))], K)
    assert sorted(places.tolist()) == [0, 1, 2] and len(set(scores.tolist())) == 1


def test_runs_know_their_blocks_and_a_shard_may_lack_frequent_terms():
    texts = [f"w{i} v{i // 2} u{i // 3}" for i in range(200)]           # no word in a sixteenth of the documents
    digest, ends = Terms().of(pa.array(texts))
    length = np.diff(ends, prepend=0)
    shard = Shard(*_pack([str(i) for i in range(200)], [digest], [length]), 3.0, 1.2, 0.75)
    assert shard.dense.shape[1] == 0 and (shard.run_block == shard.block[shard.run[:-1]]).all()
    for i, q in enumerate(np.split(digest, ends[:-1])[:40]):
        docs, scores = shard.search([(np.unique(q), np.ones(3))], 1)[0]
        assert str(i) in shard.ids[docs].tolist() and (scores > 0).all()
