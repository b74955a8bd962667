"""Operator 1: exact top-k search, BM25 with block-max pruning per shard.

Documents become index shards where they are read (``shard_docs`` documents or
``shard_words`` words at most, never across tasks): sorted term digests, and
postings with term frequencies.  Document frequencies, the number of documents
and their mean length are summed over all shards, so every shard scores with
global statistics and the merge of the shards' top k is exact.

Queries go to every bundle of shards, as rows that stream past the bundle's index in
batches; the shards of a bundle are merged, so that a query has to find its terms once.
The WAND test is made for blocks of neighbouring documents, ``BLOCKS`` a bundle: a query
looks at a block only if the summed maxima of its terms there reach the k-th best score
that it has so far.  Each term has its largest impact in each block, so bounds need no
posting.  A query takes the blocks with the largest bounds first, which raises the score to
beat; postings of blocks below it are never read.  Where there are many bundles, some are
searched first, and queries come to the others with the k-th best scores of those.

In the blocks that are left, frequent terms are products of BLAS for all queries of a batch
that look there, and rare ones are counted from lists of places and short impacts.  Documents
that may still be among the k best are scored exactly.  What one query looks at
does not depend on the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from prepkit.llm.common import stage, text_of
from prepkit.session import ship_package

#: Documents of a block; a term is frequent in a shard if one in so many documents has it.
BLOCK, FREQUENT = 16, 16
#: Blocks of a shard, at most: in large shards a block has several times BLOCK documents.
BLOCKS = 64
#: Queries that go through a shard together, and terms of them.
TOGETHER, TERMS = 128, 1 << 15
#: Scores are rounded to so many digits before they are ranked; ties go to the smaller id.
DIGITS = 6
SLICE_BYTES = 1 << 20
#: Bytes of a word that its digest has numbers for; words whose digests are computed together.
WORD_BYTES, WORDS = 64, 1 << 17
SHARD_DOCS, SHARD_WORDS = 16_384, 8_000_000
#: Bundles of shards, at least, where there are so many shards; more than half as many again are searched in two turns.
SPREAD = 8
#: Runs of postings whose impacts are computed together; terms merged together; steps of a posting's impact.
RUNS, MERGED, UNITS = 1 << 16, 1 << 14, (1 << 16) - 1
#: Lists of so many postings on average are copied one by one, shorter ones by places.
LONG = 64


class Terms:
    """64-bit digests of the words (lower case, between ASCII white space) of texts.

    A word's digest is the exclusive or of one random number for each of its bytes and their places, so two words have the
    same one as seldom as by chance; words longer than the table have XXH64."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(42).integers(1, 1 << 64, size=(WORD_BYTES, 256), dtype=np.uint64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All digests, text after text, and where each text ends."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        ends = split.offsets.to_numpy()[1:].astype(np.int64) - int(split.offsets[0].as_py())
        digest, real = self._words(split.flatten())
        if not real.all():
            before = np.concatenate(([0], np.cumsum(real)))
            digest, ends = digest[real], before[ends]
        return digest, ends

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Digests, and which words are not empty."""
        _, offsets, data = words.buffers()
        offset = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int32)
        data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        out, real = np.empty(len(words), dtype=np.uint64), np.diff(offset) > 0
        for at in range(0, len(words), WORDS):
            start, end = offset[at:at + WORDS + 1][:-1].astype(np.int64), offset[at + 1:at + WORDS + 1].astype(np.int64)
            size = np.minimum(end - start, WORD_BYTES + 1).astype(np.uint16)
            order = np.argsort(size, kind="stable")[::-1]            # longest words first
            start, some = start[order], np.zeros(len(order), dtype=np.uint64)
            left = len(order) - np.cumsum(np.bincount(size, minlength=WORD_BYTES + 2))
            for place in range(WORD_BYTES):
                if not (n := int(left[place])):
                    break
                some[:n] ^= self.table[place].take(data.take(start[:n] + place))
            for i in range(int(left[WORD_BYTES])):
                some[i] = xxhash.xxh64_intdigest(data[start[i]:end[order[i]]].tobytes())
            out[at + order] = some
        return out, real


def _slices(texts: pa.Array):
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def _in_order(key: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each with its frequency; plain numbers are sorted faster than places."""
    bits = 64 - int(key.max(initial=0)).bit_length()
    if int(tf.max(initial=0)) >> bits:
        order = np.argsort(key, kind="stable")
        return key[order], tf[order]
    both = key << np.uint64(bits) | tf if bits < 64 else tf.astype(np.uint64)
    both.sort()
    return (both >> np.uint64(bits) if bits < 64 else np.zeros_like(both)), (both & np.uint64((1 << bits) - 1)).astype(tf.dtype)


def _pack(ids: list, digests: list[np.ndarray], lengths: list[np.ndarray]) -> tuple:
    """ids, lengths, terms, how many documents have each, documents and frequencies of one shard.  Documents
    are ordered by their most frequent word, then by length: neighbours are of one
    language and size, which keeps a block's maxima close to its documents.  Frequencies
    are as wide as the largest of them needs."""
    length = np.concatenate(lengths)
    coded = pa.array(np.concatenate(digests)).dictionary_encode()
    digests.clear()                                    # arrays as long as the shard's words go when they have served
    terms = coded.dictionary.to_numpy()
    order = np.argsort(terms)
    terms, number = terms[order], np.empty(len(terms), dtype=np.uint64)
    number[order] = np.arange(len(terms), dtype=np.uint64) << np.uint64(16)
    key = number.take(coded.indices.to_numpy())
    del coded, order, number
    key |= np.repeat(np.arange(len(length), dtype=np.uint16), length)
    key.sort()
    first = np.flatnonzero(np.concatenate((key[:1] == key[:1], key[1:] != key[:-1])))
    tf = np.diff(np.append(first, len(key))).astype(np.uint32)
    key = key[first]
    del first
    doc = (key & np.uint64(0xFFFF)).astype(np.uint16)
    most = doc.astype(np.uint64) << np.uint64(48)      # a document's terms by frequency, then by place
    most |= np.minimum(tf, 0xFFFF).astype(np.uint64) << np.uint64(32)
    most |= key >> np.uint64(16)
    most.sort()
    top = np.zeros(len(length), dtype=np.uint64)
    top[(most >> np.uint64(48)).astype(np.intp)] = most & np.uint64(0xFFFFFFFF)       # the last assignment is the most frequent
    del most
    rank = np.empty(len(length), dtype=np.uint64)
    placed = np.lexsort((length, top))
    rank[placed] = np.arange(len(length), dtype=np.uint64)
    key, tf = _in_order((key & np.uint64(0xFFFFFFFFFFFF0000)) | rank.take(doc), tf)      # postings by term, then by place
    del doc
    return ([ids[i] for i in placed], length[placed].astype(np.int64).tobytes(), terms.tobytes(),
            np.bincount((key >> np.uint64(16)).astype(np.intp), minlength=len(terms)).astype(np.uint32).tobytes(),
            (key & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), tf.astype(np.min_scalar_type(int(tf.max(initial=0)))).tobytes())


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard, written to the shared folder: ``part`` and ``turn`` name
    it; ids, lengths, terms, how many postings each has, documents, frequencies."""
    if shard_docs > 1 << 16:
        raise ValueError("places of a shard's documents are 16-bit numbers")
    ship_package(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), text_of(text_col).alias("text"))

    def run(batches):
        part, turn, terms = TaskContext.get().partitionId(), 0, Terms()
        ids: list = []
        digests: list = []
        lengths: list = []
        words = 0

        def close():
            nonlocal turn, words
            row = _pack(list(ids), digests, lengths)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([turn], pa.int64()), pa.array([row[0]], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in row[1:]]],
                names=["part", "turn", "ids", "lengths", "terms", "sizes", "docs", "tfs"])
            ids.clear(), digests.clear(), lengths.clear()
            pa.default_memory_pool().release_unused()      # the worker lives on, and searches next
            turn, words = turn + 1, 0
            return out

        for b in batches:
            for at, to in _slices(b.column(1)):
                digest, ends = terms.of(b.column(1).slice(at, to - at))
                ids += b.column(0).slice(at, to - at).to_pylist()
                digests.append(digest)
                lengths.append(np.diff(ends, prepend=0))
                words += len(digest)
                if len(ids) >= shard_docs or words >= shard_words:
                    yield close()
        if ids:
            yield close()

    return stage(src.mapInArrow(run, "part long, turn long, ids array<string>, lengths binary, terms binary, sizes binary, docs binary, tfs binary"), "bm25-index")


def _statistics(index: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Document frequency of each term; part, turn, documents and words of each shard."""
    def spread(batches):
        for b in batches:
            for terms, sizes in zip(b.column(0), b.column(1)):
                t, n = np.frombuffer(terms.as_py(), dtype=np.int64), np.frombuffer(sizes.as_py(), dtype=np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["term", "df"])

    def lengths(batches):
        for b in batches:
            got = [np.frombuffer(x.as_py(), dtype=np.int64) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in got], pa.int64()), pa.array([int(x.sum()) for x in got], pa.int64())], names=["part", "turn", "n", "words"])

    shards = index.select("part", "turn", "lengths").mapInArrow(lengths, "part long, turn long, n long, words long").collect()
    frequency = index.select("terms", "sizes").mapInArrow(spread, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return frequency, sorted(tuple(x) for x in shards)


def _bundles(shards: list[tuple[int, int, int, int]], bundle: float) -> list[tuple[int, int, int]]:
    """Part, turn and bundle of each shard: ``bundle`` full shards a bundle, less where there are few, and as many documents as places."""
    full = [max(n / SHARD_DOCS, words / SHARD_WORDS) for _, _, n, words in shards]
    most = 1.125 * min(bundle, sum(full) / SPREAD)          # an eighth more, as shards are closed when they are full
    out, number, held, docs = [], 0, 0.0, 0
    for (part, turn, n, _), share in zip(shards, full):
        if held and (held + share > most or docs + n > 1 << 16):
            number, held, docs = number + 1, 0.0, 0
        out.append((part, turn, number))
        held, docs = held + share, docs + n
    return out


def merge(rows: list[tuple]) -> tuple:
    """Several shards' rows as one; documents are ordered anew, by their most frequent word among the frequent ones, then by
    length.  The list is emptied, as the rows' bytes need not be held beside their copies."""
    if len(rows) == 1:
        return rows.pop()
    ids, length = [x for r in rows for x in r[0]], np.concatenate([np.frombuffer(r[1], dtype=np.int64) for r in rows])
    term = np.concatenate([np.frombuffer(r[2], dtype=np.uint64) for r in rows])
    size = np.concatenate([np.frombuffer(r[3], dtype=np.uint32) for r in rows]).astype(np.int64)
    before = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])
    docs = np.concatenate([np.frombuffer(r[4], dtype=np.uint16) + np.uint16(at) for r, at in zip(rows, before)])
    tfs = np.concatenate([np.frombuffer(r[5], dtype=f"u{len(r[5]) // max(len(r[4]) // 2, 1) or 1}") for r in rows])
    rows.clear()
    first = np.cumsum(size) - size
    order = np.argsort(term, kind="stable")
    term, size, first = term[order], size[order], first[order]
    del order
    heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.array([], dtype=np.int64)
    sizes = np.add.reduceat(size, heads) if len(heads) else size
    part = np.append(heads, len(term))
    top, most = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=tfs.dtype)
    for t in np.flatnonzero(sizes * FREQUENT >= len(ids)):
        p = slice(part[t], part[t + 1])
        at = _ranges(first[p], size[p])
        doc, tf = docs[at], tfs[at]
        more = tf > most[doc]
        top[doc[more]], most[doc[more]] = t, tf[more]
    placed = np.lexsort((length, top))
    rank = np.empty(len(ids), dtype=np.uint64)
    rank[placed] = np.arange(len(ids), dtype=np.uint64)
    out_docs, out_tfs, to = np.empty_like(docs), np.empty_like(tfs), 0
    for t in range(0, len(heads), MERGED):              # some terms at a time: keys are eight bytes a posting
        p = slice(part[t], part[min(t + MERGED, len(heads))])
        at = _ranges(first[p], size[p])
        key = np.repeat(np.arange(len(sizes[t:t + MERGED]), dtype=np.uint64) << np.uint64(16), sizes[t:t + MERGED])
        key, out_tfs[to:to + len(at)] = _in_order(key | rank.take(docs.take(at)), tfs.take(at))
        out_docs[to:to + len(at)] = key & np.uint64(0xFFFF)
        to += len(at)
    return [ids[i] for i in placed], length[placed].tobytes(), term[heads].tobytes(), sizes.astype(np.uint32).tobytes(), memoryview(out_docs).cast("B"), memoryview(out_tfs).cast("B")


class Shard:
    """One shard's index, or that of several (``merge``); a posting's BM25 impact is its score beside the idf.

    Documents lie in blocks, ``BLOCKS`` at most: of ``BLOCK`` documents in small shards, of a multiple in large ones.
    Postings lie by term, then by place, with their impacts in ``UNITS`` steps, rounded up; each (term, block) run of them has its
    largest impact.  Frequent terms also have, in each block that has them, a column with a cell for each document, so that
    what they give many queries in a block is one product.  ``blocks`` and ``postings`` (those of rare terms) count what
    the steps of searches look at, ``all_blocks`` and ``all_postings`` what they would without pruning."""

    def __init__(self, ids, lengths, terms, sizes, docs, tfs, mean: float, k1: float, b: float):
        self.ids, self.n, self.k1, self.unit = np.array(ids, dtype=object), len(ids), k1, (k1 + 1) / UNITS
        self.width = BLOCK * max(1, -(-self.n // (BLOCK * BLOCKS)))
        self.n_blocks = -(-self.n // self.width)
        self.norm = np.ones(self.n_blocks * self.width)
        self.norm[:self.n] = k1 * (1 - b + b * np.frombuffer(lengths, dtype=np.int64) / max(mean, 1e-9))
        self.norm = self.norm.reshape(self.n_blocks, self.width)
        self.terms = np.frombuffer(terms, dtype=np.uint64)
        size = np.frombuffer(sizes, dtype=np.uint32).astype(np.int64)
        first = np.cumsum(size) - size
        docs = np.frombuffer(docs, dtype=np.uint16)
        self.tf = np.frombuffer(tfs, dtype=f"u{len(tfs) // max(len(docs), 1) or 1}")
        block = (docs // self.width).astype(np.uint8)
        change = np.ones(len(docs), dtype=bool)
        change[1:] = block[1:] != block[:-1]
        change[first] = True
        self.run = np.append(np.flatnonzero(change).astype(np.uint32), np.uint32(len(docs)))      # where each run of a term in a block starts
        del change
        self.run_block = block[self.run[:-1]]
        del block
        self.run_max = np.empty(len(self.run) - 1, dtype=np.float32)
        self.posting = np.empty(len(docs), dtype=np.uint32)            # place and impact
        for at in range(0, len(self.run_max), RUNS):                   # some at a time: impacts are eight bytes a posting
            starts = self.run[at:at + RUNS + 1].astype(np.int64)
            p = slice(starts[0], starts[-1])
            impact = self.impact(self.tf[p], self.norm.ravel()[docs[p]])
            self.run_max[at:at + RUNS] = np.maximum.reduceat(impact, starts[:-1] - starts[0])
            self.posting[p] = docs[p].astype(np.uint32) << 16 | np.minimum(np.ceil(impact / self.unit), UNITS).astype(np.uint32)
        self.lists = memoryview(self.posting)
        self.runs = np.searchsorted(self.run, np.append(first, len(docs)).astype(np.uint32)).astype(np.uint32)      # and where each term's runs do
        self.column = np.full(len(self.terms), -1, dtype=np.int32)
        often = np.flatnonzero(size * FREQUENT >= max(self.n, BLOCK))
        self.column[often] = np.arange(len(often))
        has = np.zeros((self.n_blocks, len(often)), dtype=bool)
        for c, t in enumerate(often):
            has[self.run_block[self.runs[t]:self.runs[t + 1]], c] = True
        # the frequent terms of each block, where their columns start, and the column of each (of one that it lacks: the last, of zeros)
        self.here = [np.flatnonzero(x) for x in has]
        self.starts = np.append(0, np.cumsum(has.sum(axis=1)))
        self.cell = np.where(has, np.cumsum(has).reshape(has.shape) - 1, self.starts[-1])
        columns, most = int(self.starts[-1]) + 1 if len(often) else 0, int(self.tf.max(initial=0))
        self.dense = np.zeros((columns, self.width), dtype=np.min_scalar_type(most)).T      # bytes, if no document has a word 256 times
        for c, t in enumerate(often):
            p = slice(first[t], first[t] + size[t])
            row, lane = np.divmod(docs[p].astype(np.int64), self.width)
            self.dense[lane, self.cell[row, c]] = self.tf[p]
        self.short = np.zeros((columns, self.width), dtype=np.float32).T
        self.maxima = np.zeros(has.shape, dtype=np.float32)
        for row, x in enumerate(self.here):
            p = slice(self.starts[row], self.starts[row + 1])
            self.short[:, p] = self.impact(self.dense[:, p], self.norm[row][:, None])
            self.maxima[row, x] = self.short[:, p].max(axis=0)
        self.blocks = self.all_blocks = self.postings = self.all_postings = 0

    @property
    def block(self) -> np.ndarray:
        return (self.posting >> 16) // self.width

    @property
    def lane(self) -> np.ndarray:
        return (self.posting >> 16) % self.width

    def impact(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + norm)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (digests, idfs): the documents (by place) with the k best
        scores above 0, and those that tie with the last; their rounded scores.  ``floor``
        has scores that k documents elsewhere have already: documents below may be left out.

        Queries take their steps together, so that a block's frequent terms are one product for all that look at it."""
        if not queries:
            return []
        terms, idf = np.concatenate([t for t, _ in queries]), np.concatenate([x for _, x in queries])
        query = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        asked, of = np.unique(terms, return_inverse=True)
        place = np.searchsorted(self.terms, asked)
        here = place < len(self.terms)
        here[here] = self.terms[place[here]] == asked[here]
        known = np.flatnonzero(here[of])
        query, idf, place = query[known], idf[known], place[of[known]]
        column = self.column[place]
        often, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        weight = np.zeros((len(queries), self.maxima.shape[1]), dtype=np.float32)
        weight[query[often], column[often]] = idf[often]
        first = self.runs[place[rare]].astype(np.int64)
        count = self.runs[place[rare] + 1] - first
        run, pair = _ranges(first, count), np.repeat(rare, count)
        block, give = self.run_block.take(run), idf.take(pair)
        at = query.take(pair)
        bounds = np.bincount(at * self.n_blocks + block, weights=self.run_max.take(run) * give, minlength=len(queries) * self.n_blocks).reshape(len(queries), -1)
        bounds = bounds + weight @ self.maxima.T
        self.all_blocks += bounds.size
        self.all_postings += int((self.run.take(self.runs[place[rare] + 1]) - self.run.take(first)).sum(dtype=np.int64))
        turn = np.arange(len(queries) + 1)
        runs, columns = np.searchsorted(at, turn), np.searchsorted(query[often], turn)
        ways = [_Way(self, bounds[i], run[a:b], block[a:b], pair[a:b], give[a:b], column[often[c:d]], idf[often[c:d]], k, 0.0 if floor is None else floor[i])
                for i, a, b, c, d in zip(turn, runs, runs[1:], columns, columns[1:])]
        while True:
            rows = [w.step() for w in ways]
            count = [len(r) for r in rows]
            if not sum(count):
                return [w.exact() for w in ways]
            looks = self._often(np.concatenate(rows), np.repeat(turn[:-1], count), weight)
            for w, r, look in zip(ways, rows, np.split(looks, np.cumsum(count)[:-1])):
                if len(r):
                    w.look(r, look)

    def _often(self, blocks: np.ndarray, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What frequent terms give the documents of a block, for each pair of a block and a query, in short floats."""
        out = np.zeros((len(blocks), self.width), dtype=np.float32)
        order = np.argsort(blocks, kind="stable")
        for pairs in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            row = blocks[pairs[0]]
            if len(self.here[row]):
                out[pairs] = weight[query[pairs][:, None], self.here[row]] @ self.short.T[self.starts[row]:self.starts[row + 1]]
        return out


class _Way:
    """One query's way through a shard: the blocks it has not looked at, and the documents that may be among the k best.

    It looks at some blocks with the largest bounds (summed maxima of its terms), which gives a score to beat, then at
    all others that may reach it.  Documents are looked at in short numbers, ``slack`` away from their scores at most."""

    def __init__(self, shard: Shard, bound: np.ndarray, run: np.ndarray, block: np.ndarray, pair: np.ndarray, idf: np.ndarray, columns: np.ndarray, often: np.ndarray, k: int, least: float):
        self.shard, self.bound, self.run, self.block, self.pair, self.idf = shard, bound, run, block, pair, idf
        self.columns, self.often, self.k, self.least = columns, often, k, least
        new = np.ones(len(pair), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        self.slack = 1e-3 + 3e-5 * bound.max(initial=0.0) + shard.unit * idf[new].sum()
        self.some = -(-max(k, shard.n // 16) // shard.width)
        self.docs, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)

    def step(self) -> np.ndarray:
        """The next blocks to look at."""
        rows = np.flatnonzero((self.bound >= self.least - self.slack) & (self.bound > 0))
        if not self.least and len(rows) > self.some:
            rows = np.sort(rows[np.argsort(-self.bound[rows], kind="stable")[:self.some]])
            self.some *= 4
        self.bound[rows] = 0
        self.shard.blocks += len(rows)
        return rows

    def _segments(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the postings of rare terms in the blocks ``rows`` begin, how many they are, neighbouring runs of a term at once; idfs."""
        wanted = np.zeros(self.shard.n_blocks, dtype=bool)
        wanted[rows] = True
        here = np.flatnonzero(wanted.take(self.block))
        run, pair = self.run.take(here), self.pair.take(here)
        new = np.ones(len(here) + 1, dtype=bool)
        new[1:-1] = (run[1:] != run[:-1] + 1) | (pair[1:] != pair[:-1])
        heads = np.flatnonzero(new)
        first = self.shard.run.take(run.take(heads[:-1])).astype(np.int64)
        return first, self.shard.run.take(run.take(heads[1:] - 1) + 1) - first, self.idf.take(here.take(heads[:-1]))

    def _rare(self, rows: np.ndarray) -> np.ndarray:
        """What rare terms give the documents of the blocks ``rows``; other blocks' postings are passed over."""
        shard = self.shard
        first, count, idf = self._segments(rows)
        total = int(count.sum())
        shard.postings += total
        if total > LONG * len(first):
            lists = shard.lists
            posting = np.frombuffer(b"".join([lists[a:b] for a, b in zip(first.tolist(), (first + count).tolist())]), dtype=np.uint32)
        else:
            posting = shard.posting.take(_ranges(first, count))
        give = np.repeat(idf * shard.unit, count)
        give *= posting & UNITS
        return np.bincount(posting >> 16, weights=give, minlength=shard.norm.size).reshape(shard.norm.shape)[rows]

    def look(self, rows: np.ndarray, look: np.ndarray) -> None:
        look += self._rare(rows)
        flat = look.ravel()
        least = self.least - self.slack
        at = np.flatnonzero(flat >= least) if least > 0 else np.flatnonzero(flat > 0)
        self.docs = np.append(self.docs, rows[at // self.shard.width] * self.shard.width + at % self.shard.width)
        self.scores = np.append(self.scores, flat.take(at))
        if len(self.docs) >= self.k:
            self.least = max(self.least, float(np.partition(self.scores, -self.k)[-self.k]) - self.slack)
            stay = self.scores >= self.least - self.slack
            self.docs, self.scores = self.docs[stay], self.scores[stay]

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents with the k best scores, and those that tie with the last; exact scores."""
        shard, docs = self.shard, self.docs
        if not len(docs):
            return docs, np.zeros(0)
        block, lane = np.divmod(docs, shard.width)
        number = np.full(shard.norm.size, -1)
        number[docs] = np.arange(len(docs))
        first, count, idf = self._segments(np.unique(block))
        at = _ranges(first, count)
        row = number.take(shard.posting.take(at) >> 16)
        here = np.flatnonzero(row >= 0)
        at, row = at.take(here), row.take(here)
        norm = shard.norm[block, lane]
        rare = np.bincount(row, weights=shard.impact(shard.tf.take(at), norm.take(row)) * np.repeat(idf, count).take(here), minlength=len(docs))
        tf = shard.dense[lane[:, None], shard.cell[block[:, None], self.columns]]
        scores = np.round(rare + shard.impact(tf, norm[:, None]) @ self.often, DIGITS)
        least = np.partition(scores, -self.k)[-self.k] if len(docs) > self.k else 0
        stay = (scores >= least) & (scores > 0)
        return docs[stay], scores[stay]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first, first + 1 ...``, ``count`` of each."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def search(df: DataFrame, queries: Column, id_col: str = "doc_id", text_col: str = "text", k: int = 10,
           k1: float = 1.2, b: float = 0.75, bundle: int = 2) -> DataFrame:
    """The k best documents of all rows of ``df`` for each row that ``queries``
    holds for: ``query_id, rank, doc_id, score`` (ids of the type of ``id_col``).

    A query is the set of the words of its row's whole text; its own document takes
    part.  Scores are BM25 with the plus-one idf, rounded to six digits; ties go to the
    smaller id, and equal (id, score) rows of repeated ids each count.  Only scores
    above 0 are listed, so a query without words (or with a NULL text) has no rows;
    queries with NULL ids are left out.  Words are told apart by 64-bit digests.
    A task holds ``bundle`` full shards, and queries are sent once to each bundle: to some
    bundles first, and with the k-th best scores of these to the others.
    """
    spark = df.sparkSession
    ship_package(spark)
    kind = df.schema[id_col].dataType.simpleString()
    index = build_index(df, id_col, text_col)
    frequency, shards = _statistics(index)
    n = sum(x[2] for x in shards)
    mean = sum(x[3] for x in shards) / max(n, 1)
    held = _bundles(shards, bundle)
    bundles = held[-1][2] + 1 if held else 0
    first = SPREAD if bundles > SPREAD * 3 // 2 else bundles

    def words(batches):
        terms = Terms()
        for b in batches:
            digest, ends = terms.of(b.column(1))
            of = np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0))
            pair = np.unique(np.rec.fromarrays((of, digest)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pair.f0)), pa.array(pair.f1.view(np.int64) if len(pair) else np.array([], dtype=np.int64))], names=["id", "term"])

    asked = (df.where(queries).select(F.col(f"`{id_col}`").cast("string").alias("id"), text_of(text_col).alias("text")).where("id is not null")
             .mapInArrow(words, "id string, term long").distinct())
    asked = (asked.join(frequency, "term").groupBy("id")
             .agg(F.sort_array(F.collect_list(F.struct("term", F.col("df").cast("int").alias("df")))).alias("q")).select("id", "q.term", "q.df"))
    if first < bundles:
        asked = stage(asked, "bm25-asked")
    empty = {"ids": "array<string>", "lengths": "binary", "terms": "binary", "sizes": "binary", "docs": "binary", "tfs": "binary"}
    places = spark.createDataFrame(held, "part long, turn long, bundle int")
    index = index.join(F.broadcast(places), ["part", "turn"])

    def run(batches):
        rows, shards, waiting, terms = [], [], [], 0

        def answer():
            nonlocal terms
            while rows:          # one shard of them, or as many as there must be
                some = [rows.pop(0)]
                while rows and sum(len(r[0]) for r in some) + len(rows[0][0]) <= 1 << 16:
                    some.append(rows.pop(0))
                shards.append(Shard(*merge(some), mean, k1, b))
                pa.default_memory_pool().release_unused()
            floor = np.array([x[2] for x in waiting])
            best = [np.zeros(0)] * len(waiting)
            of, docs, scores = [], [], []
            for shard in shards:
                for i, (at, score) in enumerate(shard.search([x[1] for x in waiting], k, floor)):
                    if len(at):
                        of.append(np.full(len(at), i)), docs.append(shard.ids[at]), scores.append(score)
                        best[i] = np.sort(np.append(best[i], score))[-k:]
                        if len(best[i]) == k:
                            floor[i] = max(floor[i], best[i][0])
            ids = np.array([x[0] for x in waiting], dtype=object)
            waiting.clear()
            terms = 0
            found = [np.concatenate(x) if of else np.zeros(0, dtype=kind) for x, kind in ((of, int), (docs, object), (scores, float))]
            return pa.RecordBatch.from_arrays([pa.array(ids[found[0]], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())],
                                              names=["query_id", "doc_id", "score"])

        for batch in batches:
            kinds, names, least = (batch.column(c).to_pylist() for c in ("kind", "id", "least"))
            (term, ends), (df, _) = ((batch.column(c).values.to_numpy(), batch.column(c).offsets.to_numpy()) for c in ("q_term", "q_df"))
            came = []
            for i, kind in enumerate(kinds):
                if kind == 0:
                    rows.append(tuple(batch.column(c)[i].as_py() for c in empty))
                else:
                    p = slice(ends[i], ends[i + 1])
                    came.append((names[i], (term[p].astype(np.uint64), np.log(1 + (n - df[p] + 0.5) / (df[p] + 0.5))), least[i]))
            del batch, term, df, ends              # copied; shards are built and searched without it
            for q in came:
                waiting.append(q)
                terms += len(q[1][0])
                if len(waiting) == TOGETHER or terms >= TERMS:
                    yield answer()
        if waiting:
            yield answer()

    def turn(begin: int, end: int, asked: DataFrame) -> DataFrame:
        """What the bundles from ``begin`` to ``end`` find."""
        rows = index.where(f"bundle >= {begin} and bundle < {end}").select(F.col("bundle") - begin, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("least"), *empty,
                                                                    F.lit(None).cast("array<long>").alias("q_term"), F.lit(None).cast("array<int>").alias("q_df"))
        rows = rows.toDF("bundle", *rows.columns[1:]).unionByName(asked.select(
            F.explode(F.sequence(F.lit(0), F.lit(end - begin - 1))).alias("bundle"), F.lit(1).alias("kind"), "id", "least",
            *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.col("term").alias("q_term"), F.col("df").alias("q_df")))
        # a partition for each bundle, by number: hashed numbers would put several into one task
        return rows.repartitionById(end - begin, F.col("bundle")).sortWithinPartitions("kind").mapInArrow(run, "query_id string, doc_id string, score double")

    if not bundles:
        found = spark.createDataFrame([], "query_id string, doc_id string, score double")
    else:
        found = turn(0, first, asked.withColumn("least", F.lit(0.0)))
    if first < bundles:
        found = stage(found, "bm25-found")
        least = found.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("id", F.get("s", F.lit(k - 1)).alias("least"))
        found = found.unionByName(turn(first, bundles, asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))))
    found = found.withColumns({"query_id": F.col("query_id").cast(kind), "doc_id": F.col("doc_id").cast(kind)})
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
