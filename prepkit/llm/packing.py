"""Operator 4: hierarchical multi-length packing of tokenised documents.

Each task reads its documents once, as a stream: it tokenises them, routes
what a document has beyond whole top-tier windows to the smallest tier that
holds it, fills each tier's windows (the gap of a window first by whole
shorter pieces, then by a cut piece of the exact size), and writes the
pieces.  Sequences have the tiers' lengths, powers of two, without padding;
the last tokens of a task are cut by the binary digits of their number.
There is no shuffle, and a task holds one slice of texts and less than one
window a tier of tokens that wait.

A word's ids depend only on the word (the tokenizer drops white space), so
each task tokenises the distinct words of a slice and gathers ids by word;
texts that hold ``<|`` go through the tokenizer whole, for its special ids.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from prepkit.llm.common import text_of
from prepkit.session import ship_package

#: Text handled at a time, in bytes; distinct words whose ids a task remembers.
SLICE_BYTES, WORDS_KEPT = 4 << 20, 300_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet for the Latin-1 letters: visible bytes stand for
    themselves, the others for code points from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in seen)}
    return {c: "".join(chr(other.get(b, b)) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class WordTokenizer:
    """Token ids of whole texts by a tokenizer file, word by word."""

    #: A boundary that the tokenizer always makes: after a plain letter or digit, before ASCII punctuation.
    CUT = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, name: str):
        from tokenizers import Tokenizer
        if "/" not in name:
            import public_tokenizers
            name = public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(name)
        self.model, self.letters, self.ids = self.whole.model, _byte_letters(), {}

    def _word(self, word: str) -> bytes:
        if self.PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word.lower().translate(self.letters))]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text (no NULLs), with ``end`` after them."""
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, self.CUT, r"\1 \2"))
        words = cut.flatten().dictionary_encode()
        known, parts = self.ids, []
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words.dictionary.to_pylist():
            if (b := known.get(w)) is None:
                b = known[w] = self._word(w)
            parts.append(b)
        size = np.fromiter((len(b) >> 2 for b in parts), dtype=np.int64, count=len(parts))
        flat, first = np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum(size) - size
        word = words.indices.to_numpy(zero_copy_only=False)
        took = size[word]
        ends = np.cumsum(took)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[word] - (ends - took), took)]
        ends = np.concatenate(([0], ends))
        lists = cut.offsets.to_numpy()
        at = ends[lists - lists[0]]
        last = np.array([end], dtype="<u4")
        out = [np.concatenate((ids[a:b], last)) for a, b in zip(at[:-1], at[1:])]
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)):
            out[i] = np.array([*self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, end], dtype="<u4")
        return out


class Packer:
    """Packs pieces of documents into windows of the ``tiers``' lengths.  An item
    is (length, number, document, start); ``out`` gets a row for each piece:
    (document, start, length, sequence, offset, tier, group)."""

    def __init__(self, tiers: Sequence[int], group_tokens: int, first_id: int):
        self.tiers, self.top, self.group_tokens = sorted(tiers), max(tiers), group_tokens
        self.pool: dict[int, list] = {t: [] for t in self.tiers}
        self.sequences = self.groups = first_id
        self.number, self.open, self.out = 0, {}, []

    def _put(self, doc, start: int, length: int) -> None:
        if length:
            tier = next(t for t in self.tiers if t >= length)
            self.number += 1
            insort(self.pool[tier], (length, self.number, doc, start))

    def add(self, doc, length: int) -> None:
        whole = length - length % self.top
        for start in range(0, whole, self.top):
            self._emit(self.top, [(doc, start, self.top)])
        self._put(doc, whole, length - whole)

    def _emit(self, tier: int, parts: list) -> None:
        """A sequence; it joins the open step group of its tier, which closes when
        it has ``group_tokens`` tokens, so that all groups weigh the same."""
        group, left = self.open.pop(tier, (None, self.group_tokens))
        if group is None:
            group, self.groups = self.groups, self.groups + 1
        if left > tier:
            self.open[tier] = (group, left - tier)
        offset = 0
        for doc, start, length in parts:
            self.out.append((doc, start, length, self.sequences, offset, tier, group))
            offset += length
        self.sequences += 1

    def pack(self) -> None:
        """Fill windows from the longest tier down, as long as there is enough to fill them."""
        for tier in reversed(self.tiers):
            held = sum(x[0] for t in self.tiers if t <= tier for x in self.pool[t])
            while self.pool[tier] and held >= tier:
                parts, gap = [], tier
                length, _, doc, start = self.pool[tier].pop()
                parts.append((doc, start, length))
                gap -= length
                while gap:
                    found = self._fill(tier, gap)
                    parts.append(found)
                    gap -= found[2]
                held -= tier
                self._emit(tier, parts)

    def _fill(self, tier: int, gap: int) -> tuple:
        below = [t for t in self.tiers if t <= tier]
        for t in reversed(below):
            pool = self.pool[t]
            if pool and pool[0][0] <= gap:
                length, _, doc, start = pool.pop(bisect_right(pool, gap, key=lambda x: x[0]) - 1)
                return doc, start, length
        for t in below:
            if self.pool[t]:
                length, _, doc, start = self.pool[t].pop(0)
                self._put(doc, start + gap, length - gap)
                return doc, start, gap
        raise AssertionError("a window was opened without enough to fill it")

    def waiting(self) -> list:
        return [x[2] for t in self.tiers for x in self.pool[t]]

    def finish(self) -> None:
        """Pack the rest into windows of powers of two, by the binary digits of its length."""
        self.pack()
        rest = [(d, s, n) for t in reversed(self.tiers) for n, _, d, s in self.pool[t]]
        self.pool = {t: [] for t in self.tiers}
        left = sum(x[2] for x in rest)
        while left:
            tier, parts = min(self.top, 1 << (left.bit_length() - 1)), []
            gap = tier
            while gap:
                doc, start, n = rest.pop(0)
                parts.append((doc, start, min(n, gap)))
                if n > gap:
                    rest.insert(0, (doc, start + gap, n - gap))
                gap -= min(n, gap)
            self._emit(tier, parts)
            left -= tier


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (id, text) cut into slices of about SLICE_BYTES of text."""
    for b in batches:
        if not b.num_rows:
            continue
        total = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield b.slice(at, to - at)
            at = to


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
                   end: int = 1, tiers: Sequence[int] = (256, 512, 1024, 2048), group_tokens: int = 16_384,
                   with_ids: bool = False) -> DataFrame:
    """Pack the documents' token ids into sequences.

    A document is the ids of its whole text, then ``end``; NULL and empty texts
    are the one id ``end``.  A row per piece: the id column, ``start`` (the
    document's ids before it), ``length``, ``ids_crc32`` (of the ids as unsigned
    little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset``
    (in the sequence, without gaps from 0), ``tier`` (the sequence's length, a
    power of two, so no padding), ``step_group`` (sequences of one tier,
    ``group_tokens`` tokens in all), and ``ids`` if asked for.  ``tiers`` are
    powers of two.  Rows that share an id are packed as separate documents; an
    empty table gives no rows; other columns are ignored.
    """
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError(f"tiers must be powers of two: {tiers}")
    ship_package(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, tier long, step_group long" + ", ids array<int>" * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer(tokenizer)
        packer, held, number = Packer(tiers, group_tokens, TaskContext.get().partitionId() << 33), {}, 0
        id_type = None

        def drain():
            rows, packer.out = packer.out, []
            for i in range(0, len(rows), 20_000):
                part = rows[i:i + 20_000]
                ids = [held[r[0]][1][r[1]:r[1] + r[2]] for r in part]
                cols = [pa.array([held[r[0]][0] for r in part], type=id_type),
                        *[pa.array([r[k] for r in part], type=pa.int64()) for k in (1, 2)],
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], type=pa.int64()),
                        pa.array([len(held[r[0]][1]) for r in part], type=pa.int64()),
                        *[pa.array([r[k] for r in part], type=pa.int64()) for k in (3, 4, 5, 6)]]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], type=pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            wait = set(packer.waiting())
            for k in [k for k in held if k not in wait]:
                del held[k]

        for b in slices(batches):
            id_type = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1), end)):
                held[number] = (doc, ids)
                packer.add(number, len(ids))
                number += 1
            packer.pack()
            yield from drain()
        packer.finish()
        if packer.out:
            yield from drain()

    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)
