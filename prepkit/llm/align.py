"""Operator 13: cross-tokenizer alignment over tokenizer spans.

Two tokenizers cut one text, a space and then the text.  A token's span in characters
or bytes is a coarse cut: the byte-level one (A) reports character offsets, so the
parts of a character that it splits share its span; the piece one (B) reports spans
in bytes that give a character's bytes no place of their own where it falls back to
bytes.  A span that does not end its character, or does not hold the token's bytes, is refined by the bytes
that the token stands for: a run of such tokens is laid out byte by byte.  Byte offsets where tokens of
both end cut them into groups, and the two tokens that end there are linked.

The work is done once for each distinct segment of a slice of texts.  A text is
cut where white space (U+0020) follows anything else: both tokenizers always cut there
(A's pre-tokens begin with at most one space, B has no piece with a space after
another character, which is checked), so the segments' tokens, one after another, are the text's.

Corpus-wide counts: the linked tokens end together, so the shorter one's bytes end
the longer one's.  Such pairs of entries are a fixed number that the two
vocabularies alone decide (``possible_pairs``, some 500,000 for the public ones),
whatever the corpus; the counts of all pairs are therefore bounded, and go to the tasks that mark each link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from prepkit.llm.common import stage, text_of
from prepkit.llm.packing import slices
from prepkit.session import ship_package

#: Segments begin at a space (or spaces) between other characters.
SEGMENT = regex.compile(r"(?<=\S)(?= +[^ ])")
#: ASCII white space; a text that has none of it before a space is cut at all its spaces.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
#: Segments whose alignment a task remembers, and the longest of them, in characters.
KEPT, LONGEST_KEPT = 600_000, 64
#: Counts of pairs, slice by slice, that a task adds up together.
SUMMED = 1 << 20
#: Characters of new segments that are tokenised together.
POOL = 1 << 15


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: visible bytes stand for
    themselves, the others for code points from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}


class Vocabularies:
    """The two tokenizers and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer
        where = [p if "/" in p else public_tokenizers.path(p) for p in (a_path, b_path)]
        self.a = Tokenizer.from_file(where[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=where[1])
        alphabet = byte_alphabet()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes: dict[int, bytes] = {i: bytes(map(alphabet.__getitem__, t)) if i not in special else t.encode() for t, i in self.a.get_vocab().items()}
        self.n_b = self.b.vocab_size()
        pieces = list(map(self.b.id_to_piece, range(self.n_b)))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.a_text, self.b_text = list(map(str, range(len(self.a_size)))), list(map(str, range(self.n_b)))
        #: A link's code: its A id times B's entries plus its B id.
        self.code = "<u4" if len(self.a_size) * self.n_b < 1 << 32 else "<i8"
        self.width = int(self.code[-1])
        #: Pieces that reach over a space would tie segments together; texts are then one segment.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple] = {}

    def segments(self, text: str) -> list[str]:
        if not self.cuts:
            return [" " + text]
        if not text.isascii() or text[:1].isspace() or text[-1:] == " " or any(c + " " in text for c in WHITE):
            return SEGMENT.split(" " + text)
        return [" " + part for part in text.split(" ")]         # every space stands between other characters

    def align(self, segments: list[str]) -> list[tuple | None]:
        """For each segment (n_a, n_b, n_links, groups as text, link codes as bytes), or None
        where the tokens of one side do not join to the segment.  Segments that begin
        with a space and end with anything else are tokenised together, many in a row."""
        found: dict[str, tuple | None] = {}
        pool, size = [], 0
        for s in segments:
            if not self.cuts or s[-1:].isspace() or s[:1] != " ":
                found[s] = self._align([s])[0]
                continue
            pool.append(s)
            size += len(s)
            if size >= POOL:
                found.update(zip(pool, self._align(pool)))
                pool, size = [], 0
        if pool:
            found.update(zip(pool, self._align(pool)))
        return [found[s] for s in segments]

    def _align(self, segments: list[str]) -> list[tuple | None]:
        text = "".join(segments)
        raw = text.encode()
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True)
        a_ids, b_ids = a.ids, b["ids"]
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw or not raw:
            return [None] if len(segments) == 1 else [self._align([s])[0] for s in segments]
        a_array, b_array = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_ends = self._a_ends(text, len(raw), a.offsets, self.a_size[a_array])
        b_ends = self._b_ends(np.fromiter(map(itemgetter(1), b["offsets"]), dtype=np.int64, count=len(b_ids)), self.b_size[b_array])
        both, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        codes = (a_array[at_a] * self.n_b + b_array[at_b]).astype(self.code).tobytes()
        a_text, b_text = list(map(self.a_text.__getitem__, a_ids)), list(map(self.b_text.__getitem__, b_ids))
        # groups of one token each are most; the others' ids are joined in their place
        groups = list(map("%s|%s".__mod__, zip(map(a_text.__getitem__, at_a.tolist()), map(b_text.__getitem__, at_b.tolist()))))
        a_from, b_from = np.concatenate(([0], at_a[:-1] + 1)), np.concatenate(([0], at_b[:-1] + 1))
        several = np.flatnonzero((at_a > a_from) | (at_b > b_from))
        for k, i, p, j, q in zip(several.tolist(), a_from[several].tolist(), (at_a[several] + 1).tolist(), b_from[several].tolist(), (at_b[several] + 1).tolist()):
            groups[k] = f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}"
        ends = np.cumsum(np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)) if len(raw) == len(text)
                         else np.fromiter((len(s.encode()) for s in segments), dtype=np.int64, count=len(segments)))
        last = np.searchsorted(both, ends)
        out, lo, a0, b0 = [], 0, 0, 0
        for hi, p, q in zip((last + 1).tolist(), (at_a[last] + 1).tolist(), (at_b[last] + 1).tolist()):
            out.append((p - a0, q - b0, hi - lo, ";".join(groups[lo:hi]), codes[self.width * lo:self.width * hi]))
            lo, a0, b0 = hi, p, q
        return out

    @staticmethod
    def _a_ends(text: str, size: int, offsets: list[tuple[int, int]], bytes_of: np.ndarray) -> np.ndarray:
        """Byte ends by character offsets; tokens that end inside a character by their bytes."""
        spans = np.fromiter(chain.from_iterable(offsets), dtype=np.int64, count=2 * len(offsets)).reshape(-1, 2)
        if size == len(text):
            return spans[:, 1]
        point = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        place = np.concatenate(([0], np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))))
        inside = np.append(spans[1:, 0] < spans[:-1, 1], False)         # the next token begins in this one's last character
        return _refined(place[spans[:, 1]], ~inside, bytes_of)

    @staticmethod
    def _b_ends(ends: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
        """Byte ends by the reported spans (bytes of the text, which the added space precedes);
        where a span does not hold the token's bytes (byte fallback), by those."""
        ends = ends + 1
        return _refined(ends, np.diff(ends, prepend=0) == bytes_of, bytes_of)


def _refined(ends: np.ndarray, sure: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
    """``ends`` where they are ``sure``; after those, the tokens' bytes laid out one after another."""
    laid = np.cumsum(bytes_of)
    before = np.maximum.accumulate(np.where(sure, np.arange(len(ends)), -1))
    start = np.where(before >= 0, ends[before] - laid[before], 0)
    return np.where(sure, ends, start + laid)


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair of tokenizers a worker, as long as it lives."""
    return Vocabularies(a_path, b_path)


def possible_pairs(own: Vocabularies) -> int:
    """How many (A entry, B entry) pairs could ever be linked: one's bytes end the other's."""
    found = set()
    by = [{}, {}]
    for k, entries in enumerate((own.a_bytes.items(), enumerate(own.b_bytes))):
        for i, b in entries:
            by[k].setdefault(b, []).append(i)
    for side in (0, 1):
        for whole, ids in by[side].items():
            for k in range(len(whole)):
                for other in by[1 - side].get(whole[k:], ()):
                    found.update((i, other) if side == 0 else (other, i) for i in ids)
    return len(found)


class Alignment:
    """The alignment of two tokenizers over ``df``'s texts.

    ``a`` is a byte-level tokenizer file of the ``tokenizers`` library, ``b`` a sentencepiece
    model that puts a space before a text (paths, or files of ``public_tokenizers``).
    A NULL or empty text has no tokens, nor has one whose tokens, of either side, do not
    join to it (a model that rewrites some characters): zeros and ''.  Rows that share an id, NULL ids
    too, are texts of their own; other columns do not matter; an empty table gives no rows.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model"):
        ship_package(df.sparkSession)
        self.docs = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
        self.id_col, self.kind, self.a, self.b = id_col, self.docs.schema["id"].dataType.simpleString(), a, b

    def aligned(self, with_groups: bool = False) -> DataFrame:
        """A row per text: id, n_a, n_b, n_groups, n_links, groups_sha256, ``links`` (binary: a
        code per link, ``Vocabularies.code``), and ``groups``
        (``a1,a2|b1;a3|b2``: the ids of each group) if asked for."""
        a, b = self.a, self.b

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = vocabularies(a, b)
            for batch in slices(batches):
                known = own.known
                cut = [own.segments(t) if t else [] for t in batch.column("text").to_pylist()]
                now = set().union(*cut)
                new = list(now.difference(known))
                if len(known) + len(new) > KEPT:            # frequent ones are in this slice too
                    own.known = known = {s: known[s] for s in now.difference(new)}
                known.update(zip(new, own.align(new)))
                rows = []
                for c in cut:
                    parts = [known[s] for s in c]
                    if not parts or None in parts:
                        rows.append((0, 0, 0, "", b"", ""))
                        continue
                    n_a, n_b, n, groups, codes = zip(*parts)
                    groups = ";".join(groups)
                    rows.append((sum(n_a), sum(n_b), sum(n), hashlib.sha256(groups.encode()).hexdigest(), b"".join(codes), groups if with_groups else ""))
                for s in new:
                    if len(s) > LONGEST_KEPT:
                        del known[s]
                n_a, n_b, n, sha, links, groups = zip(*rows)
                columns = [batch.column("id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)), pa.array(sha, pa.string()), pa.array(links, pa.binary())]
                names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
                if with_groups:
                    columns.append(pa.array(groups, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = f"id {self.kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
        return self.docs.mapInArrow(run, schema + ", groups string" * with_groups).withColumnRenamed("id", self.id_col)

    def counts(self, aligned: DataFrame) -> DataFrame:
        """How often each pair of ids is linked in all texts, and whether that is its B id's
        highest count: code, a_id, b_id, n, best."""
        a, b = self.a, self.b

        own = vocabularies(a, b)
        kind = own.code

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[tuple[np.ndarray, np.ndarray]] = []

            def summed() -> tuple[np.ndarray, np.ndarray]:
                both, at = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True)
                return both, np.bincount(at, weights=np.concatenate([n for _, n in seen]), minlength=len(both)).astype(np.int64)

            for batch in slices(batches):
                links = np.frombuffer(b"".join(batch.column("links").to_pylist()), dtype=kind)
                code, n = np.unique(links, return_counts=True)
                seen.append((code.astype(np.int64), n))
                if sum(len(c) for c, _ in seen[1:]) > SUMMED:
                    seen = [summed()]
            code, n = summed() if seen else (np.empty(0, dtype=np.int64),) * 2
            for lo in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[lo:lo + 100_000]), pa.array(n[lo:lo + 100_000])], names=["code", "n"])

        entries = own.n_b
        pairs = aligned.select(F.col(f"`{self.id_col}`").alias("id"), "links").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        pairs = pairs.select("code", F.expr(f"code div {entries}").alias("a_id"), (F.col("code") % entries).alias("b_id"), "n")
        return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))

    def documents(self) -> DataFrame:
        """A row per text: the id column, n_a, n_b, n_groups, n_links, ``n_best`` (links whose
        count is their B id's highest), ``count_sum`` (over links), groups_sha256."""
        aligned = stage(self.aligned(), "alignment")
        table = self.counts(aligned).select("code", "n", "best").orderBy("code").toArrow()      # at most possible_pairs() rows
        code, n, best = (table.column(k).to_numpy() for k in range(3))
        kind = vocabularies(self.a, self.b).code

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                links = [np.frombuffer(x, dtype=kind) for x in batch.column("links").to_pylist()]
                size = np.fromiter(map(len, links), dtype=np.int64, count=len(links))
                at = np.searchsorted(code, np.concatenate(links))
                ends = np.cumsum(size)
                sums = []
                for value in (best, n):         # differences of running sums, text by text
                    running = np.concatenate(([0], np.cumsum(value[at].astype(np.int64))))
                    sums.append(running[ends] - running[ends - size])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

        kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        rows = aligned.withColumnRenamed(self.id_col, "id").select("id", "links", *kept[1:])
        schema = f"id {self.kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
        out = rows.mapInArrow(mark, schema).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        return out.withColumnRenamed("id", self.id_col)
