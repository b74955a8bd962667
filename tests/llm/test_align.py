"""Cross-tokenizer alignment against whole texts tokenised one by one, by token bytes alone."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from prepkit.llm.align import Alignment, possible_pairs, vocabularies
from prepkit.llm.queries import op13_tokenizer_alignment

SCHEMA = "doc_id long, text string, links string, n int, best string, code int, groups string"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    def __init__(self):
        path = public_tokenizers.path("byte_bpe_50k.json")
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        # the byte alphabet as the vocabulary file itself lists it: the first 256 entries, by byte order of visible ones first
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        order = visible + [b for b in range(256) if b not in visible]
        vocab = sorted(json.load(open(path))["model"]["vocab"].items(), key=lambda x: x[1])[:256]
        self.byte = {c: b for (c, _), b in zip(vocab, order)}

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def ends(self, tokens):
        at, out = 0, {}
        for k, (i, x) in enumerate(tokens):
            at += len(x)
            out[at] = (k, i)
        return out

    def documents(self, rows):
        made, count = [], Counter()
        for key, text in rows:
            a, b = self.tokens(text)
            at_a, at_b = self.ends(a), self.ends(b)
            cuts = sorted(at_a.keys() & at_b.keys())
            links = [(at_a[c][1], at_b[c][1]) for c in cuts]
            groups, i, j = [], 0, 0
            for c in cuts:
                p, q = at_a[c][0] + 1, at_b[c][0] + 1
                groups.append(",".join(str(x) for x, _ in a[i:p]) + "|" + ",".join(str(x) for x, _ in b[j:q]))
                i, j = p, q
            count.update(links)
            made.append((key, len(a), len(b), groups, links))
        best = {}
        for (_, b), n in count.items():
            best[b] = max(best.get(b, 0), n)
        return Counter((key, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for key, n_a, n_b, groups, links in made)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def hard() -> list:
    rng = random.Random(5)
    parts = ["a", "it's", " ", "  ", "\n", "\t", "123", "é", "😀", "日本", "𓀀", "...", "</s>", "<0x0A>", "don't", " ", "'", "l", "und", "The", "<|endoftext|>", " \n "]
    mixed = ["".join(rng.choice(parts) for _ in range(n)) for n in (5, 9, 40, 300, 900, 2500) for _ in range(4)]
    return [None, "", " ", "  ", "\n", "a", "a ", "a  ", " a", "▁", "a▁b then more", "x\u0000y", *mixed, "z" * 3000, " " * 500, "word " * 5000, "é" * 800, "𓀀𓀁 x" * 100,
            "ﬁ ligature", "é combining", "​ zero", "﻿bom", mixed[3], mixed[3]]


def test_against_whole_texts(spark, plain):
    rows = [(i, t) for i, t in enumerate(hard())] + [(None, "no id"), (3, "again a text"), (3, "again a text")]
    df = spark.createDataFrame([(*r, "l", 1, "b", 2, "g") for r in rows], SCHEMA).repartition(3)
    got = Alignment(df).documents()
    assert got.columns == NAMES
    assert Counter(map(tuple, got.collect())) == plain.documents(rows)


def test_every_link_is_a_possible_pair_and_those_are_few():
    own = vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model")
    assert own.cuts and possible_pairs(own) < 500_000
    segments = list({s for t in hard() if t for s in own.segments(t)})
    for s, x in zip(segments, own.align(segments)):
        one = own.align([s])[0]
        assert x == one
        if x is not None:
            import numpy as np
            for code in np.frombuffer(x[4], dtype=own.code).tolist():
                a, b = own.a_bytes[code // own.n_b], own.b_bytes[code % own.n_b]
                assert a.endswith(b) or b.endswith(a)


def test_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "don't"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in Alignment(df).aligned(with_groups=True).collect()}
    assert got[2] == "" and all("|" in g for g in got[1].split(";"))
    assert Alignment(spark.createDataFrame([], SCHEMA)).documents().count() == 0


def test_the_query_over_the_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op13_tokenizer_alignment(spark, sf).select(NAMES).collect())) == plain.documents(rows)


def test_plain_spaces_need_no_pattern(monkeypatch):
    import random

    from prepkit.llm import align
    own = align.vocabularies("byte_bpe_50k.json", "piece_bpe_32k.model")
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\t\x1c\xa0　é.") for _ in range(rng.randint(1, 25))) for _ in range(3000)] + [" ", "a", " a", "a ", "a  b", "\n a", "a\n b"]
    assert all(own.segments(t) == align.SEGMENT.split(" " + t) for t in texts)
    monkeypatch.setattr(align, "SEGMENT", None)         # not asked where every space stands between other characters
    assert own.segments("one two\nthree, four.") == [" one", " two\nthree,", " four."]


def test_counts_of_many_slices_are_added_up(spark, monkeypatch):
    from prepkit.llm import align
    df = spark.createDataFrame([(i, f"some words here {i % 7}") for i in range(60)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, align.Alignment(df).documents().collect()))
    monkeypatch.setattr(align, "SUMMED", 0)
    assert sorted(map(tuple, align.Alignment(df).documents().collect())) == want and all(r[5] <= r[4] < r[6] for r in want)
