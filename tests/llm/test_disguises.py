"""Disguised words that differ little from plain tokens reach the decoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from prepkit.llm.toxicity import Scorer, trigram_costs, trigram_counts, viterbi

BAD = ["idiot", "stupid", "moron", "trash", "clown", "loser"]


@pytest.fixture(scope="module")
def scorer(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    weights = {"=" + w: 3.0 for w in BAD} | {"^" + w[:4]: 2.0 for w in BAD}
    return Scorer(weights, trigram_costs(trigram_counts(documents), BAD))


def found(scorer, text):
    return scorer.evidence(pa.array([text]))[2][0]


@pytest.mark.parametrize("text, word", [
    ("you idiiot", "idiot"), ("how sttupid", "stupid"), ("a mooron", "moron"), ("an iidioot", "idiot"),
    ("this is +rash", "trash"), ("an !diot", "idiot"), ("a (lown here", "clown"), ("an |diot", "idiot"), ("an idio+", "idiot"), ("an idio+!!", "idiot"),
    ("he is an id i ot", "idiot"), ("st up id he is", "stupid"), ("an i d i o t he is", "idiot"), ("mor on", "moron"), ("('+rash')", "trash"), ("10$3r", "loser"), ("|0$3r", "loser")])
def test_found(scorer, text, word):
    assert word in found(scorer, text).split(",")


@pytest.mark.parametrize("text", ["loot and moon, good books", "it is so up to us", "call 555-0100 now!!!", "a b c d e f", "see e.g. the u.s.a. report", "(rows + lows)", "$100 *or* so!", ""])
def test_plain(scorer, text):
    assert found(scorer, text) == ""


def test_the_expression_passes_over_nothing(scorer):
    rng = np.random.default_rng(5)
    chars = list("idiotsmurnlcwahpe10$!|+(3.-* ")
    texts = ["".join(rng.choice(chars, size=rng.integers(4, 9))) for _ in range(3000)]
    texts += [w[:k] + w[k] * int(rng.integers(1, 3)) + rng.choice(["", ".", "*"]) + w[k:] for w in BAD for k in range(len(w))]
    hidden = [scorer.hidden(t) for t in texts]
    hits = [scorer.restored(t)[0] > 0 for t in texts]
    assert sum(hits) >= 20 and all(h for h, hit in zip(hidden, hits) if hit)
    assert viterbi("idiiot", scorer.costs) == "idiot"
