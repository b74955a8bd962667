"""Exact dedup through its sort: equal texts meet as neighbours, also across ranges."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from prepkit.llm.exact_dedup import exact_dedup, exact_groups, sorted_runs

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def rows():
    hot = "the same text in a third of all rows " * 5
    head = "one common beginning of more than thirty-two characters, then "
    out = [(i, hot if i % 3 == 0 else hot.replace(" ", "  ") if i % 30 == 1 else f"{head}{i % 50}") for i in range(600)]
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (None, hot), (None, hot), (7, hot), (7, hot), (1003, "long " * 40_000), (1004, "long" * 40_000)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string").repartition(7)


def by_force():
    groups = defaultdict(list)
    for i, t in rows():
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i))
    return groups


@pytest.mark.parametrize("ranges", [None, 2, 23])
def test_groups(frame, ranges):
    got = exact_groups(frame, ranges=ranges).collect()
    want = Counter((i, min(g)[2], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by_force().items() for _, _, i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(by_force())


def test_equal_texts_are_neighbours_and_a_hot_one_spans_ranges(frame):
    found = sorted_runs(frame, ranges=23).collect()
    parts = defaultdict(set)
    runs = set()
    for r in found:
        parts[bytes(r.sha)].add(r.part)
        runs.add((r.part, r.run))
    hot = hashlib.sha256(SPACE.sub("", rows()[0][1]).encode()).digest()
    assert len(parts[hot]) >= 4
    # every run but the first of a text continues it across one border: all other equal rows met in the sort
    assert len(runs) == sum(len(p) for p in parts.values())
    texts = len(parts)
    assert sum(1 for _ in found) - len(runs) > 0.8 * (len(found) - texts)
    at = {p: sorted(parts[p]) for p in parts}
    used = sorted({r.part for r in found})
    for p in at.values():       # a text's ranges are neighbours among the ranges that have rows
        assert used.index(p[-1]) - used.index(p[0]) == len(p) - 1


def test_rows_that_stay(frame):
    assert exact_dedup(frame, ranges=5).count() == len(by_force())
    kept = {(r.doc_id, r.text) for r in exact_dedup(frame, ranges=5).collect()}
    assert kept <= set(rows())


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(none).count() == 0 and exact_dedup(none).count() == 0
