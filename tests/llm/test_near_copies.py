"""Near-duplicate dropping over awkward rows: one row of each component stays."""

from __future__ import annotations

from collections import Counter

from prepkit.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates
from test_documents import SCHEMA, awkward


def test_one_row_of_each_component_stays(spark):
    lone = " ".join(f"q{i * i % 97}z" for i in range(80))
    rows = awkward()
    rest = rows[0][5:]
    rows += [(None, lone, "en", "s1", len(lone), *rest), (None, lone, "fr", "s2", len(lone), *rest), (None, lone + " ", "en", "s1", len(lone) + 1, *rest),
             (None, rows[0][1], "en", "s1", 1, *rest), (3, rows[8][1] + " tail words that differ here", "en", "s1", 1, *rest)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    prints = [fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in group}
    left = drop_near_duplicates(df)
    got = left.collect()
    assert left.columns == df.columns
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(least.values())
    of = {r: g for r, g in zip(rows, group)}
    assert len({of[tuple(r)] for r in got}) == len(got) == len(set(group))
    assert Counter(r.component_id for r in near_duplicates(df).collect()).total() == len(rows)


def test_no_rows(spark):
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
