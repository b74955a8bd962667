"""Line removals found by rounds over ranked posting lists, held against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from prepkit.llm.line_dedup import LineDedup


def removed_by_force(rows):
    """(id, line) of the lines with an earlier similar one; a NULL id comes first."""
    seen, out = [], set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for line, body in enumerate((text or "").split("\n")):
            words = set(body.split())
            if words and any(len(words & w) >= 0.8 * len(words | w) - 1e-9 for w in seen):
                out.add((i, line))
            seen.append(words)
    return out


def found(frame, **kw):
    lines = LineDedup(frame)
    later = lines.later_classes(**kw)
    lines.later_classes = lambda: later
    return {(r.id, line) for r in lines.removals().collect() for line in r.removed}


def test_removals_equal_brute_force_whatever_the_order_of_reading(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"t{i}" for i in range(40)]
    base = [rng.choice(vocabulary, size=rng.integers(1, 20), replace=False).tolist() for _ in range(30)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.integers(0, 4)):
            words = list(base[rng.integers(len(base))])
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(None, " ".join(base[0])), (200, None), (201, ""), (202, " \n\t")]
    frame = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    want = removed_by_force(rows)
    assert want and found(frame) == want
    assert found(frame, first=1, factor=2) == want        # many rounds, the same lines


def test_variants_of_a_line_need_pairs_in_proportion_to_their_number(spark, monkeypatch):
    from prepkit.llm import line_dedup
    sizes = {}
    plain = line_dedup.stage

    def counted(df, name, release=False):
        out = plain(df, name, release)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    rows = [(i, f"own{i} " + " ".join(f"w{j}" for j in range(20))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame) == {(i, 0) for i in range(1, 400)}
    assert sizes["line-round"] <= 400 * 4 * 2        # 79,800 pairs in all


def test_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert found(frame) == set() and LineDedup(frame).texts().count() == 0


def test_links_meet_no_table_and_stages_go_when_they_have_served(spark, monkeypatch, tmp_path):
    import os

    from prepkit.llm import common
    from prepkit.session import stage_scope
    made = []
    plain = common.scratch_path
    monkeypatch.setattr(common, "scratch_path", lambda s, name: made.append(plain(s, name)) or made[-1])
    rows = [(i, f"own{i} " + " ".join(f"w{j}" for j in range(20))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    with stage_scope(spark):
        found = LineDedup(frame).documents()
        assert {(r.doc_id, r.n_removed, r.n_links) for r in found.collect()} == {(i, int(i > 0), 59) for i in range(60)}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "line-links" not in plan and plan.count("Join") == 2      # the classes' links are counted beside their scan
        left = {os.path.basename(p).rsplit("-", 1)[0] for p in made if os.path.exists(p)}
        assert left == {"line-codes", "line-classes", "line-links"}
    made.clear()
    with stage_scope(spark):
        assert LineDedup(frame).texts().count() == 1
        left = {os.path.basename(p).rsplit("-", 1)[0] for p in made if os.path.exists(p)}
        assert not left & {"line-postings", "line-live", "line-words", "line-named", "line-round", "line-part", "line-links", "line-classes"}


def test_long_lines_that_share_rare_words_only_are_no_pairs_to_verify(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(30):
        words = [f"v{w}" for w in rng.choice(4_000, size=170, replace=False)]
        rows.append((i, " ".join(["key1", "key2", *words])))
        if i % 10 == 0:
            rows.append((100 + i, " ".join([*words[:160], "key1", "key2", "more"])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lines = LineDedup(frame)
    classes = lines._classes().cache()
    every = classes.selectExpr("at as a_at").join(classes.selectExpr("at as b_at")).where("a_at < b_at")
    one_map = lines._near(every, classes.withColumn("half", F.lit(0).cast("long"))).count()
    assert one_map > 50 and lines._near(every, classes).count() < 10        # 64 bits alone let many pass
    assert lines.links(classes).count() == 3 and found(frame) == removed_by_force(rows) == {(100, 0), (110, 0), (120, 0)}


def test_pairs_that_meet_on_a_code_bring_maps_of_128_bits(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join([f"key{i // 4}", f"rare{i // 4}", *(f"v{w}" for w in rng.choice(400, size=170, replace=False))])) for i in range(40)]
    rows.append((100, rows[0][1] + " more"))
    lines = LineDedup(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = lines._classes()
    met = {(r.a_at, r.b_at) for r in lines.candidates(classes).collect()}
    at = {r.id: r.at for r in classes.collect()}
    assert (at[0], at[100]) in met and len(met) < 10        # 64 bits alone let most of the 65 pairs through
