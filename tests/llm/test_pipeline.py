"""The pipeline's stages on the smallest tables, each held against its input."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from prepkit.llm.mixing import targets
from prepkit.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, {}
    for n, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns
            assert out.where("char_length(text) <> n_chars").count() == 0
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = seen["toxicity"]
    assert set(ids(after)) <= set(ids(before)) and len(ids(after)) > 0.8 * len(ids(before))
    assert before.join(after, ["doc_id", "text", "lang", "source", "n_chars"]).count() == after.count()
    before, after = seen["line dedup"]
    texts = {r.doc_id: r.text.split("\n") for r in before.collect()}
    for r in after.collect():
        kept = iter(texts[r.doc_id])
        assert all(line in kept for line in r.text.split("\n"))      # in order
    before, after = seen["SimHash near-dedup"]
    groups = near_duplicates(before).select("component_id").distinct()
    assert after.count() == groups.count() and set(ids(after)) == {r[0] for r in groups.collect()}
    before, after = seen["mixing sources to target weights"]
    size = lambda df: {r.source: r.n for r in df.selectExpr("source", r"regexp_count(text, '[^\\x20\\x09-\\x0D]+') as n").groupBy("source").sum("n").toDF("source", "n").collect()}
    was, now = size(before), size(after)
    order = sorted(was)
    for s, want in zip(order, targets([was[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])):
        assert abs(now.get(s, 0) - want) <= 1
    assert max(ids(after).values()) <= 3
    before, after = seen["packing"]
    assert after.agg({"length": "sum"}).first()[0] == after.groupBy("sequence_id", "tier").count().agg({"tier": "sum"}).first()[0]
    assert set(ids(after)) == set(ids(before))


def tokens(rows):
    """Per document id: how many tokens its pieces have, and the tokens themselves, in any order."""
    out = {}
    for r in rows.collect():
        n, seen = out.get(r.doc_id, (0, Counter()))
        seen.update(r.ids)
        out[r.doc_id] = (n + r.length, seen)
    return out


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == docs.columns and tokens(rows) == tokens(docs)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, labels):
        documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy string, row int, size long")
        documents.write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)
    return write


def test_run_over_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables([], [])).count() == 0


def test_run_over_awkward_rows(spark, tables):
    """NULL ids, texts and sources, repeated rows, exact copies, a very long text, and columns named as the operators' own."""
    prose = [" ".join(f"w{(i * 7 + j * j) % 211}x" for j in range(60 + i)) for i in range(10)]
    more = ("c", 1, 2)
    rows = [(i, t, "en", f"s{i % 2}", len(t), *more) for i, t in enumerate(prose)]
    rows += [rows[1], rows[1], (20, prose[2], "en", "s1", len(prose[2]), *more), (None, " ".join(f"n{j}" for j in range(40)), None, None, None, None, None, None),
             (21, None, "en", "s0", 0, *more), (22, "", "en", "s0", 0, *more), (23, " \n ", "en", None, 3, *more),
             (24, "wört " * 20_000, "de", "s1", 100_000, *more)]
    got = tokens(corpus_pipeline.run(spark, tables(rows, [])))
    # the copy and the repeated rows go, whoever is left keeps its words; texts without a word take no part in the mix
    assert set(got) <= {None, *range(10), 24} and 20 not in got and {*range(10)} & set(got)
    assert all(n > 0 and sum(ids.values()) == n for n, ids in got.values())
