"""Repositories take part in the verdict of secret scans."""

from __future__ import annotations

from prepkit.llm.secrets import scan_secrets

COPIED, LIVE = "A1b2C3d4E5f6G7h8I9j0K1", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3S"
SCHEMA = "doc_id long, text string, source string, repo string"


def test_a_value_copied_over_documents_of_one_owner_is_an_example(spark):
    rows = [(i, f"see {COPIED} here", "o1", None) for i in range(40)] + [(40, f"my {LIVE}", "o1", None), (41, f"{LIVE} again", "o1", None),
                                                                        (42, "password=" + COPIED, "o1", None)]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].spans == "" and got[i].n_live == 0 for i in range(40))
    assert got[40].spans == "token:3:25" and (got[40].owners, got[40].repos, got[40].n_live) == ("1", "2", 1)
    assert (got[42].owners, got[42].repos, got[42].n_example) == ("1", "41", 1) and got[0].repos == ""
    few = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, SCHEMA), example_repos=42).collect()}
    assert few[0].spans == "token:4:26" and few[0].repos == "41"


def test_repositories_are_counted_by_name(spark):
    rows = [(i, f"see {COPIED} here", "o1", "one") for i in range(40)] + [(40, f"my {LIVE}", "o1", "a"), (41, f"{LIVE} {LIVE}", "o1", None)]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, SCHEMA), repo_col="repo", example_repos=3).collect()}
    assert got[0].spans == "token:4:26" and (got[0].owners, got[0].repos) == ("1", "1")
    assert got[41].owners == "1,1" and got[41].repos == "2,2" and got[41].n_live == 2
