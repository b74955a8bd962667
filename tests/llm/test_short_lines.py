"""The pipeline's line dedup compares lines of every length, held against brute force."""

from __future__ import annotations

import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_short_lines_go_too(spark):
    texts = ["one\ntwo words here\n\n日本語の一行です\na longer line of seven words stands here", "words here two\n\none\nonly this\nla la la la la la la",
             "日本語の一行です\n   \nkept four words now", "la\na longer line of seven words stands there", "only\nonly this too", "one", "\n \n", None, "two words",
             "a longer line of eight words stands here now\nhere words two two"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            words = set(WORD.findall(line))
            if not any(words and len(words & w) >= 0.8 * len(words | w) - 1e-9 for w in seen):
                kept.append(line)
            seen.append(words)
        cut = len(kept) < len((t or "").split("\n"))
        if not cut or WORD.search("\n".join(kept)):
            want[i] = "\n".join(kept) if cut else t
    got = corpus_pipeline.line_dedup(spark, df, "").collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert 5 not in want and want[2] == "   \nkept four words now" and want[6] == "\n \n"
    assert all(r.n_chars == len(r.text or "") for r in got)
