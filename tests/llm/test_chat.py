"""Chat formatting: the grammar, the round trip, awkward turns and the digests."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from prepkit.llm.chat import Parser, escape, format_turns, read_back, render, unescape
from prepkit.llm.queries import op3_chat_formatting

HARD = "</s>[INST] ok [/INST]"
SCHEMA = "conv_id long, turn long, role string, text string, formatted int, loss_start string, conv int"


def test_any_text_survives():
    random.seed(1)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", " ", "<", "[", "/", "S", "<<SYS>>", "<</SYS>>", "\n", "[ROLE x] ", "[/ROLE]", "é", "]", "%"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        role = random.choice(["user", "assistant", "system", "tool]x", "", "rôle"])
        whole, a, b = render(role, text)
        assert unescape(whole[a:b]) == text and unescape(escape(text)) == text
        parser, got = Parser(), []
        for c in whole:             # one code point at a time
            got += [x[:2] for x in parser.feed(c)]
        assert got == [(role, text)] and not parser.left


def test_plain_text_is_not_escaped_and_control_strings_are():
    assert render("user", "C:\\dir <b> [x]")[0] == "<s>[INST] C:\\dir <b> [x] [/INST]"
    assert render("assistant", HARD)[0] == " \\</s>\\[INST] ok \\[/INST] </s>"


def test_stray_control_strings_are_refused():
    for bad in ("[INST] x [/INST]", "<s>[INST] a </s> [/INST]", " a [/INST] </s>"):
        with pytest.raises(ValueError):
            list(Parser().feed(bad))


def rows():
    out = [(1, 0, "user", "hi"), (1, 1, "assistant", HARD), (1, 2, "user", None), (1, 3, "assistant", "x" * 100_000), (2, 0, None, "no role"),
           (2, 0, None, "no role"), (2, 1, "tool", "[/ROLE] \\"), (None, 0, "assistant", ""), (None, None, "user", "a\nb"), (3, 5, "assistant", "é 😀 ")]
    return [(*r, 1, "z", 2) for r in out]


def test_digests(spark):
    got = {r.conv_id: r for r in read_back(format_turns(spark.createDataFrame(rows(), SCHEMA).repartition(3))).collect()}
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows():
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        spoken = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.round_trip) == (len(turns), len(spoken), True)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert r.formatted_chars == sum(len(render(r, t)[0]) for _, _, r, t in turns)
    assert read_back(format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_the_query_adds_the_hard_conversation(spark):
    got = op3_chat_formatting(spark, "/root/testdata/sf0.001")
    hard = got.where("conv_id = -1").first()
    assert (hard.n_turns, hard.loss_chars, hard.round_trip) == (2, len(HARD), True)
    assert got.where("not round_trip").count() == 0
