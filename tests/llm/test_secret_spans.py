"""Secret scans against a plain version over whole results."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from prepkit.llm import secrets
from prepkit.llm.secrets import scan_secrets

#: The base kinds as the contract words them, each with its least length.
BASE = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
TOKEN = re.compile("[A-Za-z0-9+/_-]{20,}")


def bits(v):
    return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())


def plain(rows, owners=2, repos=10):
    """For each row: counts, digest, spans, and the counts of each span's value."""
    found = []
    for _, text, _ in rows:
        base = [(m.start(), k, m.end(), m[group]) for k, (_, pattern, group, least) in enumerate(BASE)
                for m in pattern.finditer(text or "") if len(m[group]) >= least]
        more = [(m.start(), 3, m.end(), m[0]) for m in TOKEN.finditer(text or "")
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and bits(m[0]) >= 3
                and not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        found.append((sorted(base), sorted(base + more)))
    who, where = defaultdict(set), defaultdict(set)
    for i, ((_, _, owner), (_, every)) in enumerate(zip(rows, found)):
        for *_, v in every:
            who[v].add(owner)
            where[v].add(i)
    live = {v: len(who[v]) < owners and len(where[v]) < repos for v in who}
    name = ("assign", "access", "hex", "token")
    joined = lambda spans: ",".join(f"{name[k]}:{s}:{e}" for s, k, e, _ in spans)
    out = []
    for (i, _, _), (base, every) in zip(rows, found):
        spans = [x for x in every if x[1] < 3 or live[x[3]]]
        out.append((i, *[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                    ",".join(str(len(who[x[3]])) for x in spans), ",".join(str(len(where[x[3]])) for x in spans),
                    sum(live[x[3]] for x in spans), sum(not live[x[3]] for x in spans)))
    return out


def corpus(n=400):
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(20, 40))) for _ in range(12)]
    keys = ["".join(rng.choice("ABCDEFGHJKabcdefghjk0123456789") for _ in range(rng.randint(16, 30))) for _ in range(40)]
    made = [lambda: "AKIA" + "".join(rng.choice("ABCDEF0123456789") for _ in range(rng.randint(12, 20))), lambda: rng.choice(hexes),
            lambda: rng.choice(keys), lambda: rng.choice(["Password", "passwd", "SECRET", "token", "api_key", "apiKEY", "API_KEY", "apikeys"])
            + rng.choice(["=", ": ", "\" : \"", "' = '", " "]) + rng.choice([*keys, "short", "abc", "hunter22", "a.b-c=d", hexes[0]]),
            lambda: rng.choice(["plain", "été", "\U0001f600", "words", "\n", "\t", "deadbeef", "AKIA", "token"])]
    rows = [(i, rng.choice([" ", "", ", ", "\n"]).join(rng.choice(made)() for _ in range(rng.randint(0, 14))), rng.choice(["a", "b", "c", None])) for i in range(n)]
    rows += [(n + i, f"a copied {keys[0]} example {hexes[1]}", "a") for i in range(n // 2)]       # one value in a third of all rows
    return rows + [(None, "secret=" + keys[1], None), (5, None, "a"), (5, "", "b"), rows[3], rows[3], (-1, "x " * 50_000 + keys[2] + "9", "c")]


def test_spans_digests_and_owners_equal_a_plain_version(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = Counter(plain(rows))
    assert Counter(map(tuple, scan_secrets(df).collect())) == want
    assert sum(r[5].count("token:") for r in want) > 20 and any(r[9] for r in want)
    for hot in (1, 20, 10 ** 9):        # no value broadcast, some, all
        monkeypatch.setattr(secrets, "_HOT", hot)
        assert Counter(map(tuple, scan_secrets(df).collect())) == want


def test_documents_without_candidates(spark):
    df = spark.createDataFrame([(1, "nothing here", "a"), (2, None, None)], "doc_id long, text string, source string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, scan_secrets(df).collect())) == [(i, 0, 0, 0, empty, "", "", "", 0, 0) for i in (1, 2)]
