"""Operator 8: secret scans with corpus-wide ownership frequency.

Each text is scanned where it lies, for three base kinds and for other
random-looking tokens.  The digests of all candidate values are counted over
the corpus by distinct repositories and owners.  A value with many owners, or
in many repositories of one owner, is a copied example; any other looks live.  Base spans always
stay; another token becomes a span only if it looks live.  Only digests,
owners and counts are shuffled, never texts.  One example may occur in a third of
all rows: digests with a ten-thousandth of all occurrences or more, of which there
are ten thousand at most, are broadcast to theirs; the others meet theirs by an equal join.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from prepkit.llm.common import stage, text_of
from prepkit.session import ship_package

#: The base kinds, in the order in which equal starts are listed, then the added kind.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")       # runs are maximal, so shorter ones need no visit
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A text without one of these, in lower case, has no assignment.
WORDS = ("passw", "secret", "token", "api")

#: A digest with one in so many of all occurrences is hot; there cannot be more hot digests than this.
_HOT = 10_000


def entropy(value: str) -> float:
    """Bits per character of the value's own character frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, index of the kind, end, value) of the base kinds, in code points."""
    low, out = text.lower(), []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def other_tokens(text: str, taken: list[tuple[int, int, int, str]], bits: float) -> list[tuple[int, int, int, str]]:
    """Tokens that mix letters and digits at ``bits`` or more a character, apart from base spans."""
    out = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if (any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= bits
                and not any(s < m.end() and m.start() < e for s, _, e, _ in taken)):
            out.append((m.start(), 3, m.end(), v))
    return out


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, example_owners: int = 2, bits: float = 3.0, example_repos: int = 10) -> DataFrame:
    """One row per input row: the id, ``n_assign, n_access, n_hex``,
    ``base_sha256``, ``spans`` (kind:start:end of all spans, by start, then kind,
    comma-joined), ``owners`` and ``repos`` (of the value of each span, in the same
    order, comma-joined), ``n_live`` and ``n_example``.

    ``owner_col`` names the owner, ``repo_col`` the repository (by default each
    row is its own).  A value with ``example_owners`` owners or more, or in
    ``example_repos`` repositories or more, is an example; with fewer of both it looks
    live.  A NULL owner counts as one more owner, a NULL repository as one more repository.
    NULL texts are empty; repeated rows are separate rows; an empty table gives
    no rows; columns that are not named are ignored.
    """
    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                base = base_spans(text)
                digest = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest()
                found = [(k, s, e, hashlib.sha256(v.encode()).hexdigest()) for s, k, e, v in base + other_tokens(text, base, bits)]
                rows.append((*[sum(x[1] == k for x in base) for k in range(3)], digest, [dict(zip(("kind", "start", "end", "hash"), f)) for f in found]))
            made = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "found"])
            yield pd.concat([b[["id", "owner", "repo"]].reset_index(drop=True), made], axis=1)

    src = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{owner_col}`").cast("string").alias("owner"),
                    (F.col(f"`{repo_col}`").cast("string") if repo_col else F.lit(None).cast("string")).alias("repo"),
                    text_of(text_col).alias("text"))
    scanned = src.mapInPandas(run, "id string, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, "
                              "found array<struct<kind:int,start:long,end:long,hash:string>>")
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    repo = F.col("repo") if repo_col else F.col("row").cast("string")
    each = scanned.where(F.size("found") > 0).select("row", "owner", repo.alias("repo"), F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    verdict = (each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
               .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))
               .withColumn("live", (F.col("owners") < example_owners) & (F.col("repos") < example_repos)))
    verdict = stage(verdict, "secret-verdicts")
    total = verdict.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * _HOT >= total
    said = ["hash", "owners", "repos", "live"]
    judged = each.drop("owner", "repo").join(F.broadcast(verdict.where(is_hot).select(said)), "hash", "left")
    judged = judged.where("live is not null").unionByName(
        judged.where("live is null").drop(*said[1:]).join(verdict.where(~is_hot).select(said), "hash"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = (judged.where((F.col("kind") < 3) | F.col("live")).groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span"), "owners", "repos"))).alias("s"),
                  F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example")))
    return scanned.join(spans, "row", "left").select(
        F.col("id").cast(kind).alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.col("s.span"), ","), F.lit("")).alias("spans"),
        *[F.coalesce(F.array_join(F.col(f"s.{c}").cast("array<string>"), ","), F.lit("")).alias(c) for c in ("owners", "repos")],
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
