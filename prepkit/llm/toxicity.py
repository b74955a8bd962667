"""Operator 2: toxicity after noisy-channel deobfuscation.

A token, and short neighbouring tokens together, become a lattice: each character
may stand for letters, for a boundary or for nothing, at a channel cost.  The
Viterbi path under a character trigram model restores the words, which are scored
like plain ones; the larger of the plain and the restored weight counts.  Only what
could spell a learned word or beginning is decoded: an automaton accepts all that the
lattice can turn into one, so nothing that could count is passed over.

* The trigram model counts all texts of the corpus (one pass) and gives half
  its weight to the learned words, so that disguised ones are recognised.
* The words and word beginnings that mark a label are learned from a bounded
  sample of labelled rows (``sample_rows``, half of each label, by the smallest
  hashes of their ids; copies of a text count once).
* A text's evidence is the largest weight of its words and their number; a
  logistic curve through the sample's evidence gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from prepkit.llm.common import stage, text_of
from prepkit.session import ship_package

#: The letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
        "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e"}
#: Characters that set letters apart.
APART = ".-_~ '`*"
#: Channel costs, in nats: a stand-in letter, a character that means nothing, a repeated letter that means nothing, a boundary.
COST_LEET, COST_NOTHING, COST_REPEAT, COST_EDGE = 1.0, 0.5, 0.5, 1.0

#: Neighbouring tokens of so many letters, digits and stand-ins at most are also read as one.
SHORT = 3

SLICE_BYTES = 4 << 20
WORDS_KEPT = 400_000
_LETTERS = 28       # boundary, a to z, any other letter


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def trigram_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each letter follows each two, over all texts; words begin after a boundary."""
    of_byte = np.zeros(256, dtype=np.int64)
    of_byte[97:123], of_byte[0xC0:], of_byte[0x80:0xC0] = np.arange(1, 27), 27, -1

    def run(batches):
        total = np.zeros(_LETTERS ** 3, dtype=np.int64)
        for b in batches:
            for _, part in _slices(b.column(0), SLICE_BYTES // 8):       # a letter takes 8 bytes in each of a few arrays
                raw = "\n".join(pc.utf8_lower(part).to_pylist()).encode()
                s = of_byte[np.frombuffer(raw, dtype=np.uint8)]
                s = np.concatenate(([0], s[s >= 0], [0]))
                first = np.where(s[1:-1] == 0, 0, s[:-2])
                total += np.bincount((first * _LETTERS + s[1:-1]) * _LETTERS + s[2:], minlength=len(total))
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["gram", "n"])

    rows = df.select(text_of(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_LETTERS ** 3)
    out[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"]
    return out.reshape(_LETTERS, _LETTERS, _LETTERS)


def trigram_costs(counts: np.ndarray, words: list[str]) -> np.ndarray:
    """Negative log-probabilities of a letter after two: half the corpus model,
    half the model of ``words``, each backed off to bigrams and letters."""
    own = np.zeros_like(counts)
    for w in words:
        s = [0, 0, *map(_symbol, w), 0]
        for a, b, c in zip(s, s[1:], s[2:]):
            own[0 if b == 0 else a, b, c] += 1

    def model(n: np.ndarray) -> np.ndarray:
        one = n.sum(axis=(0, 1)) + 0.5
        one = one / one.sum()
        two = (n.sum(axis=0) + 2 * one) / (n.sum(axis=0) + 2 * one).sum(axis=1, keepdims=True)
        three = n + 2 * two[None]
        return three / three.sum(axis=2, keepdims=True)

    return -np.log(0.5 * model(counts) + 0.5 * model(own))


def lattice(noisy: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for (a letter, a boundary, nothing) and the cost."""
    out, before = [], ""
    for c in noisy:
        ways = [(x, COST_LEET) for x in LEET.get(c, "")]
        if c.isalpha():
            ways.append((c, 0.0))
            if c == before:
                ways.append(("", COST_REPEAT))
        elif c in APART:
            ways += [("", COST_NOTHING), (" ", COST_EDGE)]
        elif ways:
            ways += [("", COST_NOTHING + COST_LEET)] * (c == before) + [(" ", 4 * COST_EDGE)]
        else:
            ways.append((" ", 0.0))
        before = c
        out.append(ways)
    return out


def viterbi(noisy: str, costs: np.ndarray) -> str:
    """The most likely restored text of a lower-case noisy one."""
    best = {(0, 0): (0.0, "")}
    for ways in lattice(noisy):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in best.items():
            for out, channel in ways:
                if out == "" or out == " " and b == 0:      # nothing, or a boundary after one
                    state, now = (a, b), (cost + channel, text)
                else:
                    c = _symbol(out)
                    state, now = ((0, 0) if c == 0 else (b, c)), (cost + channel + costs[0 if b == 0 else a, b, c], text + out)
                if state not in new or now < new[state]:
                    new[state] = now
        best = new
    return min((cost + (costs[0 if b == 0 else a, b, 0] if b else 0.0), text) for (a, b), (cost, text) in best.items())[1].strip()


class Spelling:
    """Finds all that ``lattice`` can turn into one of ``names``: stand-ins of each
    letter, and between them what may mean nothing.  A bit stands for each letter of
    each name (shift-and), so the time is linear in the text whatever it holds."""

    def __init__(self, names: list[str], back: bool = False):
        self.start = self.end = at = 0
        self.step: dict[str, int] = {}
        self.stay: dict[str, int] = {}
        every = 0
        for name in names:
            name = name[::-1] if back else name
            self.start |= 1 << at
            for k, x in enumerate(name):
                for c in (x, *(c for c, ways in LEET.items() if x in ways)):
                    self.step[c] = self.step.get(c, 0) | 1 << at
                    # between two letters the earlier one in the text may be repeated
                    if not back:
                        self.stay[c] = self.stay.get(c, 0) | 1 << at
                    elif k:
                        self.stay[c] = self.stay.get(c, 0) | 1 << at - 1
                every |= 1 << at
                at += 1
            self.end |= 1 << at - 1
        for c in APART:
            self.stay[c] = every

    def ends(self, text: str, once: bool = False) -> list[int]:
        """Where matches end (the first such place only, if ``once``)."""
        out, state, step, stay = [], 0, self.step.get, self.stay.get
        for i, c in enumerate(text):
            kept = state & stay(c, 0) if state else 0
            new = (state << 1 | self.start) & step(c, 0)
            if new & self.end & ~kept:
                out.append(i)
                if once:
                    break
            state = kept | new
        return out

    def first(self, text: str, at: int) -> int | None:
        """Reading back from ``at``, where the shortest match that begins there ends."""
        state = self.start & self.step.get(text[at], 0)
        while state and not state & self.end and at:
            at -= 1
            state = state & self.stay.get(text[at], 0) | state << 1 & ~self.start & self.step.get(text[at], 0)
        return at if state & self.end else None


def _short(token: str) -> bool:
    return len(token) <= SHORT + 1 and sum(c.isalnum() or c in LEET for c in token) <= SHORT


def _trims(edge: str) -> list[int]:
    """Where an edge of stand-ins may be cut: its ends and where the character changes."""
    return sorted({0, len(edge), *(i for i in range(1, len(edge)) if edge[i] != edge[i - 1])})


def features(word: str) -> list[str]:
    """The word, and its beginnings of four to seven letters."""
    return ["=" + word, *["^" + word[:k] for k in range(4, min(7, len(word)) + 1)]]


@dataclass
class Scorer:
    """Weights of features and the trigram costs; ``curve`` maps evidence to a score."""

    weights: dict[str, float]
    costs: np.ndarray
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def __post_init__(self):
        self.known: dict[str, tuple[float, str]] = {}
        names = [f[1:] for f in self.weights]
        self.ahead, self.back = Spelling(names), Spelling(names, back=True)

    def hidden(self, text: str) -> bool:
        """Whether a restored form may hold a learned word or beginning."""
        return bool(self.ahead.ends(text, once=True))

    def plain(self, word: str) -> tuple[float, str]:
        return max(((self.weights.get(f, 0.0), word) for f in features(word)), default=(0.0, word))

    def restored(self, noisy: str) -> tuple[float, str]:
        return max((self.plain(w) for w in viterbi(noisy, self.costs).split()), default=(0.0, ""))

    def word(self, token: str) -> tuple[float, str]:
        """The weight of a lower-case token and the word that has it."""
        if (got := self.known.get(token)) is None:
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            got = self.known[token] = self._word(token)
        return got

    def _word(self, token: str) -> tuple[float, str]:
        if not self.hidden(token):
            return 0.0, ""
        best = max((self.plain(w) for w in re.findall(r"[^\W\d_]+", token)), default=(0.0, ""))
        on = [i for i, c in enumerate(token) if c.isalnum() or c in LEET]
        if not on:
            return best
        whole = token[on[0]:on[-1] + 1]
        # stand-ins at the edges may be letters or punctuation: each reading is decoded
        inner = [i for i, c in enumerate(whole) if c.isalnum()] or [0, len(whole) - 1]
        for i in _trims(whole[:inner[0]]):
            for j in _trims(whole[inner[-1] + 1:][::-1]):
                best = max(best, self.restored(whole[i:len(whole) - j]))
        return best

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of each text: the largest weight of its words, how many have one, and which they are."""
        most, many, found = np.zeros(len(texts)), np.zeros(len(texts)), [""] * len(texts)
        for at, part in _slices(texts):
            split = pc.ascii_split_whitespace(pc.utf8_lower(part))
            coded = split.flatten().dictionary_encode()
            vocabulary = coded.dictionary.to_pylist()
            index = coded.indices.to_numpy(zero_copy_only=False)
            judged = [self.word(w) for w in vocabulary]
            weight = np.array([w for w, _ in judged])
            short = np.array([_short(w) for w in vocabulary], dtype=bool)
            ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
            doc = np.searchsorted(ends, np.arange(len(index)), side="right")
            hits = np.flatnonzero(weight[index] > 0) if len(index) else np.array([], dtype=np.int64)
            scored = [(int(doc[i]), *judged[index[i]]) for i in hits]
            # runs of two or more short tokens in one text
            near = np.flatnonzero(short[index]) if len(index) else np.array([], dtype=np.int64)
            cuts = np.flatnonzero((np.diff(near) != 1) | (np.diff(doc[near]) != 0)) + 1
            runs = [run for run in np.split(near, cuts) if len(run) > 1]
            for run in runs:
                for first, last, w, word in self.run([vocabulary[i] for i in index[run]]):
                    if w > weight[index[run[first:last + 1]]].max():
                        scored.append((int(doc[run[0]]), w, word))
            words: dict[int, set] = {}
            for d, w, word in scored:
                most[at + d], many[at + d] = max(most[at + d], w), many[at + d] + 1
                words.setdefault(at + d, set()).add(word)
            for d, w in words.items():
                found[d] = ",".join(sorted(w))
        pa.default_memory_pool().release_unused()       # the worker lives on beside the JVM's later stages
        return most, many, found

    def run(self, tokens: list[str]) -> list[tuple[int, int, float, str]]:
        """The first and last of neighbouring ``tokens`` that together spell a learned
        word or beginning, its weight and the word: the best for each first token."""
        text, best = " ".join(tokens), {}
        ends = self.ahead.ends(text)
        if ends:
            of = np.repeat(np.arange(len(tokens)), [len(t) + 1 for t in tokens])
            for e in ends:
                start = self.back.first(text, e)
                if start is not None and of[start] < of[e]:
                    first, last = int(of[start]), int(of[e])
                    w, word = self.restored(" ".join(tokens[first:last + 1]))
                    if w > best.get(first, (0, 0.0, ""))[1]:
                        best[first] = (last, w, word)
        return [(first, *found) for first, found in sorted(best.items())]

    def score(self, most: np.ndarray, many: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * most + c * np.log1p(many), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; slopes are kept from below 0."""
    x, beta = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        penalty = ridge * np.array([0.0, *np.ones(x.shape[1] - 1)])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (y - p)) - penalty * beta)
        beta = beta + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate((beta[:1], np.maximum(beta[1:], 0)))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = 20_000, max_features: int = 512, least_odds: float = 1.5) -> Scorer:
    """Learn from the rows of ``labels`` (id, label 0 or 1; others are ignored).
    Without both labels in the sample every text scores the share of label 1, or 0.5."""
    spark = df.sparkSession
    ship_package(spark)
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = sample_rows // 2
    picked = [rows.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(half) for y in (0, 1)]
    sample = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(picked[0].union(picked[1])), "id")
    sample = stage(sample.withColumn("copy", F.xxhash64("text")).dropDuplicates(["copy", "label"]).select("text", "label"), "toxic-sample")
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = trigram_counts(df, text_col)
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return Scorer({}, trigram_costs(counts, []), (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0))

    def count(batches):
        held: dict[str, list[int]] = {}

        def flush():
            frame = pd.DataFrame([(k, *v) for k, v in held.items()], columns=["feature", "neg", "pos"])
            held.clear()
            return frame

        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                for f in {f for w in set(re.findall(r"[^\W\d_]+", text.lower())) for f in features(w)}:
                    held.setdefault(f, [0, 0])[label] += 1
                if len(held) > 200_000:
                    yield flush()
        yield flush()

    # a feature counts if its split over the labels is no chance, even as the luckiest of all features
    pos, neg, base = F.col("pos"), F.col("neg"), seen[1] / (seen[0] + seen[1])

    def gain(n: Column, share: float) -> Column:
        return F.when(n > 0, n * F.log(n / (pos + neg) / F.lit(share))).otherwise(0.0)

    table = stage(sample.mapInPandas(count, "feature string, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "toxic-features")
    table = (table.withColumn("g", gain(pos, base) + gain(neg, 1 - base))
             .withColumn("odds", F.log((pos + 0.5) / (seen[1] + 1)) - F.log((neg + 0.5) / (seen[0] + 1)))
             .where((F.col("g") >= float(np.log(max(1, table.count())))) & (F.col("odds") >= least_odds))
             .orderBy(F.desc("g"), "feature").limit(8 * max_features).collect())
    # a beginning counts where no one word or longer beginning explains it
    known = [(r["feature"], r["pos"], r["odds"]) for r in table]

    def explained(f: str, n: int, odds: float) -> bool:
        return any(g != f and g[1:].startswith(f[1:]) and (1.2 * m >= n if g[0] == "=" else m >= 0.9 * n and o >= odds and len(g) > len(f))
                   for g, m, o in known)

    chosen = [r for r in table if r["feature"][0] == "=" or not explained(r["feature"], r["pos"], r["odds"])]
    weights = {r["feature"]: float(r["odds"]) for r in chosen[:max_features]}
    scorer = Scorer(weights, trigram_costs(counts, [f[1:] for f in weights]))

    def observe(batches):
        for b in batches:
            most, many, _ = scorer.evidence(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(most), pa.array(many), b.column(1)], names=["most", "many", "label"])

    got = sample.mapInArrow(observe, "most double, many double, label int").toPandas()
    x = np.column_stack((got["most"], np.log1p(got["many"])))
    y = got["label"].to_numpy(dtype=float)
    share = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    scorer.curve = tuple(_logistic(x, y, share * len(y) / share.sum()).tolist())
    return scorer


def score_texts(df: DataFrame, scorer: Scorer, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns of each row, then ``score`` (0 to 1), ``predicted`` (1 if the
    score is at least 0.5) and ``found``, the words behind it, restored and
    comma-joined.  NULL texts are empty; a text without any evidence has the
    score of the base rate; other columns do not matter."""
    ship_package(df.sparkSession)
    src = df.select(*[c.alias(n) for n, c in keep.items()], text_of(text_col).alias("__text"))
    names = list(keep)
    schema = ", ".join([*[f"`{n}` {src.schema[n].dataType.simpleString()}" for n in names], "score double, predicted int, found string"])

    def run(batches):
        for b in batches:
            most, many, found = scorer.evidence(b.column(len(names)))
            score = scorer.score(most, many)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.string())],
                                             names=[*names, "score", "predicted", "found"])

    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether the crc32 of the id as text, modulo ``folds``, is ``fold`` (NULL id: no)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels outside the held-out fold and score every row: the id,
    ``held_out``, ``score``, ``predicted``, ``found``."""
    scorer = train(df, labels.where(~held_out(id_col)), id_col, text_col)
    return score_texts(df, scorer, {id_col: F.col(f"`{id_col}`"), "held_out": held_out(id_col)}, text_col)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below 0.5, with all their columns, by a scorer
    learned from the labels outside the held-out fold.  The score is computed in the
    row's own task, so rows with equal ids are judged by their own texts.  A row goes on
    evidence only: one without any stays, also where the labels are empty or mostly toxic."""
    scorer = train(df, labels.where(~held_out(id_col)), id_col, text_col)
    names = {f"__{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    scored = score_texts(df, scorer, names, text_col).where("predicted = 0 or found = ''")
    return scored.select(*[F.col(k).alias(c) for k, c in zip(names, df.columns)])
