"""Operator 5: language ID by error-correcting output codes.

Each language has a codeword.  For each bit a binary classifier, a naive Bayes
over byte bigrams and hashed byte trigrams, tells the languages whose bit is 1
from the others.  A text gets every bit's log-odds, and the codeword with the
least summed logistic loss is chosen; the share that the next codeword gets
flags ambiguity.

Learning is one pass that counts n-grams by language over all learning rows
(per task, then summed by Spark); the counts that reach the driver are at most
131,072 a language.  Weights are whole numbers, so a text's sums depend on
nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from prepkit.llm.common import text_of
from prepkit.session import ship_package

#: Bigrams by their two bytes, then trigrams by a hash; the last row stands for no n-gram.
_PAIRS = 1 << 16
FEATURES = 2 * _PAIRS
#: Text handled at a time, in bytes; units of a weight; evidence of one n-gram (n-grams overlap) as a share of its log-odds.
SLICE_BYTES, UNIT, SHARE = 1 << 20, 256, 0.2


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of bits per language: all distinct splits for up to five languages,
    else random columns that keep the least distance large."""
    if languages <= 5:
        bits = max(1, 2 ** (languages - 1) - 1)
        return np.array([[1] * bits] + [[(j >> i) & 1 for j in range(bits)] for i in range(languages - 1)], dtype=np.int8)[:languages]
    bits, rng = max(15, 10 * int(np.ceil(np.log2(languages)))), np.random.default_rng(seed)

    def gap(code: np.ndarray) -> int:
        far = code.astype(np.int64) @ (1 - code.T.astype(np.int64))
        far = far + far.T
        return int(far[~np.eye(languages, dtype=bool)].min())

    half = np.arange(languages) % 2
    return max((np.array([rng.permutation(half) for _ in range(bits)], dtype=np.int8).T for _ in range(200)), key=gap)


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start of each text's n-grams, and at each start a bigram and a trigram
    (FEATURES where a text has ended).  Texts are lower-cased between two spaces."""
    texts = pc.binary_join_element_wise("", pc.utf8_lower(texts), "", " ").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].astype(np.int64)
    at = offsets - offsets[0]
    two, three = np.full(len(raw), FEATURES), np.full(len(raw), FEATURES)
    two[:-1] = raw[:-1] << 8 | raw[1:]
    three[:-2] = _PAIRS + (((two[:-2] << 8 | raw[2:]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
    last = at[1:] - 1
    two[last] = three[last] = FEATURES
    three[np.maximum(last - 1, 0)] = FEATURES
    return at[:-1], two, three


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


class Model:
    """The languages, their codewords and the weights of each bit's classifier."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        share = np.array([(c + 0.5) / (c.sum() + 0.5 * FEATURES) for c in (counts[x] for x in self.languages)]).reshape(-1, FEATURES)
        self.weights = np.zeros((FEATURES + 1, self.code.shape[1]), dtype=np.int64)
        for b in range(self.code.shape[1]) if len(self.languages) > 1 else ():
            one = self.code[:, b] == 1
            self.weights[:-1, b] = np.rint(UNIT * np.log(share[one].mean(axis=0) / share[~one].mean(axis=0)))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Log-odds of each bit, a row per text."""
        out = []
        for part in _slices(texts):
            starts, two, three = _ngrams(part)
            out.append(np.add.reduceat(self.weights[two] + self.weights[three], starts, axis=0))
        return SHARE / UNIT * np.concatenate(out) if out else np.zeros((0, self.code.shape[1]))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The index of the best language, its share (from 0 to 1) and the next one's."""
        signs = 2.0 * self.code - 1
        loss = np.logaddexp(0.0, -margins[:, None, :] * signs[None]).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        order = np.sort(share, axis=1)
        best = loss.argmin(axis=1)
        return best, order[:, -1], order[:, -2] if len(self.languages) > 1 else np.zeros(len(best))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the n-grams of all rows of ``df`` with a text and a language."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                for part in _slices(b.column(1).filter(pc.equal(b.column(0), lang))):
                    _, two, three = _ngrams(part)
                    add = np.bincount(two, minlength=FEATURES + 1) + np.bincount(three, minlength=FEATURES + 1)
                    held[lang] = held.get(lang, 0) + add
        for lang, counts in held.items():
            on = np.flatnonzero(counts[:FEATURES])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on), pa.array(counts[on])], names=["lang", "feature", "n"])

    summed = rows.mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, part in summed.groupby("lang"):
        counts[lang] = np.zeros(FEATURES)
        counts[lang][part["feature"]] = part["n"]
    return Model(counts)


def predict(df: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text", unsure: float = 0.2) -> DataFrame:
    """``keep`` columns of each row, then ``lang_pred``, ``score`` (the share of its
    codeword, 0 to 1) and ``ambiguous`` (the next codeword has a share of
    ``unsure`` or more).

    A NULL text, one without a letter, and any text under a model that learned no
    language is ``und`` with score 0.  Ties go to the first language in order.
    Other columns do not matter.
    """
    ship_package(df.sparkSession)
    src = df.select(*[c.alias(n) for n, c in keep.items()],
                    F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("__letters"), text_of(text_col).alias("__text"))
    names = list(keep)
    schema = ", ".join([*[f"`{n}` {src.schema[n].dataType.simpleString()}" for n in names], "lang_pred string, score double, ambiguous boolean"])

    def run(batches):
        known = np.array([*model.languages, "und"], dtype=object)
        for b in batches:
            has = b.column(len(names)).to_numpy(zero_copy_only=False)
            lang, score, flag = np.full(len(has), len(known) - 1), np.zeros(len(has)), np.ones(len(has), dtype=bool)
            if len(known) > 1 and has.any():
                best, share, second = model.decode(model.margins(b.column(len(names) + 1).filter(pa.array(has))))
                lang[has], score[has], flag[has] = best, share, second >= unsure
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(known[lang], pa.string()), pa.array(score), pa.array(flag)],
                                             names=[*names, "lang_pred", "score", "ambiguous"])

    return src.mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the rows whose crc32 of the id as text, modulo ``folds``, is not
    ``fold``, and predict all rows: the id, ``held_out``, ``lang_pred``, ``score``,
    ``ambiguous``.  A row with a NULL id is never held out and is learned from."""
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))
    return predict(df, train(df.where(~held), text_col, lang_col), {id_col: F.col(f"`{id_col}`"), "held_out": held}, text_col)
