"""Chained-equation (round-robin regression) imputation on Spark.

Semantics (multiple imputation by chained equations with a Bayesian-ridge
regressor, deterministic posterior-mean prediction):

* start: every missing cell ← its column mean over the fit data;
* columns are visited in ascending order of missing share (stable); each is
  regressed on all other columns using the rows where it is observed, and
  its missing cells are replaced by the prediction — later columns in the
  same round see the updated values;
* Bayesian ridge: intercept by centring, evidence maximisation of the noise
  and weight precisions (``alpha`` from ``1/var(y)``, ``lambda = 1``,
  gamma hyper-priors ``1e-6``), at most 300 inner steps, stop when the summed
  absolute change of the weights is below ``1e-3``;
* stop after ``max_iter`` rounds or as soon as the largest row-wise L1
  change of a round is below ``tol * max|observed value|``;
* ``transform`` on new rows starts from the *fit* means and replays the
  fitted regressions in order (so patterns never seen at fit work too);
  observed cells are returned bit-identical.

Why this runs at scale: every regression is affine, so all rows sharing a
missingness pattern ``P`` have a state that is one affine map ``A_P`` of
``h = [1, observed values less the fit means, 0 where missing]``.  Every
regression therefore needs only the per-pattern second-moment matrices
``G_P = Σ h hᵀ``.  One JVM aggregate gives counts, means and largest absolute
values; ONE Arrow pass gives the Grams (a task holds at most ``_HELD_BYTES`` of
them before it hands them on, and Spark adds them up per pattern, so a pattern
holding most rows costs a few rows per task).  The rounds run on ``(p+1)×(p+1)``
matrices; the state Gram of a pattern is updated in ``O(p²)`` per regression.
The convergence test is one more pass over rows that have a gap (every round's
change is measured at once), and ``transform`` is one matrix product per batch
and pattern; columns that are not imputed pass through as Arrow arrays.

Where the rounds run (``grams``) does not change the result.  ``"driver"``: the pattern Grams
come to the driver (``8 (p+1)²`` bytes each, three times over).  ``"barrier"``: one barrier stage,
whose tasks keep their patterns' Grams and exchange one summed matrix per
gapped column and round (``BarrierTaskContext.allGather``, for which Spark waits a second
each time); a fit is three actions and the driver sees weights only, whatever the number of
patterns.  ``"cluster"``: a checkpointed Spark table and a job per regression, for clusters with
dynamic allocation, where Spark runs no barrier stage.  ``"auto"`` takes the driver while the
Grams of all patterns, which the first pass counts, fit ``driver_bytes``, and else the barrier
stage (the cluster with dynamic allocation).
"""

from __future__ import annotations

import base64
import json
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import ship_package

_EPS = float(np.finfo(np.float64).eps)
_CHUNK = 64
_HELD_BYTES = 32 << 20      # Grams or state maps that a task holds at a time


# ---------------------------------------------------------------- regression


def bayesian_ridge_from_moments(n: float, xtx: np.ndarray, xty: np.ndarray, yty: float,
                                max_iter: int = 300, tol: float = 1e-3,
                                alpha_1: float = 1e-6, alpha_2: float = 1e-6,
                                lambda_1: float = 1e-6, lambda_2: float = 1e-6) -> np.ndarray:
    """Posterior-mean weights of a Bayesian ridge fit from centred moments
    (``XᵀX``, ``Xᵀy``, ``yᵀy`` about the means, ``n`` rows)."""
    y_var = yty / n
    alpha = 1.0 / (y_var + _EPS)
    lam = 1.0
    evals, vecs = np.linalg.eigh(xtx)
    evals = np.clip(evals, 0.0, None)
    vty = vecs.T @ xty

    def solve(a, l_):
        c = vecs @ (vty / (evals + l_ / a))
        sse = yty - 2.0 * (c @ xty) + c @ xtx @ c
        return c, max(float(sse), 0.0)

    coef_old = None
    for it in range(max_iter):
        coef, sse = solve(alpha, lam)
        gamma = float(np.sum((alpha * evals) / (lam + alpha * evals)))
        lam = (gamma + 2 * lambda_1) / (float(np.sum(coef ** 2)) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (sse + 2 * alpha_2)
        if it != 0 and float(np.sum(np.abs(coef_old - coef))) < tol:
            break
        coef_old = np.copy(coef)
    coef, _ = solve(alpha, lam)
    return coef


# ---------------------------------------------------------------- pattern algebra


_BITS = 62                  # missing flags per int64 word of a pattern key


def n_words(p: int) -> int:
    return (p + _BITS - 1) // _BITS


def pattern_codes(missing: np.ndarray) -> np.ndarray:
    """Pattern key per row: ``(n, words)`` int64, bit ``j % 62`` of word
    ``j // 62`` set ⇔ column ``j`` missing (any number of columns)."""
    n, p = missing.shape
    out = np.zeros((n, n_words(p)), dtype=np.int64)
    for w in range(out.shape[1]):
        blk = missing[:, w * _BITS:(w + 1) * _BITS].astype(np.int64)
        out[:, w] = (blk << np.arange(blk.shape[1], dtype=np.int64)).sum(axis=1)
    return out


def code_bits(codes: np.ndarray, p: int) -> np.ndarray:
    """(U, p) boolean matrix of missing flags for each pattern key."""
    codes = np.asarray(codes, dtype=np.int64).reshape(len(codes), -1)
    parts = []
    for w in range(n_words(p)):
        width = min(_BITS, p - w * _BITS)
        parts.append(((codes[:, w:w + 1] >> np.arange(width, dtype=np.int64)) & 1).astype(bool))
    return np.concatenate(parts, axis=1)


def unique_codes(codes: np.ndarray):
    """Distinct pattern keys and, per row, the index of its key (1-D sorts:
    ``unique(axis=0)`` is an order of magnitude slower per batch)."""
    if codes.shape[1] == 1:
        uniq, inv = np.unique(codes[:, 0], return_inverse=True)
        return uniq.reshape(-1, 1), np.asarray(inv).reshape(-1)
    c = np.ascontiguousarray(codes)
    rows = c.view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel()
    _, first, inv = np.unique(rows, return_index=True, return_inverse=True)
    return c[first], np.asarray(inv).reshape(-1)


def replay(codes: np.ndarray, p: int, rounds: list, upto: int | None = None,
           keep_rounds: bool = False):
    """State maps ``A`` ((p+1)×(p+1), acting on ``h``) for each pattern code
    after replaying ``rounds`` (each a list of ``(j, w)`` with ``w`` the
    (p+1) weight vector over ``[1, state]``).  With ``keep_rounds`` returns
    the maps after every round, index 0 = initial."""
    miss = code_bits(codes, p)
    u = len(codes)
    a = np.zeros((u, p + 1, p + 1))
    a[:, 0, 0] = 1.0
    for j in range(p):
        a[~miss[:, j], j + 1, j + 1] = 1.0
    hist = [a.copy()] if keep_rounds else None
    todo = rounds if upto is None else rounds[:upto]
    for steps in todo:
        for j, w in steps:
            sel = miss[:, j]
            if sel.any():
                a[sel, j + 1, :] = np.einsum("a,uab->ub", w, a[sel])
        if keep_rounds:
            hist.append(a.copy())
    return hist if keep_rounds else a


def _tri(p1: int):
    return np.triu_indices(p1)


def update_state_grams(w_state: np.ndarray, miss: np.ndarray, j: int, w: np.ndarray) -> None:
    """In place: after column ``j`` ← ``w · [1, state]`` on the patterns
    where ``j`` is missing, their state Grams ``W = A G Aᵀ`` change only in
    row/column ``j+1`` (O(p²) per pattern)."""
    sel = miss[:, j]
    if sel.any():
        ws = w_state[sel]
        v = ws @ w
        ws[:, j + 1, :] = v
        ws[:, :, j + 1] = v
        ws[:, j + 1, j + 1] = v @ w
        w_state[sel] = ws


def regression_weights(s: np.ndarray, j: int, max_iter: int, tol: float) -> np.ndarray:
    """Weights over ``[1, state]`` predicting column ``j`` from the summed
    state Gram ``s`` of the rows where ``j`` is observed."""
    p = s.shape[0] - 1
    nn = s[0, 0]
    mean = s[0, 1:] / nn
    cov = s[1:, 1:] - nn * np.outer(mean, mean)
    k = [i for i in range(p) if i != j]
    coef = bayesian_ridge_from_moments(nn, cov[np.ix_(k, k)], cov[k, j], float(cov[j, j]), max_iter, tol)
    w = np.zeros(p + 1)
    w[0] = mean[j] - mean[k] @ coef
    w[[i + 1 for i in k]] = coef
    return w


def _unpack(flat: np.ndarray, p1: int) -> np.ndarray:
    iu = _tri(p1)
    g = np.zeros((len(flat), p1, p1))
    g[:, iu[0], iu[1]] = flat
    g[:, iu[1], iu[0]] = flat
    return g


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow list array, a list per row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def unlist(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def matrix_of(batch: pa.RecordBatch, columns) -> np.ndarray:
    """Columns of a batch as a float matrix, NaN where missing."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64)


def segments(miss: np.ndarray):
    """(pattern keys, [row numbers of each key])."""
    uniq, inv = unique_codes(pattern_codes(miss))
    order = np.argsort(inv, kind="stable")
    return uniq, np.split(order, np.flatnonzero(np.diff(inv[order])) + 1)


# ---------------------------------------------------------------- the estimator


@dataclass
class ChainedImputer:
    """Fit/transform chained-equation imputer (see module docstring).

    ``columns`` are imputed and used as predictors (all cast to DOUBLE;
    booleans as 0/1); every other column passes through untouched."""

    columns: list[str]
    max_iter: int = 10
    tol: float = 1e-3
    ridge_max_iter: int = 300
    ridge_tol: float = 1e-3
    grams: str = "auto"           # "barrier", "driver" or "cluster": see the module docstring
    driver_bytes: int = 64 << 20  # of pattern Grams that "auto" lets the driver hold
    barrier_tasks: int | None = None      # tasks of the barrier stage (None: as many as cores, 16 at most)
    # fitted state
    means_: list[float] = field(default_factory=list)
    order_: list[int] = field(default_factory=list)
    rounds_: list = field(default_factory=list)   # [[(j, w list)]] per round
    n_iter_: int = 0
    n_patterns_: int = 0
    round_changes_: list[float] = field(default_factory=list)

    # ------------------------------------------------------------ helpers
    def _matrix(self, df: DataFrame) -> DataFrame:
        """Columns as DOUBLE with NaN → NULL (one missing-value concept),
        under positional aliases ``x0..`` (Python stages cannot take names
        such as ``PM2.5``)."""
        out = []
        for i, c in enumerate(self.columns):
            x = col(c).cast("double")
            out.append(F.when(F.isnan(x), F.lit(None)).otherwise(x).alias(f"x{i}"))
        return df.select(*out)

    # ------------------------------------------------------------ fit
    def fit(self, df: DataFrame) -> "ChainedImputer":
        if self.grams not in ("auto", "barrier", "driver", "cluster"):
            raise ValueError(f"unknown place for the Grams: {self.grams!r}")
        p = len(self.columns)
        ship_package(df.sparkSession)          # the Python stages below run our code
        x = self._matrix(df)
        found = F.approx_count_distinct(F.xxhash64(*[F.col(f"x{i}").isNull() for i in range(p)]), 0.03)
        *row, patterns = x.agg(F.count(F.lit(1)), *[f(f"x{i}") for i in range(p) for f in (F.count, F.avg, lambda c: F.max(F.abs(c)))], found).first()
        n, counts = row[0], np.array(row[1::3], dtype=np.float64)
        for what, bad in (("columns entirely missing at fit", counts == 0),
                          ("columns with an infinite value", [v is not None and np.isinf(v) for v in row[3::3]])):
            if names := [c for c, b in zip(self.columns, bad) if b]:
                raise ValueError(f"{what}: {names}")
        self.means_ = [float(v) for v in row[2::3]]
        self.order_ = [int(j) for j in np.argsort((n - counts) / n, kind="mergesort")]
        if p == 1:
            self.rounds_, self.n_iter_ = [], 0
            return self
        place = self.grams
        if place == "auto":     # the estimate is within some 3 percent; a tenth is left for that
            moving = df.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true"
            fits = 1.1 * patterns * 8 * (p + 1) ** 2 <= self.driver_bytes
            place = "driver" if fits else "cluster" if moving else "barrier"
        if place == "barrier":
            rounds = self._rounds_barrier(*self._partial_grams(x), gapped=[bool(c < n) for c in counts])
        elif place == "driver":
            rounds = self._rounds_local(*self._collected(*self._gram_table(x)))
        else:
            rounds = self._rounds_distributed(*self._gram_table(x))
        self.rounds_ = [[(int(j), [float(v) for v in w]) for j, w in steps] for steps in rounds]

        # one pass measures every round's largest row-wise L1 change
        changes = self._round_changes(x, rounds)
        self.round_changes_ = [float(c) for c in changes]
        thr = self.tol * float(max(row[3::3]))
        stop = next((t + 1 for t, c in enumerate(changes) if c < thr), None)
        if stop is None:
            warnings.warn("chained imputation: early stopping criterion not reached")
            stop = self.max_iter
        self.n_iter_ = stop
        self.rounds_ = self.rounds_[:stop]
        return self

    def _rounds_local(self, codes: np.ndarray, grams: np.ndarray) -> list:
        """All rounds on the driver."""
        p = len(self.columns)
        self.n_patterns_ = len(codes)
        miss = code_bits(codes, p)
        w_state = grams.copy()          # W_P = A_P G_P A_Pᵀ; A = I initially
        rounds = []
        for _t in range(self.max_iter):
            steps = []
            for j in self.order_:
                w = regression_weights(w_state[~miss[:, j]].sum(axis=0), j,
                                       self.ridge_max_iter, self.ridge_tol)
                steps.append((j, w))
                update_state_grams(w_state, miss, j, w)
            rounds.append(steps)
        return rounds

    def _rounds_barrier(self, parts: DataFrame, width: int, gapped: list[bool]) -> list:
        """All rounds in one barrier stage.  Each task keeps the state Grams of its
        share of the patterns; a regression of a gapped column takes one ``allGather`` of the tasks'
        sums, of ``(p+1)(p+2)/2`` numbers each, after which every task finds the same weights and
        advances its own states.  Complete columns come first and change no state: they share a round's first exchange.
        The driver gets the weights only; a lost task starts the stage anew."""
        p = len(self.columns)
        p1, words, order = p + 1, n_words(p), list(self.order_)
        iu = _tri(p1)
        ntri = len(iu[0])
        full = -(-ntri // width) * width
        max_iter, ridge = self.max_iter, (self.ridge_max_iter, self.ridge_tol)
        tasks = self.barrier_tasks or min(parts.sparkSession.sparkContext.defaultParallelism, 16)

        def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, np.ndarray] = {}
            for b in batches:
                vals = unlist(b.column("vals"), width)
                for key, chunk, v in zip(map(tuple, unlist(b.column("pattern"), words).tolist()), b.column("chunk").to_pylist(), vals):
                    if key not in held:
                        held[key] = np.zeros(full)
                    held[key][chunk * width:(chunk + 1) * width] += v
            context = BarrierTaskContext.get()

            def everywhere(mine: np.ndarray) -> np.ndarray:
                """The sum of what all tasks have, in their order."""
                got = context.allGather(base64.b64encode(np.ascontiguousarray(mine, dtype="<f8").tobytes()).decode())
                return np.sum([np.frombuffer(base64.b64decode(g), dtype="<f8") for g in got], axis=0)

            miss = code_bits(np.array(list(held), dtype=np.int64).reshape(-1, words), p) if held else np.zeros((0, p), dtype=bool)
            w_state = _unpack(np.array(list(held.values()))[:, :ntri], p1) if held else np.zeros((0, p1, p1))
            patterns, out = len(held), []
            held.clear()
            complete, partly = [j for j in order if not gapped[j]], [j for j in order if gapped[j]]
            for t in range(max_iter):
                for k, j in enumerate(partly or order[:1]):
                    sums = [w_state[~miss[:, j]].sum(axis=0)[iu]]
                    if k == 0:          # all rows' sum serves every complete column
                        sums += [w_state.sum(axis=0)[iu], np.array([patterns], dtype=np.float64)]
                    got = everywhere(np.concatenate(sums))
                    if k == 0:
                        whole, total = _unpack(got[None, ntri:2 * ntri], p1)[0], int(got[-1])
                        out += [(t, i, regression_weights(whole, i, *ridge)) for i in complete]
                    if gapped[j]:
                        w = regression_weights(_unpack(got[None, :ntri], p1)[0], j, *ridge)
                        out.append((t, j, w))
                        update_state_grams(w_state, miss, j, w)
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                                                  lists(np.array([x[2] for x in out])), pa.array([total] * len(out), pa.int64())],
                                                 names=["round", "col", "w", "patterns"])

        dealt = parts.repartition(tasks, "pattern")
        got = dealt.mapInArrow(rounds, "round int, col int, w array<double>, patterns long", barrier=True).collect()
        by = {(r["round"], r["col"]): np.array(r["w"]) for r in got}
        self.n_patterns_ = got[0]["patterns"]
        return [[(j, by[t, j]) for j in order] for t in range(max_iter)]

    def _rounds_distributed(self, table: DataFrame, width: int) -> list:
        """All rounds over a checkpointed table of pattern Grams.  Each regression is
        one job that replays the round's earlier steps per pattern and adds the
        Grams up in Spark; after every round the advanced state Grams are
        checkpointed again."""
        from ..session import checkpoint
        p = len(self.columns)
        p1, words = p + 1, n_words(p)
        iu = _tri(p1)
        ntri = len(iu[0])
        table = checkpoint(
            table.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("chunk", F.array(*[F.col(f"s{i}") for i in range(width)]).alias("v")))).alias("cs"))
            .select("pattern", F.slice(F.flatten(F.transform("cs", lambda c: c["v"])), 1, ntri).alias("g")))
        self.n_patterns_ = table.count()

        def load(b):
            return code_bits(unlist(b.column("pattern"), words), p), _unpack(unlist(b.column("g"), ntri), p1)

        def sums(steps, j):
            def fn(batches):
                acc = np.zeros((p1, p1))
                for b in batches:
                    if b.num_rows:
                        miss, w_state = load(b)
                        for jj, w in steps:
                            update_state_grams(w_state, miss, jj, w)
                        acc += w_state[~miss[:, j]].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ntri)), pa.array(acc[iu])], names=["at", "v"])
            return fn

        def advance(steps):
            def fn(batches):
                for b in batches:
                    if b.num_rows:
                        miss, w_state = load(b)
                        for jj, w in steps:
                            update_state_grams(w_state, miss, jj, w)
                        yield pa.RecordBatch.from_arrays([b.column("pattern"), lists(w_state[:, iu[0], iu[1]])], names=["pattern", "g"])
            return fn

        rounds = []
        for _t in range(self.max_iter):
            steps = []
            for j in self.order_:
                flat = table.mapInArrow(sums(list(steps), j), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
                s = _unpack(np.array([[r["v"] for r in flat]]), p1)[0]
                steps.append((j, regression_weights(s, j, self.ridge_max_iter, self.ridge_tol)))
            rounds.append(steps)
            table = checkpoint(table.mapInArrow(advance(list(steps)), "pattern array<long>, g array<double>"))
        return rounds

    def _gram_table(self, x: DataFrame) -> tuple[DataFrame, int]:
        """``_partial_grams`` added up per (pattern, chunk), as columns ``s0..``."""
        parts, width = self._partial_grams(x)
        return parts.groupBy("pattern", "chunk").agg(*[F.sum(F.col("vals")[i]).alias(f"s{i}") for i in range(width)]), width

    def _partial_grams(self, x: DataFrame) -> tuple[DataFrame, int]:
        """Each task's sums (``vals`` per pattern and chunk) of the upper-triangle Gram entries of
        ``h = [1, x - mean (0 where missing)]``, and how many entries a chunk has.
        Lazy; one pass when evaluated."""
        p = len(self.columns)
        iu = _tri(p + 1)
        ntri, mean = len(iu[0]), np.asarray(self.means_)
        width = min(_CHUNK, ntri)
        nchunk = -(-ntri // width)
        most = max(1, _HELD_BYTES // (8 * ntri))

        def partial_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[tuple, np.ndarray] = {}

            def flush():
                flat = np.zeros((len(acc), nchunk * width))
                flat[:, :ntri] = list(acc.values())
                keys = np.repeat(np.array(list(acc), dtype=np.int64), nchunk, axis=0)
                chunks = np.tile(np.arange(nchunk, dtype=np.int32), len(acc))
                acc.clear()
                return pa.RecordBatch.from_arrays([lists(keys), pa.array(chunks), lists(flat.reshape(-1, width))], names=["pattern", "chunk", "vals"])

            for b in batches:
                if b.num_rows == 0:
                    continue
                m = matrix_of(b, range(p))
                miss = np.isnan(m)
                h = np.concatenate([np.ones((len(m), 1)), np.where(miss, 0.0, m - mean)], axis=1)
                uniq, rows = segments(miss)
                for key, at in zip(map(tuple, uniq.tolist()), rows):
                    seg = h[at]
                    v = (seg.T @ seg)[iu]           # one BLAS product per pattern segment
                    if key in acc:
                        acc[key] += v
                    else:
                        if len(acc) >= most:
                            yield flush()
                        acc[key] = v
            if acc:
                yield flush()

        return x.mapInArrow(partial_grams, "pattern array<long>, chunk int, vals array<double>"), width

    def _collected(self, table: DataFrame, width: int):
        """The pattern keys and Grams on the driver, as Arrow columns."""
        p = len(self.columns)
        ntri = (p + 1) * (p + 2) // 2
        nchunk = -(-ntri // width)
        got = table.orderBy("pattern", "chunk").toArrow().combine_chunks()
        n = got.num_rows // nchunk
        codes = unlist(got.column("pattern").combine_chunks(), n_words(p))[::nchunk]
        flat = np.column_stack([got.column(f"s{i}").to_numpy() for i in range(width)]).reshape(n, nchunk * width)
        return codes, _unpack(flat[:, :ntri], p + 1)

    def _round_changes(self, x: DataFrame, rounds) -> np.ndarray:
        p = len(self.columns)
        mean = np.asarray(self.means_)
        r_np = [[(j, np.asarray(w)) for j, w in steps] for steps in rounds]
        nr = len(rounds)
        together = max(1, _HELD_BYTES // (8 * (p + 1) ** 2 * (nr + 1)))     # patterns replayed at a time

        def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros(nr)
            for b in batches:
                if b.num_rows == 0:
                    continue
                m = matrix_of(b, range(p))
                miss = np.isnan(m)
                h = np.concatenate([np.ones((len(m), 1)), np.where(miss, 0.0, m - mean)], axis=1)
                uniq, rows = segments(miss)
                for lo in range(0, len(uniq), together):
                    hist = replay(uniq[lo:lo + together], p, r_np, keep_rounds=True)
                    for k, at in enumerate(rows[lo:lo + together]):
                        gap = np.flatnonzero(miss[at[0]]) + 1      # only these states ever change
                        for t in range(nr):
                            moved = h[at] @ (hist[t + 1][k, gap] - hist[t][k, gap]).T
                            best[t] = max(best[t], float(np.abs(moved).sum(axis=1).max(initial=0.0)))
            yield pa.RecordBatch.from_arrays([lists(best[None, :])], names=["changes"])

        has_gap = F.lit(False)
        for i in range(p):
            has_gap = has_gap | F.col(f"x{i}").isNull()
        part = x.where(has_gap).mapInArrow(changes, "changes array<double>")
        row = part.agg(*[F.max(F.col("changes")[t]).alias(f"c{t}") for t in range(nr)]).first()
        return np.array([row[f"c{t}"] if row[f"c{t}"] is not None else 0.0 for t in range(nr)])

    # ------------------------------------------------------------ transform
    def transform(self, df: DataFrame) -> DataFrame:
        """Fill the gaps of ``columns`` (DOUBLE, no NULLs afterwards); all
        other columns pass through unchanged, in the original order."""
        p = len(self.columns)
        ship_package(df.sparkSession)
        mu = np.asarray(self.means_)
        rounds = [[(j, np.asarray(w, dtype=np.float64)) for j, w in steps] for steps in self.rounds_]
        names = list(df.columns)
        pos = {c: i for i, c in enumerate(self.columns)}
        missing_cols = [c for c in self.columns if c not in names]
        if missing_cols:
            raise KeyError(f"columns not in input: {missing_cols}")
        # positional aliases: v<k> for every input column, imputed ones DOUBLE
        src = df.select(*[(col(c).cast("double") if c in pos else col(c)).alias(f"v{k}")
                          for k, c in enumerate(names)])
        places = [names.index(c) for c in self.columns]
        held = max(1, _HELD_BYTES // (8 * (p + 1) ** 2))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[tuple, np.ndarray] = {}
            for b in batches:
                m = matrix_of(b, places)
                miss = np.isnan(m)
                if not miss.any():
                    yield b
                    continue
                h = np.concatenate([np.ones((len(m), 1)), np.where(miss, 0.0, m - mu)], axis=1)
                uniq, rows = segments(miss)
                for lo in range(0, len(uniq), held):
                    keys = [tuple(k) for k in uniq[lo:lo + held].tolist()]
                    new = [i for i, k in enumerate(keys) if k not in cache]
                    if len(cache) + len(new) > held:
                        cache.clear()               # bounded per-task memory
                        new = list(range(len(keys)))
                    if new:
                        cache.update(zip((keys[i] for i in new), replay(uniq[lo:lo + held][new], p, rounds)))
                    for key, at in zip(keys, rows[lo:lo + held]):
                        gap = np.flatnonzero(miss[at[0]])
                        m[np.ix_(at, gap)] = h[at] @ cache[key][gap + 1].T + mu[gap]
                columns = list(b.columns)
                for i, k in enumerate(places):
                    if miss[:, i].any():
                        columns[k] = pa.array(m[:, i])
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema)      # as batches without a gap go out

        filled = src.mapInArrow(fill, src.schema)
        return filled.select(*[F.col(f"v{k}").alias(c) for k, c in enumerate(names)])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "ChainedImputer":
        return cls(**json.loads(text))
