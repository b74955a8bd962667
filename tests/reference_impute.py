"""Row-wise NumPy chained-equation imputer used as a test oracle.

Works on the full matrix in memory, exactly the textbook way: fill with
means, then for every round and every column (ascending missing share)
fit a Bayesian ridge on the rows where the column is observed (SVD of the
centred design, MacKay evidence updates) and overwrite its missing cells.
Independent of the pattern-Gram algebra the Spark route uses.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def bayesian_ridge(x: np.ndarray, y: np.ndarray, max_iter=300, tol=1e-3,
                   a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6):
    n = x.shape[0]
    x_off = x.mean(axis=0)
    y_off = y.mean()
    xc = x - x_off
    yc = y - y_off
    alpha = 1.0 / (y.var() + EPS)
    lam = 1.0
    xty = xc.T @ yc
    u, s, vh = np.linalg.svd(xc, full_matrices=False)
    ev = s ** 2

    def coef_of(a, l_):
        if n > xc.shape[1]:
            c = vh.T @ (vh / (ev + l_ / a)[:, None]) @ xty
        else:
            c = xc.T @ (u / (ev + l_ / a)[None, :]) @ u.T @ yc
        return c, float(np.sum((yc - xc @ c) ** 2))

    old = None
    for it in range(max_iter):
        c, sse = coef_of(alpha, lam)
        gamma = np.sum((alpha * ev) / (lam + alpha * ev))
        lam = (gamma + 2 * l1) / (np.sum(c ** 2) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (sse + 2 * a2)
        if it != 0 and np.sum(np.abs(old - c)) < tol:
            break
        old = np.copy(c)
    c, _ = coef_of(alpha, lam)
    return c, y_off - x_off @ c


class RowwiseImputer:
    def __init__(self, max_iter=10, tol=1e-3):
        self.max_iter = max_iter
        self.tol = tol

    def fit(self, x: np.ndarray):
        mask = np.isnan(x)
        self.means = np.nanmean(x, axis=0)
        p = x.shape[1]
        frac = mask.mean(axis=0)
        order = np.argsort(frac, kind="mergesort")
        xt = np.where(mask, self.means, x)
        self.seq = []
        prev = xt.copy()
        thr = self.tol * np.max(np.abs(x[~mask]))
        self.n_iter = self.max_iter
        for t in range(1, self.max_iter + 1):
            for j in order:
                others = [k for k in range(p) if k != j]
                obs = ~mask[:, j]
                c, b = bayesian_ridge(xt[obs][:, others], xt[obs, j])
                self.seq.append((j, others, c, b))
                if (~obs).any():
                    xt[~obs, j] = xt[~obs][:, others] @ c + b
            change = np.linalg.norm(xt - prev, ord=np.inf)
            if change < thr:
                self.n_iter = t
                break
            prev = xt.copy()
        self.fitted = np.where(mask, xt, x)
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        mask = np.isnan(x)
        xt = np.where(mask, self.means, x)
        for j, others, c, b in self.seq:
            miss = mask[:, j]
            if miss.any():
                xt[miss, j] = xt[miss][:, others] @ c + b
        return np.where(mask, xt, x)
