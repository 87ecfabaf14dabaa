"""Linear classifiers on hashed sparse features: logistic, multinomial logistic and support-vector, fitted in numpy.

Only bounded samples of labelled rows reach ``fit``. ``descent`` and ``newton`` need sums over rows alone, which tasks can
make of all rows where they are. The weights travel to the executors (their number is a parameter).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np


def bucket(text: str, dim: int) -> int:
    """Stable hash bucket in 1..dim-1; 0 is the bias."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % (dim - 1) + 1


@dataclass
class Rows:
    """Sparse rows: those of ``k`` are idx[ptr[k]:ptr[k+1]] with their values."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, rows: list[dict[int, float]]) -> "Rows":
        """With the bias added to each."""
        sizes = [len(r) + 1 for r in rows]
        ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) if rows else np.zeros(1, np.int64)
        idx = np.fromiter((i for r in rows for i in (0, *r)), np.int64, ptr[-1])
        val = np.fromiter((v for r in rows for v in (1.0, *r.values())), np.float32, ptr[-1])
        return cls(ptr, idx, val)

    def take(self, which: np.ndarray) -> "Rows":
        sizes = self.ptr[which + 1] - self.ptr[which]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ptr[which] - ptr[:-1], sizes) + np.arange(ptr[-1])
        return Rows(ptr, self.idx[at], self.val[at])

    def __len__(self) -> int:
        return len(self.ptr) - 1


@dataclass
class Linear:
    weights: np.ndarray  # (dim, classes), one column for two classes

    def scores(self, rows: Rows) -> np.ndarray:
        if not len(rows):
            return np.zeros((0, self.weights.shape[1]), np.float32)
        return np.add.reduceat(self.weights[rows.idx] * rows.val[:, None], rows.ptr[:-1], axis=0)


def fit(rows: Rows, y: np.ndarray, dim: int, loss: str, classes: int = 1, epochs: int = 12, rate: float = 0.3, l2: float = 1e-6, weight: np.ndarray | None = None, seed: int = 7) -> Linear:
    """Adagrad on minibatches. ``loss``: log, hinge (y 0/1) or softmax (y a class).

    With hinge ``y`` may have a column of 1, -1 and 0 (row not used) for each of ``classes`` classifiers fitted at once.
    """
    rng = np.random.default_rng(seed)
    w, seen = np.zeros((dim, classes), np.float32), np.full((dim, classes), 1e-6, np.float32)
    model, n, size = Linear(w), len(rows), 128
    weight = np.ones(n, np.float32) if weight is None else weight
    batches = []
    for part in np.split(rng.permutation(n), range(size, n, size)) if n else []:
        b = rows.take(part)
        order = np.argsort(b.idx, kind="stable")  # the batches stay the same, so each is sorted by feature once
        at = b.idx[order]
        starts = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0].astype(np.int32)
        batches.append((part, b, np.repeat(np.arange(len(part), dtype=np.uint8), np.diff(b.ptr))[order], b.val[order][:, None], starts, at[starts].astype(np.int32)))
    for _ in range(epochs):
        for k in rng.permutation(len(batches)).tolist():
            part, b, row, val, starts, used = batches[k]
            s = model.scores(b)
            if loss == "softmax":
                e = np.exp(s - s.max(axis=1, keepdims=True))
                g = e / e.sum(axis=1, keepdims=True)
                g[np.arange(len(part)), y[part]] -= 1
            elif y.ndim == 2:
                sign = y[part]
                g = -sign * (sign * s < 1)
            else:
                sign = (2.0 * y[part] - 1)[:, None]
                g = -sign * (1 / (1 + np.exp(np.clip(sign * s, -30, 30))) if loss == "log" else (sign * s < 1))
            g = (g * weight[part][:, None] / len(part)).astype(np.float32)
            grad = np.add.reduceat(g[row] * val, starts, axis=0) + l2 * w[used]
            seen[used] += grad**2
            w[used] -= rate * grad / np.sqrt(seen[used])
    return model


def platt(scores: np.ndarray, y: np.ndarray, steps: int = 500) -> tuple[float, float]:
    """(a, b) of the probability 1/(1+exp(-(a*s+b))) fitted on held-out scores."""
    a, b = 1.0, 0.0
    if not len(scores) or y.min() == y.max():
        return a, b
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        g, m = np.array([((p - t) * scores).mean(), (p - t).mean()]), np.array([[(h * scores**2).mean() + 1e-6, (h * scores).mean()], [(h * scores).mean(), h.mean() + 1e-6]])
        da, db = np.linalg.solve(m, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a), float(b)


def log_sums(rows: Rows, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(1 + dim, columns): for each column of ``w`` the sum of the logistic loss over the rows, below it that of its gradient."""
    sign = (2.0 * y - 1)[:, None]
    s = sign * np.add.reduceat(w[rows.idx] * rows.val[:, None], rows.ptr[:-1], axis=0)
    g = np.repeat(-sign / (1 + np.exp(np.clip(s, -500, 500))), np.diff(rows.ptr), axis=0) * rows.val[:, None]
    return np.vstack([np.logaddexp(0, -s).sum(axis=0), np.stack([np.bincount(rows.idx, x, len(w)) for x in g.T], axis=1)])


def descent(dim: int, steps: int = 200, memory: int = 10, tol: float = 1e-5) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS from 0: yields where loss and gradient are wanted, is sent them, returns the place where the gradient's length
    is ``tol`` of the first."""
    w = np.zeros(dim)
    f, g = yield w
    first, past = np.linalg.norm(g), []
    for _ in range(steps):
        if np.linalg.norm(g) <= tol * first:
            break
        d, used = g.copy(), []
        for s, z in reversed(past):
            used.append((s @ d) / (s @ z))
            d -= used[-1] * z
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(g)
        for (s, z), k in zip(past, reversed(used)):
            d += s * (k - (z @ d) / (s @ z))
        step = 1.0
        while True:
            f1, g1 = yield w - step * d
            if f1 <= f - 1e-4 * step * (g @ d):
                break
            step /= 2
            if step < 1e-6:  # as low as numbers tell
                return w
        if (s := -step * d) @ (z := g1 - g) > 1e-14:
            past = [*past, (s, z)][-memory:]
        w, f, g = w - step * d, f1, g1
    return w


def platt_sums(scores: np.ndarray, t: np.ndarray, a: float, b: float) -> np.ndarray:
    """Sums of which a step of ``newton`` is made, for the probabilities ``t`` wanted."""
    p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
    h = np.maximum(p * (1 - p), 1e-6)
    return np.array([((p - t) * scores).sum(), (p - t).sum(), (h * scores**2).sum(), (h * scores).sum(), h.sum()])


def newton(sums: Callable[[float, float], np.ndarray], n: int, steps: int = 100, tol: float = 1e-6) -> tuple[float, float]:
    """(a, b) as of ``platt``, from ``platt_sums`` of ``n`` rows."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = sums(a, b) / n
        da, db = np.clip(np.linalg.solve([[haa + 1e-6, hab], [hab, hbb + 1e-6]], [ga, gb]), -1, 1)
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < tol:
            break
    return float(a), float(b)
