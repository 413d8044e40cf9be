"""Maps of a bounded number of things, from their distances (EMB-05, EMB-12)."""

from __future__ import annotations

import numpy as np

from .vectors import classical_mds


def smacof(d: np.ndarray, k: int = 2, steps: int = 300) -> np.ndarray:
    """Coordinates of least stress, from the classical ones by majorisation; signs fixed by the largest entry."""
    n = len(d)
    x = classical_mds(d, k)
    for _ in range(steps):
        e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        ratio = np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
        b = -ratio
        b[np.arange(n), np.arange(n)] += ratio.sum(1)
        x = b @ x / n
    x = x - x.mean(0)
    pivot = np.argmax(np.abs(x), axis=0)
    return x * np.sign(x[pivot, np.arange(k)])


def stress(d: np.ndarray, x: np.ndarray) -> float:
    e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return float(((d - e) ** 2).sum() / (d**2).sum())


def _ranks(v: np.ndarray) -> np.ndarray:
    u, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]


def rank_preservation(d: np.ndarray, x: np.ndarray) -> float:
    """Rank correlation of all distances with those in the map."""
    e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i = np.triu_indices(len(d), 1)
    return float(np.corrcoef(_ranks(d[i]), _ranks(e[i]))[0, 1])


def neighbor_preservation(d: np.ndarray, x: np.ndarray, k: int) -> float:
    """Share of the k nearest that the map keeps."""
    e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [np.argsort(m + np.diag([np.inf] * len(m)), axis=1, kind="stable")[:, :k] for m in (d, e)]
    return float(np.mean([len(set(a) & set(b)) / k for a, b in zip(*near, strict=True)]))
