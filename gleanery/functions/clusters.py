"""Unit vectors and k-means on arrays: the parts of approximate search that run on a bounded sample or within a batch."""

from __future__ import annotations

import numpy as np


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    # In two steps, so that squares of very small or large parts neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True).clip(1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)


def nearest_rows(x: np.ndarray, centroids: np.ndarray, n: int, block: int = 2048) -> np.ndarray:
    """Indexes of the ``n`` centroids with the largest product, the largest first."""
    out = np.empty((len(x), n), np.int32)
    for i in range(0, len(x), block):
        s = x[i : i + block] @ centroids.T
        if n == 1:
            out[i : i + block, 0] = s.argmax(1)
            continue
        top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        out[i : i + block] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool = False, rounds: int = 6) -> np.ndarray:
    k = min(k, len(x))
    centers = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        if spherical:
            to = nearest_rows(x, centers, 1)[:, 0]
        else:
            to = np.concatenate(
                [((centers**2).sum(1)[None, :] - 2 * x[i : i + 4096] @ centers.T).argmin(1) for i in range(0, len(x), 4096)]
            )
        n = np.bincount(to, minlength=k)
        order = np.argsort(to, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        sums = np.zeros_like(centers)
        full = n > 0
        sums[full] = np.add.reduceat(x[order], starts[full], axis=0)
        centers = np.where(full[:, None], sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
        if spherical:
            centers = unit(centers).astype(np.float32)
    return centers.astype(np.float32)
