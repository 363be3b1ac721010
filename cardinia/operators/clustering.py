"""Two ways to cut rows into clusters, fitted on a bounded sample: Gaussian mixtures and k-means."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FIT_ROWS = 10_000


@dataclass
class Clusters:
    """Assigns a row of features to one of k clusters."""

    centres: np.ndarray
    variances: np.ndarray | None = None
    weights: np.ndarray | None = None
    #: A cut in two along one feature, instead.
    axis: int | None = None
    cut: float = 0.0

    def labels(self, x: np.ndarray) -> np.ndarray:
        if self.axis is not None:
            return (x[:, self.axis] > self.cut).astype(int)
        if self.variances is None:
            return np.argmin(((x[:, None, :] - self.centres[None]) ** 2).sum(-1), axis=1)
        return np.argmax(self._log(x), axis=1)

    def _log(self, x: np.ndarray) -> np.ndarray:
        d = (x[:, None, :] - self.centres[None]) ** 2 / self.variances[None]
        return np.log(self.weights)[None] - 0.5 * (d.sum(-1) + np.log(self.variances).sum(-1)[None])


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    out = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(1) for c in out], axis=0)
        out.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(out)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 50) -> Clusters:
    out = Clusters(_seeds(x, k, rng))
    for _ in range(steps):
        labels = out.labels(x)
        new = np.array([x[labels == i].mean(0) if (labels == i).any() else out.centres[i] for i in range(k)])
        if np.allclose(new, out.centres):
            break
        out.centres = new
    return out


def gaussian_mixture(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 100, floor: float = 1e-6) -> Clusters:
    """Expectation maximisation with diagonal covariances, from k-means."""
    start = k_means(x, k, rng, 10)
    labels = start.labels(x)
    r = np.eye(k)[labels]
    out, last = start, -np.inf
    for _ in range(steps):
        n = r.sum(0) + 1e-10
        centres = r.T @ x / n[:, None]
        variances = np.maximum(r.T @ (x * x) / n[:, None] - centres**2, 0) + floor
        out = Clusters(centres, variances, n / n.sum())
        log = out._log(x)
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        r = np.exp(log - total[:, None])
        if total.mean() - last < 1e-3:
            break
        last = total.mean()
    return out


def median_cut(x: np.ndarray) -> Clusters:
    """Two halves along the feature of greatest variance; one cluster where nothing varies."""
    axis = int(np.argmax(x.var(0)))
    column = np.sort(x[:, axis])
    # The last value of the lower half, or the smallest where more than half are the largest.
    cut = column[(len(column) - 1) // 2]
    return Clusters(x[:1], axis=axis, cut=float(cut if cut < column[-1] else column[0]))


def split(x: np.ndarray, k: int = 2, how: str = "gmm", seed: int = 1) -> tuple[Clusters, np.ndarray]:
    """Clusters and the rows' labels: mixtures or k-means, or where these find one cluster, a median cut. Rows without any variance are one cluster."""
    rng = np.random.default_rng(seed)
    some = x if len(x) <= FIT_ROWS else x[rng.choice(len(x), FIT_ROWS, replace=False)]
    found = k_means(some, k, rng) if how == "kmeans" else gaussian_mixture(some, k, rng)
    labels = found.labels(x)
    if labels.min() == labels.max():
        found = median_cut(x)
        labels = found.labels(x)
    return found, labels
