"""Voices as weighted directions: small numeric helpers for one session's points, at most a few hundred.

A point is a window or several merged ones: a vector of length 1 and its seconds.  Means, silhouettes and separations follow from the
clusters' vector sums, so no pair of points is looked at but for the linkage itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from murmura.functions.assign import linkage_cuts


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


@dataclass
class Clusters:
    """The sums of the points of each cluster: vectors by seconds, and seconds."""

    vectors: np.ndarray
    seconds: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, seconds: np.ndarray, label: np.ndarray, k: int) -> Clusters:
        vectors = np.zeros((k, x.shape[1]))
        np.add.at(vectors, label, x * seconds[:, None])
        return cls(vectors, np.bincount(label, seconds, k).astype(float))

    @property
    def centres(self) -> np.ndarray:
        return unit(self.vectors)

    @property
    def closest(self) -> float:
        """The distance of the two closest centres; 1 of a single one."""
        c = self.centres
        return float((1 - c @ c.T)[np.triu_indices(len(c), 1)].min()) if len(c) > 1 else 1.0

    def silhouette(self, x: np.ndarray, seconds: np.ndarray, label: np.ndarray) -> float:
        """How much nearer points are to their own cluster than to the next, by seconds; a point alone in its cluster counts 0."""
        if len(self.seconds) < 2:
            return 0.0
        pull, rows = x @ self.vectors.T, np.arange(len(x))
        others = 1 - pull / np.maximum(self.seconds, 1e-12)
        rest = self.seconds[label] - seconds
        own = 1 - (pull[rows, label] - seconds * (x * x).sum(1)) / np.maximum(rest, 1e-12)
        others[rows, label] = np.inf
        gap = (others.min(1) - own) / np.maximum(np.maximum(others.min(1), own), 1e-12)
        return float((np.where(rest > 1e-9, gap, 0.0) * seconds).sum() / seconds.sum())


@dataclass
class Choice:
    label: np.ndarray
    silhouette: float = 0.0
    closest: float = 1.0
    #: Of the numbers that were vetoed, the one whose centres were farthest apart, if one cluster was all that was left.
    near_miss: int = 0


def choose(x: np.ndarray, seconds: np.ndarray, same: float, most: int, exact: int = 0, members: np.ndarray | None = None) -> Choice:
    """Clusters of points by average linkage: ``exact`` ones, or the number with the best silhouette.

    Numbers whose closest centres differ by less than ``same`` are vetoed; the smaller number wins a tie; if none is left, all is one voice.
    """
    cuts = linkage_cuts(np.clip(1 - x @ x.T, 0, 2), min(len(x), max(exact, most)), members)
    tried = {}
    for k, label in sorted(cuts.items()):
        if k == exact or not exact and 2 <= k <= min(most, len(x) - 1):
            sums = Clusters.of(x, seconds, label, k)
            tried[k] = Choice(label, sums.silhouette(x, seconds, label), sums.closest)
    if exact:
        return tried.get(exact) or tried.get(max(tried, default=0)) or Choice(np.zeros(len(x), int))
    allowed = [c for c in tried.values() if c.closest >= same]
    if allowed:
        return max(allowed, key=lambda c: round(c.silhouette, 12))
    missed = max(tried, key=lambda k: tried[k].closest, default=0)
    return Choice(np.zeros(len(x), int), near_miss=missed)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point the nearest centre, its distance, and how much farther the next one is (1 where there is none)."""
    d = 1 - x @ centres.T
    label = d.argmin(1)
    best = d[np.arange(len(d)), label]
    second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else best + 1.0
    return label, best, second - best
