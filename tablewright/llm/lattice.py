"""The E8 lattice: nearest points and their neighbours."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

SIZE = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors: two entries of +-1, or eight of +-1/2 with an even number of minuses."""
    out = []
    for i, j in combinations(range(SIZE), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(SIZE)
            v[i], v[j] = a, b
            out.append(v)
    for signs in product((0.5, -0.5), repeat=SIZE):
        if sum(s < 0 for s in signs) % 2 == 0:
            out.append(np.array(signs))
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest points with integer entries of even sum: round, and where the sum is odd round
    the entry that was changed most to its other side."""
    x = np.rint(y)
    odd = np.flatnonzero(x.sum(1) % 2)
    gap = y[odd] - x[odd]
    worst = np.abs(gap).argmax(1)
    x[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return x


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest lattice points of rows of eight numbers.  E8 is D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def neighbours(y: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """For each row the ``most`` lattice points next to ``x`` that lie closest to ``y``."""
    toward = (y - x) @ ROOTS.T
    best = np.argpartition(-toward, most - 1, axis=1)[:, :most]
    return x[:, None, :] + ROOTS[best]
