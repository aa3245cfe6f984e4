"""Union-find over the rows of one task."""

from __future__ import annotations

import numpy as np


class Groups:
    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def hook(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``up``, each node's root, after the links x, y: many at once, in rounds that hang each root under the least that it is linked with."""
    while len(x):
        a, b = up[x], up[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return up
