"""Components within one task's rows."""

from __future__ import annotations

import numpy as np


class Labels:
    """Component labels of 0..n-1; a label is the least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.label[at]

    def all(self) -> np.ndarray:
        return self.label

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i] for every i."""
        label = self.label
        while True:
            la, lb = label[a], label[b]
            off = la != lb
            if not off.any():
                return
            np.minimum.at(label, np.maximum(la[off], lb[off]), np.minimum(la[off], lb[off]))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
