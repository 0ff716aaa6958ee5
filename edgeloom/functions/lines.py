"""Line simplification by the farthest-point rule."""

from __future__ import annotations

import numpy as np


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points to keep: a stretch keeps its ends, and its farthest point while that lies
    more than ``tolerance`` off the straight line between them."""
    points = np.asarray(points, dtype=float)
    keep = np.zeros(len(points), dtype=bool)
    if not len(points):
        return keep
    keep[[0, -1]] = True
    open_ = [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        span, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.linalg.norm(span)
        if length == 0:
            off = np.linalg.norm(inner, axis=1)
        else:
            along = inner @ span / length
            off = np.sqrt(np.maximum((inner**2).sum(axis=1) - along**2, 0))
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            open_ += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep
