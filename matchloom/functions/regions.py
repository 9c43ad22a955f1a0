"""Connected regions of a mask by runs: rows are cut into runs, runs of neighbouring rows that touch are joined."""

from __future__ import annotations

import numpy as np


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all runs, row by row."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1]


def regions(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(boxes x0, y0, x1, y1 exclusive; areas) of connected regions, by top, then left run; pixels that meet at a corner are connected if ``diagonal``."""
    row, start, end = _runs(np.asarray(mask, bool))
    n = len(row)
    if not n:
        return np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    reach, wide = int(diagonal), mask.shape[1] + 4
    # runs of the next row that end after a run's start and start before its end
    lo = np.searchsorted(row * wide + end, (row + 1) * wide + start - reach, "right")
    hi = np.searchsorted(row * wide + start, (row + 1) * wide + end + reach, "left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo, count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(n)
    while True:  # each root hooks to the least root that it touches, then every run finds its root: rounds grow with the logarithm of the longest chain
        x, y = root[a], root[b]
        least = root.copy()
        np.minimum.at(least, x, y)
        np.minimum.at(least, y, x)
        while (least != least[least]).any():
            least = least[least]
        root = least[root]
        if (root[a] == root[b]).all():
            break
    name, at = np.unique(root, return_inverse=True)
    box = np.empty((len(name), 4), np.int64)
    for i, (values, pick, worst) in enumerate(((start, np.minimum, mask.shape[1]), (row, np.minimum, mask.shape[0]), (end, np.maximum, 0), (row + 1, np.maximum, 0))):
        box[:, i] = worst
        pick.at(box[:, i], at, values)
    return box, np.bincount(at, weights=end - start).astype(np.int64)


def spread(mask: np.ndarray, side: int) -> np.ndarray:
    """A mask widened by a square of odd side."""
    r, (h, w) = side // 2, mask.shape
    total = np.zeros((h + 2 * r + 1, w + 2 * r + 1), np.int32)
    total[1 + r : 1 + r + h, 1 + r : 1 + r + w] = mask
    total = total.cumsum(axis=0).cumsum(axis=1)
    full = np.pad(total, ((0, side), (0, side)), mode="edge")
    return full[side : side + h, side : side + w] - full[:h, side : side + w] - full[side : side + h, :w] + full[:h, :w] > 0


def changes(image: np.ndarray, clean: np.ndarray, over: int = 25, least: int = 60, widen: int = 9) -> tuple[np.ndarray, np.ndarray, float]:
    """(boxes, areas, median difference) of the regions where an image differs from a clean one: largest difference of the channels, smoothed, above ``over``, widened, of ``least`` pixels or more."""
    d = np.abs(np.atleast_3d(image).astype(np.int16) - np.atleast_3d(clean).astype(np.int16)).max(axis=2).astype(float)
    weight = np.array([1, 4, 6, 4, 1]) / 16  # fixed values: the smoothing kernel
    for axis in (0, 1):
        n = d.shape[axis]
        turn = max(2 * (n - 1), 1)
        d = sum(w * np.take(d, np.abs((np.arange(n) + k + n - 1) % turn - (n - 1)) if n > 1 else np.zeros(1, int), axis=axis) for k, w in zip(range(-2, 3), weight, strict=True))
    d = np.floor(d + 0.5)
    box, area = regions(spread(d > over, widen))
    return box[area >= least], area[area >= least], float(np.median(d))
