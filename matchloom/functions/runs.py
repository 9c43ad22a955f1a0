"""Masks as sorted runs: union, intersection, IoU and box without a pixel in memory.

A mask of height h is two arrays, the starts and the (exclusive) ends of its runs in column-major order: pixel (x, y) is x * h + y.
Runs are sorted, apart and not empty; a run may go on into the next column.
"""

from __future__ import annotations

import numpy as np

from .scalar import _pack, rle_runs

Runs = tuple[np.ndarray, np.ndarray]
NONE: Runs = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def from_rle(rle: dict) -> Runs:
    """Of run lengths, zeros first."""
    edge = np.cumsum([0, *rle_runs(rle["counts"])])
    a, b = edge[1:-1:2], edge[2::2]
    return a[a < b], b[a < b]


def to_rle(runs: Runs, size: tuple[int, int]) -> dict:
    edge = np.concatenate([[0], np.stack(runs, axis=1).ravel(), [size[0] * size[1]]])
    lengths = np.diff(edge).tolist()
    if lengths and lengths[-1] == 0:  # the mask holds the last pixel
        lengths.pop()
    return {"size": list(size), "counts": _pack(lengths)}


def from_box(box: tuple[int, int, int, int], h: int) -> Runs:
    """x0, y0, x1, y1 (exclusive) in a frame of height h."""
    x0, y0, x1, y1 = box
    x = np.arange(x0, x1 if y0 < y1 else x0, dtype=np.int64) * h
    return joined((x + y0, x + y1))


def from_boxes(box: np.ndarray, h: int | np.ndarray, notch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``from_box`` of many boxes [n, 4] at once: (runs of each mask, starts, ends), one mask after another.

    ``notch`` [n, 2] is a width and a height that each box lacks at its upper right corner.
    """
    x0, y0, x1, y1 = box.T
    wide = np.where(y0 < y1, np.maximum(x1 - x0, 0), 0)
    own = np.repeat(np.arange(len(box)), wide)
    x = np.arange(len(own)) - np.repeat(np.cumsum(wide) - wide, wide) + x0[own]
    top = y0[own] if notch is None else y0[own] + np.where(x >= (x1 - notch[:, 0])[own], notch[:, 1][own], 0)
    a, b = x * h + top, x * h + y1[own]
    full = a < b
    own, a, b = own[full], a[full], b[full]
    if not len(own):
        return np.zeros(len(box), np.int64), a, b
    apart = (a[1:] > b[:-1]) | (own[1:] != own[:-1])  # runs that touch are one
    a, b, own = a[np.append(True, apart)], b[np.append(apart, True)], own[np.append(True, apart)]
    return np.bincount(own, minlength=len(box)), a, b


def depths(starts: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """Pixels that lie in one or more of the masks whose runs these are, and in two or more."""
    at = np.sort(np.concatenate([starts * 2 + 1, ends * 2]))
    inside, gap = np.cumsum((at[:-1] & 1) * 2 - 1), np.diff(at >> 1)
    return int(gap[inside >= 1].sum()), int(gap[inside >= 2].sum())


def joined(runs: Runs) -> Runs:
    """Sorted runs that touch, as one."""
    a, b = runs
    if not len(a):
        return NONE
    apart = a[1:] > b[:-1]
    return a[np.append(True, apart)], b[np.append(apart, True)]


def area(runs: Runs) -> int:
    return int((runs[1] - runs[0]).sum())


def covered(masks: list[Runs], least: int) -> Runs:
    """Pixels that lie in ``least`` of the masks or more: 1 is the union, all of them the intersection. One sweep over the ends of all runs."""
    if not masks or least > len(masks):
        return NONE
    at = np.concatenate([x for m in masks for x in m])
    step = np.concatenate([np.full(len(m[0]), s) for m in masks for s in (1, -1)])
    place, inverse = np.unique(at, return_inverse=True)
    inside = np.cumsum(np.bincount(inverse, weights=step, minlength=len(place))) >= least
    before = np.append(False, inside[:-1])
    return place[inside & ~before], place[~inside & before]


def minus(a: Runs, b: Runs) -> Runs:
    """Pixels of a that are not in b."""
    hole = covered([a, b], 2)
    edge = np.sort(np.concatenate([*a, *hole]))  # ends that meet cancel out
    return tuple(x[edge[::2] < edge[1::2]] for x in (edge[::2], edge[1::2]))


def below(runs: Runs, at: np.ndarray) -> np.ndarray:
    """How many pixels of a mask come before each position."""
    a, b = runs
    if not len(a):
        return np.zeros(len(at), np.int64)
    total = np.concatenate([[0], np.cumsum(b - a)])
    i = np.searchsorted(a, at, "right") - 1
    j = np.maximum(i, 0)
    return np.where(i < 0, 0, total[j] + np.clip(at - a[j], 0, (b - a)[j]))


def overlaps(one: Runs, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pixels that a mask shares with each of several others, whose runs stand one after another; ``first`` says where each begins."""
    shared = np.concatenate([[0], np.cumsum(below(one, ends) - below(one, starts))])
    return shared[np.append(first[1:], len(starts))] - shared[first]


class Flat:
    """Many masks' runs, one mask after another, for questions to many pairs at once."""

    def __init__(self, count: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.starts, self.ends = starts, ends
        self.before = np.concatenate([[0], np.cumsum(ends - starts)])  # pixels of all runs before
        self.area = self.before[self.first[1:]] - self.before[self.first[:-1]]
        some = count > 0
        self.lo, self.hi = np.full(len(count), -1, np.int64), np.full(len(count), -1, np.int64)
        self.lo[some], self.hi[some] = starts[self.first[:-1][some]], ends[self.first[1:][some] - 1]
        self.zero = int(starts.min()) if len(starts) else 0
        self.base = int(ends.max()) - self.zero + 1 if len(ends) else 1  # a mask's positions, raised by its place times this, follow those of the mask before
        up = np.repeat(np.arange(len(count)), count) * self.base - self.zero
        self.start_key, self.end_key = starts + up, ends + up

    def one(self, j: int) -> Runs:
        return self.starts[self.first[j] : self.first[j + 1]], self.ends[self.first[j] : self.first[j + 1]]

    def _below(self, mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many pixels of masks come before positions, each of its own mask."""
        j = np.searchsorted(self.start_key, mask * self.base + at - self.zero, "right") - 1
        k = np.maximum(j, self.first[mask])
        held = self.before[k] - self.before[self.first[mask]] + np.minimum(at - self.starts[k], (self.ends - self.starts)[k])
        return np.where(j < self.first[mask], 0, held)

    def shared(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Pixels that each pair of masks that are not empty shares: the runs of k that can meet i look up how much of i they hold."""
        r0 = np.searchsorted(self.end_key, k * self.base + self.lo[i] - self.zero, "right")
        n = np.maximum(np.searchsorted(self.start_key, k * self.base + self.hi[i] - self.zero, "left") - r0, 0)
        pair = np.repeat(np.arange(len(i)), n)
        r = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + r0[pair]
        v = self._below(i[pair], self.ends[r]) - self._below(i[pair], self.starts[r])
        return np.bincount(pair, weights=v, minlength=len(i)).astype(np.int64)

    def rows(self, h: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows (first, last and one) that each mask may hold in a frame of height h; (0, 0) of an empty one."""
        lo, hi = self.starts % h, (self.ends - 1) % h + 1
        over = self.starts // h != (self.ends - 1) // h
        lo, hi = np.where(over, 0, lo), np.where(over, h, hi)
        some = self.first[1:] > self.first[:-1]
        top, end = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        if some.any():
            top[some], end[some] = np.minimum.reduceat(lo, self.first[:-1][some]), np.maximum.reduceat(hi, self.first[:-1][some])
        return top, end


def iou(a: Runs, b: Runs, crowd: bool = False) -> float:
    """Intersection over union; over a alone, where b is a crowd."""
    both = area(covered([a, b], 2))
    whole = area(a) if crowd else area(a) + area(b) - both
    return both / whole if whole else 0.0


def box(runs: Runs, h: int) -> tuple[int, int, int, int]:
    """x0, y0, x1, y1 (exclusive); all 0 for an empty mask."""
    a, b = runs
    if not len(a):
        return 0, 0, 0, 0
    left, right = a // h, (b - 1) // h
    long = bool((left != right).any())  # a run that goes on into the next column has its last and its first pixel
    return int(left[0]), 0 if long else int((a % h).min()), int(right[-1]) + 1, h if long else int(((b - 1) % h).max()) + 1
