"""Masks and crops of images as arrays (rows, columns, channels): windows, boxes, squares, fillers, blur, resizing."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

# The colour of what is out of the frame, the crop's side, the blur's width as a share of the square.
MEAN = (124, 116, 104)
CROP, SIGMA = 448, 0.05
FILLERS = ("0", "mean", "blur")


def grey(image: np.ndarray) -> np.ndarray:
    """Grey levels of an image with one channel, or with blue, green, red (and more, ignored)."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return np.clip(np.round(image[:, :, :3].astype(float) @ [0.114, 0.587, 0.299]), 0, 255).astype(np.uint8)


def mask_box(mask: np.ndarray) -> list[int]:
    """x0, y0, x1, y1 (exclusive) of what a mask covers; an empty mask is an error."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        raise ValueError("empty mask")
    return [int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1]


def square(box: tuple[float, float, float, float], factor: float) -> tuple[int, int, int]:
    """Left, top and side of the square around a box, in whole pixels, halves to even."""
    side = max(1, round(factor * max(box[2] - box[0], box[3] - box[1])))
    return round((box[0] + box[2]) / 2 - side / 2), round((box[1] + box[3]) / 2 - side / 2), side


def _linear(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at rows y and columns x; the border repeats."""
    h, w = image.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    i, j = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    i1, j1 = np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)
    fy, fx = (y - i)[:, None], (x - j)[None, :]
    if image.ndim == 3:
        fy, fx = fy[:, :, None], fx[:, :, None]
    image = image.astype(float)
    top = image[np.ix_(i, j)] * (1 - fx) + image[np.ix_(i, j1)] * fx
    return top * (1 - fy) + (image[np.ix_(i1, j)] * (1 - fx) + image[np.ix_(i1, j1)] * fx) * fy


def mask_window(mask: np.ndarray, scale: tuple[float, float], x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """A window, in pixels of the original, of a mask held at another size: bilinear at pixel centres, over one half; empty out of the frame."""
    sx, sy = scale
    h, w = round(mask.shape[0] * sy), round(mask.shape[1] * sx)
    out = _linear(mask, (np.arange(y0, y1) + 0.5) / sy - 0.5, (np.arange(x0, x1) + 0.5) / sx - 0.5) > 0.5
    inside = lambda a, n: (a >= 0) & (a < n)
    return out & inside(np.arange(y0, y1), h)[:, None] & inside(np.arange(x0, x1), w)[None, :]


def _shares(n: int, m: int) -> np.ndarray:
    """Share of each of n pixels in each of m equal cells."""
    edge = np.arange(m + 1) * n / m
    return np.maximum(np.minimum(edge[1:, None], np.arange(n) + 1) - np.maximum(edge[:-1, None], np.arange(n)), 0) * m / n


def _along(rows: np.ndarray, image: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """An image under one linear map of its rows and one of its columns."""
    half = np.tensordot(rows, image, axes=(1, 0))
    return np.moveaxis(np.tensordot(columns, half, axes=(1, 1)), 0, 1)


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """By area where it shrinks, else bilinear."""
    a = image.astype(float)
    if h <= a.shape[0] and w <= a.shape[1]:
        return _along(_shares(a.shape[0], h), a, _shares(a.shape[1], w))
    return _linear(a, (np.arange(h) + 0.5) * a.shape[0] / h - 0.5, (np.arange(w) + 0.5) * a.shape[1] / w - 0.5)


def _gauss(n: int, sigma: float, at: np.ndarray) -> np.ndarray:
    """Weights of n pixels in each of the blurred pixels ``at``: a Gaussian of three widths to each side, folded back at the border."""
    step = np.arange(-max(1, math.ceil(3 * sigma)), max(1, math.ceil(3 * sigma)) + 1)
    weight = np.exp(-0.5 * (step / sigma) ** 2)
    turn = max(2 * (n - 1), 1)
    source = np.abs((at[:, None] + step + n - 1) % turn - (n - 1)) if n > 1 else np.zeros((len(at), len(step)), int)
    out = np.zeros((len(at), n))
    np.add.at(out, (np.arange(len(at))[:, None], source), weight / weight.sum())
    return out


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur; the border is mirrored."""
    h, w = image.shape[:2]
    return _along(_gauss(h, sigma, np.arange(h)), image.astype(float), _gauss(w, sigma, np.arange(w)))


class Cut:
    """A square of an image, which may reach out of the frame: where its pixels are in the frame, clipped once, and which are seen."""

    def __init__(self, shape: tuple[int, ...], left: int, top: int, side: int):
        self.side, self.y, self.x = side, top + np.arange(side), left + np.arange(side)
        self.rows, self.columns = np.clip(self.y, 0, shape[0] - 1), np.clip(self.x, 0, shape[1] - 1)
        self.seen = ((self.rows == self.y)[:, None] & (self.columns == self.x)[None, :])[:, :, None]

    def pixels(self, image: np.ndarray) -> np.ndarray:
        return image[np.ix_(self.rows, self.columns)]

    def blurred(self, image: np.ndarray, share: float = SIGMA, work: int = 4 * CROP) -> np.ndarray:
        """The same pixels of the image blurred by a share of the side; squares over ``work`` pixels are blurred at that size."""
        sigma = share * self.side
        near = math.ceil(3 * sigma)  # what lies further off has no weight
        y0, x0 = max(int(self.rows[0]) - near, 0), max(int(self.columns[0]) - near, 0)
        part = image[y0 : int(self.rows[-1]) + near + 1, x0 : int(self.columns[-1]) + near + 1].astype(float)
        h, w = part.shape[:2]
        at = self.rows - y0, self.columns - x0
        if self.side <= work:
            return _along(_gauss(h, sigma, at[0]), part, _gauss(w, sigma, at[1]))
        k = work / self.side
        small = blur(resize(part, max(1, round(h * k)), max(1, round(w * k))), sigma * k)
        return _linear(small, (at[0] + 0.5) * small.shape[0] / h - 0.5, (at[1] + 0.5) * small.shape[1] / w - 0.5)


def crop(image: np.ndarray, box: tuple[float, float, float, float], window: Callable[[int, int, int, int], np.ndarray], filler: str, factor: float, size: int = CROP) -> np.ndarray:
    """A size x size crop around a box: the mask's pixels on black, on the mean colour, or on their blurred surroundings; the mean colour out of the frame of those."""
    around = {"0": lambda _: np.zeros(3), "mean": lambda _: np.array(MEAN), "blur": lambda c: np.where(c.seen, c.blurred(image), MEAN)}
    if filler not in around:
        raise ValueError(f"filler {filler!r} is none of {FILLERS}")
    left, top, side = square(box, factor)
    c = Cut(image.shape, left, top, side)
    own = c.seen & window(left, top, left + side, top + side)[:, :, None]
    out = np.where(own, c.pixels(image), around[filler](c))
    return np.clip(np.round(out if side == size else resize(np.round(out), size, size)), 0, 255).astype(np.uint8)
