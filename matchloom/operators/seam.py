"""Where models plug in: an encoder turns arrays into vectors, a segmenter images into masks. Rows keep their order.

Defined results: rows without content give null vectors; an encoder that answers with another number of rows, another
length or a value that is not finite is an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Encoder(Protocol):
    dim: int
    patch: int

    def encode(self, items: list[np.ndarray]) -> np.ndarray:
        """One vector for each array (rows, columns, channels)."""

    def patch_features(self, image: np.ndarray) -> np.ndarray:
        """One vector for each patch of an image, row by row."""


class Segmenter(Protocol):
    def generate(self, image: np.ndarray) -> list[dict]:
        """Masks of an image: mask, box, score."""


class StubEncoder:
    """A fixed linear map of patch means and deviations: stands in for a model in tests and queries."""

    def __init__(self, dim: int = 64, patch: int = 14, seed: int = 0):
        self.dim, self.patch = dim, patch
        self.map = np.random.default_rng(seed).standard_normal((12, dim)) / np.sqrt(12)

    def _stats(self, block: np.ndarray) -> np.ndarray:
        x = np.atleast_3d(block).astype(float)[:, :, :3].reshape(-1, min(3, np.atleast_3d(block).shape[2]))
        x = np.pad(x, ((0, 0), (0, 3 - x.shape[1])))
        half = x[: len(x) // 2 + 1]
        return np.concatenate([x.mean(axis=0), x.std(axis=0), half.mean(axis=0), half.std(axis=0)])

    def encode(self, items: list[np.ndarray]) -> np.ndarray:
        z = np.stack([self._stats(x) for x in items]) @ self.map
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def patch_features(self, image: np.ndarray) -> np.ndarray:
        h, w = image.shape[0] // self.patch, image.shape[1] // self.patch
        return np.stack([self._stats(image[i * self.patch : (i + 1) * self.patch, j * self.patch : (j + 1) * self.patch]) for i in range(h) for j in range(w)]) @ self.map


def noise_input(patch: int, hw: tuple[int, int] = (448, 448), seed: int = 0) -> np.ndarray:
    """Normal noise in whole patches: what is fed to a model to find the directions of its positions."""
    return np.random.default_rng(seed).standard_normal((hw[0] // patch * patch, hw[1] // patch * patch, 3))


def directions(features: np.ndarray, r: int) -> np.ndarray:
    """The r leading right singular vectors of features, as orthonormal rows; not centred."""
    return np.linalg.svd(features, full_matrices=False)[2][:r]


def noise_directions(encoder: Encoder, r: int, hw: tuple[int, int] = (448, 448), seed: int = 0) -> np.ndarray:
    return directions(encoder.patch_features(noise_input(encoder.patch, hw, seed)), r)


def encode(rows: DataFrame, encoder: Encoder, group: str, order: str, keep: list[str], batch: int = 32) -> DataFrame:
    """(group, order, keep, z) of rows (group, order, keep, height, width, channels, data), encoded in order within each group, ``batch`` at a time."""
    names = [group, order, *[c for c in keep if c not in (group, order)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                h, w, c, data = (b.column(len(names) + i).to_pylist() for i in range(4))
                have = [i for i, x in enumerate(data) if x is not None]
                z: list = [None] * b.num_rows
                if have:
                    out = encoder.encode([np.frombuffer(data[i], np.uint8).reshape(h[i], w[i], c[i]) for i in have])
                    if out.shape != (len(have), encoder.dim) or not np.isfinite(out).all():
                        raise ValueError(f"encoder answered {out.shape} for {len(have)} rows, or not in finite numbers")
                    for i, v in zip(have, out.astype(np.float32), strict=True):
                        z[i] = v
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(z, pa.list_(pa.float32()))], [*names, "z"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*names).schema)
    dealt = rows.select(*names, "height", "width", "channels", "data").repartition(group).sortWithinPartitions(group, order)
    return dealt.mapInArrow(run, f"{fields}z array<float>")


def detect(images: DataFrame, segmenter: Segmenter, key: str) -> DataFrame:
    """(key, mask_no, box, score, area) of the masks that a segmenter finds in each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, h, w, c, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                found = segmenter.generate(np.frombuffer(data, np.uint8).reshape(h, w, c)) if data is not None else []
                rows = [{"key": k, "mask_no": i, "box": [float(v) for v in m["box"]], "score": float(m["score"]), "area": int(np.asarray(m["mask"]).sum())} for i, m in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", b.schema.field(0).type), ("mask_no", pa.int64()), ("box", pa.list_(pa.float64())), ("score", pa.float64()), ("area", pa.int64())]))

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "height", "width", "channels", "data").mapInArrow(run, f"key {kind}, mask_no long, box array<double>, score double, area long").withColumnRenamed("key", key)
