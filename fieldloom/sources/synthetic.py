"""Synthetic fields of bright ellipses with known labels: one seeded field a row, made where the row is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldloom.operators.kernels import gaussian


def synthetic_field(side: int = 192, n_objects: int = 15, radius: tuple[float, float] = (8.0, 12.0), touching: bool = False, noise: float = 0.02, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """An image (float32, 0 to 1) and its labels. Ellipses that would lie more than half on others, or touch one where that
    is not wanted, are placed anew, 40 times n_objects at most."""
    rng = np.random.default_rng(seed)
    gy, gx = np.mgrid[:side, :side]
    labels, signal, made = np.zeros((side, side), np.int32), np.zeros((side, side)), 0
    for _ in range(40 * n_objects):
        if made == n_objects:
            break
        a, b = rng.uniform(*radius, 2)
        y, x = rng.uniform(radius[1], side - radius[1], 2)
        turn = rng.uniform(0, np.pi)
        u, v = (gy - y) * np.sin(turn) + (gx - x) * np.cos(turn), (gy - y) * np.cos(turn) - (gx - x) * np.sin(turn)
        far = (u / a) ** 2 + (v / b) ** 2
        inside = far <= 1
        near = ((u / (a + 2)) ** 2 + (v / (b + 2)) ** 2) <= 1
        if not inside.any() or (labels[inside] > 0).mean() > 0.5 or (not touching and (labels[near] > 0).any()):
            continue
        made += 1
        free = inside & (labels == 0)
        labels[free] = made
        signal[free] = rng.uniform(0.6, 0.9) * (1 - 0.3 * far[free])
    centre = rng.uniform(0.3, 0.7, 2) * side
    shade = 1 - 0.15 * np.hypot(gy - centre[0], gx - centre[1]) / side
    image = gaussian(0.08 + signal, 1.0) * shade
    image = rng.poisson(image * 2000) / 2000 + rng.normal(0, noise, image.shape)
    return np.clip(image, 0, 1).astype(np.float32), labels


def synthetic_fields(spark: SparkSession, n: int, channels: int = 1, **how) -> DataFrame:
    """image_id, channel_idx, role, height, width, data (array<float>), labels (array<int>) of n fields; image_id is the seed.

    Channels of a field share its labels: the first is the nuclei channel, the others are markers with gains of their own."""

    def make(batches):
        for batch in batches:
            rows = []
            for seed in batch.column("id").to_pylist():
                image, labels = synthetic_field(**how, seed=seed)
                rng = np.random.default_rng(seed + 1000)
                for c in range(channels):
                    gain = np.concatenate([[1.0], rng.uniform(0.3, 1.2, labels.max())])[labels] if c else 1.0
                    rows.append((seed, c, "marker" if c else "nuclei", *labels.shape, np.clip(image * gain, 0, 1).ravel().astype(np.float32), labels.ravel()))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int32())]
            names = ["image_id", "channel_idx", "role", "height", "width", "data", "labels"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.range(n).mapInArrow(make, "image_id long, channel_idx int, role string, height int, width int, data array<float>, labels array<int>")
