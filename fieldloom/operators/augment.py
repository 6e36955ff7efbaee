"""Seeded augmentation of fields with their labels, crops and padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import kernels as K
from fieldloom.operators import segment as S
from fieldloom.operators.preprocess import Chain, preprocess_field


def padded(a: np.ndarray, size: int, zeros: bool = False) -> np.ndarray:
    """Both sides at least size, mirrored without the edge, or with zeros (labels); the larger half of the padding last."""
    pad = [(max(0, size - n) // 2, max(0, size - n) - max(0, size - n) // 2) for n in a.shape[:2]]
    return np.pad(a, pad, mode="constant" if zeros else "reflect") if any(map(any, pad)) else a


def cropped(a: np.ndarray, size: int, at: tuple[int, int] | None = None, zeros: bool = False) -> np.ndarray:
    """A size x size part of the padded field from at on, or from its middle."""
    a = padded(a, size, zeros)
    y, x = at or ((a.shape[0] - size) // 2, (a.shape[1] - size) // 2)
    return a[y : y + size, x : x + size]


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Values at fractional places: linear with mirrored borders, or the nearest, 0 outside (labels)."""
    h, w = a.shape
    if nearest:
        iy, ix = np.rint(y).astype(int), np.rint(x).astype(int)
        inside = (iy >= 0) & (iy < h) & (ix >= 0) & (ix < w)
        return np.where(inside, a[np.clip(iy, 0, h - 1), np.clip(ix, 0, w - 1)], 0)
    mirror = lambda k, n: np.abs((k + n - 1) % (2 * n - 2) - (n - 1)) if n > 1 else k * 0
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    at = lambda i, j: a[mirror(y0 + i, h), mirror(x0 + j, w)]
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def turned(a: np.ndarray, labels: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    k, across, down = int(r.integers(4)), r.random() < 0.5, r.random() < 0.5
    for flip, axis in ((across, 1), (down, 0)):
        a, labels = (np.flip(a, axis), np.flip(labels, axis)) if flip else (a, labels)
    return np.rot90(a, k), np.rot90(labels, k)


def affine(a: np.ndarray, labels: np.ndarray, r: np.random.Generator, degrees: float = 15.0, scales: tuple[float, float] = (0.85, 1.15)) -> tuple[np.ndarray, np.ndarray]:
    """Turned and scaled about the middle."""
    angle, scale = np.radians(r.uniform(-degrees, degrees)), r.uniform(*scales)
    y, x = np.indices(a.shape)
    y, x = y - a.shape[0] / 2, x - a.shape[1] / 2
    c, s = np.cos(angle) / scale, np.sin(angle) / scale
    places = (a.shape[0] / 2 + c * y + s * x, a.shape[1] / 2 + c * x - s * y)
    return sampled(a, *places), sampled(labels, *places, nearest=True)


def elastic(a: np.ndarray, labels: np.ndarray, r: np.random.Generator, alpha: float = 12.0, sigma: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Moved along a smooth random field."""
    y, x = np.indices(a.shape)
    dy, dx = (K.gaussian(r.uniform(-1, 1, a.shape), sigma) * alpha for _ in range(2))
    return sampled(a, y + dy, x + dx), sampled(labels, y + dy, x + dx, nearest=True)


def intensity(a: np.ndarray, r: np.random.Generator) -> np.ndarray:
    return np.clip(a * r.uniform(0.8, 1.2) + r.uniform(-0.1, 0.1), 0, 1) ** r.uniform(0.75, 1.35)


def augmented(a: np.ndarray, labels: np.ndarray, r: np.random.Generator, chance: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Turns always, the other changes by chance; labels follow every move by their nearest pixel."""
    a, labels = turned(a, labels, r)
    for move in (affine, elastic):
        if r.random() < chance:
            a, labels = move(a, labels, r)
    if r.random() < chance:
        a = intensity(a, r)
    if r.random() < chance:
        a = K.gaussian(a, r.uniform(0.5, 1.5))
    if r.random() < chance:
        a = a + r.normal(0, 0.03, a.shape)
    return np.clip(a, 0, 1), labels


def augment_fields(fields: DataFrame, seed: int = 0) -> DataFrame:
    """fields (square) with data and labels augmented; a field's random numbers depend on the seed and its image_id only."""

    def both(a, labels, key):
        x, y = augmented(a, labels.astype(int), np.random.default_rng([seed, abs(int(key.flat[0]))]))
        return np.concatenate([x.ravel(), y.ravel()])

    rows = fields.withColumn("_key", F.transform("data", lambda _: F.col("image_id").cast("double")))
    made = K.map_fields(rows, both, "_made", "array<double>", ("data", "labels", "_key"))
    n = F.size("data")
    labels = F.transform(F.slice("_made", n + 1, n), lambda v: v.cast("int"))
    return made.withColumns({"_data": F.slice("_made", F.lit(1), n), "_labels": labels}).withColumns({"data": F.col("_data"), "labels": F.col("_labels")}).drop("_data", "_labels", "_made", "_key")


def training_items(fields: DataFrame, size: int, train: bool = True, how: Chain = Chain(), boundary: int = 2, seed: int = 0) -> DataFrame:
    """image_id, height, width, data, labels, target (classes) and distance of one size x size part of every field.

    The whole field goes through the chain, as its statistics are those of the field, not of the part; then it is cut, at a
    random place and augmented for training, else in its middle. Random numbers depend on the seed and the image_id only."""

    def item(a, labels, key):
        a, labels, r = preprocess_field(a, how)[0], labels.astype(int), np.random.default_rng([seed, abs(int(key.flat[0]))])
        at = tuple(int(r.integers(0, max(n - size, 0) + 1)) for n in a.shape) if train else None
        a, labels = cropped(a, size, at), cropped(labels, size, at, zeros=True)
        if train:
            a, labels = augmented(a, labels, r)
        return np.concatenate([x.ravel() for x in (a, labels, S.semantic_target(labels, boundary), S.distance_target(labels))])

    rows = fields.withColumn("_key", F.transform("data", lambda _: F.col("image_id").cast("double")))
    made = K.map_fields(rows, item, "_made", "array<double>", ("data", "labels", "_key"))
    n = size * size
    part = lambda k, kind: F.slice("_made", k * n + 1, n).cast(f"array<{kind}>")
    return made.select("image_id", F.lit(size).alias("height"), F.lit(size).alias("width"), part(0, "double").alias("data"), part(1, "int").alias("labels"), part(2, "int").alias("target"), part(3, "double").alias("distance"))
