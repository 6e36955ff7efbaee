"""Per-field preprocessing on pixel arrays: every step is a column expression or one kernel, none shuffles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import arrays as A
from fieldloom.operators import kernels as K


def percentile_normalize(data: Column, low: float = 1.0, high: float = 99.0) -> Column:
    if high <= low:
        raise ValueError("high must be above low")
    return A.rescale(data, A.quantiles(data, low / 100, high / 100), clipped=True)


def minmax_normalize(data: Column) -> Column:
    return A.rescale(data, F.array(F.array_min(data), F.array_max(data)))


def zscore_normalize(data: Column, clip_sigma: float | None = 3.0) -> Column:
    scale = (lambda z: A.clip((z + clip_sigma) / (2 * clip_sigma))) if clip_sigma else (lambda z: z)

    def by(r):
        m, s = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        return F.when(s < 1e-8, F.transform(data, lambda v: F.lit(0.0))).otherwise(F.transform(data, lambda v: scale(F.try_divide(v - m, s))))

    return A.bind(F.array(A.mean(data), F.sqrt(A.variance(data))), by)


def normalize(data: Column, method: str = "percentile", **how) -> Column:
    methods = {"percentile": percentile_normalize, "minmax": minmax_normalize, "zscore": zscore_normalize, "none": lambda d: d}
    if method not in methods:
        raise ValueError(f"unknown normalisation {method}")
    return methods[method](data, **how)


def adjust_gamma(data: Column, gamma: float) -> Column:
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    return F.transform(data, lambda v: F.pow(A.clip(v), F.lit(float(gamma))))


def has_dark_background(data: Column, q: float = 0.5) -> Column:
    def by(r):
        low, high, middle = (F.get(r, F.lit(k)) for k in range(3))
        return F.when(high - low < 1e-6, F.lit(True)).otherwise(middle < (low + high) / 2)

    return A.bind(A.quantiles(data, 0.01, 0.99, q), by)


def auto_invert(data: Column) -> Column:
    return F.when(has_dark_background(data), data).otherwise(F.transform(data, lambda v: 1.0 - v))


def to_uint8(data: Column) -> Column:
    """0 to 255 by truncation."""
    return F.transform(data, lambda v: F.floor(A.clip(v * 255.0, 0.0, 255.0)).cast("int"))


def from_integers(data: Column, dtype_max: float) -> Column:
    return F.transform(data, lambda v: v.cast("double") / F.lit(float(dtype_max)))


def shading(height: Column, width: Column, p: Column, strength: float, cy: float, cx: float) -> Column:
    """Multiplicative shading at pixel p, falling with the distance from (cy, cx), shares of the field."""
    y, x = F.floor(p / width), p % width
    far = lambda a, b: F.sqrt((a - cy * height) * (a - cy * height) + (b - cx * width) * (b - cx * width))
    most = F.greatest(*(far(a, b) for a in (F.lit(0), height - 1) for b in (F.lit(0), width - 1)))
    return 1.0 - strength * far(y, x) / (most + 1e-6)


def neighbour(data: Column, p: Column, dy: int, dx: int, height: Column, width: Column) -> Column:
    """The value at an offset from p, the edge repeated."""
    y = F.least(F.greatest(F.floor(p / width).cast("int") + dy, F.lit(0)), height - 1)
    x = F.least(F.greatest((p % width).cast("int") + dx, F.lit(0)), width - 1)
    return F.get(data, (y * width + x).cast("int"))


def median3(data: Column, height: Column, width: Column) -> Column:
    """3 x 3 median with repeated edges."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return F.transform(data, lambda v, p: F.get(F.array_sort(F.array(*(neighbour(data, p, a, b, height, width) for a, b in near))), F.lit(4)))


def remove_hot_pixels(fields: DataFrame, threshold: float = 5.0) -> DataFrame:
    """data with pixels far from their 3 x 3 median, by a robust spread of the residuals, replaced by it."""

    def by(m):
        def around(r):
            fixed = lambda spread: F.zip_with("data", F.zip_with(m, r, lambda x, y: F.struct(x.alias("m"), y.alias("r"))), lambda v, z: F.when(F.abs(z["r"]) > threshold * spread, z["m"]).otherwise(v))
            spread = A.bind(A.quantile(r, 0.5), lambda c: 1.4826 * A.quantile(F.transform(r, lambda x: F.abs(x - c)), 0.5))
            return A.bind(spread, lambda s: F.when(s < 1e-6, F.col("data")).otherwise(fixed(s)))

        return A.bind(F.zip_with("data", m, lambda a, b: a - b), around)

    return fields.withColumn("data", A.bind(median3(F.col("data"), F.col("height"), F.col("width")), by))


def flatten(data: Column, background: Column, mode: str = "subtract") -> Column:
    if mode == "subtract":
        return A.bind(A.quantile(background, 0.5), lambda middle: F.zip_with(data, background, lambda v, b: A.clip(v - b + middle)))
    if mode == "divide":
        return A.bind(A.quantile(background, 0.5), lambda middle: F.zip_with(data, background, lambda v, b: A.clip(v / F.greatest(b, F.lit(1e-6)) * middle)))
    raise ValueError(f"unknown mode {mode}")


#: Denoising by one strength knob, background estimates and contrast, as kernels of one field, by name.
DENOISE = {
    "none": lambda a, s: a,
    "gaussian": K.gaussian,
    "median": lambda a, s: K.median(a, int(round(3 * s)) | 1),
    "bilateral": lambda a, s: K.bilateral(a, 5, 0.1 * s, 5.0),
    "nlm": lambda a, s: K.non_local_means(a, 5.0 * s),
    "tv": lambda a, s: K.total_variation(a, 0.05 * s),
}
BACKGROUND = {
    "morphological": K.morphological_background,
    "gaussian": lambda a, r: K.gaussian(a, max(1.0, r / 2)),
    "polynomial": lambda a, r: K.polynomial_background(a),
}


def chosen(methods: dict, name: str | None, what: str):
    """The method of a name; None stands for none, an unknown name is an error."""
    name = "none" if name is None else name
    if name not in methods:
        raise ValueError(f"unknown {what} {name!r}; one of {', '.join(methods)}")
    return methods[name]


def denoise(a, method: str | None = "gaussian", strength: float = 1.0):
    return chosen(DENOISE, method, "denoising")(a, strength)


def estimate_background(a, method: str = "morphological", radius: int = 50):
    return chosen(BACKGROUND, method, "background")(a, radius)


def unsharp(a, sigma: float = 1.0, amount: float = 1.0):
    return np.clip(a + amount * (a - K.gaussian(a, sigma)), 0, 1)


def enhance_contrast(a, method: str | None = "clahe", clip: float = 2.0, grid: int = 8, gamma: float = 1.0):
    methods = {
        "none": lambda: a,
        "clahe": lambda: K.clahe(a, clip, grid),
        "gamma": lambda: K.gamma(a, gamma),
        "stretch": lambda: K.percentile_normalize(a, 2.0, 98.0),
        "unsharp": lambda: unsharp(a),
    }
    return chosen(methods, method, "contrast")()


@dataclass(frozen=True)
class Chain:
    """Settings of preprocess_field; steps that are None or "none" are left out."""

    hot_pixels: float | None = 5.0
    auto_invert: bool = True
    illumination: str | None = "morphological"
    radius: int = 50
    denoise: str | None = "gaussian"
    strength: float = 1.0
    contrast: str | None = "clahe"
    clip: float = 2.0
    grid: int = 8
    gamma: float = 1.0
    normalize: str = "percentile"
    low: float = 1.0
    high: float = 99.0


def preprocess_field(a, how: Chain = Chain()) -> tuple[np.ndarray, dict[str, np.ndarray], bool]:
    """The chain on one field, in fixed order: hot pixels, polarity, illumination, denoising, contrast, normalisation.

    Gives the result, the result after every step that was taken, and whether polarity was inverted."""
    stages = {"raw": a}
    inverted = False
    if how.hot_pixels is not None:
        stages["hot pixels"] = a = K.remove_hot_pixels(a, how.hot_pixels)
    if how.auto_invert and not K.has_dark_background(a):
        stages["inverted"], inverted = a, True
        stages["inverted"] = a = 1.0 - a
    if how.illumination not in (None, "none"):
        stages["illumination"] = a = K.flatten(a, estimate_background(a, how.illumination, how.radius))
    if how.denoise not in (None, "none"):
        stages["denoised"] = a = denoise(a, how.denoise, how.strength)
    if how.contrast not in (None, "none"):
        stages["contrast"] = a = enhance_contrast(a, how.contrast, how.clip, how.grid, how.gamma)
    methods = {"percentile": lambda: K.percentile_normalize(a, how.low, how.high), "minmax": lambda: K.minmax_normalize(a), "zscore": lambda: K.zscore_normalize(a), "none": lambda: a}
    stages["normalized"] = a = chosen(methods, how.normalize, "normalisation")()
    return a, stages, inverted


def preprocess_fields(fields: DataFrame, how: Chain = Chain(), channels: list | None = None) -> DataFrame:
    """fields with data through the chain, each row (an image's channel) alone, in one pass of Arrow batches without a
    shuffle. Where there is a column channel, only the given channels change."""
    chain = lambda a: preprocess_field(a, how)[0]
    if channels is None:
        return K.map_fields(fields, chain, "_made", "array<double>").withColumn("data", F.col("_made")).drop("_made")
    here = F.col("channel").isin(channels)
    made = K.map_fields(fields.where(here), chain, "_made", "array<double>").withColumn("data", F.col("_made")).drop("_made")
    return made.unionByName(fields.where(~here | F.col("channel").isNull()))
