"""U-Net inference in NumPy: double convolutions, pooling, transposed convolutions, class and distance heads."""

from __future__ import annotations

import numpy as np


def convolve(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """(channels, h, w) by a kernel (out, in, k, k) with zeros around, as one product a kernel cell."""
    r = weight.shape[-1] // 2
    big = np.pad(x, ((0, 0), (r, r), (r, r)))
    h, w = x.shape[1:]
    out = sum(np.tensordot(weight[:, :, i, j], big[:, i : i + h, j : j + w], 1) for i in range(2 * r + 1) for j in range(2 * r + 1))
    return out if bias is None else out + bias[:, None, None]


def _double(x: np.ndarray, block: dict) -> np.ndarray:
    """Twice a 3 x 3 convolution, its normalisation folded into scale and shift, and a ramp."""
    for k in (0, 1):
        x = convolve(x, block[f"weight{k}"])
        x = np.maximum(x * block[f"scale{k}"][:, None, None] + block[f"shift{k}"][:, None, None], 0)
    return x


def _pooled(x: np.ndarray) -> np.ndarray:
    c, h, w = x.shape
    return x[:, : h // 2 * 2, : w // 2 * 2].reshape(c, h // 2, 2, w // 2, 2).max((2, 4))


def _grown(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Transposed convolution by a kernel (in, out, 2, 2) in steps of two."""
    c, h, w = x.shape
    out = np.einsum("chw,cokl->ohkwl", x, weight).reshape(weight.shape[1], 2 * h, 2 * w)
    return out + bias[:, None, None]


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    """Logits (classes, and distance where there is that head; h, w) of (channels, h, w)."""
    levels = [_double(x, net["stem"])]
    for block in net["down"]:
        levels.append(_double(_pooled(levels[-1]), block))
    x = levels.pop()
    for block in net["up"]:
        skip = levels.pop()
        x = _grown(x, block["grow"], block["grow_bias"])
        dy, dx = skip.shape[1] - x.shape[1], skip.shape[2] - x.shape[2]
        x = np.pad(x, ((0, 0), (dy // 2, dy - dy // 2), (dx // 2, dx - dx // 2)))
        x = _double(np.concatenate([skip, x]), block)
    return convolve(x, net["head"], net["head_bias"])


def activated(logits: np.ndarray, classes: int) -> np.ndarray:
    """Likelihoods of the classes, and the distance, if any, between 0 and 1."""
    e = np.exp(logits[:classes] - logits[:classes].max(0))
    return np.concatenate([e / e.sum(0), 1 / (1 + np.exp(-logits[classes:]))])


def predict(net: dict, a: np.ndarray, views: bool = False) -> np.ndarray:
    """Activated maps of a field (h, w) or (h, w, channels), mirrored to a size that the depth divides and cut back; views:
    the mean over its eight turned and mirrored views, each turned back."""
    a = a[..., None] if a.ndim == 2 else a
    h, w = a.shape[:2]
    step = 2 ** len(net["down"])
    x = np.pad(a, ((0, -h % step), (0, -w % step), (0, 0)), mode="reflect").transpose(2, 0, 1)
    out = 0.0
    for k in range(4 if views else 1):
        for flip in (False, True) if views else (False,):
            seen = np.rot90(x, k, (1, 2))
            made = activated(forward(net, seen[:, :, ::-1] if flip else seen), net["classes"])
            out = out + np.rot90(made[:, :, ::-1] if flip else made, -k, (1, 2))
    return (out / (8 if views else 1))[:, :h, :w]


def random_weights(channels: int = 1, classes: int = 3, base: int = 32, depth: int = 4, distance: bool = False, seed: int = 0) -> dict:
    """A network of seeded weights; the form that trained weights come in."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    r = np.random.default_rng(seed)
    draw = lambda *shape: r.normal(0, np.sqrt(2 / np.prod(shape[1:])), shape)

    def block(i, o):
        return {k: v for n, c in ((0, i), (1, o)) for k, v in ((f"weight{n}", draw(o, c, 3, 3)), (f"scale{n}", np.ones(o)), (f"shift{n}", np.zeros(o)))}

    widths = [base * 2**i for i in range(depth + 1)]
    up = [block(2 * o, o) | {"grow": draw(i, o, 2, 2), "grow_bias": np.zeros(o)} for i, o in zip(widths[:0:-1], widths[-2::-1], strict=True)]
    heads = classes + distance
    return {"classes": classes, "stem": block(channels, base), "down": [block(i, o) for i, o in zip(widths, widths[1:], strict=False)], "up": up, "head": draw(heads, base, 1, 1), "head_bias": np.zeros(heads)}
