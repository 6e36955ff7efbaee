"""Vectorised 64-bit hashing of words, shingles and byte windows of whole Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

#: The white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTOR = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(_FACTOR))

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        size = max(n, 2 * len(have))
        factors = np.full(size, U(_BASE if kind == "up" else _INVERSE), np.uint64)
        factors[0] = 1
        have = _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


#: A-Z to a-z, every other byte itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEY = 0x5851F42D4C957F2D
_LONG = 512  # bytes of a run beyond which it is hashed on its own


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Keyed 64-bit hashes of the byte runs raw[start:end], with lower as if A-Z were a-z.

    Eight bytes at a time go through a mixing step that is not linear, so that no pattern of bytes collides by its form, as
    texts can under a polynomial modulo 2**64; two given runs have one hash with a probability of about 2**-64. Long runs
    take BLAKE2b."""
    n = end - start
    padded = np.concatenate([LOWER[raw] if lower else raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place on
    h = mix(n.astype(np.uint64) + U(_KEY))
    live, at = np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(live):
        rest = n[live] - at
        lane = lanes[start[live] + at]
        short = rest < 8
        lane[short] &= (U(1) << (8 * rest[short]).astype(np.uint64)) - U(1)
        h[live] = mix((h[live] ^ lane) * U(_FACTOR) + U(at + 1))
        at += 8
        live = live[rest > 8]
    for k in np.flatnonzero(n > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(padded[start[k] : end[k]].tobytes(), digest_size=8, key=_KEY.to_bytes(8, "little")).digest(), "little")
    return h


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A polynomial modulo 2**64 over hashed bytes of every window of width bytes. It chooses places and decides no equality."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _power("up", len(raw)), out=sums[1:])
    n = len(sums) - width
    return (sums[width:] - sums[:n]) * _power("down", len(raw) + 1)[:n]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    inside = ~SPACE[raw]
    n = len(raw)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of every text the sorted distinct 64-bit hashes of its shingles of size words, A-Z lower-cased.

    A text with fewer words has one shingle, its whole sequence; one without words has none."""
    start, end, text = words(raw, offsets)
    hashed = run_hashes(raw, start, end, lower=True)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    joined = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        joined = joined * U(0xA24BAED4963EE407) + hashed[k : len(hashed) - size + 1 + k] if len(joined) else joined
    joined = mix(joined)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= size:
            h = np.sort(joined[lo : hi - size + 1])
            keep = np.empty(len(h), bool)
            keep[0] = True
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        elif hi > lo:
            v = np.full(1, hi - lo, np.uint64) * U(0xC2B2AE3D27D4EB4F)
            for x in hashed[lo:hi]:
                v = mix(v * U(0xA24BAED4963EE407) + x)
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
