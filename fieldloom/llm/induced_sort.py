"""External induced sorting of suffixes with common-prefix values.

A level classifies suffixes as larger (L) or smaller (S) than their successor, sorts the substrings between leftmost S
suffixes, names them, and sorts the shorter string of names by the same method. From the sorted leftmost S suffixes the L
suffixes are induced in rising order, then from these all S suffixes in falling order. Both scans run on a disk-backed
monotone priority queue: it holds tuples (symbol and type, position, common prefix with the tuple before). A scan takes
from the front the longest bulk into which none of its own inductions falls, so that it works on arrays. The common
prefix of two suffixes induced one after the other is one more than the minimum over the scanned values between their
sources; minima are kept per bulk, and per symbol from its last induction on.

Substrings between leftmost S suffixes are sorted in memory while few, else by inducing from their first symbols with the
same queues. Text, types, starts, names, runs and results are scratch arrays, mapped files beyond the scratch's limit, and
every step takes them piece by piece: memory holds a bounded number of pieces and the recursion's base, whatever the text.

Prefix values are exact up to cap and cap beyond, which is all that the search for strings of cap symbols needs.
"""

from __future__ import annotations

import numpy as np

from fieldloom.llm.external_queue import BulkQueue, Log, Scratch

_MOST = 1 << 16  # rows of a bulk
_BASE = 1 << 17  # names that are sorted in memory
_PIECE = 1 << 16  # rows of an array that are handled at once


def _extend(text: np.ndarray, p: np.ndarray, q: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, cap at most (one number, or one a pair), of suffixes p and q, of which known symbols are known to
    agree."""
    cap = np.broadcast_to(cap, len(p))
    out = np.minimum(known, cap).astype(np.int64)
    live = np.flatnonzero(out < cap)
    n = len(text)
    while len(live):
        a, b = p[live] + out[live], q[live] + out[live]
        inside = (a < n) & (b < n)
        same = np.zeros(len(live), bool)
        same[inside] = text[a[inside]] == text[b[inside]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < cap[live]]
    return out


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi + 1] for many ranges that are not empty."""
    table = [values]
    width = 1
    longest = int((hi - lo).max()) + 1 if len(lo) else 0
    while 2 * width <= longest:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in range(len(table)):
        at = level == k
        if at.any():
            out[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k) + 1])
    return out


def _induce(scratch: Scratch, seeds, before, kinds: int, cap: int, text: np.ndarray, emit, is_sorted: bool = True) -> None:
    """Scan the queue of seeds (pieces of keys, positions, prefixes, each sorted by key) to its end; keys are 2 * symbol + type.

    before(positions) gives the keys of the suffixes to be induced, -1 where there is none. emit gets every bulk."""
    queue = BulkQueue(scratch)
    for piece in seeds:
        queue.push(*piece, is_sorted=is_sorted)
    last = scratch.array(kinds, np.int32)  # per key, the bulk of its last induction
    tail = scratch.array(kinds, np.uint8 if cap < 256 else np.int32)  # and the minimum in that bulk since then
    last[:] = -1
    ends: list[int] = []  # bulks that are minima of all later ones, with their minima: at most cap + 1
    lows: list[int] = []
    bulk, limit = 0, 1024
    old_key, old_position = -2, -1
    never = np.int64(1 << 62)
    while queue.rows:
        keys, positions, prefixes, token = queue.peek(limit)
        new = before(positions)
        ahead = np.minimum.accumulate(np.where(new < 0, never, new))
        bad = np.flatnonzero(keys[1:] > ahead[:-1])
        n = int(bad[0]) + 1 if len(bad) else len(keys)
        queue.pop(token, n)
        limit = min(_MOST, limit * 2) if n == len(keys) else max(64, n + n // 2)
        keys, positions, new = keys[:n], positions[:n], new[:n]

        low = prefixes[:n].astype(np.int64)
        previous = np.concatenate([[old_key], keys[:-1]])
        other = np.flatnonzero(previous != keys)
        low[other] = 0
        seam = other[(previous[other] >> 1) == (keys[other] >> 1)]
        if len(seam):
            left = np.where(seam > 0, positions[seam - 1], old_position)
            low[seam] = _extend(text, left, positions[seam], np.zeros(len(seam), np.int64), cap)
        old_key, old_position = int(keys[-1]), int(positions[-1])
        emit(keys, positions, low)

        source = np.flatnonzero(new >= 0)
        if len(source):
            target = new[source]
            order = np.argsort(target, kind="stable")
            t, s = target[order], source[order]
            first = np.concatenate([[True], t[1:] != t[:-1]])
            prefix = np.empty(len(t), np.int64)
            inner = np.flatnonzero(~first)
            if len(inner):
                prefix[inner] = _range_minima(low, s[inner - 1] + 1, s[inner])
            heads = np.flatnonzero(first)
            head = np.minimum.accumulate(low)[s[heads]]
            since = last[t[heads]]
            known = since >= 0
            value = np.zeros(len(heads), np.int64)
            if known.any():
                k = heads[known]
                v = np.minimum(head[known], tail[t[k]].astype(np.int64))
                spot = np.searchsorted(np.array(ends, np.int64), since[known] + 1)
                minima = np.array([*lows, cap], np.int64)
                value[known] = np.minimum(v, minima[spot])
            prefix[heads] = value
            lasts = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))
            rest = np.concatenate([np.minimum.accumulate(low[::-1])[::-1], [cap]])
            last[t[lasts]] = bulk
            tail[t[lasts]] = np.minimum(rest[s[lasts] + 1], cap)
            queue.push(t, positions[s] - 1, np.minimum(prefix + 1, cap).astype(prefixes.dtype), is_sorted=True)
        least = int(low.min())
        while lows and lows[-1] >= least:
            lows.pop()
            ends.pop()
        lows.append(least)
        ends.append(bulk)
        bulk += 1


def _pieces(n: int):
    return ((lo, min(lo + _PIECE, n)) for lo in range(0, n, _PIECE))


def _types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True where the suffix is smaller than its successor."""
    n = len(text)
    out = scratch.array(n, bool)
    out[n - 1] = True
    for hi in range(n - 1, 0, -_PIECE):
        lo = max(0, hi - _PIECE)
        part = np.asarray(text[lo : hi + 1])
        change = np.flatnonzero(part[:-1] != part[1:])
        types = np.full(hi - lo, out[hi])
        types[: change[-1] + 1 if len(change) else 0] = np.repeat(part[change] < part[change + 1], np.diff(np.concatenate([[-1], change])))
        out[lo:hi] = types
    return out


def _starts(small: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places of the leftmost S suffixes."""
    out = Log(scratch, np.int64)
    for lo, hi in _pieces(len(small) - 1):
        out.append(np.flatnonzero(small[lo + 1 : hi + 1] & ~small[lo:hi]) + lo + 1)
    return out.array()


def _names(text: np.ndarray, small: np.ndarray, starts: np.ndarray, kinds: int) -> np.ndarray:
    """Ranks of the substrings from each leftmost S suffix to the next one; equal substrings have equal ranks."""
    n = len(starts)
    length = np.concatenate([np.diff(starts) + 1, [1]])
    bits = max(1, int(2 * kinds + 2).bit_length())
    per = max(1, 62 // bits)
    rank = np.zeros(n, np.int64)
    live = np.arange(n)
    at = 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for k in range(at, at + per):
            inside = length[live] > k
            spot = starts[live[inside]] + k
            key <<= bits
            key[inside] += 2 * text[spot].astype(np.int64) + small[spot] + 1
        order = np.lexsort((key, rank[live]))
        rows, k, r = live[order], key[order], rank[live[order]]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_key = new_group | np.concatenate([[True], k[1:] != k[:-1]])
        group_start = np.maximum.accumulate(np.where(new_group, np.arange(len(rows)), 0))
        key_start = np.maximum.accumulate(np.where(new_key, np.arange(len(rows)), 0))
        rank[rows] = r + key_start - group_start
        alone = new_key & np.concatenate([new_key[1:], [True]])
        at += per
        live = rows[~alone & (length[rows] > at)]
    return np.unique(rank, return_inverse=True)[1].reshape(-1)


def _induced_names(text: np.ndarray, small: np.ndarray, starts: np.ndarray, kinds: int, scratch: Scratch) -> np.ndarray:
    """_names for many substrings: inducing from leftmost S suffixes in the order of their first symbols sorts the
    substrings; neighbours in that order are compared."""
    zeros = np.zeros(_PIECE, np.uint8)
    seeds = ((2 * text[p].astype(np.int64) + 1, p, zeros[: len(p)]) for p in (np.asarray(starts[lo:hi]) for lo, hi in _pieces(len(starts))))
    found = Log(scratch, np.int64)

    def keep(keys, positions, low):
        at = np.maximum(positions - 1, 0)
        found.append(positions[(positions > 0) & small[positions] & ~small[at]])

    _scans(text, small, kinds, 1, scratch, seeds, keep, is_sorted=False)
    order = found.array()[::-1]
    out = scratch.array(len(starts), np.int64)
    name, old, old_length = 0, -1, 0
    for lo, hi in _pieces(len(order)):
        p = np.asarray(order[lo:hi])
        spot = np.searchsorted(starts, p)
        length = np.where(spot + 1 < len(starts), starts[np.minimum(spot + 1, len(starts) - 1)] - p + 1, 1)
        left, left_length = np.concatenate([[old], p[:-1]]), np.concatenate([[old_length], length[:-1]])
        alike = np.flatnonzero((left >= 0) & (left_length == length))
        new = np.ones(len(p), np.int64)
        new[alike] = _extend(text, left[alike], p[alike], np.zeros(len(alike), np.int64), length[alike]) < length[alike]
        names = name + np.cumsum(new) - (lo == 0)
        out[spot] = names
        name, old, old_length = int(names[-1]), int(p[-1]), int(length[-1])
    scratch.drop(order.base if order.base is not None else order)
    return out


def _doubled(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a short string of names, by doubling sorted prefixes; common prefixes by comparison."""
    n = len(text)
    rank = np.asarray(text, np.int64)
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        values, rank = np.unique(key, return_inverse=True)
        if len(values) == n:
            order = np.argsort(rank)
            return order, np.concatenate([[0], _extend(text, order[:-1], order[1:], np.zeros(n - 1, np.int64), cap)])
        width *= 2


def _scans(text: np.ndarray, small: np.ndarray, kinds: int, cap: int, scratch: Scratch, seeds, emit, is_sorted: bool = True) -> None:
    """Induce all L suffixes from the seeds, then all S suffixes from these; emit gets the bulks of the second scan, in
    falling order, with the common prefix of each suffix and the one above it."""
    n, kind = len(text), np.uint8 if cap < 256 else np.int32
    larger, larger_prefix = Log(scratch, np.int64), Log(scratch, kind)

    def rising(positions):
        at = np.maximum(positions - 1, 0)
        return np.where((positions > 0) & ~small[at], 2 * text[at].astype(np.int64), -1)

    def keep_larger(keys, positions, low):
        mine = keys & 1 == 0
        larger.append(positions[mine])
        larger_prefix.append(low[mine])

    _induce(scratch, seeds, rising, 2 * kinds, cap, text, keep_larger, is_sorted)
    positions, low = larger.array(), larger_prefix.array()

    def from_larger():
        above = np.zeros(1, kind)  # prefix of a suffix with the one above it
        for hi in range(len(positions), 0, -_PIECE):
            lo = max(0, hi - _PIECE)
            p, f = np.asarray(positions[lo:hi])[::-1], np.asarray(low[lo:hi])[::-1]
            yield 2 * (kinds - 1 - text[p].astype(np.int64)) + 1, p, np.concatenate([above, f[:-1]])
            above = f[-1:]
        # the last suffix is of type S and nothing induces it
        yield 2 * (kinds - 1 - text[n - 1 :].astype(np.int64)), np.array([n - 1]), above

    def falling(positions):
        at = np.maximum(positions - 1, 0)
        return np.where((positions > 0) & small[at], 2 * (kinds - 1 - text[at].astype(np.int64)), -1)

    _induce(scratch, from_larger(), falling, 2 * kinds, cap, text, emit)
    scratch.drop(positions)
    scratch.drop(low)


def suffix_order(text: np.ndarray, kinds: int, cap: int, scratch: Scratch, base: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text and common prefixes (up to cap) of neighbours; the last symbol is 0 and occurs only there.

    Symbols are below kinds. The recursion ends at base names, which are sorted in memory."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    base = _BASE if base is None else base
    kind = np.uint8 if cap < 256 else np.int32
    small = _types(text, scratch)
    starts = _starts(small, scratch)
    m = len(starts)
    names = _names(text, small, starts, kinds) if starts.nbytes <= scratch.in_memory else _induced_names(text, small, starts, kinds, scratch)
    most = int(names.max()) + 1
    shared = None
    if most == m:
        order = scratch.array(m, np.int64)
        for lo, hi in _pieces(m):
            order[names[lo:hi]] = np.arange(lo, hi)
    elif m <= base:
        order, shared = _doubled(names, cap)
    else:
        order, shared = suffix_order(scratch.keep(names), most, cap, scratch, base)

    def seeds():
        old = -1
        for lo, hi in _pieces(m):
            o = np.asarray(order[lo:hi])
            p = np.asarray(starts[o])
            known = np.zeros(len(p), np.int64) if shared is None else starts[np.minimum(o + np.asarray(shared[lo:hi], np.int64), m - 1)] - p
            left = np.concatenate([[old], p[:-1]])
            prefix = _extend(text, left, p, np.minimum(known, cap), cap) if old >= 0 else np.concatenate([[0], _extend(text, left[1:], p[1:], np.minimum(known[1:], cap), cap)])
            yield 2 * text[p].astype(np.int64) + 1, p, prefix.astype(kind)
            old = int(p[-1])

    out, out_prefix = Log(scratch, np.int64), Log(scratch, kind)

    def keep_all(keys, positions, low):
        out.append(positions)
        out_prefix.append(low)

    _scans(text, small, kinds, cap, scratch, seeds(), keep_all)
    for used in (names, order, shared, small, starts):
        scratch.drop(used)
    order, low = out.array()[::-1], out_prefix.array()
    shared = scratch.array(n, kind)
    shared[0] = 0
    shared[1:] = low[1:][::-1]
    scratch.drop(low)
    return order, shared
