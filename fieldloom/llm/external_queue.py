"""Disk-backed building blocks of external sorting: scratch arrays, append-only logs and a monotone bulk priority queue."""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

_PIECE = 1 << 16  # rows of a merge that are in memory


class Scratch:
    """A task's private scratch folder, removed with the task: no other task reads it. Arrays up to in_memory bytes stay in
    memory, larger ones are mapped files."""

    def __init__(self, in_memory: int = 32 << 20, folder: str | None = None):
        self.in_memory, self.parent, self.folder, self.made = in_memory, folder, None, 0

    def _path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=self.parent)
        self.made += 1
        return os.path.join(self.folder, f"{self.made}.bin")

    def array(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.in_memory:
            return np.empty(n, dtype)
        return np.memmap(self._path(), dtype, "w+", shape=(n,))

    def keep(self, values: np.ndarray) -> np.ndarray:
        """values themselves, or a mapped copy if they are large."""
        if values.nbytes <= self.in_memory:
            return values
        out = self.array(len(values), values.dtype)
        out[:] = values
        return out

    def drop(self, values: np.ndarray | None) -> None:
        """Delete the file of a mapped array, also by one of its views; what still maps it can go on."""
        if isinstance(values, np.memmap) and values.filename and os.path.exists(values.filename):
            os.unlink(values.filename)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Log:
    """Rows appended in bulks and read back as one array; beyond the scratch limit they are on disk."""

    def __init__(self, scratch: Scratch, dtype):
        self.scratch, self.dtype, self.parts, self.file, self.rows, self.held = scratch, np.dtype(dtype), [], None, 0, 0

    def append(self, values: np.ndarray) -> None:
        values = np.ascontiguousarray(values, self.dtype)
        self.parts.append(values)
        self.rows += len(values)
        self.held += values.nbytes
        if self.held > self.scratch.in_memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.path = self.scratch._path()
            self.file = open(self.path, "wb")  # noqa: SIM115
        for p in self.parts:
            p.tofile(self.file)
        self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        self._spill()
        self.file.close()
        return np.memmap(self.path, self.dtype, "r", shape=(self.rows,))


class BulkQueue:
    """Rows (key, position, common prefix) that leave in order of key, equal keys in order of arrival.

    Rows arrive in bulks, each a sorted run. Runs of a level merge to one run of the next, so that a row is moved a
    logarithmic number of times and few runs are open; runs beyond the scratch limit are files. No row may arrive with a
    key below the last that left."""

    FAN = 8

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.levels: list[list[list]] = [[]]  # per level, runs [keys, positions, prefixes, head] from the oldest on
        self.rows = 0

    def push(self, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray, is_sorted: bool = False) -> None:
        if not len(keys):
            return
        if not is_sorted:
            order = np.argsort(keys, kind="stable")
            keys, positions, prefixes = keys[order], positions[order], prefixes[order]
        self.rows += len(keys)
        self._add(0, keys, positions, prefixes)

    def _add(self, level: int, keys, positions, prefixes) -> None:
        if level == len(self.levels):
            self.levels.append([])
        keep = self.scratch.keep
        self.levels[level].append([keep(keys), keep(positions), keep(prefixes), 0])
        if len(self.levels[level]) >= self.FAN:
            runs, self.levels[level] = self.levels[level], []
            merged = self._merged(runs)
            for r in runs:
                for c in range(3):
                    self.scratch.drop(r[c])
            if len(merged[0]):
                self._add(level + 1, *merged)

    def _merged(self, runs: list[list]) -> list[np.ndarray]:
        """The rest of runs, from the oldest on, as one run; large ones go from file to file in pieces."""
        rows = sum(len(r[0]) - r[3] for r in runs)
        if rows * runs[0][0].itemsize <= self.scratch.in_memory:
            parts = [np.concatenate([r[c][r[3] :] for r in runs]) for c in range(3)]
            order = np.argsort(parts[0], kind="stable")
            return [p[order] for p in parts]
        out = [self.scratch.array(rows, runs[0][c].dtype) for c in range(3)]
        at = 0
        while at < rows:
            *parts, (live, source) = self._front([r for r in runs if r[3] < len(r[0])], _PIECE)
            n = len(parts[0])
            for c in range(3):
                out[c][at : at + n] = parts[c]
            self._advance(live, source)
            at += n
        return out

    def _runs(self) -> list[list]:
        out = []
        for level in reversed(self.levels):  # the oldest first
            live = [r for r in level if r[3] < len(r[0])]
            for r in level:
                if r[3] >= len(r[0]):
                    for c in range(3):
                        self.scratch.drop(r[c])
            level[:] = live
            out += live
        return out

    @staticmethod
    def _front(runs: list[list], limit: int):
        """About limit rows from the front of runs, as keys, positions, prefixes and (runs, run of each row)."""
        step = max(1, limit // len(runs))
        bound = min((int(r[0][r[3] + step]) for r in runs if len(r[0]) - r[3] > step), default=None)
        if bound is None or any(int(r[0][r[3]]) < bound for r in runs):
            cut = [len(r[0]) if bound is None else r[3] + int(np.searchsorted(r[0][r[3] : r[3] + step + 1], bound, side="left")) for r in runs]
        else:  # the front is one key only: rows by age
            cut, left = [], limit
            for r in runs:
                have = int(np.searchsorted(r[0][r[3] : r[3] + left], bound, side="right")) if left else 0
                cut.append(r[3] + have)
                left -= have
        parts = [np.concatenate([np.asarray(r[c][r[3] : e]) for r, e in zip(runs, cut, strict=True)]) for c in range(3)]
        source = np.repeat(np.arange(len(runs)), [e - r[3] for r, e in zip(runs, cut, strict=True)])
        if len(runs) > 1:
            order = np.argsort(parts[0], kind="stable")
            parts, source = [p[order] for p in parts], source[order]
        return (*parts, (runs, source))

    @staticmethod
    def _advance(runs: list[list], source: np.ndarray) -> None:
        for r, k in zip(runs, np.bincount(source, minlength=len(runs)).tolist(), strict=True):
            r[3] += k

    def peek(self, limit: int):
        """About limit rows from the front, as keys, positions, prefixes and a token for pop()."""
        return self._front(self._runs(), limit)

    def pop(self, token, n: int) -> None:
        """Remove the first n rows of the last peek."""
        runs, source = token
        self._advance(runs, source[:n])
        self.rows -= n
