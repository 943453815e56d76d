"""Vectorised text kernels over Arrow string columns, used inside tasks.

Texts are handled as UTF-8 bytes in slices of a quarter of a megabyte (or one text, if it is longer), so the memory
of a task does not depend on the number of rows in a batch. White space is ASCII (0x20, 0x09-0x0D), letters A-Z are folded to lower case.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm._spark import in_parts

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n, kept by the worker and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


_kept: dict[object, object] = {}  # what this worker keeps over tasks
_asked: set[object] = set()  # of that, what its task has asked for


def kept(key, make: Callable):
    """``make()``, once in each worker: kept for its later tasks until one ends that did not ask for it."""
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """At the end of a task: drop what it did not ask for and return freed memory, as its worker outlives it."""
    for key in _kept.keys() - _asked:
        del _kept[key]
    _asked.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that yields small batches and gives back what it has freed when it ends, as its worker
    outlives the task."""

    @functools.wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel(batches):
            yield from in_parts(batch)
        give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) for runs of rows of about ``limit`` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64, n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = ~space[full]
    tail = off[1:][off[1:] > off[:-1]] - 1
    last[tail] = ~space[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, from sums of powers over the whole slice."""
    if not len(start):
        return np.zeros(0, np.uint64)
    value = (_LOWER[data] if fold else data).astype(np.uint64)
    value += np.uint64(1)
    value *= _power_table(_BASE, len(data))
    total = np.cumsum(value)
    h = total[end - 1] - total[start] + value[start]
    return mix(h * _power_table(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))


def ngrams(words: np.ndarray, bounds: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, the index of each run's first word, and the rows' bounds in them.

    A row of fewer than k words, but one at least, has its whole sequence as one run if ``short``.
    """
    n, counts = len(words), np.diff(bounds)
    runs = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if len(out) else np.zeros(0, np.int64)
    out = mix(out[at])
    if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
        own = np.zeros(len(few), np.uint64)
        for i, r in enumerate(few):
            h = int(counts[r])
            for w in words[bounds[r] : bounds[r + 1]].tolist():
                h = (h * 0xA24BAED4963EE407 + w) & 0xFFFFFFFFFFFFFFFF
            own[i] = h
        runs[few] = 1
        where = np.searchsorted(at, bounds[few])
        out, at = np.insert(out, where, mix(own)), np.insert(at, where, bounds[few])
    return out, at, np.concatenate([[0], np.cumsum(runs)])
