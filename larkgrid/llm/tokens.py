"""Words and their 64-bit hashes from whole Arrow batches, without Python objects per word.

A word is a run of bytes outside [\\x20\\x09-\\x0D]; A-Z count as a-z. The hash of a word is a polynomial over a random
number per byte, modulo 2**64, finished by a mixer: equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import functools

import numpy as np

from larkgrid.llm.common import STEP_BYTES

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n pseudo-random uint64, the same for the same seed."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + mix64(np.array([seed], U64)))


@functools.cache
def _byte_values() -> np.ndarray:
    return seeds(256, 11)[LOWER]


_held: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; only the longest made so far is held."""
    if not _held or len(_held[0][0]) < n:
        size = max(n, STEP_BYTES + (1 << 12))
        up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _held[:] = [(np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))]
    return _held[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    begins = np.empty(len(data) + 1, bool)
    begins[0], begins[-1] = True, True
    begins[1:-1] = space[:-1]
    begins[offsets] = True  # a row begins anew
    starts = np.flatnonzero(begins[:-1] & ~space)
    begins[1:-1] = space[1:]
    begins[offsets] = True
    ends = np.flatnonzero(begins[1:] & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span, in steps of bounded memory."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP_BYTES, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            size = hi - lo
            up, down = _powers(size)
            total = np.empty(size + 1, U64)
            total[0] = 0
            np.cumsum(_byte_values()[data[lo:hi]] * up[:size], dtype=U64, out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((total[e] - total[s]) * down[s] ^ (e - s).astype(U64))
            i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each row."""
    starts, ends, before = spans(data, offsets)
    return hashes(data, starts, ends), before


def shingles(h: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of k words per row, sorted, and the number before each row.

    A row of fewer words has one shingle, its whole sequence; a row without words has none.
    """
    n_rows, counts = len(before) - 1, np.diff(before)
    mult = seeds(k + 1, 77) | U64(1)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            run = np.zeros(len(h) - k + 1, U64)
            for i in range(k):
                run += h[i : len(h) - k + 1 + i] * mult[i]
            run = mix64(run)
        else:
            run = np.zeros(0, U64)
        row = np.repeat(np.arange(n_rows), counts)
        left = before[1:][row] - np.arange(len(h))
        full = left >= k
        values, rows = run[np.flatnonzero(full)], row[full]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            extra = np.zeros(len(short), U64)
            for i in range(k - 1):
                has = counts[short] > i
                extra[has] += h[before[short[has]] + i] * mult[i]
            extra = mix64(extra ^ (counts[short].astype(U64) * mult[k]))
            values, rows = np.concatenate([values, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            values, rows = values[order], rows[order]
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    parts, sizes = [], np.zeros(n_rows, np.int64)
    for r in np.flatnonzero(np.diff(bounds)):
        u = np.sort(values[bounds[r] : bounds[r + 1]])
        if len(u) > 1:
            u = u[np.concatenate([[True], u[1:] != u[:-1]])]
        parts.append(u)
        sizes[r] = len(u)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)])
