"""MinHash by independent hash functions: the smallest value of each function over a set, and keys of bands of them."""

from __future__ import annotations

import numpy as np

from groundwork.llm.common import mix

# Hashes that meet all functions at a time.
PART = 1 << 13


def factors(functions: int) -> np.ndarray:
    """Odd numbers, one per function."""
    return mix(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def lower(least: np.ndarray, of: np.ndarray, hashed: np.ndarray, by: np.ndarray) -> None:
    """Lowers the rows of ``least`` (one column per function) to the values of the hashes; ``of``, their rows, ascends."""
    for k in range(0, len(of), PART):
        rows, part = of[k : k + PART], hashed[k : k + PART]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        low = np.minimum.reduceat(part[:, None] * by[None, :], starts, axis=0)
        least[rows[starts]] = np.minimum(least[rows[starts]], low)


def keys_of(least: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """One key per band of ``rows`` consecutive functions."""
    bands = least.shape[1] // rows
    keys = np.empty((len(least), bands), np.uint64)
    for j in range(bands):
        total = np.full(len(least), seed + j, np.uint64)
        for b in range(j * rows, (j + 1) * rows):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + least[:, b])
        keys[:, j] = total
    return keys
