"""Hashes of many byte spans at once."""

from __future__ import annotations

import numpy as np

SPACE, PUNCT, WORD = 0, 1, 2
#: What each byte is: white space and controls, ASCII punctuation, or part of a word.
CLASS = np.array([SPACE if b <= 32 or b == 127 else WORD if b >= 128 or chr(b).isalnum() else PUNCT for b in range(256)], dtype=np.uint8)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = 1 << 16


def _inverse(x: np.uint64) -> np.uint64:
    """Of an odd number, modulo 2**64, by Newton's steps."""
    y = x
    with np.errstate(over="ignore"):
        for _ in range(6):
            y *= np.uint64(2) - x * y
    return y


with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(_STEP, _BASE, np.uint64))
    _UNPOWER = np.cumprod(np.full(_STEP, _inverse(_BASE), np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: A random number for each byte, the same for A-Z and a-z.
_VALUE = mixed(np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], dtype=np.uint64))


def _powers(table: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` powers of the table's base."""
    while len(table) < n:
        with np.errstate(over="ignore"):
            table = np.concatenate([table, table * table[-1]])
    return table[:n]


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``data[first:last]``, with A-Z in lower case."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(_POWER, len(data)))])
        return mixed((sums[last] - sums[first]) * _powers(_UNPOWER, len(data) + 1)[first])


def run_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbouring values, in their order."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_POWER, len(values)))])
        return mixed((sums[n:] - sums[:-n]) * _powers(_UNPOWER, len(values) - n + 1))
