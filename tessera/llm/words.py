"""Words of a text and their hashes, in numpy: words are runs of bytes other than space and 9 to 13."""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_TABLES = np.random.default_rng(23).integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BLOCK = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base modulo 2**64, and of its inverse."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        m = max(n, _BLOCK + 1)
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps = np.full(m, x, _U)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        held = _powers[base] = (both[0], both[1])
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(data: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word, (2, n). Long texts go by blocks that end between words."""
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + _BLOCK)
        if end < n:
            while end < n and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        sep = _SEPARATOR[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], sep, [True]])))
        s, e = edge[::2], edge[1::2]
        if len(s):
            up, down = powers(_MULT, end - at + 1)
            found = np.empty((2, len(s)), _U)
            for k in range(2):
                total = np.zeros(len(b) + 1, _U)
                np.cumsum(_TABLES[k][b] * up[: len(b)], out=total[1:])
                found[k] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
            parts.append(found)
        at = end
    return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), _U)


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `size` words: a polynomial in their hashes modulo 2**64, by prefix sums."""
    n = len(words)
    if n < size:
        return np.zeros(0, _U)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(words * up[:n], out=total[1:])
    return (total[size:] - total[:-size]) * down[: n - size + 1]
