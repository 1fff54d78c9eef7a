"""Word shingles as 64-bit hashes, computed per text in numpy.

Words are runs of `[^\\x20\\x09-\\x0D]` after lower-casing A-Z alone: what `bytes.split` sees in UTF-8. A text's
set holds its distinct `width`-word shingles; one with fewer words gives its whole sequence as the only
shingle; one without words, or null, gives the empty set.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Base of the word polynomial, odd so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer with full avalanche (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Keeps the power tables between texts; they grow to the longest text seen."""

    def __init__(self, width: int = 5) -> None:
        self.width = width
        self.bytes = _mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
        self.steps = _mix(np.arange(1000, 1000 + width, dtype=_U) * _U(_BASE)) | _U(1)
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        self.up = _powers(_BASE, n)
        self.down = _powers(pow(_BASE, -1, 1 << 64), n)

    def words(self, text: str | None) -> np.ndarray:
        """Hash of each word in order."""
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        return self.runs(self.bytes[raw], (raw == 32) | ((raw >= 9) & (raw <= 13)))

    def runs(self, values: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Hash of each run of `values` between those that are `apart`."""
        n = values.size
        if n > self.up.size:
            self._grow(max(n, 2 * self.up.size))
        gap = np.ones(n + 2, bool)
        gap[1:-1] = apart
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edges[::2], edges[1::2]
        if not start.size:
            return np.zeros(0, _U)
        total = np.zeros(n + 1, _U)
        np.cumsum(values * self.up[:n], out=total[1:])
        return _mix((total[end] - total[start]) * self.down[start] + (end - start).astype(_U))

    def sequence(self, text: str | None) -> np.ndarray:
        """Hash of each shingle in order, repeats included."""
        w = self.words(text)
        n = w.size
        if not n:
            return w
        if n < self.width:
            return _mix(np.array([int((w * self.steps[:n]).sum(dtype=_U)) + n & _MASK], _U))
        h = w[: n - self.width + 1] * self.steps[0]
        for i in range(1, self.width):
            h = h + w[i : n - self.width + 1 + i] * self.steps[i]
        return _mix(h)

    def distinct(self, text: str | None) -> np.ndarray:
        """Sorted set of the shingles."""
        return np.unique(self.sequence(text))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.size > b.size:
        a, b = b, a
    if not a.size:
        return 0
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int((b[at] == a).sum())
