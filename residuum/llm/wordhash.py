"""Words and word n-grams of whole Arrow batches as 64-bit hashes (numpy).

Texts are UTF-8 bytes, end to end in one array (see ``common.slices``). Hashes
are polynomials over prefix sums, so the cost does not depend on n; all
arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so they have inverses
_POWERS: dict[int, np.ndarray] = {}


def _table(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)])


# bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return
WHITE = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
# bytes that part normalised tokens: every ASCII byte but letters and digits
NOT_ALNUM = _table(lambda b: b < 0x80 and not chr(b).isalnum())


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            grown = np.multiply.accumulate(np.full(size, base, np.uint64))
        have = np.concatenate([np.ones(1, np.uint64), grown[:-1]])
        if size <= 1 << 23:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (one-to-one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=out[1:])
    return out


def words(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = WHITE, cuts: np.ndarray | None = None):
    """``(row, hash)`` of every word, in order of the texts. ``cuts``: places where
    words part without a gap."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gap = gaps[data]
    cut = np.zeros(n + 1, bool)  # a text starts here
    cut[off] = True
    cut[0] = cut[n] = True
    if cuts is not None:
        cut[cuts] = True
    inside = ~gap
    start, end = inside.copy(), inside.copy()
    start[1:] &= gap[:-1] | cut[1:n]
    end[:-1] &= gap[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    base = _BASES[0]
    sums = _sums(data.astype(np.uint64) + np.uint64(1), base)
    h = (sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), n)[start]
    row = np.searchsorted(off, start, side="right") - 1
    return row, mix(h ^ (end - start).astype(np.uint64))


class Grams:
    """Hashes of any run of words ``[i, j)`` of one slice."""

    def __init__(self, word_hash: np.ndarray):
        self.sums = _sums(word_hash, _BASES[1])
        self.back = _powers(pow(_BASES[1], -1, 1 << 64), len(word_hash) + 1)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.back[i] ^ (j - i).astype(np.uint64))


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each text's words start, and the end of the last."""
    return np.searchsorted(row, np.arange(n_rows + 1))
