"""md5 of ``seed:key:position`` for every position of many arrays, with numpy.

The digests are those of ``hashing.rank_key(seed, key, position)``; a task computes
them for all positions of an Arrow batch together, in blocks that stay in the cache.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 65536  # positions hashed together: few calls of numpy, arrays that stay in the cache
TABLE = 1 << 17  # positions whose digits are made once

_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_ADD = [int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


@functools.lru_cache(1 << 12)
def _scalar(x: int) -> np.ndarray:
    return np.array(x & 0xFFFFFFFF, dtype=np.uint32)


_LEFT = [_scalar(s) for s in _SHIFTS]
_RIGHT = [_scalar(32 - s) for s in _SHIFTS]


def _space(n: int) -> np.ndarray:
    """Six arrays of ``n`` words for ``_compress``; each begins a cache line, where numpy's
    loops are faster."""
    width = -(-n // 16) * 16
    raw = np.empty((6 * width + 16) * 4, dtype=np.uint8)
    skip = -raw.ctypes.data % 64
    return raw[skip:skip + 6 * width * 4].view(np.uint32).reshape(6, width)


def _compress(state: list, words: list, steps: int = 64, space: np.ndarray | None = None) -> list[np.ndarray]:
    """One md5 step: ``state`` (four words each) and 16 ``words``, each an array or, the same
    for all, an int.  The first word of the result needs 61 ``steps`` only.  The work is done
    in ``space``, all of its arrays as long as the result."""
    if space is None:
        n = next(len(x) for x in [*state, *words] if not isinstance(x, int))
        space = _space(n)[:, :n]
    a, b, c, d, f, t = space
    for x, y in zip((a, b, c, d), state):
        x[...] = y
    for i in range(steps):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f); np.bitwise_and(f, b, f); np.bitwise_xor(f, d, f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f); np.bitwise_and(f, d, f); np.bitwise_xor(f, c, f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f); np.bitwise_xor(f, d, f)
        else:
            g = (7 * i) % 16
            np.invert(d, f); np.bitwise_or(f, b, f); np.bitwise_xor(f, c, f)
        if isinstance(words[g], int):
            np.add(a, _scalar(words[g] + _ADD[i]), a)
        else:
            np.add(a, words[g], a); np.add(a, _scalar(_ADD[i]), a)
        np.add(a, f, a)
        np.left_shift(a, _LEFT[i], t); np.right_shift(a, _RIGHT[i], a)
        np.bitwise_or(a, t, a); np.add(a, b, a)
        a, d, c, b = d, c, b, a
    # after 61 steps the first word still stands second
    new = (a, b, c, d) if steps == 64 else (b,)
    return [x + (_scalar(y) if isinstance(y, int) else y) for x, y in zip(new, state)]


def _digits(pos: np.ndarray, skip: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Little-endian words with the decimal digits of the positions after ``skip`` free
    bytes and the closing 0x80 of md5, and the numbers of bits of the digits."""
    digits = np.searchsorted(10 ** np.arange(1, 19), pos, side="right") + 1
    most = int(digits.max(initial=1))
    out = np.zeros((len(pos), -(-(skip + most + 1) // 4) * 4), dtype=np.uint8)
    every = np.arange(len(pos))
    out[every, skip + digits] = 0x80
    for j in range(most):
        has = every[digits > j]
        out[has, skip + digits[has] - 1 - j] = 48 + (pos[has] // 10**j) % 10
    w = out.view("<u4")
    return [np.ascontiguousarray(w[:, j]) for j in range(w.shape[1])], (digits * 8).astype(np.uint32)


@functools.lru_cache(8)  # four ``skip``, two lengths
def _table(skip: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    return _digits(np.arange(n), skip)


def _endings(pos: np.ndarray, skip: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """``_digits`` of positions below ``n``, from a table as far as it goes."""
    if n > TABLE and int(pos.max()) >= TABLE:
        return _digits(pos, skip)
    words, bits = _table(skip, TABLE if n > 1 << 13 else 1 << 13)
    return [w[pos] for w in words], bits[pos]


def position_words(seed, keys: list, counts: np.ndarray, n_words: int = 4) -> np.ndarray:
    """The digests of positions 0..count-1 of every key, keys one after the other, as
    four rows of big-endian words (word 0: hex digits 1-8, ...), or the first of them
    (``n_words`` 1).

    Positions whose texts begin alike in length and end in the same 64-byte block are
    hashed together, so most of the 16 words of a step are the same for all."""
    texts = [f"{seed}:{k}:".encode() for k in keys]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.asarray(counts, dtype=np.int64)
    starts = np.cumsum(counts) - counts
    out = np.empty((n_words, int(counts.sum())), dtype=np.uint32)
    for length in np.unique(lengths[counts > 0]).tolist():
        at = np.flatnonzero((lengths == length) & (counts > 0))
        whole, rest = divmod(length, 64)
        raw = b"".join(texts[r].ljust((whole + 1) * 64, b"\0") for r in at)
        prefix = np.frombuffer(raw, dtype="<u4").reshape(len(at), -1)
        state = [np.full(len(at), s, dtype=np.uint32) for s in _START]
        for s in range(whole):
            state = _compress(state, list(np.ascontiguousarray(prefix[:, s * 16:s * 16 + 16].T)))
        # up to this position the digits, 0x80 and the length fit the block
        cut = np.minimum(counts[at], 10 ** min(55 - rest, 18) if rest < 55 else 0)
        for blocks, lo, hi in ((1, 0 * cut, cut), (2, cut, counts[at])):
            _hash_positions(out, starts[at], lo, hi, prefix[:, whole * 16:], state, length, blocks)
    return out


def _hash_positions(out: np.ndarray, starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, prefix: np.ndarray,
                    state: list[np.ndarray], length: int, blocks: int) -> None:
    """Fills ``out`` for positions lo..hi-1 of rows, which begin at ``starts``."""
    ends, rest = np.cumsum(hi - lo), length % 64
    total = int(ends[-1:].sum())
    space = _space(min(BLOCK, total))
    for s in range(0, total, BLOCK):
        e = min(s + BLOCK, total)
        i, j = np.searchsorted(ends, (s, e - 1), side="right") + (0, 1)
        first = ends[i:j] - (hi - lo)[i:j]
        n = np.minimum(ends[i:j], e) - np.maximum(first, s)
        pos = np.arange(s, e) - np.repeat(first - lo[i:j], n)

        def each(x: np.ndarray):
            return int(x[0]) if (x == x[0]).all() else np.repeat(x, n)

        words = [0] * (16 * blocks)
        for w in range(-(-rest // 4)):
            words[w] = each(prefix[i:j, w])
        digits, bits = _endings(pos, rest % 4, int(hi.max()))
        for w, x in enumerate(digits, rest // 4):
            if w < len(words) - 2:
                words[w] = x if isinstance(words[w], int) and words[w] == 0 else x | np.uint32(words[w]) \
                    if isinstance(words[w], int) else x | words[w]
        words[-2] = bits + np.uint32(length * 8)
        h = [each(x[i:j]) for x in state]
        for b in range(blocks):
            last = b == blocks - 1 and len(out) == 1
            h = _compress(h, words[16 * b:16 * b + 16], 61 if last else 64, space[:, :e - s])
        begin, end = starts[i] + pos[0], starts[j - 1] + pos[-1]
        to = slice(begin, end + 1) if end - begin == e - s - 1 else np.repeat(starts[i:j], n) + pos
        for w in range(len(out)):
            out[w, to] = h[w].byteswap(True)


def below(words, prefix: str) -> np.ndarray:
    """Whether the hex digits of ``words`` (most significant word first) sort before
    ``prefix`` (lower-case hex digits, at most as many)."""
    p = prefix.ljust(8 * len(words), "0")
    out = np.zeros(len(words[0]), dtype=bool)
    for i in reversed(range(len(words))):
        limit = int(p[8 * i:8 * i + 8], 16)
        out = (words[i] < limit) | ((words[i] == limit) & out)
    return out


def keyed(keys: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Per position, whether its array has a key: without one there is no digest."""
    return np.repeat(keys.is_valid().to_numpy(zero_copy_only=False), counts)


def list_parts(lists: pa.Array, kind: type = np.int8) -> tuple[np.ndarray, pa.Array]:
    """Lengths of an Arrow list array, or of packed values, (0 for null) and the values,
    null lists left out.

    Packed values are a binary column, with one signed byte a value, -128 for null, or
    one ``kind``, such as doubles with NaN for null: such a row crosses between the JVM
    and Python as one piece."""
    if not packed(lists.type):
        counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        return counts, lists.flatten()
    offsets, data = text_parts(lists)
    data = data.view(kind)
    none = data == NO_VALUE if kind is np.int8 else np.isnan(data)
    return np.diff(offsets) // data.itemsize, pa.array(data, mask=none if none.any() else None)


def list_like(lists: pa.Array, counts: np.ndarray, values: pa.Array) -> pa.Array:
    """Values as a list array of these lengths, packed if ``lists`` is; null where ``lists`` is."""
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if packed(lists.type):
        data = values.cast(pa.int8()).fill_null(NO_VALUE).to_numpy(zero_copy_only=False)
        return pieces(lists, offsets, data, pa.binary())
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


NO_VALUE = -128
SLICE = 1 << 18  # values (bytes of texts) that a function takes at once


def in_slices(fn):
    """An Arrow function of rows that takes the rows of a batch in slices, which stay in
    the cache; the first array tells their size."""
    @functools.wraps(fn)
    def run(*arrays):
        first = arrays[0]
        flat = packed(first.type) or pa.types.is_string(first.type) or pa.types.is_large_string(first.type)
        sizes = pc.binary_length(first) if flat else pc.list_value_length(first)
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(first)]
        parts = [fn(*(a.slice(lo, hi - lo) for a in arrays)) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
        return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else fn(*arrays)

    return run


def packed(kind: pa.DataType) -> bool:
    return pa.types.is_binary(kind) or pa.types.is_large_binary(kind)


def text_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) of strings or binaries and their bytes, none for null."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def lists_of(lists: pa.Array) -> list:
    """Rows of a list array or of packed values as Python lists."""
    counts, values = list_parts(lists)
    flat, ends = values.to_pylist(), np.cumsum(counts)
    return [flat[e - c:e] if known else None for c, e, known in zip(counts, ends, lists.is_valid().to_pylist())]


def pieces(like: pa.Array, offsets: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values ``offsets[i]`` to ``offsets[i + 1]`` of ``data`` as strings or binaries; null
    where ``like`` is."""
    data, offsets = np.ascontiguousarray(data), offsets * data.itemsize
    if offsets[-1] > 2**31 - 1:
        raise OverflowError("more than 2 GB in an Arrow batch: lower spark.sql.execution.arrow.maxBytesPerBatch")
    out = pa.Array.from_buffers(kind, len(offsets) - 1,
                                [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(like.is_valid(), out, pa.scalar(None, kind)) if like.null_count else out


def beside(counts: np.ndarray, other: pa.Array, kind: type = np.int8) -> pa.Array:
    """Values of the list array ``other`` at the positions of arrays of these lengths;
    null where its array is shorter."""
    there, values = list_parts(other, kind)
    if np.array_equal(there, counts):
        return values
    row = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(there) - there, counts) + pos
    return values.take(pa.array(at, mask=pos >= there[row]))
