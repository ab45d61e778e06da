"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

A batch's texts lie in one byte buffer; every step here works on that buffer with numpy, in
pieces of about ``PIECE`` bytes, so that no Python string is made for a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Byte classes: 0 separates words, anything else is the byte to hash.
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[65:91] += 32
_SPACE[[0x20, *range(0x09, 0x0E)]] = 0
_NULL_BYTE = 0x01
#: Words of letters, digits and non-ASCII characters; ASCII signs separate.
_ALNUM = _SPACE.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        _ALNUM[_b] = 0
_SPACE_WORD = np.ones(256, dtype=bool)
_SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM_WORD = _ALNUM != 0
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE * 2, 1 << int(n).bit_length())
    return _powers(size)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    off = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def groups(offsets: np.ndarray, piece: int = PIECE):
    """Ranges (first row, last row + 1) of about ``piece`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + piece, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _fold_latin(part: np.ndarray) -> np.ndarray:
    """Lower-case the capitals of Latin-1 in UTF-8 (C3 80 to C3 9E)."""
    after = np.flatnonzero(part[:-1] == 0xC3) + 1 if len(part) > 1 else np.empty(0, np.int64)
    if len(after):
        up = after[(part[after] >= 0x80) & (part[after] <= 0x9E) & (part[after] != 0x97)]
        part[up] += 0x20
    return part


def hashes(raw: np.ndarray, offsets: np.ndarray, words: str = "alnum") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offsets of each row's words.

    ``words``: "alnum" (letters, digits, non-ASCII; case folded in ASCII and Latin-1) or
    "space" (what lies between ASCII white space; A-Z lower-cased).
    """
    return placed(raw, offsets, words)[:2]


def folded(raw: np.ndarray) -> bytes:
    """Bytes with the words of "alnum" case-folded and spaces in place of other bytes."""
    out = _fold_latin(_ALNUM[raw])
    out[out == 0] = 0x20
    return out.tobytes()


def placed(raw: np.ndarray, offsets: np.ndarray, words: str = "alnum") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hashes``, and the first byte of every word and the byte after its last."""
    is_word = _ALNUM_WORD if words == "alnum" else _SPACE_WORD
    fold = _ALNUM if words == "alnum" else _SPACE
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    out, at, to = [], [], []
    i = 0
    starts_of_rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    while i < n:
        j = min(n, i + PIECE)
        while j < n:  # never cut inside a word
            k = int(np.searchsorted(starts_of_rows, j))
            if k < len(starts_of_rows) and starts_of_rows[k] == j or not is_word[raw[j]]:
                break
            ahead = raw[j : j + 4096]
            stop = np.flatnonzero(~is_word[ahead])
            end = j + (int(stop[0]) if len(stop) else len(ahead))
            if k < len(starts_of_rows):
                end = min(end, int(starts_of_rows[k]))
            j = end
            if len(stop):
                break
        part = raw[i:j]
        on = is_word[part]
        before = np.empty_like(on)
        before[0], before[1:] = False, on[:-1]
        lo, hi = np.searchsorted(starts_of_rows, [i, j])
        before[starts_of_rows[lo:hi] - i] = False
        start = np.flatnonzero(on & ~before)
        if len(start):
            stop = np.empty_like(on)
            stop[:-1], stop[-1] = ~on[1:], True
            cut = starts_of_rows[lo:hi] - i - 1
            stop[cut[cut >= 0]] = True
            end = np.flatnonzero(on & stop) + 1
            folded = fold[part]
            if words == "alnum":
                folded = _fold_latin(folded)
            up, down = powers(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[folded] * up[: len(part)], out=total[1:])
            out.append(mix((total[end] - total[start]) * down[start]))
            at.append(start + i)
            to.append(end + i)
        i = j
    if not out:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.concatenate(at)
    return np.concatenate(out), np.searchsorted(start, offsets).astype(np.int64), start, np.concatenate(to)


def shingles(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row, and each row's offsets; a shorter row is one shingle."""
    lens = np.diff(offsets)
    count = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    off = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=off[1:])
    if not off[-1]:
        return np.empty(0, np.uint64), off
    first = np.repeat(offsets[:-1] - off[:-1], count) + np.arange(off[-1])
    last = np.repeat(offsets[1:], count) - 1
    acc = np.zeros(len(first), np.uint64)
    for k in range(n):
        at = first + k
        acc = acc * np.uint64(_BASE) + np.where(at <= last, h[np.minimum(at, len(h) - 1)], np.uint64(k + 1))
    return mix(acc), off
