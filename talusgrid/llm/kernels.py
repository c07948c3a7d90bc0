"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one Arrow batch of whole texts at a time: the UTF-8 buffer is
viewed as bytes and words, word hashes and shingle hashes are computed with NumPy, so no
Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_MIX = (U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX[0]
        x = (x ^ (x >> U64(27))) * _MIX[1]
        return x ^ (x >> U64(31))


#: A random-looking 64-bit value for each byte, after ASCII lower-casing.
_BYTE = mix64(_LOWER.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**n, modulo 2**64."""
    out = np.empty(n + 1, dtype=U64)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        step = base
        while filled <= n:
            take = min(filled, n + 1 - filled)
            out[filled : filled + take] = out[:take] * step
            step = step * step
            filled += take
    return out


_INVERSE = U64(pow(int(_STEP), -1, 1 << 64))
_CACHE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _CACHE or len(_CACHE["up"]) <= n:
        _CACHE["up"], _CACHE["down"] = _powers(n, _STEP), _powers(n, _INVERSE)
    return _CACHE["up"], _CACHE["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column (null: empty) and the row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words of each row, and the rows' offsets into them.

    A word is a maximal run of bytes outside SPACES inside one row. The hash is the
    polynomial of the bytes' table values, taken as a difference of prefix sums modulo 2**64.
    """
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    word = ~_IS_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    inner = offsets[offsets < n]
    first[inner] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = np.zeros(n, dtype=bool)
    ends_of_rows = offsets[1:][offsets[1:] > 0] - 1
    last[ends_of_rows] = True
    ends = np.flatnonzero(word & (~after | last)) + 1
    up, down = _power_tables(n)
    with np.errstate(over="ignore"):
        prefix = np.empty(n + 1, dtype=U64)
        prefix[0] = 0
        np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
        raw = (prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64)
    return mix64(raw), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles, in text order, and the rows' offsets into them.

    A row with fewer than ``width`` words, but at least one, has its whole sequence as one
    shingle; a row without words has none.
    """
    lengths = np.diff(offsets)
    full = np.maximum(lengths - width + 1, 0)
    counts = np.where(lengths == 0, 0, np.maximum(full, 1))
    out_offsets = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(counts, out=out_offsets[1:])
    n = len(words)
    out = np.empty(out_offsets[-1], dtype=U64)
    if not n:
        return out, out_offsets
    multipliers = mix64(np.arange(1, width + 1, dtype=U64)) | U64(1)
    with np.errstate(over="ignore"):
        if n >= width:
            total = np.zeros(n - width + 1, dtype=U64)
            for k in range(width):
                total += words[k : n - width + 1 + k] * multipliers[k]
            has = full > 0
            position = np.repeat(offsets[:-1][has] - out_offsets[:-1][has], full[has])
            where = np.repeat(has, counts)
            slots = np.flatnonzero(where)
            out[slots] = mix64(total[slots + position])
        for row in np.flatnonzero((lengths > 0) & (full == 0)):
            part = words[offsets[row] : offsets[row + 1]]
            out[out_offsets[row]] = mix64(np.asarray([(part * multipliers[: len(part)]).sum() + U64(len(part))], dtype=U64))[0]
    return out, out_offsets


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats."""
    out, counts = [], np.zeros(len(offsets), dtype=np.int64)
    for row in range(len(offsets) - 1):
        part = values[offsets[row] : offsets[row + 1]]
        if len(part) > 1:
            part = np.sort(part)
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        out.append(part)
        counts[row + 1] = len(part)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(counts)
