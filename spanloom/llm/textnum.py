"""Whole Arrow string columns as numbers: words and other stretches are hashed without a loop over rows.

A stretch's hash is a polynomial over its bytes modulo 2**64, read off two prefix sums, then mixed.
All functions work over segments of a few MB, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into numbers at once.
SEGMENT = 1 << 19
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that white space, also beyond ASCII, may end with.
_MAY_END_SPACE = SPACE.copy()
_MAY_END_SPACE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
#: What separates words of letters and digits; bytes of other scripts count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POWERS: dict[str, np.ndarray] = {}
_VALUE = np.arange(1, 257, dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser over uint64: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def segments(data: np.ndarray, offsets: np.ndarray, limit: int = SEGMENT, blank: np.ndarray = SPACE, not_after: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (from byte, to byte, from row, to row) of at most ``limit`` bytes.

    Rows are kept together while they fit. A longer row is cut before a blank that follows something
    else; where there is none within the limit, at the next one.
    """
    n, row = len(offsets) - 1, 0
    not_after = _MAY_END_SPACE if not_after is None else not_after
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        if last > row:
            yield int(offsets[row]), int(offsets[last]), row, last
            row = last
            continue
        begin, end = int(offsets[row]), int(offsets[row + 1])
        while end - begin > limit:
            cut = begin + limit
            while True:  # the last cut within the limit, else the first one beyond it
                space = blank[data[cut - limit + 1 : cut + 1]] & ~not_after[data[cut - limit : cut]]
                found = np.flatnonzero(space)
                if len(found):
                    cut = cut - limit + 1 + int(found[-1] if cut == begin + limit else found[0])
                    break
                cut += limit
                if cut >= end:
                    cut = end
                    break
            if cut >= end:
                break
            yield begin, cut, row, row + 1
            begin = cut
        yield begin, end, row, row + 1
        row += 1


def _powers(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    if key not in _POWERS or len(_POWERS[key]) < n:
        with np.errstate(over="ignore"):
            size = max(n, SEGMENT + 2)
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
        if size > 4 * SEGMENT:
            return _POWERS.pop(key)[:n]
    return _POWERS[key][:n]


def hash_stretches(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; independent of where the stretch lies."""
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.multiply(_VALUE[data] if data.dtype == np.uint8 else data.astype(np.uint64) + np.uint64(1), _powers(_BASE, len(data)), out=sums[1:])
        np.add.accumulate(sums, out=sums)
        return mix((sums[end] - sums[start]) * _powers(_BASE_INV, len(data) + 1)[start])


def words(column: pa.Array, lower: bool = True, gap: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each segment: from row, to row, the words' hashes, and each row's number of words in it.

    A word is a run of bytes that aren't in ``gap``, lower-cased. A row that is longer than a
    segment comes in several segments.
    """
    data, offsets = buffers(column, lower)
    for a, b, lo, hi in segments(data, offsets):
        part = data[a:b]
        solid = ~gap[part]
        cuts = np.clip(offsets[lo : hi + 1] - a, 0, b - a)
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        if len(part):
            before[0], after[-1] = False, False
            before[cuts[:-1][cuts[:-1] < len(part)]] = False
            after[cuts[1:][cuts[1:] > 0] - 1] = False
        start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        yield lo, hi, hash_stretches(part, start, end), np.diff(np.searchsorted(start, cuts))


def whole_rows(found: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same with each row in one piece: the segments of a long row are joined."""
    held: list | None = None
    for lo, hi, values, counts in found:
        if held and held[0] == lo:
            held[2].append(values)
            continue
        if held:
            yield _joined(held)
        held = [lo, hi, [values], counts]
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[int, int, np.ndarray, np.ndarray]:
    lo, hi, parts, counts = held
    if len(parts) == 1:
        return lo, hi, parts[0], counts
    values = np.concatenate(parts)
    return lo, hi, values, np.array([len(values)])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order of appearance, where each is first, and each value's index in them."""
    import pandas as pd  # here, as workers that don't need it should not hold it

    code, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[code[::-1]] = np.arange(len(values) - 1, -1, -1)
    return found, first, code


def take_stretches(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``data[start : start + length]``, one behind the other."""
    ends = np.cumsum(length)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)]


def per_row(values: np.ndarray, counts: np.ndarray, how: np.ufunc, empty: float = 0) -> np.ndarray:
    """``how.reduceat`` over runs of the given lengths, with ``empty`` for runs of none."""
    out = np.full(len(counts), empty, values.dtype)
    full = counts > 0
    if full.any():
        at = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
        out[full] = how.reduceat(values, at)
    return out


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column with ``counts`` values in each row."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64()), pa.array(values, kind))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows hold ``counts`` values each, as their little-endian bytes."""
    values = np.ascontiguousarray(values)
    at = np.concatenate(([0], np.cumsum(counts))).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(values)]).cast(pa.binary())
