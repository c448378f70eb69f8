"""Vectorised text kernels over Arrow columns.

A batch of texts is one byte buffer with offsets; words, lines, shingles and their 64-bit
fingerprints are found by passes over that buffer in numpy, without a Python object per word.
Fingerprints agree between processes and runs. Two different strings share a 64-bit fingerprint
with a chance of about 2**-64 a pair, which the operators accept as equality.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


class Buffer(NamedTuple):
    """Bytes of a batch and where each row begins and ends."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    null: np.ndarray


def buffer_of(column: pa.Array) -> Buffer:
    """The bytes of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    n = len(column)
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(offs[0]), int(offs[-1])) if n else (0, 0)
    starts, ends = offs[:-1] - lo, offs[1:] - lo
    ends = np.where(null, starts, ends)
    return Buffer(raw[lo:hi], starts, ends, null)


def slices(column: pa.Array, limit: int = 2 << 20) -> list[pa.Array]:
    """Consecutive parts of a column of at most `limit` bytes each, or of one longer row: the
    working memory of the kernels follows this, not the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    buf = buffer_of(column)
    size = buf.ends - buf.starts
    out, begin, held = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and held + n > limit:
            out.append(column.slice(begin, i - begin))
            begin, held = i, 0
        held += n
    if begin < len(size) or not out:
        out.append(column.slice(begin))
    return out


class Tokens(NamedTuple):
    """Spans of a batch: byte range and row of each, and how many each row has."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray


def spans(buf: Buffer, breaks: np.ndarray) -> Tokens:
    """Maximal runs of bytes outside `breaks` that don't cross a row's border."""
    n = len(buf.data)
    rows = len(buf.starts)
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, np.zeros(rows, np.int64))
    inside = ~breaks[buf.data]
    covered = np.zeros(n + 1, np.int8)
    np.add.at(covered, buf.starts, 1)
    np.add.at(covered, buf.ends, -1)
    if buf.null.any():
        inside &= np.cumsum(covered[:-1], dtype=np.int8) > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = buf.starts[buf.starts < n]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = buf.ends[buf.ends > 0] - 1
    last[edge] = inside[edge]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(buf.starts, start, side="right") - 1
    count = np.bincount(row, minlength=rows)
    return Tokens(start, end, row, count)


def words(buf: Buffer) -> Tokens:
    """Words: maximal runs of bytes other than space and tab to carriage return."""
    return spans(buf, _SPACE)


def lowered(buf: Buffer) -> Buffer:
    """A-Z lower-cased, all else as it is."""
    return buf._replace(data=_LOWER[buf.data])


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each byte range: a polynomial over random byte values, from prefix
    sums, moved to a common origin by the inverse power, then scrambled with the length."""
    power, inverse = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * power[: len(data)], dtype=U64, out=prefix[1:])
        h = (prefix[end] - prefix[start]) * inverse[start]
        return mix(h + (end - start).astype(U64) * U64(0xA0761D6478BD642F) + U64(seed))


def shingles(h: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all k-word windows of each row, in order, and how many each row has. A row
    with fewer words than k, and at least one, has one shingle: its whole sequence."""
    begins = np.concatenate([[0], np.cumsum(count)])[:-1]
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    total = int(n.sum())
    if not total:
        return np.zeros(0, U64), n
    row = np.repeat(np.arange(len(count)), n)
    at = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + begins[row]
    length = np.minimum(count, k)[row]
    out = np.zeros(total, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            has = length > j
            step = np.where(has, h[np.minimum(at + j, len(h) - 1)], U64(0))
            out = out * U64(0x2545F4914F6CDD1D) + mix(step + U64(j + 1)) * has.astype(U64)
        return mix(out ^ length.astype(U64)), n


def distinct_in_rows(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each row, one row after another, and how many each has."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values over each range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]
