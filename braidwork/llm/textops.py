"""Vectorised word and shingle hashing over Arrow string columns.

All functions work on the UTF-8 buffer of a batch, so no Python string is made
per word. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that separate words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def pieces(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole rows of about ``most_bytes`` each, with the number of their first row."""
    at = buffers(column)[1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(at, at[start] + most_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, column.slice(start, stop - start)
        start = stop


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base^0 .. base^(n-1); kept between calls up to two megabytes of values."""
    found = kept.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 18), base, dtype=U)
        found[0] = U(1)
        np.cumprod(found, out=found)
        if n <= 1 << 21:
            kept[base] = found
    return found[:n]


def powers(n: int, *, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the multiplier of running sums, or of its inverse; not to be written to."""
    return _powers(_INVERSE if inverse else _MULTIPLIER, n)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the sum of keyed bytes i..j-1, each times a power of the multiplier by position."""
    out = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(_BYTE_KEYS[raw] * _powers(_MULTIPLIER, len(raw)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, independent of where the spans stand."""
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(U))


def words(column: pa.Array, *, space: np.ndarray = SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, start and end bytes, and for each row the number of its first word (n + 1 values).

    A word is a run of bytes outside ``space``; A-Z are folded to a-z first.
    """
    raw, at = buffers(column)
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U), empty, empty, np.zeros(len(column) + 1, np.int64)
    inside = ~space[raw]
    before = np.empty(len(raw), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    before[edges] = False  # a row's first byte begins a word
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hashes(prefix_sums(fold[raw]), starts, ends), starts, ends, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words of a row, and the number of each row's first shingle.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    total = int(at[-1])
    if not total:
        return np.zeros(0, U), at
    row = np.repeat(np.arange(len(counts)), counts)
    start = first[:-1][row] + (np.arange(total) - at[:-1][row])
    left = np.minimum(n_words[row], width)
    out = np.full(total, 0x2545F4914F6CDD1D, dtype=U)
    for k in range(width):
        here = left > k
        word = hashes[np.minimum(start + k, len(hashes) - 1)]
        out = np.where(here, mix(out * U(_MULTIPLIER) + word), out)
    return out, at


def distinct_by_row(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and the new row starts."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(at)))


def sketches(values: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """(rows, words) of 64 bits: a row's distinct hashes dealt to bits, each the parity of its number.

    Two sets differ in at least as many elements as their sketches in bits.
    """
    out = np.zeros((len(at) - 1) * words, U)
    place = np.repeat(np.arange(len(at) - 1) * words, np.diff(at)) + ((values >> U(6)) % U(words)).astype(np.int64)
    np.bitwise_xor.at(out, place, U(1) << (values & U(63)))
    return out.reshape(-1, words)


def list_column(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of 64-bit values as an Arrow list column."""
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(values.view(np.int64), pa.int64())).cast(pa.list_(pa.int64()))
