"""Words and shingles of many texts at once, straight from the bytes of an Arrow string column.

A word is a maximal run of bytes other than space and the five ASCII control blanks, the same as
``[^\\x20\\x09-\\x0D]+``. Hashes are sums of table entries times powers of an odd constant, modulo
2**64, followed by a mixing step; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    if lower:
        table[65:91] = table[97:123]
    table[list(b" \t\n\v\f\r")] = 0
    return table


GAP = np.zeros(256, bool)
GAP[list(b" \t\n\v\f\r")] = True
TABLES = {False: _table(False), True: _table(True)}
RAW = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
BASE = U(0x2545F4914F6CDD1D)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, BASE, U)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


_POWERS = _powers(1024)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0.

    A single longer text makes a run by itself. NULL counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~GAP[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, raw: bool = False
) -> np.ndarray:
    """A hash for each word; ``lower`` reads A-Z as a-z. With ``raw``, for any spans that are not empty."""
    global _POWERS
    out = np.zeros(len(starts), U)
    table, a = RAW if raw else TABLES[lower], 0
    while a < len(starts):  # pieces of bounded size, also within one very long text
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK)))
        base, end = starts[a], ends[b - 1]
        at = starts[a:b] - base
        within = np.arange(end - base) - np.repeat(at, np.diff(at, append=end - base))
        if (longest := int(within.max()) + 1) > len(_POWERS):
            _POWERS = _powers(2 * longest)
        values = table[data[base:end]] * _POWERS[within]
        if raw:
            values[within >= np.repeat(ends[a:b] - starts[a:b], np.diff(at, append=end - base))] = 0
        out[a:b] = np.add.reduceat(values, at)
        a = b
    return mix(out ^ (ends - starts).astype(U))


def windows(hashes: np.ndarray, rows: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``k`` words within a row.

    With ``short``, a row of fewer words (one at least) gives its whole sequence as one run.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    if n >= k:
        first = np.flatnonzero(rows[k - 1 :] == rows[: n - k + 1])
        total = np.zeros(n - k + 1, U)
        for j in range(k):
            total = total * BASE + hashes[j : n - k + 1 + j]
        found = mix(total[first])
    else:
        first, found = np.zeros(0, np.int64), np.zeros(0, U)
    if short:
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sizes = np.diff(heads, append=n)
        for at, size in zip(heads[sizes < k], sizes[sizes < k]):
            total = U(size)
            for h in hashes[at : at + size]:
                total = U((int(total) * int(BASE) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            first = np.append(first, at)
            found = np.append(found, mix(np.array([total], U) ^ U(0x5851F42D4C957F2D)))
        order = np.argsort(first, kind="stable")
        first, found = first[order], found[order]
    return first, found
