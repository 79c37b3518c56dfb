"""Vectorised text helpers for Arrow batches: UTF-8 buffers as NumPy arrays, word spans, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; bounds a worker's temporaries to some tens of MB.
CHUNK_BYTES = 1 << 20

_MUL = 0x9E3779B97F4A7C15
_ODD = 0xD6E8FEB86659FD93
_RADIX = 0x5851F42D4C957F2D
_RADIX_INV = pow(_RADIX, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(_ODD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(_MUL)
    x ^= x >> np.uint64(32)
    return x


#: A fixed pseudo-random value for every byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, CHUNK_BYTES + 1), dtype=np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its offsets (int64, len + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of at most `limit` bytes of text, or of one row where that row is longer."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row in which each byte position lies."""
    return np.searchsorted(offsets, positions, side="right") - 1


def word_spans(in_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs where in_word holds, never across rows, and the row of each run.

    `in_word` has one boolean for each byte of the buffer."""
    n = len(in_word)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    starts = in_word.copy()
    starts[1:] &= ~in_word[:-1]
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = in_word[cuts]
    ends[cuts - 1] = in_word[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, row_of(offsets, s)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum over the buffer."""
    n = len(data)
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power_table(_RADIX, n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power_table(_RADIX_INV, n + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(_MUL)))


def gram_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of words within a row, and the index of each one's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(_RADIX)
        h += words[j : j + n]
    inside = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix64(h[inside]), inside


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, all else as it is."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: [\x20\x09-\x0D]
SPACE = class_table(b" \t\n\x0b\x0c\r")


def row_sums(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n_rows).astype(np.int64)


def byte_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row have their flag set."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
