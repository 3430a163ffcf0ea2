"""Vectorised text helpers that run inside Spark tasks.

They work on the raw UTF-8 buffer of an Arrow string column, a few megabytes at a
time, so a task never holds more than one slice of hashes whatever the text lengths.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once (a single longer text is a slice of its own).
SLICE_BYTES = 700_000
#: Odd 64-bit multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def worker_state() -> types.ModuleType:
    """A place in this Python worker that outlives a task: workers are used again."""
    return sys.modules.setdefault("presswork_worker_state", types.ModuleType("presswork_worker_state"))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


CODES = _byte_codes(False)
CODES_LOWER = _byte_codes(True)


#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first n bytes of eight.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Longer words are hashed by hashlib, one by one.
SHORT_WORD = 64


class Powers:
    """Powers of the hash base and of its inverse, grown on demand.

    Hashes of spans are polynomials modulo 2**64. Some pairs of texts of 1,000 bytes and more (such as the Thue-Morse word and its
    complement) are equal under every such polynomial, so they serve shorter spans, and features that may collide; words take word_hashes().
    """

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                up, down = (np.full(size, b, dtype=np.uint64) for b in (BASE, BASE_INV))
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most `limit` bytes each, or a single row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def prefix_hash(data: np.ndarray, codes: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative polynomial hash C (n + 1 values) and the inverse powers to normalise a span."""
    n = len(data)
    up, down = powers.get(n + 1)
    out = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes[data] * up[:n], out=out[1:])
    return out, down


def span_hash(cum: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] that depends on the content and length alone."""
    with np.errstate(over="ignore"):
        return mix((cum[end] - cum[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of non-space bytes; runs never cross rows."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], mixed eight bytes at a time: no sum that could cancel out. Long words take blake2b."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
        h = mix(h ^ (eight[start] & FIRST_BYTES[np.minimum(size, 8)]))
    for at in range(8, SHORT_WORD, 8):
        more = np.flatnonzero((size > at) & (size <= SHORT_WORD))
        if not len(more):
            break
        h[more] = mix(h[more] ^ (eight[start[more] + at] & FIRST_BYTES[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def shingles(data: np.ndarray, offsets: np.ndarray, powers: Powers, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, words per row) of all runs of `size` lower-cased words, in text order.

    A row with fewer words gives its whole word sequence as one shingle; one without words none.
    """
    start, end, row = words(data, offsets)
    per_row = np.bincount(row, minlength=len(offsets) - 1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), per_row
    w = word_hashes(LOWER[data], start, end)
    m = len(w)
    first_word = np.concatenate(([0], np.cumsum(per_row)[:-1]))
    with np.errstate(over="ignore"):
        wcum = np.zeros(m + 1, dtype=np.uint64)
        up, wdown = powers.get(m + 1)
        np.cumsum(w * up[:m], out=wcum[1:])
    at = np.arange(m)
    whole = at + size <= first_word[row] + per_row[row]
    short = (at == first_word[row]) & (per_row[row] < size)
    s = np.flatnonzero(whole | short)
    e = np.where(whole[s], s + size, s + per_row[row[s]])
    return span_hash(wcum, wdown, s, e), row[s], per_row


def distinct_by_row(h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, concatenated, with n_rows + 1 offsets."""
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=n_rows))))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.uint64).view(np.int64)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary column from one buffer and offsets counted in items of `data`."""
    data = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(data.view(np.uint8).tobytes())]).cast(pa.binary())
