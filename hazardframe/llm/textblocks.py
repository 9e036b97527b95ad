"""Vectorised words and rolling hashes over the UTF-8 bytes of a batch of texts (NumPy, inside Spark tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# White space of the word patterns: tab to carriage return, and the blank.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII that is neither letter nor digit; bytes of longer characters count as letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(count: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 to count - 1, modulo 2**64; kept and grown as needed."""
    have = _powers[inverse]
    if len(have) < count:
        step = _INVERSE if inverse else BASE
        have = np.concatenate([np.ones(1, np.uint64), np.full(max(count + count // 8, 2) - 1, step, np.uint64)])
        np.multiply.accumulate(have, out=have)
        _powers[inverse] = have
    return have[:count]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release_memory() -> None:
    """Give freed memory back to the system: Python workers wait for their next task with what they have."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, to
        at = to
    release_memory()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text begins (one more entry than texts). NULL counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences give the hash of any byte range by ``range_hash``."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_VALUES[data] * powers(len(data) + 1)[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever they stand. For ranges well below 1,000 bytes."""
    top = int(start.max()) + 1 if len(start) else 1
    h = (sums[end] - sums[start]) * powers(top, inverse=True)[start]
    return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """``range_hash`` of the ``length`` bytes from each position on."""
    h = sums[length:] - sums[:-length]
    h *= powers(len(h), inverse=True)
    h += np.uint64(length * 0xD6E8FEB86659FD93 & _MASK)
    return mixed(h)


WORD_PIECE = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word over its whole length; words longer than a piece from the hashes of their pieces."""
    sums = prefix_hash(data)
    out = range_hash(sums, starts, np.minimum(ends, starts + WORD_PIECE))
    for i in np.flatnonzero(ends - starts > WORD_PIECE):
        at = np.arange(starts[i], ends[i], WORD_PIECE)
        pieces = range_hash(sums, at, np.minimum(at + WORD_PIECE, ends[i]))
        out[i] = mixed(mixed(pieces + np.arange(1, len(at) + 1, dtype=np.uint64) * np.uint64(BASE)).sum(keepdims=True))[0]
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of its first word (one more entry than texts)."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= inside[edges]
    stop[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (across text ends too; callers leave those out)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += words[k : k + count] * np.uint64(pow(BASE, 2 * k + 3, 1 << 64))
    return mixed(out)


def windowed_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segment_arange(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
