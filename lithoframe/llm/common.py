"""Helpers that the operators of this folder share: Arrow text access and word hashing, beside those of the library."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut, drop, shared_dir, table

__all__ = ["PLAIN_WORD", "cut", "drop", "frugal", "mix", "shared_dir", "shingles_of", "small_batches", "table", "text_views", "words_of"]

#: Word separators of the contracts: blank and the bytes 9 to 13.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Powers of the hash's base that are kept; a longer word is hashed in parts of so many bytes.
KEPT_POWERS = 1 << 16


def small_batches(df: DataFrame) -> None:
    """Let Python workers take BATCH_ROWS rows or about BATCH_BYTES at a time at most, as rows hold whole texts; smaller settings stay."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):  # sizes with other units are taken as larger
            conf.set(key, str(most))


def frugal(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back to the system when its task ends, as workers serve later tasks too."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def text_views(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column without copies: first row, end row, the bytes, and each row's offsets in them.

    Null rows come out empty. Every slice holds whole rows, and `most` bytes at most unless one row is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _mixer(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63 - 1, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _mixer(20, 256)
_BASE = _mixer(21, 1)[0]
_ROLL = _mixer(22, 1)[0]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED = _BYTE[_LOWER]
_WORD = np.ones(256, bool)
_WORD[list(SEPARATORS)] = False
#: Words of letters and digits only: ASCII punctuation and control bytes separate too.
PLAIN_WORD = np.zeros(256, bool)
PLAIN_WORD[48:58] = PLAIN_WORD[65:91] = PLAIN_WORD[97:123] = PLAIN_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (the public SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(KEPT_POWERS - 1, _BASE)]))


def _long_hash(word: np.ndarray) -> np.uint64:
    """The sum of bytes times powers of the base, part by part."""
    total, scale, step = np.zeros(1, np.uint64), np.ones(1, np.uint64), _POWERS[-1:] * _BASE
    for k in range(0, len(word), KEPT_POWERS):
        part = _LOWERED[word[k : k + KEPT_POWERS]]
        total += np.add.reduce(part * _POWERS[: len(part)]) * scale
        scale = scale * step
    return total[0]


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, runs of the bytes that `word` has: their start and end bytes, a 64-bit hash of each in lower case (A-Z), and each row's first word's number (one more at the end).

    Memory beside the words' own figures is bounded by SLICE_BYTES, whatever the length of the slice.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64)
    inside = word[data]
    edge = np.zeros(n, bool)  # a row's first byte starts a word of its own
    edge[offsets[:-1][offsets[:-1] < n]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(begins)
    inside[:-1] &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(inside) + 1
    rows = np.searchsorted(starts, offsets)
    hashes, lengths = np.zeros(len(starts), np.uint64), ends - starts
    total = np.cumsum(lengths)
    k = 0
    while k < len(starts):
        upto = int(np.searchsorted(total, (total[k - 1] if k else 0) + SLICE_BYTES, side="right"))
        if upto <= k:  # one word is longer
            hashes[k] = _long_hash(data[starts[k] : ends[k]])
            k += 1
            continue
        own = lengths[k:upto]
        long = np.flatnonzero(own > KEPT_POWERS)
        if len(long):
            upto = k + int(long[0])
            if upto == k:
                hashes[k] = _long_hash(data[starts[k] : ends[k]])
                k += 1
                continue
            own = own[: upto - k]
        first = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(first, own)
        hashes[k:upto] = np.add.reduceat(_LOWERED[data[place + np.repeat(starts[k:upto], own)]] * _POWERS[place], first)
        k = upto
    return starts, ends, mix(hashes + lengths.astype(np.uint64)), rows


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one row; of the whole row if it has fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    if n < size:
        total = np.full(1, n, np.uint64)
        for k in range(n):
            total = total * _ROLL + hashes[k : k + 1]
        return mix(total)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total = total * _ROLL + hashes[k : n - size + 1 + k]
    return mix(total)
