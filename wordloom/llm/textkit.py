"""Vectorised text primitives on Arrow string buffers: words, hashes and shingles.

All functions work on whole texts. A batch is cut into chunks of whole rows so that the numpy
arrays stay within a few dozen megabytes; a row longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 2 << 20


def trim() -> None:
    """Gives freed memory back to the system; Python workers are used again by later tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection that spreads all bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting beats the hashing of numpy.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: A-Z as a-z, all other bytes as themselves.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

#: The first 1 to 8 bytes of a little-endian word.
_FIRST = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], U64)
#: Longer spans are hashed one by one.
_SHORT = 64
#: Multipliers of the words in a shingle.
_STEP = mix(np.arange(101, 133, dtype=U64)) | U64(1)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as rows that share their memory; zeros follow the last byte."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.lib.stride_tricks.as_strided(padded, (len(buf) + 1, 8), (1, 1), writeable=False)


def numbers(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of ``eights`` as numbers."""
    return held[places].view("<u8")[:, 0]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; with ``fold``, A-Z count as a-z.

    Every step is a bijection of the hash so far and the next eight bytes; spans over 64 bytes are left
    to xxh3.
    """
    if fold:
        buf = FOLDED[buf]
    size = ends - starts
    out = mix((size.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    held = eights(buf)
    some = np.flatnonzero((size > 0) & (size <= _SHORT))
    at, left = starts[some], size[some]
    for k in range(0, _SHORT, 8):
        if not len(some):
            break
        out[some] = mix(out[some] ^ (numbers(held, at + k) & _FIRST[np.minimum(left - k, 8)]) * U64(0xD1342543DE82EF95))
        more = left > k + 8
        some, at, left = some[more], at[more], left[more]
    whole = memoryview(np.ascontiguousarray(buf))
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[starts[i] : ends[i]])
    return out


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words ``starts, ends`` of ``buf``, A-Z as a-z, each with one blank behind it, and where each begins (one more entry than words)."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(begin[-1], 32, np.uint8)
    flat = np.arange(size.sum())
    word = np.repeat(np.arange(len(size)), size)
    out[flat + word] = FOLDED[buf[flat + np.repeat(starts - np.cumsum(size) + size, size)]]
    return out, begin


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 128-bit xxh3 digest of each span of bytes, as two columns."""
    whole, one = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([one(whole[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of a string column: first row, end row, UTF-8 bytes, and the rows' offsets in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        high = min(high, len(column))
        yield low, high, whole[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word (one more entry than rows)."""
    solid = ~BLANK[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    first[edge] = solid[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased (A-Z) word, and each row's first word."""
    starts, ends, at = word_spans(buf, offsets)
    return span_hash(buf, starts, ends, fold=True), at


def shingles(words: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of ``size`` words in each row, and each row's first shingle.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    count = np.diff(at)
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(count)), number)
    position = at[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    length = np.minimum(count, size)[row]
    total = length.astype(U64) * U64(0x2545F4914F6CDD1D)
    padded = np.concatenate([words, np.zeros(size, U64)])
    for k in range(size):
        part = padded[position + k] * _STEP[k]
        if k:
            part[length <= k] = 0
        total += part
    return mix(total), begin
