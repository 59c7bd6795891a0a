"""Words, hashes and shingles of many texts at once, on the UTF-8 bytes of an Arrow column.

The functions see one block of whole texts at a time; a block holds about ``BLOCK`` bytes, or one longer text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BYTE_KEYS = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of the texts in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer, ends.astype(np.int64)


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes each."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, count)
        first = min(last, count)


def word_spans(buffer: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of the words in the block, and how many words each text has (n + 1 running counts)."""
    inside = ~space[buffer]
    before = np.empty(len(buffer), bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(buffer)]
    before[cuts] = False  # a word never crosses texts
    if len(buffer):
        before[0] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buffer), bool)
    after[:-1] = inside[1:]
    closing = offsets[1:][offsets[1:] > 0] - 1
    after[closing] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(base: int, size: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < size:
        row = np.full(max(size, BLOCK + 1), base, np.uint64)
        row[0] = 1
        _powers[base] = np.cumprod(row)
    return _powers[base][:size]


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C159E3779B9) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    Every eight bytes of a span are mixed with their place in it, and the results are added up. Unlike a polynomial
    modulo 2^64 this has no structure that makes chosen texts collide.
    """
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    place = np.arange(total) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    values = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view("<u8").ravel()
    rest = np.minimum(np.repeat(size, pieces) - 8 * place, 8).astype(np.uint64)
    values &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
    mixed = mix(values + mix(place.astype(np.uint64), 5), 1)
    sums = np.zeros(len(starts), np.uint64)
    filled = np.flatnonzero(pieces)
    if len(filled):
        sums[filled] = np.add.reduceat(mixed, first[filled])
    return mix(sums + size.astype(np.uint64), 9)


def rolling_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of many overlapping spans at the cost of one pass. Chosen texts can collide, so these only route and count."""
    sums = np.empty(len(buffer) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_KEYS[buffer] * _power(_BASE, len(buffer)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(buffer) + 1)[starts], 1) + (ends - starts).astype(np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; the caller leaves out the runs that cross texts."""
    count = len(words) - width + 1
    total = np.zeros(max(count, 0), np.uint64)
    for at in range(width if count > 0 else 0):
        total = mix(total + words[at:at + count], at + 2)
    return total


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A text of fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    for first, last in blocks(offsets):
        low, high = offsets[first], offsets[last]
        part, at = LOWER[buffer[low:high]], offsets[first:last + 1] - low
        starts, ends, counts = word_spans(part, at)
        words = span_hashes(part, starts, ends)
        shingles = shingle_hashes(words, width)
        for one, two in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if two - one >= width:
                row = np.sort(shingles[one:two - width + 1])
                yield row[np.concatenate(([True], row[1:] != row[:-1]))]
            elif two > one:
                yield shingle_hashes(words[one:two], two - one)
            else:
                yield np.zeros(0, np.uint64)
