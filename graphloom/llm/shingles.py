"""Sets of word shingles as 64-bit hashes, made from Arrow batches with numpy.

Words are runs of anything but space and the ASCII controls 9 to 13, with A-Z lower-cased. A text's set holds its distinct
shingles of ``SIZE`` consecutive words; a text of fewer words has the whole sequence as its one shingle, one without words has
none. Equal hashes are taken for equal shingles, and equal set ids, of 96 bits, for equal sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words of a shingle.
SIZE = 5
#: Bytes of text that are hashed at once; a longer text is hashed alone.
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[_SPACE] = 0
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts ``data[offsets[i]:offsets[i + 1]]``, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    # each byte's weight is a power of the radix by its place in the word; spaces weigh nothing
    spread = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, spread)
    lengths = np.add.reduceat((~space).astype(np.int32), starts)
    powers = np.ones(int(spread.max()), dtype=np.uint64)
    top = int(lengths.max())
    powers[1:top] = np.cumprod(np.full(top - 1, _RADIX), dtype=np.uint64)
    sums = np.add.reduceat(_BYTE[data[starts[0] :]] * powers[place], starts - starts[0])
    return mix(sums + lengths.astype(np.uint64)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    if len(words) >= SIZE:
        grams = np.zeros(len(words) - SIZE + 1, dtype=np.uint64)
        for k in range(SIZE):
            grams += words[k : k + len(grams)] * _PLACE[k]
        grams = mix(grams)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= SIZE:
            g = np.sort(grams[end - n : end - SIZE + 1])
            keep = np.empty(len(g), dtype=bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        elif n:
            out.append(mix((words[end - n : end] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> bytes:
    """The 12 bytes that name a set: two sums over its hashes that have nothing in common, so their order does not matter."""
    size = np.uint64(len(s))
    one = mix(mix(s ^ _RADIX).sum(dtype=np.uint64, keepdims=True) + size)
    two = mix(mix(s * _PLACE[0] + _PLACE[1]).sum(dtype=np.uint64, keepdims=True) ^ size)
    return one.tobytes() + two.tobytes()[:4]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the texts' offsets in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def steps(batch: pa.RecordBatch, column: int):
    """(first row, sets) for consecutive rows of a batch, ``STEP_BYTES`` of text or one row at a time."""
    data, offsets = _bytes_of(batch.column(column))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1, rows))
        yield at, shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
