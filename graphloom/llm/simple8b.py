"""Simple-8b word-aligned coding of unsigned 64-bit integers, with escapes and per-block offsets.

A word is 64 bits: the top 4 hold a selector, the other 60 hold as many values as the selector says. Values are coded in
blocks of ``BLOCK``; a block starts with a new word, so blocks are coded and decoded side by side. A value of ``ESCAPE`` or
more is coded as ``ESCAPE`` and its true value stands, in order, in the list of escapes.

Layout of a payload, little-endian: magic ``S8B1``, u32 block length, u64 number of values, u64 number of blocks,
u64 word offset of each block and of the end, u64 escape offset of each block and of the end, words, escapes.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the code: how many values a word of each selector holds, and the bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)

MAGIC = b"S8B1"
BLOCK = 512
ESCAPE = (1 << 60) - 1
_HEAD = struct.Struct("<4sIQQ")


_SMALL = np.array([v.bit_length() for v in range(1 << 16)], dtype=np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs none."""
    top = int(v.max(initial=0)).bit_length()
    if top <= 16:
        return _SMALL[v.astype(np.uint16)]
    out = np.zeros(v.shape, dtype=np.uint8)
    for b in range(top):
        out += v >= np.uint64(1 << b)
    return out


def _selectors(w: np.ndarray, length: int) -> np.ndarray:
    """For each place, the selector whose word takes the most values from there. ``w`` has ``COUNTS[0]`` spare columns."""
    out = np.full((w.shape[0], length), len(COUNTS) - 1, dtype=np.uint8)
    power, most = 1, w
    for k in range(len(COUNTS) - 1, -1, -1):
        n = int(COUNTS[k])
        while power * 2 <= n:
            most = np.maximum(most[:, : most.shape[1] - power], most[:, power:])
            power *= 2
        a = most[:, :length]
        if n > power:
            a = np.maximum(a, most[:, n - power : n - power + length])
        # k where all n values fit, else 255
        np.minimum(out, np.maximum((a > BITS[k]).view(np.uint8) * np.uint8(255), np.uint8(k)), out=out)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """The payload of any array of unsigned integers; an empty one gives a payload of no blocks."""
    values = np.asarray(values).ravel()
    if values.dtype.kind != "u":
        values = values.astype(np.uint64)
    n = len(values)
    rows = -(-n // block)
    lengths = np.full(rows, block, dtype=np.int64)
    if rows:
        lengths[-1] = n - (rows - 1) * block
    # one spare column of zeros, which slots past a block's end read
    grid = np.zeros((rows, block + 1), dtype=values.dtype)
    grid[: n // block, :block] = values[: n - n % block].reshape(-1, block)
    if n % block:
        grid[-1, : n % block] = values[n - n % block :]
    escapes, per_block = np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    if values.dtype.itemsize == 8:
        escaped = grid >= np.uint64(ESCAPE)
        escapes, per_block = grid[escaped], escaped.sum(axis=1)
        grid[escaped] = ESCAPE
    widths = np.zeros((rows, block + int(COUNTS[0])), dtype=np.uint8)
    widths[:, :block] = _widths(grid[:, :block])
    sel = _selectors(widths, block)
    at, live = np.zeros(rows, dtype=np.int64), np.arange(rows)
    row_of, place, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    while len(live):
        here = at[live]
        k = sel[live, here]
        row_of.append(live)
        place.append(here)
        kind.append(k)
        here = here + COUNTS[k]
        at[live] = here
        live = live[here < lengths[live]]
    row_of, place, kind = map(np.concatenate, (row_of, place, kind))
    order = np.argsort(row_of, kind="stable")  # steps are in order within a row already
    row_of, place, kind = row_of[order], place[order], kind[order]
    words = kind.astype(np.uint64) << np.uint64(60)
    flat = grid.ravel()
    for k in np.unique(kind):
        if BITS[k]:
            i = np.flatnonzero(kind == k)
            base, start = row_of[i] * (block + 1), place[i]
            packed = flat[base + start].astype(np.uint64)
            for j in range(1, int(COUNTS[k])):
                packed |= flat[base + np.minimum(start + j, block)].astype(np.uint64) << np.uint64(j * BITS[k])
            words[i] |= packed
    offsets, jumps = np.zeros(rows + 1, dtype="<u8"), np.zeros(rows + 1, dtype="<u8")
    offsets[1:] = np.cumsum(np.bincount(row_of, minlength=rows))
    jumps[1:] = np.cumsum(per_block)
    return b"".join([_HEAD.pack(MAGIC, block, n, rows), offsets.tobytes(), jumps.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def _parts(payload: bytes):
    magic, block, n, rows = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b payload")
    at = _HEAD.size
    offsets = np.frombuffer(payload, "<u8", rows + 1, at).astype(np.int64)
    jumps = np.frombuffer(payload, "<u8", rows + 1, at + 8 * (rows + 1)).astype(np.int64)
    at += 16 * (rows + 1)
    words = np.frombuffer(payload, "<u8", int(offsets[-1]), at)
    return block, n, rows, offsets, jumps, words, np.frombuffer(payload, "<u8", int(jumps[-1]), at + 8 * len(words))


def decode(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (not included; all by default), read without touching other blocks."""
    block, n, rows, offsets, jumps, words, escapes = _parts(payload)
    last = rows if last is None else min(last, rows)
    if first >= last:
        return np.zeros(0, np.uint64)
    lo, hi = int(offsets[first]), int(offsets[last])
    words, per_row = words[lo:hi], np.diff(offsets[first : last + 1])
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[kind]
    row_of = np.repeat(np.arange(last - first), per_row)
    before = np.cumsum(count) - count
    place = before - before[offsets[first:last] - lo][row_of]
    stride = block + int(count.max())
    out = np.zeros((last - first) * stride, dtype=np.uint64)
    base = row_of * stride + place
    for k in np.unique(kind):
        if BITS[k]:
            i = np.flatnonzero(kind == k)
            here, word, mask = base[i], words[i], np.uint64((1 << int(BITS[k])) - 1)
            for j in range(int(COUNTS[k])):
                out[here + j] = (word >> np.uint64(j * BITS[k])) & mask
    flat = out.reshape(last - first, stride)[:, :block].ravel()[: n - first * block]
    if len(escapes):
        flat[flat == ESCAPE] = escapes[jumps[first] : jumps[last]]
    return flat
