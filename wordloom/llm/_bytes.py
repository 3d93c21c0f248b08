"""Vectorised words, numbers of words and hashes of byte windows over Arrow text columns.

Hashes only deal and propose; whatever is decided is decided on bytes, on numbers
that stand for bytes, or on cryptographic digests.

Everything here works on whole texts, in slices of a few megabytes, so memory
does not depend on the number of documents.  A single text larger than the
slice size forms a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: 64-bit odd multipliers of the splitmix64 finaliser (fixed values).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd base of the rolling polynomial and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


#: A random-looking 64-bit value for each byte.
BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
#: The same with A-Z mapped onto a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1), base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.cumprod(table, dtype=np.uint64)
        if n > 4 * SLICE_BYTES:
            del _powers[base]
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls count as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) for runs of rows of at most ``limit`` bytes."""
    offsets, data = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes other than 0x20 and 0x09-0x0D."""
    solid = ~IS_SPACE[data]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    starts_at = offsets[:-1][offsets[:-1] < len(data)]
    if len(solid):
        before[0] = False
    before[starts_at] = False
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    if len(solid):
        after[-1] = False
    after[ends_at] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ``data`` of these lengths as an Arrow binary column."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each value, distinct values); equal numbers mean equal values, byte by byte."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> pa.Array:
    """The words between the bounds (as :func:`word_bounds` or cuts of them give), one entry each."""
    solid = data[~IS_SPACE[data]]
    return binary_array(LOWER[solid] if lower else solid, ends - starts)


def window_codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` ids (all 0 or more); equal numbers mean equal runs.

    Runs are joined two by two and numbered anew, so no hash decides.
    """
    codes, have = ids, 1
    while have < width and len(codes):
        step = min(have, width - have)
        top = int(codes.max()) + 1
        codes = codes[: max(len(codes) - step, 0)] * top + codes[step:]
        codes, have = numbered(pa.array(codes))[0], have + step
    return codes


def digests(words: pa.Array) -> np.ndarray:
    """128 bits of BLAKE2b of each word, as two columns of 64 bits."""
    found = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in words.to_pylist()])
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash for each ``length``-byte string of data (mixed, so usable as an order)."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * powers(BASE_INVERSE, n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each run of ``width`` consecutive values."""
    n, have, out = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n]) if have < width else out


def piece_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``data`` between neighbouring offsets; it only chooses places in a table."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=sums[1:])
    starts, ends = offsets[:-1], offsets[1:]
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


class ByteTable:
    """Numbers of byte strings, in the order in which they are added: an open hash table of arrays.

    Hashes choose slots; a string has a number only if all its bytes agree.
    """

    def __init__(self, most: int):
        self.slots = np.full(1 << max(int(2 * most - 1).bit_length(), 4), -1, np.int32)
        self.hashes, self.n = np.zeros(most, np.uint64), 0
        self.offsets, self.data = np.zeros(most + 1, np.int64), np.zeros(1 << 16, np.uint8)

    def _same(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether the strings at ``starts`` equal the ``known`` ones, which have their lengths."""
        ends = np.cumsum(lengths)
        step = np.arange(int(ends[-1]) if len(ends) else 0)
        own = step + np.repeat(starts - (ends - lengths), lengths)
        other = step + np.repeat(self.offsets[known] - (ends - lengths), lengths)
        wrong = np.concatenate([[0], np.cumsum(data[own] != self.data[other])])
        return wrong[ends] == wrong[ends - lengths]

    def find(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each string, or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        slot, mask = hashes.astype(np.int64) & (len(self.slots) - 1), len(self.slots) - 1
        starts, lengths = offsets[:-1], np.diff(offsets)
        while len(left):
            number = self.slots[slot].astype(np.int64)
            left, slot, number = left[number >= 0], slot[number >= 0], number[number >= 0]
            like = (self.hashes[number] == hashes[left]) & (self.offsets[number + 1] - self.offsets[number] == lengths[left])
            hit = np.flatnonzero(like)
            like[hit] = self._same(data, starts[left[hit]], lengths[left[hit]], number[hit])
            out[left[like]] = number[like]
            left, slot = left[~like], (slot[~like] + 1) & mask
        return out

    def add(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of strings that are not there yet, all different."""
        first, size = self.n, int(offsets[-1] - offsets[0])
        used = int(self.offsets[first])
        while used + size > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[used : used + size] = data[offsets[0] : offsets[-1]]
        self.n = first + len(hashes)
        self.offsets[first + 1 : self.n + 1] = used + offsets[1:] - offsets[0]
        self.hashes[first : self.n] = hashes
        left, slot, mask = np.arange(first, self.n), hashes.astype(np.int64) & (len(self.slots) - 1), len(self.slots) - 1
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & mask
        return np.arange(first, self.n)
