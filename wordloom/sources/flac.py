"""FLAC files to samples: fixed and linear prediction, Rice residuals, all channel layouts.

The format is RFC 9639.  Code words of a Rice partition are found by a chain over
the next one bits of the frame; their values, the fixed predictors and the joint
channels are worked out over all samples of a block at once.  Check sums of
frames, and the MD5 of all samples if the file has one, are verified.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: Bits of a sample by the code in a frame's head; 0 is the stream's (fixed values).
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Sample rates by the code in a frame's head (fixed values).
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}


@cache
def _crc_table(polynomial: int, width: int) -> list[int]:
    top, mask, table = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial if c & top else c << 1) & mask
        table.append(c)
    return table


def crc(data: bytes, polynomial: int, width: int) -> int:
    table, mask, c = _crc_table(polynomial, width), (1 << width) - 1, 0
    for byte in data:
        c = ((c << 8) & mask) ^ table[(c >> (width - 8)) ^ byte]
    return c


class Bits:
    """A window of bytes as bits, read from the front."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        n = len(self.bits)
        ones = np.where(self.bits == 1, np.arange(n), n)
        #: For each place, that of the next one bit.
        self.ones: list[int] = np.minimum.accumulate(ones[::-1])[::-1].tolist()

    def number(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("a FLAC frame ends too early")
        packed = np.packbits(self.bits[self.at : self.at + n]).tobytes()
        self.at += n
        return int.from_bytes(packed, "big") >> (-n % 8)

    def signed(self, n: int) -> int:
        x = self.number(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Zeros before the next one bit, which is read too."""
        if self.at >= len(self.bits) or self.ones[self.at] >= len(self.bits):
            raise ValueError("a FLAC frame ends too early")
        zeros = self.ones[self.at] - self.at
        self.at += zeros + 1
        return zeros

    def _at(self, places: np.ndarray, n: int) -> np.ndarray:
        """Numbers of ``n`` bits at each of the places."""
        if not n:
            return np.zeros(len(places), np.int64)
        if len(places) and int(places[-1]) + n > len(self.bits):
            raise ValueError("a FLAC frame ends too early")
        return self.bits[places[:, None] + np.arange(n)].astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))

    def plain(self, count: int, n: int) -> np.ndarray:
        """``count`` signed numbers of ``n`` bits."""
        x = self._at(self.at + n * np.arange(count, dtype=np.int64), n)
        self.at += n * count
        return np.where(x >> (n - 1) == 1, x - (1 << n), x) if n else x

    def rice(self, count: int, n: int) -> np.ndarray:
        """``count`` Rice numbers with ``n`` low bits."""
        ends, at, ones, size = [], self.at, self.ones, len(self.bits)
        for _ in range(count):
            if at >= size:
                raise ValueError("a FLAC frame ends too early")
            at = ones[at]
            ends.append(at)
            at += 1 + n
        end = np.array(ends, np.int64)
        high = end - np.concatenate([[self.at], end[:-1] + 1 + n])[:count]
        folded = (high << n) | self._at(end + 1, n)
        self.at = at
        return (folded >> 1) ^ -(folded & 1)


def _residual(bits: Bits, size: int, order: int) -> np.ndarray:
    method, partitions = bits.number(2), 1 << bits.number(4)
    if method > 1:
        raise ValueError("a FLAC residual of an unknown kind")
    width, out = 4 + method, []
    for k in range(partitions):
        count, n = size // partitions - (order if k == 0 else 0), bits.number(width)
        out.append(bits.plain(count, bits.number(5)) if n == (1 << width) - 1 else bits.rice(count, n))
    return np.concatenate(out)


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.number(1):
        raise ValueError("a FLAC subframe without its zero bit")
    kind = bits.number(6)
    wasted = bits.unary() + 1 if bits.number(1) else 0
    depth -= wasted
    if kind == 0:
        out = np.full(size, bits.signed(depth), np.int64)
    elif kind == 1:
        out = bits.plain(size, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        first = bits.plain(order, depth)
        out = np.concatenate([first, _residual(bits, size, order)])
        # the residual is the order-th difference: it is summed up as often, each time from a known start
        for k in range(order - 1, -1, -1):
            start = np.diff(first, k)[: order - k]
            out[k:] = np.concatenate([start[:1], start[0] + np.cumsum(out[k + 1 :])]) if k < order else out[k:]
    elif kind >= 32:
        out = _predicted(bits, size, depth, kind - 31)
    else:
        raise ValueError("a FLAC subframe of an unknown kind")
    return out << wasted


def _predicted(bits: Bits, size: int, depth: int, order: int) -> np.ndarray:
    samples = bits.plain(order, depth).tolist()
    width, shift = bits.number(4) + 1, bits.signed(5)
    if width == 16 or shift < 0:
        raise ValueError("a FLAC predictor of an unknown kind")
    weights = bits.plain(order, width).tolist()[::-1]  # the oldest sample first
    for k, r in enumerate(_residual(bits, size, order).tolist()):
        samples.append(r + (sum(map(int.__mul__, weights, samples[k:])) >> shift))
    return np.array(samples, np.int64)


def _frame(data: bytes, stream_depth: int, stream_rate: int) -> tuple[np.ndarray, int, int]:
    """(samples x channels, bits of a sample, bytes used) of the frame at the start of ``data``."""
    bits = Bits(data)
    if bits.number(15) != 0x7FFC:
        raise ValueError("no FLAC frame where one should start")
    bits.number(1)
    size_code, rate_code, layout, depth_code = bits.number(4), bits.number(4), bits.number(4), bits.number(3)
    bits.number(1)
    lead = bits.number(8)
    for _ in range(max(8 - (~lead & 0xFF).bit_length() - 1, 0)):  # further bytes of the coded number
        bits.number(8)
    size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else bits.number(8 if size_code == 6 else 16) + 1 if size_code < 8 else 256 << (size_code - 8)
    if rate_code in (12, 13, 14):
        bits.number(8 if rate_code == 12 else 16)
    head = bits.at // 8
    if crc(data[:head], 0x07, 8) != bits.number(8) or size_code == 0 or layout > 10:
        raise ValueError("a damaged head of a FLAC frame")
    depth = SAMPLE_BITS.get(depth_code, stream_depth)
    side = {8: 1, 9: 0, 10: 1}.get(layout, -1)
    channels = [_subframe(bits, size, depth + (c == side)) for c in range(layout + 1 if layout < 8 else 2)]
    a, b = channels[0], channels[-1]
    if layout == 8:
        channels = [a, a - b]
    elif layout == 9:
        channels = [a + b, b]
    elif layout == 10:
        whole = (a << 1) | (b & 1)
        channels = [(whole + b) >> 1, (whole - b) >> 1]
    used = -(-bits.at // 8)
    if crc(data[:used], 0x8005, 16) != int.from_bytes(data[used : used + 2], "big"):
        raise ValueError("a damaged FLAC frame")
    return np.stack(channels, axis=1), depth, used + 2


def decode_flac(content: bytes) -> tuple[np.ndarray, int, int]:
    """(samples x channels as integers, bits of a sample, rate)."""
    at = 0
    if content[:3] == b"ID3":
        at = 10 + sum((content[6 + k] & 0x7F) << (21 - 7 * k) for k in range(4))
    if content[at : at + 4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, info = at + 4, False, b""
    while not last:
        last, kind, size = content[at] >= 0x80, content[at] & 0x7F, int.from_bytes(content[at + 1 : at + 4], "big")
        info = content[at + 4 : at + 4 + size] if kind == 0 else info
        at += 4 + size
    if len(info) != 34:
        raise ValueError("a FLAC file without its stream's head")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = packed >> 44, ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
    largest = max(int.from_bytes(info[2:4], "big"), 4096) * channels * (depth + 8) // 8 + 4096
    blocks, count = [], 0
    while at < len(content) and (not total or count < total):
        block, _, used = _frame(content[at : at + largest], depth, rate)
        blocks.append(block)
        at, count = at + used, count + len(block)
    samples = np.concatenate(blocks) if blocks else np.zeros((0, channels), np.int64)
    width = -(-depth // 8)
    if any(info[18:]):
        raw = samples.astype("<i8").view(np.uint8).reshape(*samples.shape, 8)[:, :, :width].tobytes()
        if hashlib.md5(raw, usedforsecurity=False).digest() != info[18:]:
            raise ValueError("the samples of a FLAC file do not have its MD5")
    return samples, depth, rate


def read_flac(content: bytes) -> tuple[np.ndarray, int]:
    """(samples in -1..1, the mean of all channels; rate)."""
    samples, depth, rate = decode_flac(content)
    return (samples / 2.0 ** (depth - 1)).mean(axis=1).astype(np.float32), rate
