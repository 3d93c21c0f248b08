"""FLAC files made by hand, bit by bit, decoded bit for bit."""

import hashlib

import numpy as np
import pytest

from wordloom.plans import cli
from wordloom.sources import features, flac


def number(x, n):
    return format(x & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(values, k):
    out = []
    for v in values:
        z = int(2 * v if v >= 0 else -2 * v - 1)
        out.append("0" * (z >> k) + "1" + number(z, k))
    return "".join(out)


def residual(values, size, order, partitions, escape=False, wide=False):
    width = 5 if wide else 4
    out, at = number(int(wide), 2) + number(partitions, 4), 0
    for p in range(1 << partitions):
        part = values[at : at + (size >> partitions) - (order if p == 0 else 0)]
        at += len(part)
        if escape and p % 2 == 0:
            n = max([int(abs(v)).bit_length() + 1 for v in part] or [0])
            out += "1" * width + number(n, 5) + "".join(number(int(v), n) for v in part)
        else:
            k = max(int(np.abs(part).mean()).bit_length(), 0) if len(part) else 0
            out += number(k, width) + rice(part, k)
    return out


def subframe(x, depth, kind, wasted=0, **how):
    head = lambda code: "0" + number(code, 6) + ("1" + "0" * (wasted - 1) + "1" if wasted else "0")
    x, depth = x >> wasted, depth - wasted
    if kind == "constant":
        return head(0) + number(int(x[0]), depth)
    if kind == "verbatim":
        return head(1) + "".join(number(int(v), depth) for v in x)
    if kind.startswith("fixed"):
        order = int(kind[5:])
        return head(8 + order) + "".join(number(int(v), depth) for v in x[:order]) + residual(np.diff(x, order), len(x), order, **how)
    weights, shift = [[7, -3], [60, -20, 5], [120, -40, 9, -3, 2, 1, -1, 1]][int(kind[3:])], 6
    order = len(weights)
    errors = [int(x[i]) - (sum(w * int(x[i - 1 - j]) for j, w in enumerate(weights)) >> shift) for i in range(order, len(x))]
    coded = number(9 - 1, 4) + number(shift, 5) + "".join(number(w, 9) for w in weights)
    return head(31 + order) + "".join(number(int(v), depth) for v in x[:order]) + coded + residual(np.array(errors), len(x), order, **how)


def packed(bits):
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def file(blocks, depth, rate, layout, kinds, md5=True, **how):
    """``blocks``: lists of left and right (or one channel) as integers."""
    channels = len(blocks[0])
    everything = np.stack([np.concatenate([b[c] for b in blocks]) for c in range(channels)], axis=1)
    raw = everything.astype("<i8").view(np.uint8).reshape(*everything.shape, 8)[:, :, : -(-depth // 8)].tobytes()
    info = bytes(4) + bytes(6) + packed(number(rate, 20) + number(channels - 1, 3) + number(depth - 1, 5) + number(len(everything), 36)) + (hashlib.md5(raw).digest() if md5 else bytes(16))
    out = b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x81]) + (3).to_bytes(3, "big") + b"pad"
    for k, block in enumerate(blocks):
        n = len(block[0])
        coded = bytes([k]) if k < 128 else chr(k).encode()
        head = b"\xff\xf8" + packed(number(7, 4) + number(0, 4) + number(layout, 4) + number(0, 3) + "0") + coded + (n - 1).to_bytes(2, "big")
        head += bytes([flac.crc(head, 0x07, 8)])
        a, b = block[0], block[-1]
        parts = {8: [(a, depth), (a - b, depth + 1)], 9: [(a - b, depth + 1), (b, depth)], 10: [((a + b) >> 1, depth), (a - b, depth + 1)]}.get(layout, [(c, depth) for c in block])
        body = head + packed("".join(subframe(x, d, kinds[(k + i) % len(kinds)], **how) for i, (x, d) in enumerate(parts)))
        out += body + flac.crc(body, 0x8005, 16).to_bytes(2, "big")
    return out, everything


def tone(n, depth, seed=0):
    rng = np.random.default_rng(seed)
    return (np.sin(np.arange(n) / 9 + seed) * 2 ** (depth - 3) + rng.integers(-20, 20, n)).astype(np.int64)


@pytest.mark.parametrize("kind", ["verbatim", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "lpc0", "lpc1", "lpc2"])
@pytest.mark.parametrize("how", [{"partitions": 0}, {"partitions": 3}, {"partitions": 2, "escape": True}, {"partitions": 1, "wide": True}])
def test_subframes(kind, how):
    data, want = file([[tone(256, 16, k)] for k in range(3)], 16, 16000, 0, [kind], **({} if kind == "verbatim" else how))
    got, depth, rate = flac.decode_flac(data)
    assert (depth, rate) == (16, 16000) and got.dtype == np.int64 and (got == want).all()


@pytest.mark.parametrize("layout", [1, 8, 9, 10])
@pytest.mark.parametrize("depth", [8, 16, 24])
def test_channels_and_depths(layout, depth):
    blocks = [[tone(192 + 7 * k, depth, k), tone(192 + 7 * k, depth, k + 50)] for k in range(4)]
    data, want = file(blocks, depth, 44100, layout, ["fixed2", "lpc1"], partitions=0, wide=depth > 16)
    got, found, rate = flac.decode_flac(b"ID3\x04\0\0\0\0\0\x05-----" + data)
    assert (found, rate) == (depth, 44100) and (got == want).all()
    samples, _ = flac.read_flac(data)
    assert np.abs(samples - want.mean(axis=1) / 2 ** (depth - 1)).max() < 1e-6


def test_constant_wasted_bits_and_many_frames():
    data, want = file([[np.full(64, -5)], [np.full(32, 0)]], 16, 8000, 0, ["constant"])
    assert (flac.decode_flac(data)[0] == want).all()
    data, want = file([[tone(64, 12, 1) << 3]], 16, 8000, 0, ["fixed1"], wasted=3, partitions=1)
    assert (flac.decode_flac(data)[0] == want).all()
    data, want = file([[tone(16, 16, k)] for k in range(300)], 16, 8000, 0, ["fixed1"], partitions=0)
    assert len(want) == 4800 and (flac.decode_flac(data)[0] == want).all()
    data, want = file([[np.zeros(0, np.int64)]][:0] or [[tone(16, 16)]], 16, 8000, 0, ["verbatim"], md5=False)
    assert (flac.decode_flac(data)[0] == want).all()


def test_damage_is_noticed():
    data, _ = file([[tone(256, 16, k)] for k in range(3)], 16, 16000, 0, ["fixed2"], partitions=2)
    for at in (60, 200, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode_flac(bytes(broken))
    for bad in (b"", b"RIFF", data[:60], data[:-40]):
        with pytest.raises((ValueError, IndexError)):
            flac.decode_flac(bad)


def test_extract_reads_flac_by_default(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    for name in ("x", "y"):
        (tmp_path / f"audio/{name}.flac").write_bytes(file([[tone(4000, 16, k)] for k in range(4)], 16, 16000, 0, ["lpc1"], partitions=0)[0])
    args = ["extract", "english", str(tmp_path / "audio"), str(tmp_path / "o"), "wavlm-large", "2", "--encoder", "tests.encoders:layers", "--for_kmeans"]
    rows = {r.node: len(r.frames) for r in cli.run(spark, args).collect()}
    assert rows == {"x": 50, "y": 50}
    assert features.list_audio(spark, str(tmp_path / "audio"), "english").count() == 2
