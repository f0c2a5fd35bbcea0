"""FLAC: exact round trips, checksums, seeking and foreign stream shapes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixgraph.llm import flac


def padded(raw):
    return raw + b"\xff" * (-len(raw) % flac.BLOCK if raw else flac.BLOCK)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4), st.sampled_from([0, 2, 5, None]))
def test_round_trip(texts, order):
    payloads = [padded(t) for t in texts]
    streams = flac.encode_payloads(payloads, order)
    for payload, (info, frames, ok) in zip(payloads, flac.decode_streams(streams)):
        pcm = flac.pcm_bytes(frames, info["bits"])
        assert ok and hashlib.md5(pcm).digest() == info["md5"]
        assert (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes() == payload


def test_extremes_and_many_frames():
    r = random.Random(0)
    for raw in (b"\x00\xff" * 5000, b"\x00" * 2000, bytes(r.randrange(256) for _ in range(200_000)), b"\x80" * 575 + b"\x00"):
        (info, frames, ok), = flac.decode_streams(flac.encode_payloads([padded(raw)]))
        assert ok and (np.frombuffer(flac.pcm_bytes(frames, 8), np.uint8) ^ 0x80).tobytes() == padded(raw)


def test_checksums_and_seeking():
    raw = padded(bytes(random.Random(1).randrange(97, 122) for _ in range(5000)))
    stream, = flac.encode_payloads([raw])
    assert bytes(b ^ 0x80 for b in flac.seek(stream, 700, 1500)) == raw[700:2200]
    broken = bytearray(stream)
    broken[-100] ^= 4
    try:
        assert not flac.decode_streams([bytes(broken)])[0][2]
    except (ValueError, IndexError):
        pass
    with pytest.raises(ValueError):
        flac.decode_streams([b"RIFF" + stream[4:]])


def test_best_frames_blocks_and_seeking():
    """Frames choose between predictors and partitions; blocks have offsets and any of them can be sought."""
    wave = (100 * np.sin(np.arange(576 * 6) * 0.05) + 128).astype(np.uint8).tobytes()
    half = bytes(288) + bytes(random.Random(2).randrange(256) for _ in range(288))
    raw = wave + half + padded(b"some text, some more text. " * 40)
    stream, plain = flac.encode_payloads([raw])[0], flac.encode_payloads([raw], 0)[0]
    assert len(stream) < len(plain)
    info, offsets, first = flac.read_header(stream)
    kinds = [stream[first + o + 6] for o in offsets]  # the subframe's header follows a frame header of six bytes
    assert any(k & 0x40 for k in kinds) and any(not k & 0x40 for k in kinds)
    for size in (100, 576, 1000, 1 << 20):
        (_, ok, blocks), = flac.pcm_blocks([stream], size)
        blocks = list(blocks)
        assert ok and [b[0] for b in blocks] == list(range(0, len(raw), size)) and bytes(b ^ 0x80 for b in b"".join(b[2] for b in blocks)) == raw
    got = flac.seek_many([stream, plain, stream], [0, 1000, len(raw) - 40], 40)
    assert [bytes(b ^ 0x80 for b in g) for g in got] == [raw[:40], raw[1000:1040], raw[-40:]] and flac.seek_many([], [], 5) == []


def test_null_streams(spark):
    media = flac.encode_column(spark.createDataFrame([(1, "x"), (2, None)], "id long, text string"), "id", "text")
    rows = media.union(spark.createDataFrame([(3, None, None)], media.schema))
    out = {r["id"]: r for r in flac.features(rows, "id", "media", "n_bytes").collect()}
    assert out[3]["payload_bytes"] is None and out[1]["payload_bytes"] == 576 and out[2]["n_bytes"] == 0
    assert {r["id"] for r in flac.decode_blocks(rows, "id", "media").collect()} == {1, 2}


class Writer:
    """Writes bits one by one, for streams that the encoder doesn't make."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]
        return self

    def rice(self, value, k):
        u = value << 1 if value >= 0 else -2 * value - 1
        self.bits += [0] * (u >> k) + [1]
        return self.put(u & (1 << k) - 1, k)

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def crc(data, poly, bits):
    value = 0
    for byte in data:
        value ^= byte << bits - 8
        for _ in range(8):
            value = (value << 1 ^ poly if value >> bits - 1 else value << 1) & (1 << bits) - 1
    return value


def frame(body, channels, number=0, size=16):
    head = bytes([0xFF, 0xF8, 0x60, channels << 4 | 4 << 1, number, size - 1])
    head += bytes([crc(head, 0x07, 8)])
    data = head + body.bytes()
    return data + crc(data, 0x8005, 16).to_bytes(2, "big")


def stream(frames, channels, samples, size=16):
    info = size.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | channels - 1 << 41 | 15 << 36 | samples).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def test_foreign_streams_without_seek_tables():
    """16-bit stereo in mid-side, partitions, escapes, constant, verbatim and wasted bits, without a seek table."""
    r = random.Random(2)
    left = [r.randrange(-3000, 3000) for _ in range(16)]
    right = [x + r.randrange(-20, 20) for x in left]
    mid, side = [(a + b) >> 1 for a, b in zip(left, right)], [a - b for a, b in zip(left, right)]
    w = Writer().put(0x12, 8).put(mid[0] & 0xFFFF, 16).put(0, 2).put(1, 4)  # fixed order 1, two partitions
    residual = [b - a for a, b in zip(mid, mid[1:])]
    w.put(9, 4)
    for v in residual[:7]:
        w.rice(v, 9)
    w.put(15, 4).put(14, 5)  # an escaped partition
    for v in residual[7:]:
        w.put(v & (1 << 14) - 1, 14)
    w.put(0x02, 8)  # verbatim side of 17 bits
    for v in side:
        w.put(v & 0x1FFFF, 17)
    (info, frames, ok), = flac.decode_streams([stream([frame(w, 10)], 2, 16)])
    assert ok and frames[0].tolist() == [left, right]
    constant = Writer().put(0x01, 8).put(1, 2).put(5, 14)  # constant, two wasted bits
    (info, frames, ok), = flac.decode_streams([stream([frame(constant, 0), frame(Writer().put(0x00, 8).put(0xFFFF, 16), 0, 1)], 1, 32)])
    assert ok and [f.tolist() for f in frames] == [[[20] * 16], [[-1] * 16]]
    assert flac.pcm_bytes(frames, 16) == np.array([20] * 16 + [-1] * 16, "<i2").tobytes()


def test_columns(spark):
    rows = [(1, "héllo", 9), (2, None, 9), (3, "", 9), (4, "x" * 300_000, 9), (5, "héllo", 9), (None, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media long")
    media = flac.encode_column(df, "doc_id", "text")
    got = {r["doc_id"]: r for r in flac.features(media, "doc_id", "media", "n_bytes").collect()}
    for d, text, _ in rows:
        raw = (text or "").encode()
        assert got[d]["n_bytes"] == len(raw) and got[d]["payload_bytes"] == len(padded(raw))
        assert got[d]["payload_sha256"] == hashlib.sha256(padded(raw)).hexdigest()
        assert got[d]["tail_crc32"] == zlib.crc32(padded(raw)[-32:])
    assert got[1]["media_sha256"] == got[5]["media_sha256"] and got[1]["feature"] == got[5]["feature"]
    blocks = flac.decode_blocks(media, "doc_id", "media").filter("doc_id = 4").orderBy("block").collect()
    assert [b["sample_offset"] for b in blocks] == [i * 65536 for i in range(len(blocks))] and all(b["checksums_hold"] for b in blocks)
    assert b"".join(bytes(x ^ 0x80 for x in b["pcm"]) for b in blocks) == padded(b"x" * 300_000)
    assert flac.features(flac.encode_column(df.limit(0), "doc_id", "text"), "doc_id", "media", "n_bytes").collect() == []
