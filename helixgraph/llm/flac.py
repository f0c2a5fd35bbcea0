"""Media columns: a lossless FLAC codec for byte payloads, vectorised over frames.

``encode_column`` stores 8-bit samples as FLAC streams of 576-sample frames (fixed predictors or quantised linear
prediction, Rice residuals) with a seek point for each frame; ``decode_blocks`` reads any column of mono or stereo
streams of 4 to 24 bits back into PCM blocks with sample offsets. Frames are independent, so a batch decodes all its
frames in step: each numpy operation advances thousands of bit cursors by one residual. Memory is bounded by CHUNK.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_bytes

BLOCK = 576
#: Order of linear prediction; Rice partitions of a frame that is split, and their order in the format.
LPC_ORDER, PARTS, PART_ORDER = 4, 4, 2
#: Bytes of payload that are encoded or decoded at once.
CHUNK = 2 << 20
#: Fixed values of the format: coefficients of the fixed predictors by order.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
#: Fixed values of the format: sample sizes by their code.
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly) & mask if crc & top else (crc << 1) & mask
        out.append(crc)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.uint16)
    for j in range(int(length.max(initial=0))):
        crc = np.where(j < length, CRC8[crc ^ data[np.minimum(start + j, len(data) - 1)]], crc)
    return crc


def _crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte runs in step; runs are taken longest first, so that those still open are a prefix."""
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    crc = np.zeros(len(at), np.uint16)
    ends = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")
    for j, n in enumerate(ends):
        crc[:n] = (crc[:n] << 8) ^ CRC16[(crc[:n] >> 8) ^ data[at[:n] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's extended UTF-8: rows of up to 6 bytes, and their lengths."""
    out, size = np.zeros((len(n), 6), np.uint8), np.ones(len(n), np.int64)
    for k, least in ((2, 0x80), (3, 0x800), (4, 0x10000), (5, 0x200000), (6, 0x4000000)):
        size[n >= least] = k
    for k in range(1, 7):
        rows = size == k
        if k == 1:
            out[rows, 0] = n[rows]
            continue
        lead = (0xFF00 >> k) & 0xFF
        out[rows, 0] = lead | (n[rows] >> (6 * (k - 1)))
        for j in range(1, k):
            out[rows, j] = 0x80 | ((n[rows] >> (6 * (k - 1 - j))) & 0x3F)
    return out, size


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear prediction (12-bit coefficients, shift 8) by Levinson-Durbin, for all frames at once."""
    w = x * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(w[:, : x.shape[1] - k] * w[:, k:]).sum(1) for k in range(order + 1)], 1)
    a, err = np.zeros((len(x), order)), r[:, 0] + 1e-6
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] = a[:, :i] - k[:, None] * a[:, i - 1 :: -1][:, :i] if i else a[:, :i]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-6)
    return np.clip(np.rint(a * 256), -2048, 2047).astype(np.int64), np.full(len(x), 8)


def _rice(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rice parameters for sums of folded residuals."""
    mean = total / np.maximum(count, 1)
    return np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 14).astype(np.int32)


def encode_best(samples: np.ndarray, numbers: np.ndarray, lpc_order: int = LPC_ORDER) -> tuple[bytes, np.ndarray]:
    """Frames by linear prediction where that is shorter than the best fixed predictor."""
    fixed, linear = _predict(samples, 0), _predict(samples, lpc_order)
    better = -(-linear["bits"] // 8) < -(-fixed["bits"] // 8)
    length, out = np.zeros(len(samples), np.int64), [b""] * len(samples)
    for plan, rows, order in ((fixed, np.flatnonzero(~better), 0), (linear, np.flatnonzero(better), lpc_order)):
        if not len(rows):
            continue
        frames, lengths = _pack({name: values[rows] for name, values in plan.items()}, numbers[rows], order)
        length[rows] = lengths
        ends = np.cumsum(lengths).tolist()
        for row, start, end in zip(rows.tolist(), [0, *ends], ends):
            out[row] = frames[start:end]
    return b"".join(out), length


def encode_frames(samples: np.ndarray, numbers: np.ndarray, lpc_order: int = 0) -> tuple[bytes, np.ndarray]:
    """Encode rows of signed 8-bit samples as frames; returns their bytes, back to back, and the frames' lengths.

    numbers: each row's frame number in its stream. lpc_order 0 takes the best fixed predictor of order 0 to 2. Residuals
    are in one Rice partition or in PARTS of them, whichever is shorter for the frame.
    """
    return _pack(_predict(samples, lpc_order), numbers, lpc_order)


def _predict(samples: np.ndarray, lpc_order: int) -> dict[str, np.ndarray]:
    """What a frame's subframe is made of, an entry for each frame in each array; ``bits`` is its length."""
    x = samples.astype(np.int32)
    n, size = x.shape
    if lpc_order:
        coef, shift = _lpc(x, lpc_order)
        residual = np.zeros_like(x)
        for i in range(lpc_order, size):
            residual[:, i] = x[:, i] - ((coef * x[:, i - lpc_order : i][:, ::-1]).sum(1) >> shift)
        best = np.full(n, lpc_order)
    else:
        tries, r = [x], x
        for p in (1, 2):
            d = np.zeros_like(x)
            d[:, p:] = r[:, p:] - r[:, p - 1 : -1]
            tries.append(d)
            r = d
        best = np.argmin(np.stack([np.abs(t).sum(1) for t in tries]), 0)
        residual = np.choose(best[:, None], tries)
    raw = np.arange(size)[None, :] < best[:, None]
    u = np.where(raw, 0, (residual << 1) ^ (residual >> 31)).astype(np.int32)
    one_k = _rice(u.sum(1), size - best)
    step = size // PARTS
    many_k = np.stack([_rice(u[:, j : j + step].sum(1), step - (best if not j else 0)) for j in range(0, size, step)], 1)
    each = np.repeat(many_k, step, 1)
    shorter = np.where(raw, 0, (u >> each) + each).sum(1) + 4 * (PARTS - 1) < np.where(raw, 0, (u >> one_k[:, None]) + one_k[:, None]).sum(1)
    k = np.where(shorter[:, None], each, one_k[:, None])
    bits = np.where(raw, np.int32(8), (u >> k) + (1 + k))
    extra = 4 + 5 + 12 * lpc_order if lpc_order else 0  # precision, shift and coefficients
    body = 8 + bits.sum(1) + 10 + extra + np.where(shorter, 4 * (PARTS - 1), 0)
    plan = {"x": x, "u": u, "k": k, "codes": bits, "best": best, "shorter": shorter, "one_k": one_k, "many_k": many_k, "bits": body}
    return plan | ({"coef": coef, "shift": shift} if lpc_order else {})


def _pack(plan: dict[str, np.ndarray], numbers: np.ndarray, lpc_order: int) -> tuple[bytes, np.ndarray]:
    """The frames that the plan describes, with their checksums."""
    x, u, k, bits, best, shorter, one_k, many_k, body = (plan[c] for c in ("x", "u", "k", "codes", "best", "shorter", "one_k", "many_k", "bits"))
    coef, shift = plan.get("coef"), plan.get("shift")
    n, size = x.shape
    step = size // PARTS
    raw = np.arange(size)[None, :] < best[:, None]
    one = np.int32(1) << k
    value = np.where(raw, x & 0xFF, one | (u & (one - 1)))
    width = np.where(raw, np.int32(8), k + 1)
    # each partition after the first has its parameter before its codes
    later = np.where(shorter[:, None], 4 * (np.arange(size) // step)[None, :], 0)
    gap = 10 + (4 + 5 + 12 * best if lpc_order else np.zeros(n, np.int64))
    before = np.cumsum(bits, 1) + np.where(raw, 0, gap[:, None] + later)  # end of each sample's code, after the subframe's header
    number, number_size = _utf8_number(numbers)
    head = 4 + number_size + 1
    length = head + (body + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    zero = (start + head) * 8
    # Every code is at most 32 bits wide: it adds to two 32-bit words, and sums of disjoint bits are their union.
    kind = (0x40 | (lpc_order - 1) << 1) if lpc_order else 0x10
    head_value = np.full(n, kind) if lpc_order else kind | (best << 1)
    rice_end = zero + 8 + 8 * best + gap
    ends = [(zero[:, None] + 8 + before).ravel(), zero + 8, rice_end]
    first_k = np.where(shorter, many_k[:, 0], one_k)
    values, widths = [value.ravel(), head_value, np.where(shorter, PART_ORDER << 4, 0) | first_k], [width.ravel(), np.full(n, 8), np.full(n, 10)]
    split = np.flatnonzero(shorter)
    for j in range(1, PARTS):
        ends.append(zero[split] + 8 + before[split, j * step - 1] + 4)
        values.append(many_k[split, j])
        widths.append(np.full(len(split), 4))
    if lpc_order:
        at = zero + 8 + 8 * best
        ends += [at + 9]
        values += [(np.full(n, 11) << 5) | shift]
        widths += [np.full(n, 9)]
        for j in range(lpc_order):
            ends += [at + 9 + 12 * (j + 1)]
            values += [coef[:, j] & 0xFFF]
            widths += [np.full(n, 12)]
    end, value, width = (np.concatenate(v).astype(np.int64) for v in (ends, values, widths))
    at = end - width
    word, value = at >> 5, value.astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
    total = int(length.sum())
    words = total // 4 + 3
    packed = np.bincount(word, (value >> np.uint64(32)).astype(float), words) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(float), words)
    out = packed.astype(np.uint32).astype(">u4").view(np.uint8)[:total].copy()
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, 0x20, 0x02
    for j in range(6):
        rows = number_size > j
        out[start[rows] + 4 + j] = number[rows, j]
    out[start + head - 1] = _crc8(out, start, head - 1)
    crc = _crc16(out, start, length - 2)
    out[start + length - 2], out[start + length - 1] = crc >> 8, crc & 0xFF
    return out.tobytes(), length


def _stream(frames: bytes, lengths: np.ndarray, md5: bytes) -> bytes:
    """A stream: marker, STREAMINFO, SEEKTABLE with a point for each frame, frames. One channel at 8000 Hz, 8 bits."""
    total = len(lengths) * BLOCK
    info = BLOCK.to_bytes(2, "big") * 2 + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += (8000 << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + md5
    points = np.zeros(len(lengths), [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    points["sample"] = np.arange(len(lengths)) * BLOCK
    points["offset"] = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    points["size"] = BLOCK
    table = points.tobytes()
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + frames


def encode_payloads(payloads: list[bytes], lpc_order: int | None = None) -> list[bytes]:
    """A stream for each payload, whose length is a positive multiple of BLOCK; byte b is sample b - 128. Each frame takes
    the shorter of fixed and linear prediction, or one of them for all (order 0: fixed)."""
    counts = [len(p) // BLOCK for p in payloads]
    raw = np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80  # unsigned to two's complement
    numbers = np.concatenate([np.arange(c) for c in counts])
    rows = raw.view(np.int8).reshape(-1, BLOCK)
    blocks, lengths = [], []
    for i in range(0, len(rows), CHUNK // BLOCK):
        part = rows[i : i + CHUNK // BLOCK], numbers[i : i + CHUNK // BLOCK]
        b, n = encode_best(*part) if lpc_order is None else encode_frames(*part, lpc_order)
        blocks.append(b)
        lengths.append(n)
    frames, lengths = b"".join(blocks), np.concatenate(lengths)
    out, row, at = [], 0, 0
    for c in counts:
        n = lengths[row : row + c]
        size = int(n.sum())
        out.append(_stream(frames[at : at + size], n, hashlib.md5(raw[row * BLOCK : (row + c) * BLOCK].tobytes()).digest()))
        row, at = row + c, at + size
    return out


class Bits:
    """Bit cursors over one byte buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        b = padded.astype(np.uint64)
        m = len(padded) - 8
        self.window = np.zeros(m, np.uint64)  # the 8 bytes that begin at each byte
        for j in range(8):
            self.window |= b[j : j + m] << np.uint64(56 - 8 * j)
    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zero bits from each cursor to the next one bit."""
        w = (self.window[at >> 3] << (at & 7).astype(np.uint64)) >> np.uint64(11)
        out = 53 - np.frexp(w.astype(np.float64))[1].astype(np.int64)
        rows = np.flatnonzero(w == 0)
        while len(rows):  # runs beyond the window
            v = (self.window[(at[rows] + out[rows]) >> 3] << ((at[rows] + out[rows]) & 7).astype(np.uint64)) >> np.uint64(11)
            out[rows] += 53 - np.frexp(v.astype(np.float64))[1]
            rows = rows[(v == 0) & (at[rows] + out[rows] < 8 * len(self.window))]
        return out

    def read(self, at: np.ndarray, n) -> np.ndarray:
        """n bits (at most 32 a cursor) as unsigned numbers."""
        n = np.asarray(n, np.uint64)
        w = self.window[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(n == 0, 0, (w >> ((np.uint64(64) - n) & np.uint64(63)))).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        v = self.read(at, n)
        return np.where(v >> (np.asarray(n) - 1) & 1, v - (np.int64(1) << np.asarray(n, np.int64)), v)


def _residuals(bits: Bits, at: np.ndarray, order: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitioned Rice residuals of subframes of one order and size; lanes are grouped by partition order."""
    out = np.zeros((len(at), size), np.int64)
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    end = at + 6
    for m, po in sorted(set(zip(method.tolist(), parts.tolist()))):
        rows = np.flatnonzero((method == m) & (parts == po))
        cur, width = end[rows], 4 + m
        step = size >> po
        for part in range(1 << po):
            k = bits.read(cur, width)
            cur = cur + width
            escape = k == (1 << width) - 1
            raw = np.where(escape, bits.read(cur, 5), 0)
            cur = np.where(escape, cur + 5, cur)
            some = bool(escape.any())
            ku = k.astype(np.uint64)
            shift = (np.uint64(64) - ku) & np.uint64(63)
            shift = np.where(k == 0, np.uint64(63), shift)
            mask = np.where(k == 0, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF))
            for i in range(max(part * step, order), (part + 1) * step):
                q = bits.zeros(cur)
                tail = cur + q + 1
                low = ((bits.window[tail >> 3] << (tail & 7).astype(np.uint64)) >> shift) & mask
                u = (q << k) | low.view(np.int64)
                v = (u >> 1) ^ -(u & 1)
                after = tail + k
                if some:
                    v = np.where(escape, np.where(raw > 0, bits.signed(cur, np.maximum(raw, 1)), 0), v)
                    after = np.where(escape, cur + raw, after)
                out[rows, i] = v
                cur = after
        end[rows] = cur
    return out, end


def _subframes(bits: Bits, at: np.ndarray, size: int, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One channel of frames of one block size: samples, and the cursors after them."""
    kind = bits.read(at + 1, 6)
    wasted = bits.read(at + 7, 1)
    cur = at + 8
    rows = np.flatnonzero(wasted)
    if len(rows):
        run = bits.zeros(cur[rows]) + 1
        wasted[rows] = run
        cur[rows] += run
    depth = depth - wasted
    out = np.zeros((len(at), size), np.int64)
    for t in np.unique(kind):
        rows = np.flatnonzero(kind == t)
        c, d = cur[rows], depth[rows]
        if t == 0:
            out[rows] = bits.signed(c, d)[:, None]
            c = c + d
        elif t == 1:
            for i in range(size):
                out[rows, i] = bits.signed(c, d)
                c = c + d
        elif 8 <= t <= 12 or t >= 32:
            order = int(t - 8) if t < 32 else int(t - 31)
            warm = np.zeros((len(rows), order), np.int64)
            for i in range(order):
                warm[:, i] = bits.signed(c, d)
                c = c + d
            if t < 32:
                coef, shift = np.tile(np.array(FIXED[order], np.int64), (len(rows), 1)), np.zeros(len(rows), np.int64)
            else:
                precision, shift = bits.read(c, 4) + 1, bits.read(c + 4, 5)
                c = c + 9
                coef = np.zeros((len(rows), order), np.int64)
                for j in range(order):
                    coef[:, j] = bits.signed(c, precision)
                    c = c + precision
            r, c = _residuals(bits, c, order, size)
            r[:, :order] = warm
            if t < 32 and order <= 2:
                for p in range(order, 0, -1):  # undo the differences from the inside out
                    lead = np.diff(warm, p - 1, axis=1)[:, 0]
                    r[:, p - 1] = lead
                    r[:, p - 1 :] = np.cumsum(r[:, p - 1 :], 1)
            else:
                back = coef[:, ::-1]
                for i in range(order, size):
                    r[:, i] += (back * r[:, i - order : i]).sum(1) >> shift
            out[rows] = r
        else:
            raise ValueError("reserved subframe type")
        cur[rows] = c
    return out << wasted[:, None], cur


def decode_frames(data: np.ndarray, start: np.ndarray, info_bits: int = 8) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Decode frames that begin at the offsets given.

    Returns each frame's samples (channels by samples), its end, and whether both of its checksums hold.
    """
    b2, b3 = data[start + 2].astype(np.int64), data[start + 3].astype(np.int64)
    if ((data[start] != 0xFF) | ((data[start + 1] & 0xFE) != 0xF8)).any():
        raise ValueError("no frame begins here")
    lead = data[start + 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code, rate = b2 >> 4, b2 & 15
    more = np.select([code == 6, code == 7], [1, 2], 0)
    rest = np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    extra = start + 4 + number
    size = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.maximum(code - 2, 0), data[extra].astype(np.int64) + 1, data[extra].astype(np.int64) * 256 + data[np.minimum(extra + 1, len(data) - 1)] + 1, 256 << np.maximum(code - 8, 0)], 0)
    head = 4 + number + more + rest
    good = _crc8(data, start, head) == data[start + head]
    assignment = b3 >> 4
    channels = np.where(assignment < 8, assignment + 1, 2)
    sample_code = (b3 >> 1) & 7
    depth = np.array([SAMPLE_BITS.get(int(c), info_bits) for c in sample_code], np.int64) if (sample_code != 1).any() else np.full(len(start), 8, np.int64)
    bits = Bits(data)
    out: list = [None] * len(start)
    end = np.zeros(len(start), np.int64)
    for s, ch, a in sorted(set(zip(size.tolist(), channels.tolist(), assignment.tolist()))):
        rows = np.flatnonzero((size == s) & (assignment == a))
        cur, got = (start[rows] + head[rows] + 1) * 8, []
        for c in range(ch):
            side = a in (8, 10) and c == 1 or a == 9 and c == 0
            v, cur = _subframes(bits, cur, s, depth[rows] + side)
            got.append(v)
        if a == 8:
            got[1] = got[0] - got[1]
        elif a == 9:
            got[0] = got[0] + got[1]
        elif a == 10:
            mid = (got[0] << 1) | (got[1] & 1)
            got = [(mid + got[1]) >> 1, (mid - got[1]) >> 1]
        stacked = np.stack(got, 1)
        for i, r in enumerate(rows):
            out[r] = stacked[i]
        end[rows] = (cur + 7) // 8
    crc = _crc16(data, start, end - start)
    good &= crc == (data[end].astype(np.uint16) << 8 | data[end + 1])
    return out, end + 2, good


def read_header(media: bytes) -> tuple[dict, np.ndarray, int]:
    """Stream information, frame offsets from the seek table (relative to the first frame), and where frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, offsets = 4, False, {}, np.zeros(0, np.int64)
    while not last:
        last, kind, n = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            info = {"rate": v >> 44, "channels": (v >> 41 & 7) + 1, "bits": (v >> 36 & 31) + 1, "samples": v & (1 << 36) - 1, "md5": body[18:34], "block": int.from_bytes(body[2:4], "big")}
        elif kind == 3:
            points = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
            offsets = points["offset"][points["sample"] != 0xFFFFFFFFFFFFFFFF].astype(np.int64)
        at += 4 + n
    return info, offsets, at


def decode_streams(streams: list[bytes]) -> list[tuple[dict, list[np.ndarray], bool]]:
    """Every stream's information, frames and whether its checksums hold. Streams with a seek point for each frame
    decode all frames in step; others frame by frame."""
    whole, spans, out = np.frombuffer(b"".join(streams), np.uint8), [], []
    at = 0
    for s in streams:
        info, offsets, first = read_header(s)
        full = info["samples"] and len(offsets) * info["block"] >= info["samples"]
        spans.append((info, offsets + at + first if full else None, at + first, at + len(s)))
        at += len(s)
    fast = [x[1] for x in spans if x[1] is not None]
    frames, _, good = decode_frames(whole, np.concatenate(fast)) if fast and sum(map(len, fast)) else ([], None, [])
    used = 0
    for info, offsets, first, end in spans:
        if offsets is not None:
            n = len(offsets)
            out.append((info, frames[used : used + n], bool(np.all(good[used : used + n]))))
            used += n
            continue
        mine, ok, data = [], True, whole[first:end]
        pos = 0
        while pos < len(data):
            f, stop, g = decode_frames(data[pos:], np.array([0]), info["bits"])
            mine, ok, pos = mine + f, ok and bool(g[0]), pos + int(stop[0])
        out.append((info, mine, ok))
    return out


def pcm_bytes(frames: list[np.ndarray], bits: int) -> bytes:
    """Interleaved little-endian signed samples."""
    if not frames:
        return b""
    x = np.concatenate(frames, axis=1).T
    if bits <= 8:
        return x.astype(np.int8).tobytes()
    if bits <= 16:
        return x.astype("<i2").tobytes()
    return x.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def pcm_blocks(streams: list[bytes], block_samples: int = 65536) -> Iterator[tuple[dict, bool, Iterator[tuple[int, int, bytes]]]]:
    """Every stream's information, whether its checksums hold, and its PCM blocks: sample offset, samples, bytes."""
    for info, frames, ok in decode_streams(streams):
        width, pending, ready, offset = info["channels"] * ((info["bits"] + 7) // 8), [], 0, 0
        blocks = []
        for frame in frames:
            pending.append(frame)
            ready += frame.shape[-1]
            if ready >= block_samples:
                pcm = pcm_bytes(pending, info["bits"])
                while len(pcm) >= width * block_samples:
                    blocks.append((offset, block_samples, pcm[: width * block_samples]))
                    pcm, offset = pcm[width * block_samples :], offset + block_samples
                rest = len(pcm) // width
                pending, ready = ([np.concatenate(pending, axis=1)[:, -rest:]] if rest else []), rest
        if ready:
            pcm = pcm_bytes(pending, info["bits"])
            blocks.append((offset, ready, pcm))
        yield info, ok, iter(blocks)


def encode_column(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A FLAC stream for each text: (id, n_bytes, media).

    Null and empty texts give one frame of padding (bytes 255). Columns beside these are not read, so clashing names
    do no harm; repeated rows give repeated streams; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_text", CHUNK):
                texts = text_bytes(batch.column("_text"))
                sizes = pc.binary_length(texts)
                payloads = [t + b"\xff" * (-len(t) % BLOCK if t else BLOCK) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), sizes.cast(pa.int64()), pa.array(encode_payloads(payloads), pa.binary())], ["_id", "n_bytes", "media"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_column)


def decode_blocks(df: DataFrame, id_column: str, media_column: str, block_samples: int = 65536) -> DataFrame:
    """PCM blocks of every stream: (id, block, sample_offset, n_samples, pcm, checksums_hold).

    A null stream gives no block. A stream whose header is broken fails the task; one with a wrong checksum is returned
    with checksums_hold false, so that the caller can set it aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_media", CHUNK):
                kept = [(i, m) for i, m in zip(batch.column("_id").to_pylist(), batch.column("_media").to_pylist()) if m is not None]
                rows = []
                for (key, _), (_, ok, blocks) in zip(kept, pcm_blocks([m for _, m in kept], block_samples)):
                    rows += [(key, number, *block, ok) for number, block in enumerate(blocks)]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [batch.schema.field("_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()])], ["_id", "block", "sample_offset", "n_samples", "pcm", "checksums_hold"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(media_column).alias("_media"))
    return rows.mapInArrow(run, f"_id {kind}, block int, sample_offset long, n_samples long, pcm binary, checksums_hold boolean").withColumnRenamed("_id", id_column)


def seek_many(streams: list[bytes], sample: list[int], count: int) -> list[bytes]:
    """Samples [sample, sample + count) of each stream, decoding only the frames that hold them, all in step."""
    starts, spans, at = [], [], 0
    for media, s in zip(streams, sample):
        info, offsets, first = read_header(media)
        lo, hi = s // info["block"], -(-(s + count) // info["block"])
        starts.append(offsets[lo:hi] + at + first)
        spans.append((info, len(starts[-1]), s - lo * info["block"]))
        at += len(media)
    if not streams:
        return []
    frames, _, good = decode_frames(np.frombuffer(b"".join(streams), np.uint8), np.concatenate(starts), spans[0][0]["bits"])
    if not good.all():
        raise ValueError("a frame's checksum is wrong")
    out, used = [], 0
    for info, n, cut in spans:
        width = info["channels"] * ((info["bits"] + 7) // 8)
        out.append(pcm_bytes(frames[used : used + n], info["bits"])[cut * width : (cut + count) * width])
        used += n
    return out


def seek(media: bytes, sample: int, count: int) -> bytes:
    """Samples [sample, sample + count) of a stream, reading only the frames that hold them."""
    return seek_many([media], [sample], count)[0]


def features(df: DataFrame, id_column: str, media_column: str, n_bytes: str) -> DataFrame:
    """Read each stream's PCM blocks in the order of their offsets and describe its payload: lengths, digests, the checksum
    of the last 32 payload bytes, which are sought by their sample offset, and a feature string (sum, sum of squares, zero
    crossings and a 16-bin level histogram of the samples).

    A stream whose frame checksums or MD5 don't hold fails the task. A null stream has nulls.
    """

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = batch.column("_media").to_pylist()
        known = [m for m in media if m is not None]
        tails = iter(seek_many(known, [read_header(m)[0]["samples"] - 32 for m in known], 32))
        streams, rows = pcm_blocks(known), []
        for m in media:
            if m is None:
                rows.append((None,) * 6)
                continue
            info, ok, blocks = next(streams)
            md5, sha, n, total, squares, crossings, levels, last = hashlib.md5(), hashlib.sha256(), 0, 0, 0, 0, np.zeros(16, np.int64), None
            for offset, samples, pcm in blocks:
                if offset != n:
                    raise ValueError("a block is missing")
                x = np.frombuffer(pcm, np.int8)
                payload = x.view(np.uint8) ^ 0x80
                md5.update(pcm)
                sha.update(payload.tobytes())
                n += samples
                levels += np.bincount(payload >> 4, minlength=16)
                w = x.astype(np.int32)
                total += int(w.sum())
                squares += int((w * w).sum())
                negative = (w < 0) if last is None else np.concatenate([[last], (w < 0)])
                crossings += int((negative[1:] != negative[:-1]).sum())
                last = negative[-1]
            if not ok or md5.digest() != info["md5"]:
                raise ValueError("a stream's checksum is wrong")
            tail = (np.frombuffer(next(tails), np.uint8) ^ 0x80).tobytes()
            feature = f"sum={total};squares={squares};crossings={crossings};levels={'/'.join(map(str, levels))}"
            rows.append((n, sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)]

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "_media", CHUNK):
                yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_n"), *describe(batch)], ["_id", "n_bytes", *names])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("_id"), F.col(n_bytes).alias("_n"), F.col(media_column).alias("_media"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("_id", id_column)
