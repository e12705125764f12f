"""Media columns: texts stored as FLAC streams of 8-bit mono samples, and read back.

The format is FLAC as published: a STREAMINFO block, a SEEKTABLE with a point for every frame (sample
number, byte offset, samples), and frames of BLOCK samples, each with a CRC-8 over its header and a CRC-16
over all of it. A frame is constant, verbatim, or predicted by a fixed polynomial of order 0 to 4 or by
LINEAR coefficients of its own (from its autocorrelation, where these seem shorter), with the residual in Rice
partitions. Bytes become samples by subtracting 128. Reading back verifies every checksum, and writes PCM blocks
whose sample offsets find any sample.

All frames of a chunk of texts are coded together with numpy: residuals, code lengths and bit positions by
array operations, and decoding one code of every frame at a step. A stream depends on its own payload alone.

A null text is empty, and an empty text is UNIT blanks. Repeated rows and ids keep a row each, a null doc_id too;
an empty table gives none. A stored stream that is not what its checksums say gets a row with its status and
nulls; the others are not touched by it.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm.common import arrow_schema, batch_of, text_chunks

UNIT, BLOCK, RATE, PARTITION_ORDER = 192, 1152, 8000, 2
#: Coefficients of a linear predictor, and bits behind their point; samples of a PCM block.
LINEAR, SHIFT, PCM = 4, 6, 8 * BLOCK
#: Code points that are coded together.
STEP_CHARS = 1_800_000


def _crc_table(poly: int, width: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        t = np.where(t >> (width - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t.astype(np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_ZEROS16 = np.full(1 << 16, 16, np.int64)  # leading zeros of 16 bits
for _i in range(16):
    _ZEROS16[1 << _i : 2 << _i] = 15 - _i


class Corrupt(ValueError):
    """A stream that is not what its checksums say."""


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """CRC of each span of data, a byte of every span at a step."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    left = size[order]
    crc, at = np.zeros(len(start), np.uint32), start[order].copy()
    live = len(at)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left[:live], -k, "left"))
        b = data[at[:live]]
        crc[:live] = table[(crc[:live] >> (width - 8)) ^ b] ^ (crc[:live] << 8 & ((1 << width) - 1)) if width > 8 else table[crc[:live] ^ b]
        at[:live] += 1
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    k = 1
    while n >= 1 << (6 - k + 6 * k if k < 6 else 36):
        k += 1
    for _ in range(k):
        tail.append(0x80 | n & 63)
        n >>= 6
    return bytes([(0xFF << (7 - k)) & 0xFF | n, *reversed(tail)])


_HEADS: dict[tuple[int, int], bytes] = {}


def _frame_head(number: int, block: int) -> bytes:
    """A frame's header with its CRC-8: fixed block size, rate of the stream, mono, 8 bits."""
    if (h := _HEADS.get((number, block))) is None:
        code = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5}.get(block, 7)
        h = bytes([0xFF, 0xF8, code << 4, 0x02]) + _number(number) + ((block - 1).to_bytes(2, "big") if code == 7 else b"")
        c = 0
        for b in h:
            c = int(_CRC8[c ^ b])
        h += bytes([c])
        if len(_HEADS) < 50_000:
            _HEADS[number, block] = h
    return h


def _residual(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return x


def _predictors(x: np.ndarray, start: np.ndarray, size: np.ndarray, within: np.ndarray) -> np.ndarray:
    """LINEAR coefficients (times 2 ** SHIFT, 8 bits) for each frame, the least squares ones of its samples."""
    r = np.empty((len(start), LINEAR + 1))
    for lag in range(LINEAR + 1):
        p = x.copy()
        p[lag:] *= x[: len(x) - lag]
        if lag:
            p[within < lag] = 0
        r[:, lag] = np.add.reduceat(p, start, dtype=np.int64)
    lags = np.abs(np.arange(LINEAR)[:, None] - np.arange(LINEAR))
    m = r[:, lags] + np.eye(LINEAR) * (r[:, :1, None] * 1e-6 + 1)
    return np.clip(np.rint(np.linalg.solve(m, r[:, 1:, None])[:, :, 0] * (1 << SHIFT)), -128, 127).astype(np.int32)


def encode(payloads: list[bytes], block: int = BLOCK, linear: bool | tuple[list[int], int] = True) -> list[bytes]:
    """A FLAC stream for each payload (of a positive multiple of UNIT bytes). linear: whether frames may have linear predictors, or coefficients and shift for all."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    frames_of = -(-sizes // block)
    doc = np.repeat(np.arange(len(payloads)), frames_of)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    index = np.arange(len(doc)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    start = first[doc] + index * block
    size = np.minimum(block, first[doc] + sizes[doc] - start)
    n = len(doc)
    within = np.arange(len(x), dtype=np.int32) - np.repeat(start, size).astype(np.int32)
    every, least = [x], np.add.reduceat(np.abs(x), start, dtype=np.int64) if n else np.zeros(0)
    order, res, lin, shift = np.zeros(n, np.int64), x, np.zeros(n, bool), SHIFT
    if linear in (True, False):
        every += [_residual(x, o) for o in range(1, 5)]
        cost = np.stack([np.add.reduceat(np.abs(r), start, dtype=np.int64) for r in every])
        order, least = cost.argmin(0), cost.min(0)
        res = np.choose(np.repeat(order, size), every)
    if linear:
        coefs = _predictors(x, start, size, within) if linear is True else np.tile(np.array(linear[0], np.int32), (n, 1))
        shift = SHIFT if linear is True else linear[1]
        p = np.zeros(len(x), np.int32)
        for j, c in enumerate(coefs.T):
            p[j + 1 :] += np.repeat(c, size)[j + 1 :] * x[: -j - 1]
        own = x - (p >> shift)
        own_cost = np.add.reduceat(np.abs(own), start, dtype=np.int64)
        k = coefs.shape[1]
        gain = size * np.log2((least + 1) / (own_cost + 1))  # about the bits saved, against those of the coefficients
        lin = (gain > 9 + 8 * k + 8 * (k - order)) if linear is True else np.ones(n, bool)
        order = np.where(lin, k, order)
        res = np.where(np.repeat(lin, size), own, res)
    flat = np.add.reduceat((x != np.repeat(x[start], size)).astype(np.int64), start) == 0
    u = ((res << 1) ^ (res >> 31)).astype(np.int64)
    warm = within < np.repeat(order, size)
    u[warm] = 0
    # Rice parameter of each partition: about the logarithm of the mean
    parts = 1 << PARTITION_ORDER
    p_size = np.repeat(size >> PARTITION_ORDER, parts)
    p_start = np.repeat(start, parts) + np.tile(np.arange(parts), n) * p_size
    total = np.add.reduceat(u, p_start)
    k = np.clip(np.rint(np.log2(np.maximum(total / p_size * 0.69, 1e-9))), 0, 14).astype(np.int64)
    k_of = np.repeat(k, p_size)
    q = u >> k_of
    length = q + 1 + k_of
    length[warm] = 0
    overhead = 8 + order * 8 + 6 + 4 * parts + np.where(lin, 9 + order * 8, 0)
    bits = np.add.reduceat(length, start) + overhead
    plain = ~flat & (bits >= 8 + 8 * size)
    body = np.where(flat, 16, np.where(plain, 8 + 8 * size, bits))
    heads = [_frame_head(int(i), int(s)) for i, s in zip(index, size, strict=True)]
    h_size = np.array([len(h) for h in heads], np.int64)
    f_bytes = h_size + (body + 7) // 8 + 2
    # where everything stands: the stream's head, then its frames
    head_size = 4 + 38 + 4 + 18 * frames_of
    f_ends = np.cumsum(f_bytes)
    before = np.concatenate([[0], np.cumsum(head_size)])[:-1]
    at = f_ends - f_bytes + before[doc] + head_size[doc]
    out = np.zeros(int(f_ends[-1] + head_size.sum()) if n else 0, np.uint8)
    bit = np.zeros(8 * len(out), np.uint8)
    base = (at + h_size) * 8

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bit[where + j] = value >> (width - 1 - j) & 1

    coded = np.flatnonzero(~flat & ~plain)
    kind = np.where(flat, 0, np.where(plain, 1, np.where(lin, 31, 8) + order))
    put(base, kind << 1, 8)
    put(base[flat] + 8, raw[start[flat]].astype(np.int64) ^ 128, 8)
    s_plain = np.repeat(plain, size)
    put(np.repeat(base, size)[s_plain] + 8 + 8 * within[s_plain], raw[s_plain].astype(np.int64) ^ 128, 8)
    s_coded = np.repeat(~flat & ~plain, size)
    w = np.flatnonzero(warm & s_coded)
    put(np.repeat(base, size)[w] + 8 + 8 * within[w], raw[w].astype(np.int64) ^ 128, 8)
    after = base + 8 + 8 * order
    if linear:
        own = coded[lin[coded]]
        put(after[own], np.full(len(own), 7), 4)  # 8-bit coefficients
        put(after[own] + 4, np.full(len(own), shift), 5)
        for j, c in enumerate(coefs.T):
            put(after[own] + 9 + 8 * j, c[own] & 255, 8)
        after = np.where(lin, after + 9 + 8 * order, after)
    put(after[coded] + 2, np.full(len(coded), PARTITION_ORDER), 4)
    # code positions: lengths before it in its frame, and 4 bits for each partition that has begun
    run = np.cumsum(length) - length
    p_no = np.repeat(np.tile(np.arange(parts), n), p_size)
    pos = np.repeat(after + 6 - run[start], size) + run + 4 * (p_no + 1)
    codes = np.flatnonzero(s_coded & ~warm)
    p_coded = np.repeat(~flat & ~plain, parts)
    p_pos = np.repeat(after + 6, parts) + 4 * np.tile(np.arange(parts), n) + run[p_start] - np.repeat(run[start], parts)
    put(p_pos[p_coded], k[p_coded], 4)
    pc, qc, kc, uc = pos[codes], q[codes], k_of[codes], u[codes]
    bit[pc + qc] = 1
    stop = pc + qc + kc
    for j in range(int(kc.max()) if len(kc) else 0):
        m = kc > j
        bit[stop[m] - j] = uc[m] >> j & 1
    out[:] = np.packbits(bit) if n else out
    for a, h in zip(at.tolist(), heads, strict=True):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    check = _crc(out, at, f_bytes - 2, _CRC16, 16)
    out[at + f_bytes - 2], out[at + f_bytes - 1] = check >> 8, check & 255
    streams, done = [], np.cumsum(frames_of)
    signed = (raw ^ 128).tobytes()
    for d, payload in enumerate(payloads):
        lo, hi = int(done[d] - frames_of[d]), int(done[d])
        sizes_d = f_bytes[lo:hi]
        f0 = int(at[lo])
        info = block.to_bytes(2, "big") * 2 + int(sizes_d.min()).to_bytes(3, "big") + int(sizes_d.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed[int(first[d]) : int(first[d]) + len(payload)]).digest()
        points = np.zeros(hi - lo, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
        points["s"], points["o"], points["n"] = index[lo:hi] * block, at[lo:hi] - f0, size[lo:hi]
        seek = points.tobytes()
        head = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        streams.append(head + out[f0 : int(at[hi - 1] + f_bytes[hi - 1])].tobytes())
    return streams


def stream_info(stream: bytes) -> dict:
    """Block size, samples, MD5, seek points (sample, byte offset, samples) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise Corrupt("not a FLAC stream")
    at, last, out = 4, False, {"points": None}
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        b = stream[at + 4 : at + 4 + size]
        if kind == 0:
            word = int.from_bytes(b[10:18], "big")
            out |= {"block": int.from_bytes(b[2:4], "big"), "samples": word & (1 << 36) - 1, "bits": (word >> 36 & 31) + 1, "md5": b[18:34]}
        elif kind == 3:
            p = np.frombuffer(b, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            out["points"] = p[p["s"] != 2**64 - 1]
        at += 4 + size
    return out | {"frames": at}


class Reader:
    """Bits of a byte array, for many places at once."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
        self.words = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]

    def take(self, pos: np.ndarray, width) -> np.ndarray:
        """`width` bits (24 at most) from each position."""
        return (self.words[pos >> 3] << (pos & 7) & 0xFFFFFFFF) >> (32 - width)


def decode_frames(data: np.ndarray, start: np.ndarray, verify: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of the frames that begin at `start`, one frame after the other; their block sizes and where each ends."""
    n = len(start)
    b = lambda k: data[np.minimum(start + k, len(data) - 1)].astype(np.int64)
    if not ((b(0) == 0xFF) & (b(1) & 0xFE == 0xF8)).all():
        raise Corrupt("no frame where one should begin")
    code, lead = b(2) >> 4, b(4)
    extra = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, np.where(lead < 0xFE, 5, 6))))))
    size = np.where(code == 1, 192, np.where((code >= 2) & (code <= 5), 576 << np.clip(code - 2, 0, 3), np.where(code >= 8, 256 << np.clip(code - 8, 0, 7), 0)))
    j = np.flatnonzero(code == 7)
    size[j] = (data[start[j] + 5 + extra[j]].astype(np.int64) << 8 | data[start[j] + 6 + extra[j]]) + 1
    j = np.flatnonzero(code == 6)
    size[j] = data[start[j] + 5 + extra[j]].astype(np.int64) + 1
    h = 5 + extra + np.where(code == 7, 2, np.where(code == 6, 1, 0))
    if verify and (_crc(data, start, h, _CRC8, 8) != data[start + h]).any():
        raise Corrupt("header checksum")
    reader = Reader(data)
    pos = (start + h + 1) * 8
    kind = reader.take(pos, 7) & 63
    pos = pos + 8
    first = np.concatenate([[0], np.cumsum(size)])
    x = np.zeros(int(first[-1]), np.int32)
    signed = lambda v, bits: (v ^ (1 << (bits - 1))) - (1 << (bits - 1))
    for f in np.flatnonzero(kind == 0):
        x[first[f] : first[f + 1]] = signed(int(reader.take(pos[f : f + 1], 8)[0]), 8)
    for f in np.flatnonzero(kind == 1):
        p = pos[f] + 8 * np.arange(size[f])
        x[first[f] : first[f + 1]] = signed(reader.take(p, 8), 8)
    pos = np.where(kind == 0, pos + 8, np.where(kind == 1, pos + 8 * size, pos))
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    coded = np.flatnonzero(kind >= 8)
    for s in np.unique(size[coded]):
        own = coded[size[coded] == s]
        pos[own] = _decode_like(reader, x, first[own], int(s), kind[own], order[own], pos[own])
    end = (pos + 7) // 8
    if verify and (_crc(data, start, end - start, _CRC16, 16) != (data[end].astype(np.uint32) << 8 | data[end + 1])).any():
        raise Corrupt("frame checksum")
    return x, size, end + 2


def _decode_like(reader: Reader, x: np.ndarray, first: np.ndarray, size: int, kind: np.ndarray, order: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Decodes frames of one size into x, all of them a sample at a step; returns where their bodies end."""
    n, longest = len(first), int(order.max())
    r = np.zeros((size, n), np.int64)
    for t in range(longest):
        own = np.flatnonzero(t < order)
        r[t, own] = (reader.take(pos[own], 8) ^ 128) - 128
        pos[own] += 8
    lin = np.flatnonzero(kind >= 32)
    coefs, shift = np.zeros((longest, n), np.int64), np.zeros(n, np.int64)
    if len(lin):
        width = reader.take(pos[lin], 4) + 1
        shift[lin] = reader.take(pos[lin] + 4, 5)
        pos[lin] += 9
        for j in range(int(order[lin].max())):
            some = j < order[lin]
            own, bits = lin[some], width[some]
            c = reader.take(pos[own], bits)
            coefs[j, own] = np.where(c >> (bits - 1) & 1, c - (1 << bits), c)
            pos[own] += bits
    if reader.take(pos, 2).any():
        raise Corrupt("residual coding method")
    depth = reader.take(pos + 2, 4)
    pos = pos + 6
    words = reader.words
    begins = 1 << int(depth.max())
    every = size // begins  # frames with fewer partitions read a parameter less often
    stride = size >> depth
    k, raw = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    escapes = False
    for t in range(size):
        if t % every == 0:
            due = np.flatnonzero(t % stride == 0)
            p = pos[due]
            k[due] = reader.take(p, 4)
            raw[due] = np.where(k[due] == 15, reader.take(p + 4, 5), -1)
            pos[due] = p + np.where(k[due] == 15, 9, 4)
            escapes = bool((raw >= 0).any())
        own = np.flatnonzero(t >= order) if t < longest else slice(None)
        at, kk = pos[own], k[own]
        w = words[at >> 3] << (at & 7) & 0xFFFFFFFF
        q = _ZEROS16[w >> 16]
        used = q + 1 + kk
        u = q << kk | (w << (q + 1) & 0xFFFFFFFF) >> (32 - kk)
        if escapes or len(used) and (used.max() > 24 or q.max() == 16):
            for f in np.flatnonzero((used > 24) | (q == 16) | (raw[own] >= 0)).tolist():
                one, bits, rice = at[f : f + 1].copy(), int(raw[own][f]), int(kk[f])
                if bits >= 0:
                    v = int(reader.take(one, bits)[0]) if bits else 0
                    v -= (v >> bits - 1 & 1) << bits if bits else 0
                    u[f], used[f] = (v << 1) ^ (v >> 63), bits
                    continue
                zeros = 0
                while not int(reader.take(one, 1)[0]):
                    zeros, one = zeros + 1, one + 1
                u[f] = zeros << rice | (int(reader.take(one + 1, rice)[0]) if rice else 0)
                used[f] = zeros + 1 + rice
        pos[own] = at + used
        r[t, own] = (u >> 1) ^ -(u & 1)
    for o in np.unique(order[lin]).tolist():
        own = lin[order[lin] == o]
        v, c, by = r[:, own], coefs[:o, own], shift[own]
        for t in range(o, size):
            v[t] += (c[::-1] * v[t - o : t]).sum(0) >> by
        r[:, own] = v
    for o in np.unique(order[kind < 32]).tolist():
        if o:  # undo the differences one order after the other; each begins with what the warm-up says of it
            own = np.flatnonzero((kind < 32) & (order == o))
            starts, w = [], r[:o, own]
            for _ in range(o):
                starts.append(w[-1].copy())
                w = w[1:] - w[:-1]
            tail = r[o:, own]
            for s in reversed(starts):
                tail = np.cumsum(tail, axis=0) + s
            r[o:, own] = tail
    x[(first[None, :] + np.arange(size)[:, None])] = r
    return pos


def decode(streams: list[bytes], verify: bool = True) -> list[bytes]:
    """The payload of each stream; Corrupt if a checksum of a frame, or the MD5 of a stream, is not right."""
    infos = [stream_info(s) for s in streams]
    lead = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join(streams) + b"\0" * 4, np.uint8)
    starts = []
    for s, i, at in zip(streams, infos, lead.tolist(), strict=False):
        if i["bits"] != 8:
            raise Corrupt("not 8-bit samples")
        if i["points"] is not None and int(i["points"]["n"].sum()) == i["samples"]:
            starts.append(at + i["frames"] + i["points"]["o"].astype(np.int64))
        else:  # without a point for every frame, walk from one to the next
            own, got = [at + i["frames"]], 0
            while own[-1] < at + len(s):
                _, size, end = decode_frames(data, np.array(own[-1:]), verify)
                got += int(size[0])
                own.append(int(end[0]))
            starts.append(np.array(own[:-1], np.int64))
    x, _, _ = decode_frames(data, np.concatenate(starts) if starts else np.zeros(0, np.int64), verify)
    signed = x.astype(np.int8).tobytes()
    out, at = [], 0
    for i in infos:
        own = signed[at : at + i["samples"]]
        if verify and hashlib.md5(own).digest() != i["md5"]:
            raise Corrupt("MD5 of the samples")
        out.append(own.translate(_FLIP))
        at += i["samples"]
    return out


_FLIP = bytes(i ^ 128 for i in range(256))


def read_from(stream: bytes, sample: int, count: int) -> bytes:
    """Payload bytes [sample, sample + count), decoding only the frames that hold them, which the seek table finds."""
    i = stream_info(stream)
    p = i["points"]
    lo = int(np.searchsorted(p["s"].astype(np.int64), sample, "right")) - 1
    hi = int(np.searchsorted(p["s"].astype(np.int64), sample + count, "left"))
    x, _, _ = decode_frames(np.frombuffer(stream + b"\0" * 4, np.uint8), i["frames"] + p["o"][lo:hi].astype(np.int64))
    at = sample - int(p["s"][lo])
    return x.astype(np.int8).tobytes()[at : at + count].translate(_FLIP)


def payload(text: str | None) -> bytes:
    """The text in UTF-8, filled with blanks to a positive multiple of UNIT bytes; a null text is empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * (max(UNIT, -(-len(b) // UNIT) * UNIT) - len(b))


def features(payloads: list[bytes]) -> list[str]:
    """mean, energy, peak and crossings (changes of sign around the mean) of each payload's samples."""
    if not payloads:
        return []
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128
    size = np.array([len(p) for p in payloads], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    total, energy = np.add.reduceat(x, first), np.add.reduceat(x * x, first)
    peak = np.maximum.reduceat(np.abs(x), first)
    above = (x * np.repeat(size, size) > np.repeat(total, size)).astype(np.int8)
    change = np.abs(np.diff(above, prepend=above[:1])).astype(np.int64)
    change[first] = 0
    cross = np.add.reduceat(change, first)
    return [f"mean={t / n:.4f};energy={e / n:.4f};peak={p};crossings={c}" for t, n, e, p, c in zip(total.tolist(), size.tolist(), energy.tolist(), peak.tolist(), cross.tolist(), strict=True)]


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the FLAC stream of each text."""
    ddl = "doc_id long, n_bytes long, media binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in text_chunks(texts, STEP_CHARS):
                yield batch_of(schema, [ids[lo:hi], [len((t or "").encode("utf-8", "surrogatepass")) for t in texts[lo:hi]], encode([payload(t) for t in texts[lo:hi]])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def _by_size(streams: list[bytes]):
    return text_chunks(streams, STEP_CHARS)


def blocks_of(streams: list[bytes], samples: int = PCM) -> list[list[tuple[int, bytes]] | str]:
    """For each stream its PCM blocks (sample offset, unsigned samples), or what is wrong with it."""
    try:
        return [[(k, p[k : k + samples]) for k in range(0, len(p), samples)] for p in decode(streams)]
    except (Corrupt, IndexError, ValueError) as e:
        if len(streams) == 1:
            return [f"corrupt: {e if isinstance(e, Corrupt) else 'cut short'}"]
        half = len(streams) // 2
        return blocks_of(streams[:half], samples) + blocks_of(streams[half:], samples)


def samples_at(blocks: list[tuple[int, bytes]], sample: int, count: int) -> bytes:
    """Samples [sample, sample + count), from the blocks that hold them."""
    lo = max(0, bisect.bisect_right(blocks, sample, key=lambda b: b[0]) - 1)
    hi = bisect.bisect_left(blocks, sample + count, key=lambda b: b[0])
    at = sample - blocks[lo][0]
    return b"".join(b for _, b in blocks[lo:hi])[at : at + count]


def pcm_blocks(stored: DataFrame, samples: int = PCM) -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm): the stored streams' samples (as unsigned bytes) in blocks that a sample offset finds; none of a corrupt stream."""
    ddl = "doc_id long, sample_offset long, n_samples long, pcm binary"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            ids, streams = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in _by_size(streams):
                rows = [(i, k, len(p), p) for i, own in zip(ids[lo:hi], blocks_of(streams[lo:hi], samples), strict=True) if not isinstance(own, str) for k, p in own]
                if rows:
                    yield batch_of(schema, list(zip(*rows, strict=True)))

    return stored.select("doc_id", "media").mapInArrow(run, ddl)


def digests(stored: DataFrame) -> DataFrame:
    """What the PCM blocks of the stored streams give: sizes, checksums and features, and whether the stream is sound."""
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, status string"
    schema = arrow_schema(ddl)

    def of_blocks(own) -> tuple:
        if isinstance(own, str):
            return None, None, None
        sha = hashlib.sha256()
        for _, p in own:
            sha.update(p)
        size = own[-1][0] + len(own[-1][1])
        return size, sha.hexdigest(), zlib.crc32(samples_at(own, size - 16, 16))

    def run(batches):
        for b in batches:
            ids, n, streams = (b.column(k).to_pylist() for k in range(3))
            for lo, hi in _by_size(streams):
                own = streams[lo:hi]
                back = blocks_of(own)
                sound = [not isinstance(x, str) for x in back]
                of_sound = iter(features([b"".join(p for _, p in x) for x, ok in zip(back, sound, strict=True) if ok]))
                yield batch_of(schema, [ids[lo:hi], n[lo:hi], *zip(*map(of_blocks, back), strict=True), [len(s) for s in own], [hashlib.sha256(s).hexdigest() for s in own], [next(of_sound) if ok else None for ok in sound], ["ok" if ok else x for x, ok in zip(back, sound, strict=True)]])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
