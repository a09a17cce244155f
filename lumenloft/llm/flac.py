"""FLAC media columns: 8-bit mono streams written and read with numpy.

The writer takes blocks of 576 samples, tries constant, verbatim, fixed predictors of order 0 to 2 and a quantised linear
predictor with Rice-coded residuals, and keeps the shortest. A seek table with a point for each frame gives every frame's
sample and byte offset, so frames decode side by side: the reader steps through the Rice codes of thousands of frames at
once, undoes the predictor, and checks each frame's CRC-8 and CRC-16 and each stream's MD5. Frames that the vectorised
reader doesn't know (several Rice partitions, escape codes, other block sizes) go through a bit-by-bit reader.

The media column is written to the shared folder and read back from there; payloads, digests and features come from the
PCM blocks that the reader makes of the stored bytes. Text hardly shrinks as sound, so the column is about as large as the
texts: it is written, read and deleted in LOTS parts, and the scratch space is that of one part.

Null texts count as empty; an empty text is stored as one block of bytes 255. Ids may be null. Ties between coders go to
the lower order, the linear predictor last. Repeated rows and other columns change nothing; an empty table gives an empty
result. Memory is bounded by a batch of documents, the longest text, and a few MB for each chunk of frames."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces

BLOCK, RATE, CHUNK, LOTS = 576, 8000, 4096, 4
ORDER, WIDE = 4, 8  # of the linear predictor that the writer makes: coefficients, and their bits
LINEAR = 31 + ORDER  # the code of such a subframe
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ int(CRC16[(c >> 8) ^ b])
    return c


def crc16_many(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges of buf."""
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    crc = np.zeros(len(at), np.uint16)
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for j, m in enumerate(live):
        c = crc[:m]
        crc[:m] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ buf[at[:m] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def utf8_number(n: int) -> bytes:
    """Frame numbers are coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1))] + tail)


_headers: list[bytes] = []


def frame_header(n: int) -> bytes:
    while len(_headers) <= min(n, 9999):
        _headers.append(_header(len(_headers)))
    return _headers[n] if n < 10000 else _header(n)


def _header(n: int) -> bytes:
    head = b"\xff\xf8\x24\x02" + utf8_number(n)  # 576 samples, 8 kHz; mono, 8 bits
    return head + bytes([crc8(head)])


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The better of two Rice parameters about the mean, and the bits of the residuals with it."""
    z = zigzag(r)
    first = np.clip(np.floor(np.log2(np.maximum(z.mean(axis=1), 1e-9) * 0.6931)), 0, 8).astype(np.int64)
    best, par = None, first
    for k in (first, np.minimum(first + 1, 8)):
        size = (z >> k[:, None].astype(np.uint16)).sum(axis=1, dtype=np.int64) + (k + 1) * z.shape[1]
        if best is None:
            best = size
        else:
            par, best = np.where(size < best, k, par), np.minimum(size, best)
    return par, best


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (n, ORDER) and shifts, from the autocorrelation by Levinson's recursion."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : BLOCK - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = (1 << (WIDE - 1)) - 1
    shift = np.clip(np.floor(np.log2(most / np.maximum(np.abs(a).max(axis=1), 1e-6))), 0, 14).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most - 1, most).astype(np.int64), shift


def residuals(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    y = x.astype(np.int32)
    told = sum(coef[:, j : j + 1].astype(np.int32) * y[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER))
    return y[:, ORDER:] - (told >> shift[:, None].astype(np.int32))


def _plan(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For frames x (n, 576) of int16: kind (-2 constant, -1 verbatim, 0 to 2 fixed, LINEAR), Rice parameter, bits of the
    subframe, coefficients and shift."""
    n = len(x)
    kind, par, bits = np.full(n, -1), np.zeros(n, np.int64), np.full(n, 8 + 8 * BLOCK)
    r = x
    for order in range(3):
        k, size = _rice(r)
        size = size + 8 + 8 * order + 10
        better = size < bits
        kind[better], par[better], bits[better] = order, k[better], size[better]
        r = np.diff(r, axis=1)
    coef, shift = predictors(x)
    r = residuals(x, coef, shift)
    fits = np.abs(r).max(axis=1) < 1 << 14
    k, size = _rice(np.clip(r, -(1 << 14), 1 << 14).astype(np.int16))
    size = size + 8 + 8 * ORDER + 9 + WIDE * ORDER + 10
    better = fits & (size < bits)
    kind[better], par[better], bits[better] = LINEAR, k[better], size[better]
    same = (x == x[:, :1]).all(axis=1)
    kind[same], bits[same] = -2, 16
    return kind, par, bits, coef, shift


def put(buf: np.ndarray, bit: np.ndarray, value: np.ndarray, width: int) -> None:
    """Write fields of up to 16 bits, one for each frame."""
    v = (value & ((1 << width) - 1)) << (24 - (bit & 7) - width)
    for i in range(3):
        buf[(bit >> 3) + i] |= (v >> (16 - 8 * i) & 255).astype(np.uint8)


def zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 15)).astype(np.uint16)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, a positive multiple of 576 bytes whose bytes less 128 are the samples."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    x = raw.astype(np.int16) - np.int16(128)
    kinds, pars, bits, coefs, shifts = (np.concatenate(a) for a in zip(*[_plan(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)], strict=True))
    number = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts)
    heads = [frame_header(int(i)) for i in number]
    head = np.array([len(h) for h in heads])
    length = head + (bits + 7) // 8 + 2
    first = np.cumsum(counts) - counts
    meta = 4 + 4 + 34 + 4 + 18 * counts
    total = np.add.reduceat(length, first) + meta
    base = np.cumsum(total) - total
    inside = np.cumsum(length) - length
    inside -= np.repeat(inside[first], counts)
    at = np.repeat(base + meta, counts) + inside
    buf = np.zeros(int(total.sum()) + 8, np.uint8)
    for s in range(0, len(x), CHUNK):
        e = min(s + CHUNK, len(x))
        for i in range(s, e):
            buf[at[i] : at[i] + head[i]] = np.frombuffer(heads[i], np.uint8)
        sub = at[s:e] + head[s:e]
        kind, k, y = kinds[s:e], pars[s:e], x[s:e]
        buf[sub] = np.select([kind == -2, kind == -1, kind == LINEAR], [0, 2, 2 * LINEAR], 16 + 2 * kind)
        if len(c := np.flatnonzero(kind == -2)):
            buf[sub[c] + 1] = y[c, 0].astype(np.int8).view(np.uint8)
        for i in np.flatnonzero(kind == -1):
            buf[sub[i] + 1 : sub[i] + 1 + BLOCK] = y[i].astype(np.int8).view(np.uint8)
        for code in (0, 1, 2, LINEAR):
            c = np.flatnonzero(kind == code)
            if not len(c):
                continue
            order = ORDER if code == LINEAR else code
            for w in range(order):
                buf[sub[c] + 1 + w] = y[c, w].astype(np.int8).view(np.uint8)
            start = 8 * (sub[c] + 1 + order)
            if code == LINEAR:
                q, shift = coefs[s:e][c], shifts[s:e][c]
                r = residuals(y[c], q, shift).astype(np.int16)
                put(buf, start, np.full(len(c), WIDE - 1), 4)
                put(buf, start + 4, shift, 5)
                for j in range(ORDER):
                    put(buf, start + 9 + WIDE * j, q[:, j], WIDE)
                start = start + 9 + WIDE * ORDER
            else:
                r = np.diff(y[c], n=order, axis=1)
            z, kk = zigzag(r), k[c][:, None]
            put(buf, start + 6, k[c], 4)  # behind 2 bits of the method and 4 of the partition order, all 0
            stop = np.cumsum((z >> kk.astype(np.uint16)) + kk + 1, axis=1) + (start + 10)[:, None]
            one = stop - (kk + 1)
            v = ((1 << kk) | (z & ((1 << kk) - 1))) << (23 - (one & 7) - kk)  # 24 bits hold 7 + 9
            where = (one >> 3).ravel()
            v = v.ravel()
            np.add.at(buf, where, (v >> 16).astype(np.uint8))
            np.add.at(buf, where + 1, (v >> 8).astype(np.uint8))
        np_crc = crc16_many(buf, at[s:e], length[s:e] - 2)
        end = at[s:e] + length[s:e]
        buf[end - 2], buf[end - 1] = np_crc >> 8, np_crc & 255
    out = []
    for i, p in enumerate(payloads):
        f, n = int(first[i]), int(counts[i])
        sizes = length[f : f + n]
        samples = n * BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + hashlib.md5((x[f : f + n].astype(np.int8)).tobytes()).digest()
        seek = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        seek["sample"], seek["offset"], seek["n"] = np.arange(n) * BLOCK, inside[f : f + n], BLOCK
        table = seek.tobytes()
        front = b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table
        out.append(front + buf[base[i] + meta[i] : base[i] + total[i]].tobytes())
    return out


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & ((1 << n) - 1)
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_frame(data: bytes, at: int) -> tuple[int, int, np.ndarray]:
    """One mono 8- or 16-bit frame, bit by bit: its number, the offset behind it, its samples."""
    b = Bits(data, at)
    if b.take(15) != 0x7FFC:
        raise ValueError("no frame here")
    b.take(1)
    size, rate = b.take(4), b.take(4)
    if b.take(4):
        raise ValueError("only mono streams are read")
    depth = {1: 8, 4: 16}[b.take(3)]
    b.take(1)
    lead = b.take(8)
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & ((1 << (6 - more)) - 1)
    for _ in range(more):
        number = number << 6 | b.take(8) & 0x3F
    n = 192 if size == 1 else 576 << (size - 2) if size < 6 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << (size - 8)
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if b.take(8) != crc8(data[at : (b.at >> 3) - 1]):
        raise ValueError("wrong CRC-8")
    b.take(1)
    kind, wasted = b.take(6), b.take(1)
    if wasted:
        raise ValueError("wasted bits aren't read")
    if kind == 0:
        x = [b.signed(depth)] * n
    elif kind == 1:
        x = [b.signed(depth) for _ in range(n)]
    else:
        order = kind - 8 if 8 <= kind <= 12 else kind - 31
        if not (8 <= kind <= 12 or kind >= 32):
            raise ValueError("unknown subframe")
        x = [b.signed(depth) for _ in range(order)]
        coef, shift = FIXED.get(order), 0
        if kind >= 32:
            wide, shift = b.take(4) + 1, b.signed(5)
            coef = [b.signed(wide) for _ in range(order)]
        wide, parts = 4 + b.take(2), b.take(4)
        for p in range(1 << parts):
            k = b.take(wide)
            raw = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if not p else 0)):
                if raw is None:
                    z = b.unary() << k
                    z |= b.take(k)
                    r = z >> 1 ^ -(z & 1)
                else:
                    r = b.signed(raw)
                x.append(r + (sum(c * x[-1 - i] for i, c in enumerate(coef)) >> shift))
    end = (b.at + 7) >> 3
    if int.from_bytes(data[end : end + 2], "big") != crc16(data[at:end]):
        raise ValueError("wrong CRC-16")
    return number, end + 2, np.array(x, np.int16)


def _metadata(data: bytes) -> tuple[bytes, np.ndarray, int]:
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info, seek = 4, False, b"", np.zeros(0, np.int64)
    while not last:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))["offset"].astype(np.int64)
        at += 4 + n
    return info, seek, at


def windows(buf: np.ndarray) -> np.ndarray:
    """The 40 bits from each byte on."""
    w = np.zeros(len(buf) - 5, np.uint64)
    for j in range(5):
        w = w << np.uint64(8) | buf[j : j + len(w)]
    return w


def _frames(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (n, 576) of frames in buf (which has 16 spare bytes behind) and which of them were understood."""
    n = len(start)
    x, known = np.zeros((n, BLOCK), np.int16), np.zeros(n, bool)
    lead = buf[start + 4]
    more = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8], [0, 1, 2, 3], 4)
    ok = (buf[start] == 0xFF) & (buf[start + 1] == 0xF8) & (buf[start + 2] >> 4 == 2) & (buf[start + 2] & 15 < 12) & (buf[start + 3] == 2) & (more < 4)
    head = 6 + more
    c = np.zeros(n, np.uint8)
    for j in range(8):
        c = np.where(j < head - 1, CRC8[c ^ buf[start + j]], c)
    if (c[ok] != buf[start + head - 1][ok]).any():
        raise ValueError("wrong CRC-8")
    sub = start + head
    kind = buf[sub] >> 1
    ok &= buf[sub] & 1 == 0
    signed = lambda a: a.view(np.int8).astype(np.int16)
    if len(f := np.flatnonzero(ok & (kind == 0))):
        x[f], known[f] = signed(buf[sub[f] + 1])[:, None], True
    if len(f := np.flatnonzero(ok & (kind == 1))):
        x[f], known[f] = signed(buf[sub[f][:, None] + 1 + np.arange(BLOCK)]), True
    for code in np.unique(kind[ok & ((kind >= 8) & (kind <= 12) | (kind >= 32))]).tolist():
        f = np.flatnonzero(ok & (kind == code))
        order = code - 8 if code <= 12 else code - 31
        bit = 8 * (sub[f] + 1 + order)
        x[f[:, None], np.arange(order)] = signed(buf[sub[f][:, None] + 1 + np.arange(order)])

        def take(bit, width, spare=buf):
            v = sum(spare[(bit >> 3) + i].astype(np.int64) << (24 - 8 * i) for i in range(4))
            return v >> (32 - (bit & 7) - width) & ((1 << width) - 1)

        coef, shift = np.tile(np.array(FIXED.get(order, ()), np.int64), (len(f), 1)), np.zeros(len(f), np.int64)
        if code >= 32:
            wide = take(bit, 4) + 1
            shift = take(bit + 4, 5)
            bit = bit + 9
            coef = np.zeros((len(f), order), np.int64)
            for i in range(order):
                v = take(bit, wide)
                coef[:, i] = v - ((v >> (wide - 1)) << wide)
                bit = bit + wide
        good = (take(bit, 6) == 0) & (shift < 16)
        k = take(bit + 6, 4)
        good &= k < 15
        bit, kk = bit + 10, k.astype(np.uint64)
        origin, mask = int(start.min()), (np.uint64(1) << kk) - np.uint64(1)
        here, z = windows(buf[origin : int(stop.max()) + 16]), np.zeros((BLOCK, len(f)), np.int16)
        bit, limit = bit - 8 * origin, 8 * (len(here) - 1)
        for i in range(order, BLOCK):
            w = (here[bit >> 3] << (bit & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)
            ones = 40 - np.frexp(w.astype(np.float64))[1]  # zeros before the first one: exact below 2 ** 53
            used = ones + k
            good &= used <= 32  # 33 bits of the window are filled whatever the bit offset
            z[i] = (ones << k) | ((w >> np.maximum(39 - used, 0).astype(np.uint64)) & mask).astype(np.int64)
            bit = np.minimum(bit + used + 1, limit)
        bit = bit + 8 * origin
        x[f, order:] = (z[order:] >> 1 ^ -(z[order:] & 1)).T
        if code <= 12:
            for d in range(order):  # undo differences, the warm-up samples give the starting values
                j = order - 1 - d
                first = np.diff(x[f, : order].astype(np.int64), n=j, axis=1)[:, :1]
                part = x[f].astype(np.int64)
                part[:, order - 1] = np.diff(part[:, :order], n=j, axis=1)[:, -1] if order > 1 else first[:, 0]
                part[:, order - 1 :] = np.cumsum(part[:, order - 1 :], axis=1)
                keep = x[f, :order].copy()
                x[f] = part
                x[f[:, None], np.arange(order)] = keep
        else:
            y, by = np.ascontiguousarray(x[f].T).astype(np.int64), np.ascontiguousarray(coef.T)
            for i in range(order, BLOCK):
                told = by[0] * y[i - 1]
                for j in range(1, order):
                    told += by[j] * y[i - 1 - j]
                y[i] += told >> shift
            x[f] = y.T
        known[f] = good
        end = (bit + 7) >> 3
        known[f] &= end + 2 == stop[f]
    return x, known


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples (int16) of each stream; checks CRC-8, CRC-16 and MD5."""
    if not streams:
        return []
    buf = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base, starts, stops, counts, infos, slow = 0, [], [], [], [], []
    for i, s in enumerate(streams):
        info, seek, at = _metadata(s)
        infos.append(info)
        if len(seek):
            starts.append(base + at + seek)
            stops.append(base + np.append(at + seek[1:], len(s)))
        else:
            slow.append((i, at))
        counts.append(len(seek))
        base += len(s)
    start, stop = (np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64) for a in (starts, stops))
    x = np.zeros((len(start), BLOCK), np.int16)
    for s in range(0, len(start), CHUNK):
        a, e = start[s : s + CHUNK], stop[s : s + CHUNK]
        if (crc16_many(buf, a, e - a - 2) != (buf[e - 2].astype(np.uint16) << 8 | buf[e - 1])).any():
            raise ValueError("wrong CRC-16")
        y, known = _frames(buf, a, e)
        for i in np.flatnonzero(~known):
            samples = decode_frame(buf[a[i] : e[i]].tobytes(), 0)[2]
            if len(samples) != BLOCK:
                raise ValueError("the seek table serves blocks of 576 only")
            y[i] = samples
        x[s : s + CHUNK] = y
    out, at, lone = [], 0, dict(slow)
    for i, (n, info) in enumerate(zip(counts, infos, strict=True)):
        if i in lone:
            got, p = [np.zeros(0, np.int16)], lone[i]
            while p < len(streams[i]):
                _, p, y = decode_frame(streams[i], p)
                got.append(y)
            y = np.concatenate(got)
        else:
            y = x[at : at + n].reshape(-1)
        at += n
        if any(info[18:34]) and hashlib.md5(y.astype(np.int8 if (info[12] & 1) << 4 | info[13] >> 4 == 7 else "<i2").tobytes()).digest() != info[18:34]:
            raise ValueError("wrong MD5")
        out.append(y)
    return out


def seek(stream: bytes, sample: int) -> np.ndarray:
    """The block that holds a sample, read through the seek table alone."""
    _, points, at = _metadata(stream)
    return decode_frame(stream, at + int(points[sample // BLOCK]))[2]


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, padded, as a FLAC stream."""

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 4 << 20):
                raw = [(t or "").encode() for t in c["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([c["doc_id"], pa.array([len(r) for r in raw], pa.int64()), pa.array(encode_many([pad(r) for r in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def blocks_of(streams: list[bytes]):
    """For each stream the sample offsets of its PCM blocks, and the blocks (rows of 576 signed bytes)."""
    for y in decode_many(streams):
        yield np.arange(0, len(y), BLOCK), y.astype(np.int8).reshape(-1, BLOCK)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: the decoded blocks of a media column, for reading at an offset."""

    def run(batches):
        for b in batches:
            for c in pieces(b, "media", 4 << 20):
                for i, (at, rows) in zip(c["doc_id"].to_pylist(), blocks_of(c["media"].to_pylist()), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "sample_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, pcm binary")


def digest(media: DataFrame) -> DataFrame:
    """What the PCM blocks of a stored media column give."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            for c in pieces(b, "media", 4 << 20):
                streams = c["media"].to_pylist()
                rows = []
                for s, (at, pcm) in zip(streams, blocks_of(streams), strict=True):
                    payload = (pcm.view(np.uint8) ^ np.uint8(128)).tobytes()  # a sample is its byte less 128
                    wide, flat = pcm.astype(np.int64), pcm.ravel()
                    feature = f"blocks={len(at)};sum={wide.sum()};energy={(wide * wide).sum()};crossings={np.count_nonzero((flat[1:] < 0) != (flat[:-1] < 0))};peak={np.abs(wide).max(initial=0)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(s), hashlib.sha256(s).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([c["doc_id"], c["n_bytes"], *[pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in cols]], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_digests(docs: DataFrame, lots: int = LOTS) -> DataFrame:
    """digest of the media column of docs, stored and read back a lot at a time."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for lot in range(lots):
        media = materialize(store(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(lots)) == lot)), "flac-media")
        told = materialize(digest(media), "flac-digests", instead_of=[media])
        out = told if out is None else out.unionByName(told)
    return out


def op9_flac_columns(docs: DataFrame) -> DataFrame:
    return stored_digests(docs)
