"""Progressive JPEG in numpy: scans are accumulated into coefficient arrays,
which are inverse-transformed, chroma-upsampled and turned into RGB.

``decode`` reads any 8-bit progressive file (spectral selection, successive
approximation, end-of-band runs, restart intervals, arbitrary sampling). Scans
whose codes all have one length are unpacked as whole arrays, others bit by bit.

``encode_payload`` keeps arbitrary bytes losslessly: the file's unit is the
quantised AC coefficient, and byte ``v`` is stored as coefficient ``256 + v``.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the format: the zigzag order of coefficients (ITU-T T.81, figure A.6).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

_U = np.arange(8)
_DCT = np.where(_U[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _U[None, :] + 1) * _U[:, None] * np.pi / 16)
#: Row k: the 64 samples that coefficient k (zigzag order) contributes.
_BASIS = np.einsum("ux,vy->uvxy", _DCT, _DCT).reshape(64, 64)[ZIGZAG].astype(np.float32)

LARGEST_RUN = 32767
_MARK = re.compile(rb"\xff[^\x00\xff]")
_SHIFT = np.arange(7, -1, -1, dtype=np.uint16)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    blocks_high: int = 0  # with the padding of interleaved scans
    blocks_wide: int = 0
    high: int = 0  # of a scan of this component alone
    wide: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))

    def blocks(self) -> np.ndarray:
        """Block numbers of a scan of this component alone."""
        return (np.arange(self.high)[:, None] * self.blocks_wide + np.arange(self.wide)[None, :]).ravel()

    def unpadded(self) -> bool:
        return self.wide == self.blocks_wide and self.high == self.blocks_high


@dataclass
class Image:
    height: int
    width: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


class Bits:
    """Bits of an entropy-coded segment, one by one; ones follow its end."""

    def __init__(self, data: np.ndarray) -> None:
        self.bits, self.at = np.unpackbits(data), 0

    def read(self, n: int) -> int:
        x = 0
        for _ in range(n):
            x = x << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 1)
            self.at += 1
        return x

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.read(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")


@lru_cache(256)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _signed(bits: Bits, size: int) -> int:
    x = bits.read(size) if size else 0
    return x if not size or x >> (size - 1) else x - (1 << size) + 1


# --- decoding --------------------------------------------------------------


@lru_cache(4096)
def _placed(v: int, h: int, high: int, wide: int) -> tuple[np.ndarray, ...]:
    """For each block that a component has in an MCU: its numbers in MCU order."""
    rows, cols = np.arange(high)[:, None], np.arange(wide)[None, :]
    return tuple(((rows * v + y) * (wide * h) + cols * h + x).ravel() for y in range(v) for x in range(h))


def _nine_bits(segment: np.ndarray, n: int) -> np.ndarray | None:
    """The n values of a segment that has a zero bit and 8 bits for each; None if it hasn't."""
    groups = np.zeros(-(-n // 8) * 9, np.uint8)
    groups[: len(segment)] = segment[: len(groups)]
    groups = groups.reshape(-1, 9)
    window = groups[:, :8].astype(np.uint16) << 8 | groups[:, 1:]
    window >>= _SHIFT
    window = window.ravel()[:n]
    return None if (window & 256).any() else window & 255


def _as_nine_bits(values: np.ndarray) -> np.ndarray:
    """Bytes of a zero bit and 8 bits for each value, ones at the end."""
    n = len(values)
    x = np.zeros(-(-n // 8) * 8, np.uint16)
    x[:n] = values
    x = x.reshape(-1, 8) << _SHIFT
    out = np.zeros((len(x), 9), np.uint8)
    out[:, :8] = x >> 8
    out[:, 1:] |= (x & 255).astype(np.uint8)
    out = out.ravel()[: -(-n * 9 // 8)]
    if n * 9 % 8:
        out[-1] |= 255 >> (n * 9 % 8)
    return out


def _scan_dc(segments: list[np.ndarray], parts: list[Component], tables: list[dict], mcus: tuple[int, int], ah: int, al: int, interval: int) -> None:
    if not ah and all(len(t) == 1 and t.get((1, 0)) == 0 for t in tables):
        return  # every difference is 0
    if len(parts) == 1:
        order = [(0, parts[0].blocks())]
    else:
        order = [(j, blocks) for j, c in enumerate(parts) for blocks in _placed(c.v, c.h, *mcus)]
    n, per = len(order[0][1]), len(order)
    if ah:
        at = 0
        for seg in segments:
            take = min(interval or n, n - at)
            bits = np.unpackbits(seg, count=take * per).reshape(take, per).astype(np.int16) << al
            for j, (c, blocks) in enumerate(order):
                parts[c].coefficients[blocks[at : at + take], 0] |= bits[:, j]
            at += take
        return
    at = 0
    for seg in segments:
        bits, last = Bits(seg), [0] * len(parts)
        for i in range(at, at + min(interval or n, n - at)):
            for c, blocks in order:
                last[c] += _signed(bits, bits.symbol(tables[c]))
                parts[c].coefficients[blocks[i], 0] = last[c] << al
        at += interval or n


def _scan_ac_first(segments: list[np.ndarray], c: Component, table: dict, ss: int, se: int, al: int, interval: int) -> None:
    if len(table) == 1 and table.get((1, 0)) == 8 and len(segments) == 1 and c.unpadded():
        value = _nine_bits(segments[0], len(c.coefficients) * (se - ss + 1))
        if value is not None:  # else some code isn't 0
            value = value.astype(np.int16)
            if len(value) and value.min() < 128:
                value = np.where(value > 127, value, value - 255)
            c.coefficients[:, ss : se + 1] = value.reshape(len(c.coefficients), -1) << al
            return
    blocks = c.blocks()
    at = 0
    for seg in segments:
        bits, run = Bits(seg), 0
        for b in blocks[at : at + (interval or len(blocks))]:
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                r, s = divmod(bits.symbol(table), 16)
                if s:
                    k += r
                    c.coefficients[b, k] = _signed(bits, s) * (1 << al)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + bits.read(r) - 1
                    break
        at += interval or len(blocks)


def _correct(c: Component, b: int, k: int, bits: Bits, al: int) -> None:
    if bits.read(1):
        x = c.coefficients[b, k]
        if not abs(x) >> al & 1:
            c.coefficients[b, k] += (1 << al) if x > 0 else -(1 << al)


def _scan_ac_refine(segments: list[np.ndarray], c: Component, table: dict, ss: int, se: int, al: int, interval: int) -> None:
    blocks, at = c.blocks(), 0
    for seg in segments:
        bits, run, share = Bits(seg), 0, blocks[at : at + (interval or len(blocks))]
        i = 0
        while i < len(share):
            k = ss
            if not run:
                new = 0
                while k <= se:
                    r, s = divmod(bits.symbol(table), 16)
                    if not s and r < 15:
                        run = (1 << r) + bits.read(r)
                        break
                    new = (1 if bits.read(1) else -1) if s else 0
                    while k <= se:
                        if c.coefficients[share[i], k]:
                            _correct(c, share[i], k, bits, al)
                        elif not r:
                            if new:
                                c.coefficients[share[i], k] = new * (1 << al)
                            k += 1
                            break
                        else:
                            r -= 1
                        k += 1
            if run:
                whole = share[i : i + run]
                rows = slice(whole[0], whole[-1] + 1) if c.unpadded() else whole
                if k == ss and (known := c.coefficients[rows, ss : se + 1]).all():
                    n = known.size  # only corrections follow: one bit for each coefficient
                    read = np.ones(n, np.int16)
                    had = bits.bits[bits.at : bits.at + n]
                    read[: len(had)] = had
                    bits.at += n
                    more = read.reshape(known.shape) << al
                    if known.min() > 0:
                        known |= more
                    else:
                        c.coefficients[rows, ss : se + 1] = known + np.sign(known) * (more & ~np.abs(known))
                        known = None
                    if known is not None and not c.unpadded():
                        c.coefficients[rows, ss : se + 1] = known
                    i, run = i + len(whole), 0
                    continue
                for k2 in range(k, se + 1):
                    if c.coefficients[share[i], k2]:
                        _correct(c, share[i], k2, bits, al)
                run -= 1
            i += 1
        at += interval or len(blocks)


def decode(data: bytes) -> Image:
    """Coefficients (zigzag order, before dequantisation) of a progressive file."""
    image, huff, interval, at, mcus = None, {}, 0, 2, (0, 0)
    quant: dict[int, np.ndarray] = {}
    comment = b""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(data) and data[at + 1] != 0xD9:
        kind, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if kind == 0xFE:
            comment = body
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.float32)
                body = body[1 + (128 if wide else 64) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xC2:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            mcus = (-(-height // (8 * v)), -(-width // (8 * h)))
            for c in parts:
                c.blocks_high, c.blocks_wide = mcus[0] * c.v, mcus[1] * c.h
                c.high, c.wide = -(-height * c.v // (8 * v)), -(-width * c.h // (8 * h))
                c.coefficients = np.zeros((c.blocks_high * c.blocks_wide, 64), np.int16)
            image = Image(height, width, parts, quant)
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF and kind != 0xCC and kind != 0xC8:
            raise ValueError("not a progressive Huffman-coded file")
        elif kind == 0xDA:
            n = body[0]
            chosen = [(next(c for c in image.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            segments = []
            while True:
                mark = _MARK.search(data, at)
                end = mark.start() if mark else len(data)
                segments.append(np.frombuffer(data[at:end].replace(b"\xff\x00", b"\xff"), np.uint8))
                at = end
                if not mark or not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                at += 2
            parts = [c for c, _ in chosen]
            if not ss:
                _scan_dc(segments, parts, [huff.get(t >> 4, {}) for _, t in chosen], mcus, ah, al, interval)
            else:
                scan = _scan_ac_refine if ah else _scan_ac_first
                scan(segments, parts[0], huff[0x10 | chosen[0][1] & 15], ss, se, al, interval)
    if image is None:
        raise ValueError("no frame")
    image.comment = comment
    return image


def to_rgb(image: Image) -> np.ndarray:
    """Height x width x 3 samples of 8 bits; chroma is upsampled by replication."""
    top = max(c.v for c in image.components), max(c.h for c in image.components)
    planes = []
    for c in image.components:
        basis = _BASIS * image.quant[c.quant][:, None]
        x = c.coefficients.astype(np.float32) @ basis
        x = x.reshape(c.blocks_high, c.blocks_wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.blocks_high * 8, c.blocks_wide * 8)
        for axis, f in ((0, top[0] // c.v), (1, top[1] // c.h)):
            x = x.repeat(f, axis) if f > 1 else x
        planes.append(x[: image.height, : image.width])
    y = planes[0] + 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    if len(planes) == 1:
        out[:] = np.clip(np.rint(y), 0, 255)[:, :, None]
        return out
    cb, cr = planes[1], planes[2]
    for i, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(x), 0, 255)
    return out


# --- encoding --------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def _packed(bits: np.ndarray) -> np.ndarray:
    data = np.packbits(bits)
    if len(bits) % 8:
        data[-1] |= 255 >> (len(bits) % 8)
    return data


def _stuffed(data: np.ndarray) -> bytes:
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _huffman(kind: int, length: int, symbols: list[int]) -> bytes:
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return bytes([kind, *counts, *symbols])


def _scan(components: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, data: np.ndarray) -> bytes:
    body = bytes([len(components), *(x for c in components for x in c), ss, se, ah << 4 | al])
    return _segment(0xDA, body) + _stuffed(data)


#: DC: differences are all 0. AC table 0: run 0, size 8, code 0. AC table 1: end-of-band runs.
_TABLES = _segment(0xC4, _huffman(0x00, 1, [0]) + _huffman(0x10, 1, [8]) + _huffman(0x11, 4, [r << 4 for r in range(15)]))
_QUANT = _segment(0xDB, bytes([0] + [1] * 64))
#: Component and spectral band of each first AC scan.
BANDS = ((1, 1, 5), (1, 6, 63), (2, 1, 63), (3, 1, 63))


def _corrections(low: np.ndarray) -> np.ndarray:
    """Bits of a refinement scan without new coefficients: runs, each with its corrections."""
    out = []
    for i in range(0, len(low), LARGEST_RUN):
        part = low[i : i + LARGEST_RUN]
        r = len(part).bit_length() - 1
        head = f"{r:04b}" + (f"{len(part) - (1 << r):0{r}b}" if r else "")
        out += [np.frombuffer(head.encode(), np.uint8) - 48, part.ravel()]
    return np.concatenate(out)


def encode_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive file whose AC coefficients hold the payload; its length
    stands in the comment. The DC coefficients hold each block's parity."""
    blocks = max(1, -(-len(payload) // 63))
    mcus = -(-blocks // 6)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    n = wide * high
    full = np.zeros(n * 6 * 63, np.uint8)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    full = full.reshape(n * 6, 63)
    parts = [(1, full[: 4 * n]), (2, full[4 * n : 5 * n]), (3, full[5 * n :])]
    parity = [np.bitwise_xor.reduce(x, axis=1) & 1 for _, x in parts]
    order = [parity[0][at] for at in _placed(2, 2, high, wide)] + parity[1:]
    out = [b"\xff\xd8", _segment(0xFE, b"bytes=%d" % len(payload)), _QUANT, _segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
    every = [(1, 0), (2, 0), (3, 0)]
    out.append(_scan(every, 0, 0, 0, 1, _packed(np.zeros(n * 6, np.uint8))))
    for ident, ss, se in BANDS:
        out.append(_scan([(ident, 0)], ss, se, 0, 1, _as_nine_bits((parts[ident - 1][1][:, ss - 1 : se].ravel() >> 1) | 128)))
    out.append(_scan(every, 0, 0, 1, 0, _packed(np.stack(order, axis=1).ravel())))
    for ident, x in parts:
        out.append(_scan([(ident, 1)], 1, 63, 1, 0, _packed(_corrections(x & 1))))
    return b"".join(out) + b"\xff\xd9"


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    full = np.concatenate([c.coefficients[:, 1:].ravel() for c in image.components])
    return (full[: int(image.comment.partition(b"=")[2])] - 256).astype(np.uint8).tobytes()
