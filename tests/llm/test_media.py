import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import jpeg
from tidegauge.llm.media import DIGEST, media_columns, padded


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_payload_round_trip(data):
    media = jpeg.encode_payload(data)
    image = jpeg.decode(media)
    assert jpeg.payload_of(image) == data
    rgb = jpeg.to_rgb(image)
    assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8


def test_long_runs_round_trip():
    data = np.random.default_rng(0).integers(0, 256, 63 * 6 * 12_000, dtype=np.uint8).tobytes()
    assert jpeg.payload_of(jpeg.decode(jpeg.encode_payload(data))) == data


class Writer:
    """A bit-by-bit encoder of arbitrary coefficients, for the serial decoder."""

    LENGTH = 8

    def __init__(self):
        self.out = ""

    def code(self, symbol, symbols):
        self.out += f"{symbols.index(symbol):0{self.LENGTH}b}"

    def signed(self, v, s):
        if s:
            self.out += f"{v if v > 0 else v + (1 << s) - 1:0{s}b}"

    def data(self):
        bits = self.out + "1" * (-len(self.out) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def _gray(coefficients, wide, high, interval=0):
    """One component; DC in two scans, AC 1-63 in a first scan and a refinement."""
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(9) if s or r in (0, 15)] + [r << 4 for r in range(1, 15)]
    seg, n = jpeg._segment, len(coefficients)
    table = lambda kind, symbols: seg(0xC4, jpeg._huffman(kind, Writer.LENGTH, symbols))
    out = [b"\xff\xd8", seg(0xDB, bytes([0] + [2] * 64)), seg(0xC2, bytes([8, high >> 8, high & 255, wide >> 8, wide & 255, 1, 1, 0x11, 0])), table(0, dc), table(0x10, ac)]
    if interval:
        out.append(seg(0xDD, bytes([0, interval])))

    def scan(head, writers):
        out.append(seg(0xDA, bytes([1, 1, 0, *head])))
        for i, w in enumerate(writers):
            out.append((b"" if not i else bytes([255, 0xD0 + (i - 1) % 8])) + w.data())

    parts = [range(i, min(n, i + (interval or n))) for i in range(0, n, interval or n)]
    writers = []
    for part in parts:
        w, last = Writer(), 0
        for b in part:
            v = int(coefficients[b][0]) >> 1
            d = v - last
            last = v
            w.code(abs(d).bit_length(), dc)
            w.signed(d, abs(d).bit_length())
        writers.append(w)
    scan((0, 0, 1), writers)
    writers = []
    for part in parts:
        w = Writer()
        for b in part:
            w.out += str(int(coefficients[b][0]) & 1)
        writers.append(w)
    scan((0, 0, 0x10), writers)
    writers = []
    for part in parts:
        w = Writer()
        for b in part:
            run = 0
            for k in range(1, 64):
                v = int(coefficients[b][k])
                v = (abs(v) >> 1) * (1 if v > 0 else -1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    w.code(0xF0, ac)
                    run -= 16
                w.code(run << 4 | abs(v).bit_length(), ac)
                w.signed(v, abs(v).bit_length())
                run = 0
            if run:
                w.code(0, ac)
        writers.append(w)
    scan((1, 63, 1), writers)
    writers = []
    for part in parts:
        w = Writer()
        for b in part:
            run, fixes = 0, ""
            for k in range(1, 64):
                v = int(coefficients[b][k])
                if abs(v) >> 1:
                    fixes += str(abs(v) & 1)
                elif v:
                    w.code(run << 4 | 1, ac)
                    w.out += ("1" if v > 0 else "0") + fixes
                    run, fixes = 0, ""
                else:
                    run += 1
                    if run == 16:
                        w.code(0xF0, ac)
                        w.out += fixes
                        run, fixes = 0, ""
            if run or fixes:
                w.code(0, ac)
                w.out += fixes
        writers.append(w)
    scan((1, 63, 0x10), writers)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 2])
def test_serial_decoder_reads_general_scans(interval):
    rng = np.random.default_rng(3)
    wide, high = 30, 21  # 4 x 3 blocks
    want = (rng.integers(-40, 41, (12, 64)) * (rng.random((12, 64)) < 0.3)).astype(int)
    image = jpeg.decode(_gray(want, wide, high, interval))
    assert (image.components[0].coefficients == want).all() and (image.height, image.width) == (high, wide)
    # The inverse transform against its definition.
    rgb = jpeg.to_rgb(image)
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = want[0] * 2
    f, c = block.reshape(8, 8), lambda u: np.sqrt(0.5) if u == 0 else 1
    s = sum(c(u) * c(v) / 4 * f[u, v] * np.cos((2 * 3 + 1) * u * np.pi / 16) * np.cos((2 * 5 + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    assert abs(int(rgb[3, 5, 0]) - np.clip(round(128 + s), 0, 255)) <= 1


def test_bad_files():
    for bad in (b"", b"PNG", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_columns(spark):
    rows = [(1, "abc", "x"), (2, None, "x"), (3, "", "x"), (None, "äöü" * 5000, "x"), (1, "abc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media_columns(df).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[2].media_sha256 == by[3].media_sha256 and by[2].n_bytes == 0 and by[2].payload_bytes == 576
    for i, text, _ in rows:
        r, p = by[i], padded((text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.rgb) == r.height * r.width * 3
        assert jpeg.payload_of(jpeg.decode(bytes(r.media))) == p
    assert media_columns(df.limit(0), columns=DIGEST).collect() == []
