"""Motion-JPEG: images of any baseline kind against what was encoded, and tables of AVI files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import jpeg, media


def put_bits(pairs):
    text = "".join(format(v, f"0{n}b") if n else "" for v, n in pairs)
    text += "1" * (-len(text) % 8)
    return int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def codes(counts, symbols):
    out, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[symbols[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def amplitude(v):
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1, n)


def encode(planes, sampling, quant, restart=0, tables=True, interleaved=True):
    """A plain JPEG encoder: planes of each component's own resolution, whole units only."""
    dc = [codes(jpeg.DC_COUNTS[i], jpeg.DC_SYMBOLS) for i in (0, 1)]
    ac = [codes(jpeg.AC_COUNTS[i], jpeg.AC_SYMBOLS[i]) for i in (0, 1)]
    height, width = planes[0].shape
    top, left = (max(s[k] for s in sampling) for k in (1, 0))
    coefficients = []
    for p in planes:
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).astype(float) - 128
        spread = np.einsum("ux,abxy,vy->abuv", jpeg.COSINES, blocks, jpeg.COSINES)
        coefficients.append(np.rint(spread.reshape(*blocks.shape[:2], 64)[:, :, jpeg.ZIGZAG] / quant).astype(int))
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes(quant.tolist())
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, height, width, len(planes))
    out += b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    if tables:
        for c, (counts, symbols) in enumerate(((jpeg.DC_COUNTS, (jpeg.DC_SYMBOLS,) * 2), (jpeg.AC_COUNTS, jpeg.AC_SYMBOLS))):
            for i in (0, 1):
                out += b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols[i]), c << 4 | i) + counts[i] + symbols[i]
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    scans = [range(len(planes))] if interleaved else [[i] for i in range(len(planes))]
    for chosen in scans:
        out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(chosen), len(chosen)) + b"".join(bytes([i + 1, (i > 0) * 0x11]) for i in chosen) + bytes([0, 63, 0])
        if len(chosen) > 1:
            units = [[(i, my * sampling[i][1] + y, mx * sampling[i][0] + x) for i in chosen for y in range(sampling[i][1]) for x in range(sampling[i][0])] for my in range(height // (8 * top)) for mx in range(width // (8 * left))]
        else:
            shape = coefficients[chosen[0]].shape
            units = [[(chosen[0], r, c)] for r in range(shape[0]) for c in range(shape[1])]
        step = restart or len(units)
        for k, at in enumerate(range(0, len(units), step)):
            before, bits = {}, []
            for unit in units[at : at + step]:
                for i, r, c in unit:
                    z, t = coefficients[i][r, c], int(i > 0)
                    v, n = amplitude(int(z[0]) - before.get(i, 0))
                    before[i] = int(z[0])
                    bits += [dc[t][n], (v, n)]
                    run = 0
                    for x in z[1 : 1 + max(np.flatnonzero(z[1:]), default=-1) + 1].tolist():
                        if not x:
                            run += 1
                            continue
                        while run > 15:
                            bits.append(ac[t][0xF0])
                            run -= 16
                        v, n = amplitude(x)
                        bits += [ac[t][run << 4 | n], (v, n)]
                        run = 0
                    if not z[63]:
                        bits.append(ac[t][0])
            out += put_bits(bits) + (bytes([0xFF, 0xD0 + k % 8]) if at + step < len(units) else b"")
    return out + b"\xff\xd9"


def picture(height, width, seed=0):
    y, x = np.mgrid[:height, :width]
    noise = np.random.default_rng(seed).integers(-20, 20, (height, width))
    return np.clip(128 + 60 * np.sin(x / 9 + seed) + 50 * np.cos(y / 7) + noise, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("tables", [True, False])
@pytest.mark.parametrize("interleaved", [True, False])
def test_baseline_images(restart, tables, interleaved):
    planes = [picture(48, 64), picture(24, 32, 1), picture(24, 32, 2)]
    data = encode(planes, [(2, 2), (1, 1), (1, 1)], np.full(64, 2), restart, tables, interleaved)
    for a, b in zip(planes, jpeg.decode(data)):
        assert a.shape == b.shape and np.abs(a.astype(int) - b).max() <= 6
    coarse = jpeg.decode(encode(planes[:1], [(1, 1)], np.arange(8, 72), restart, tables))[0]
    assert np.abs(planes[0].astype(int) - coarse).mean() < 12


def test_broken_images_raise():
    good = encode([picture(16, 16)], [(1, 1)], np.full(64, 3))
    for bad in (b"", b"\xff\xd8", good[:-40], good.replace(b"\xff\xc0", b"\xff\xc2"), b"\xff\xd8" + b"\x00" * 50):
        with pytest.raises(ValueError):
            jpeg.decode(bad)
    rng = np.random.default_rng(1)
    for _ in range(300):  # no other error, whatever the bytes
        raw = bytearray(good)
        for at in rng.integers(0, len(raw), 4):
            raw[at] = rng.integers(0, 256)
        try:
            jpeg.decode(bytes(raw))
        except ValueError:
            pass


def test_fast_and_general_decoder_agree():
    samples = np.random.default_rng(2).integers(0, 256, (5, media.FRAME), dtype=np.uint8)
    for frame, row in zip(media.encode_frames(samples), samples):
        assert (jpeg.decode(frame)[0][::8, ::8].ravel() == row).all()
    assert (media.decode_frames(media.encode_frames(samples)) == samples).all()


def test_clips_of_a_table(spark):
    frames = [encode([np.full((16, 16), v, np.uint8)], [(1, 1)], np.full(64, 2)) for v in [10] * 9 + [200] * 6]
    file = media.write_avi(frames)
    absolute = file.replace(b"idx1", b"junk")  # without an index the movi list is walked
    df = spark.createDataFrame([(1, file, "x"), (2, absolute, "y"), (3, b"RIFF", "z"), (4, None, None), (5, file[:-400], "t")], "id long, media binary, clip string")
    rows = media.clips(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r)
    for i in (1, 2):
        assert [(r.first, r.end, r.start_s, r.end_s, r.level) for r in got[i]] == [(0, 9, 0.0, 0.36, 10.0), (9, 15, 0.36, 0.6, 200.0)]
        assert [r.clip_ for r in got[i]] == [0, 1] and got[1][0].clip == "x" and got[i][0].error is None
    assert got[3][0].error and got[4][0].error == "no file" and len(got[3]) == len(got[4]) == 1
    assert media.clips(df.limit(0)).count() == 0


def test_round_trip_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "abc" * 1000, "mine", 7)], "doc_id long, text string, payload string, frames int")
    r = media.round_trip(df).first()
    assert r.payload == "mine" and r.frames == 7 and bytes(r.payload_) == media.pad(b"abc" * 1000) and r.frames_ == 16
    assert media.round_trip(df.limit(0), digests=True).filter(F.col("n_bytes") > 0).count() == 0
