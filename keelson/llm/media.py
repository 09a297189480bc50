"""AVI motion-JPEG: write, parse, decode, and cut at shots.

``clips`` reads a column of AVI files: RIFF lists and the frame index are parsed, every frame is an
intra frame of its own and is decoded by the tables in its headers (``jpeg``), and shots are cut
where the difference of neighbouring frames' histograms exceeds the mean of the differences around
it by a multiple of their deviation: one timed row per clip.

``round_trip`` stores bytes as such files. A frame is a grey baseline JPEG of 16 x 12 blocks. Each
block is flat: its DC coefficient is one 8-bit sample, quantised by 8, so the sample survives
exactly; the decoded frame shows the samples as blocks of 8 x 8 pixels. Frames use the standard
Huffman tables, which motion-JPEG leaves out of the stream. ``decode_frames`` reads the
entropy-coded segments of many frames with just these headers in step, one symbol of all frames at
a time, STEP frames at once; it is the same decoding as ``jpeg``'s, in numpy.

Defined results: null counts as empty for ``round_trip``; an empty text is one frame of bytes 32;
equal texts give equal values; repeated rows are each reported; a null or broken file gives one row
with ``error``, and clips of the frames before the broken one are not reported; columns of other
names pass through, those named like a result keep their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import fresh, slices

#: Frames that are encoded or decoded at once; bounds memory on very long texts.
STEP = 4096
COLUMNS, ROWS = 16, 12
FRAME = COLUMNS * ROWS
RATE = 25  # frames a second
#: Bins of a frame's histogram; frames before and after that a difference is held against; how far it must stand out.
BINS, AROUND, FACTOR, FLOOR = 16, 8, 3.0, 0.35

# Fixed values of the JPEG standard: lengths of the luminance DC codes by category, and the end-of-block code.
DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9)
END_OF_BLOCK, END_BITS = 0b1010, 4


def dc_codes() -> list[tuple[int, int]]:
    """(code, length) by category: canonical codes of the lengths."""
    code, last, out = 0, DC_LENGTHS[0], []
    for n in DC_LENGTHS:
        code <<= n - last
        out.append((code, n))
        code, last = code + 1, n
    return out


def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a difference of -255..255 with the end of its block."""
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = dc_codes()[n]
        extra = d if d >= 0 else d + (1 << n) - 1
        bits[d + 255] = ((code << n | extra) << END_BITS) | END_OF_BLOCK
        sizes[d + 255] = length + n + END_BITS
    return bits, sizes


SYMBOL_BITS, SYMBOL_SIZES = symbol_table()


def decode_table() -> tuple[np.ndarray, np.ndarray]:
    """Category and code length by the next 9 bits."""
    category, length = np.zeros(512, np.int64), np.zeros(512, np.int64)
    for n, (code, size) in enumerate(dc_codes()):
        category[code << 9 - size : code + 1 << 9 - size], length[code << 9 - size : code + 1 << 9 - size] = n, size
    return category, length


CATEGORY, CODE_LENGTH = decode_table()


def jpeg_head() -> bytes:
    """Markers before a frame's entropy-coded data."""
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] + [1] * 63)
    frame = b"\xff\xc0" + struct.pack(">HBHHB3B", 11, 8, ROWS * 8, COLUMNS * 8, 1, 1, 0x11, 0)
    scan = b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 0, 63, 0)
    return b"\xff\xd8" + quant + frame + scan


HEAD, TAIL = jpeg_head(), b"\xff\xd9"


def pad(raw: bytes) -> bytes:
    return raw + b" " * ((-len(raw)) % FRAME or (0 if raw else FRAME))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames x 192 samples."""
    n = len(samples)
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    bits, sizes = SYMBOL_BITS[diff], SYMBOL_SIZES[diff]
    ends = np.cumsum(sizes, axis=1)
    width = (ends[:, -1] + 7) // 8
    base = np.cumsum(width + 4) - (width + 4)  # room for the last symbol's spill
    at = ends - sizes
    byte = (base[:, None] + (at >> 3)).ravel()
    word = (bits << (32 - (at & 7) - sizes)).ravel()  # at most 7 + 20 bits
    total = int(base[-1] + width[-1] + 4)
    out = np.zeros(total, np.int64)
    for k in range(4):
        out += np.bincount(byte + k, (word >> (24 - 8 * k)) & 255, total).astype(np.int64)[:total]
    last = base + width - 1
    free = width * 8 - ends[:, -1]
    out[last] |= (1 << free) - 1
    data = out.astype(np.uint8).tobytes()
    return [HEAD + data[b : b + w].replace(b"\xff", b"\xff\x00") + TAIL for b, w in zip(base.tolist(), width.tolist())] if n else []


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file of JPEG frames with an idx1 index."""
    w, h = COLUMNS * 8, ROWS * 8
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


@dataclass(frozen=True)
class Clip:
    width: int
    height: int
    rate: float
    frames: list[bytes]


def parse_avi(data: bytes) -> Clip:
    """Frames of a RIFF AVI file, by its idx1 index, or by walking its movi lists where there is none.

    Offsets of the index count from the movi list, or from the file's begin, as the first entry shows.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    width = height = 0
    rate, movi, index = float(RATE), [], None
    video = lambda name: name[2:] in (b"dc", b"db")

    def chunks(at: int, end: int):
        while at + 8 <= min(end, len(data)):
            size = struct.unpack_from("<I", data, at + 4)[0]
            yield data[at : at + 4], at + 8, size
            at += 8 + size + (size & 1)

    def walk(at: int, end: int):
        nonlocal width, height, rate, index
        for name, body, size in chunks(at, end):
            if name in (b"LIST", b"RIFF"):
                if data[body : body + 4] == b"movi":
                    movi.append((body, body + size))
                else:
                    walk(body + 4, body + size)
            elif name == b"avih":
                width, height = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, r = struct.unpack_from("<II", data, body + 20)
                rate = r / max(1, scale) or float(RATE)
            elif name == b"idx1":
                index = (body, body + size)

    def frames_in(at: int, end: int):
        for name, body, size in chunks(at, end):
            if name == b"LIST":  # groups of chunks that are read together
                yield from frames_in(body + 4, body + size)
            elif video(name) and size:
                yield data[body : body + size]

    try:
        walk(12, len(data))
        if not movi:
            raise ValueError("no movi list")
        if index:
            entries = [(at, size) for name, _, at, size in struct.iter_unpack("<4sIII", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]) if video(name) and size]
            base = movi[0][0] if entries and video(data[movi[0][0] + entries[0][0] :][:4]) else 0
            frames = [data[base + at + 8 : base + at + 8 + size] for at, size in entries]
        else:
            frames = [f for a, b in movi for f in frames_in(a + 4, b)]
    except struct.error as e:
        raise ValueError(f"broken file: {e}") from e
    return Clip(width, height, rate, frames)


def scan_data(frame: bytes) -> bytes:
    """A frame's entropy-coded bytes, without stuffing; its headers must be those that ``encode_frames`` writes."""
    if not frame.startswith(HEAD) or not frame.endswith(TAIL):
        raise ValueError("not a frame of flat blocks")
    return frame[len(HEAD) : -2].replace(b"\xff\x00", b"\xff")


def decode_frames(frames: list[bytes], blocks: int = FRAME) -> np.ndarray:
    """frames x blocks samples: the DC image of each frame."""
    scans = [scan_data(f) for f in frames]
    sizes = np.fromiter(map(len, scans), np.int64, len(scans))
    data = np.frombuffer(b"".join(scans) + b"\xff" * 8, np.uint8).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte
    at = (np.cumsum(sizes) - sizes) * 8
    value = np.full(len(frames), 128, np.int64)
    out = np.zeros((blocks, len(frames)), np.uint8)
    bad = np.zeros(len(frames), bool)
    for i in range(blocks):
        word = (window[at >> 3] << (at & 7)) & 0xFFFFFFFF
        top = word >> 23
        n, length = CATEGORY[top], CODE_LENGTH[top]
        extra = (word >> (32 - length - n)) & ((1 << n) - 1)
        value = value + np.where(extra >> np.maximum(n - 1, 0) == 0, extra - ((1 << n) - 1), extra)
        bad |= (word >> (28 - length - n)) & 15 != END_OF_BLOCK
        at = at + length + n + END_BITS
        out[i] = value
    if bad.any():
        raise ValueError("a frame has other coefficients than DC")
    return out.T


def histograms(samples: np.ndarray) -> np.ndarray:
    """Share of each frame's samples in each of BINS bins."""
    n = len(samples)
    at = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of each shot, from the frames' histograms."""
    n = len(hist)
    if n < 2:
        return [(0, n)] if n else []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    sums, squares = np.cumsum([0, *d]), np.cumsum([0, *d * d])
    i = np.arange(n - 1)
    lo, hi = np.maximum(i - AROUND, 0), np.minimum(i + AROUND + 1, n - 1)
    others = np.maximum(hi - lo - 1, 1)
    mean = (sums[hi] - sums[lo] - d) / others
    deviation = np.sqrt(np.maximum((squares[hi] - squares[lo] - d * d) / others - mean * mean, 0))
    cuts = (np.flatnonzero(d > np.maximum(mean + FACTOR * deviation, FLOOR)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def timed(hist: np.ndarray, means: np.ndarray, rate: float) -> list[dict]:
    """Clips: their frames, seconds, and mean brightness."""
    return [{"clip": i, "first": x, "end": y, "start_s": x / rate, "end_s": y / rate, "level": round(float(means[x:y].mean()), 3)} for i, (x, y) in enumerate(shots(hist))]


SCHEMA = "media binary, payload binary, frames int, clips array<struct<clip:int,first:int,end:int,start_s:double,end_s:double,level:double>>"


def store(raws: list[bytes]) -> list[bytes]:
    """AVI files of byte strings; the frames of all are encoded together."""
    padded = [pad(r) for r in raws]
    counts = [len(p) // FRAME for p in padded]
    samples = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME)
    frames = [f for i in range(0, len(samples), STEP) for f in encode_frames(samples[i : i + STEP])]
    ends = np.cumsum([0, *counts]).tolist()
    return [write_avi(frames[a:b]) for a, b in zip(ends, ends[1:])]


def load(files: list[bytes]) -> list[tuple[bytes, list[dict]]]:
    """Payload and timed clips of the files that ``store`` writes; the frames of all are decoded together."""
    parsed = [parse_avi(f) for f in files]
    frames = [f for c in parsed for f in c.frames]
    samples = np.concatenate([np.zeros((0, FRAME), np.uint8), *(decode_frames(frames[i : i + STEP]) for i in range(0, len(frames), STEP))])
    ends = np.cumsum([0, *(len(c.frames) for c in parsed)]).tolist()
    out = []
    for c, a, b in zip(parsed, ends, ends[1:]):
        own = np.ascontiguousarray(samples[a:b])
        out.append((own.tobytes(), timed(histograms(own), own.mean(axis=1), c.rate)))
    return out


def clip_rows(data: bytes | None) -> list[dict]:
    """Timed clips of one file, its brightness decoded frame by frame; one row with an error for a broken file."""
    try:
        if data is None:
            raise ValueError("no file")
        parsed = parse_avi(data)
        hist, means = [], []
        for f in parsed.frames:
            plane = jpeg.decode(f)[0].reshape(1, -1)
            hist.append(histograms(plane)[0])
            means.append(plane.mean())
        if not hist:
            raise ValueError("no frames")
        return [{**c, "error": None} for c in timed(np.array(hist), np.array(means), parsed.rate)]
    except ValueError as e:
        return [{"error": str(e)}]


CLIPS = "clip int, first int, end int, start_s double, end_s double, level double, error string"


def clips(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per clip of each AVI file in a binary column, beside the other columns; one row with ``error`` for a broken file."""
    from pyspark.sql.types import StructType

    kept = [c for c in files.columns if c != media_col]
    extra = StructType.fromDDL(CLIPS)
    names = [fresh(c, files.columns) for c in extra.names]
    own = fresh("__media", files.columns)
    schema = StructType([*files.select(*kept).schema.fields, *[type(f)(n, f.dataType) for f, n in zip(extra.fields, names)]])

    def run(batches):
        import pyspark.sql.pandas.types as types

        arrow = [types.to_arrow_type(f.dataType) for f in extra.fields]
        for batch in slices(batches, 16):
            for i in range(batch.num_rows):
                rows = clip_rows(batch.column(batch.num_columns - 1)[i].as_py())
                same = batch.slice(i, 1).take(pa.array([0] * len(rows)))
                yield pa.RecordBatch.from_arrays([*same.columns[:-1], *[pa.array([r.get(c) for r in rows], t) for c, t in zip(extra.names, arrow)]], [*batch.schema.names[:-1], *names])

    return files.select(*kept, F.col(media_col).alias(own)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` without the text, with media, payload read back, frames and timed clips of each.

    digests: only their sizes, checksums and a feature string, so that no file leaves the worker.
    """
    own = fresh("__text", docs.columns)
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept).schema
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if digests else SCHEMA)
    names = [fresh(c, docs.columns) for c in extra.names]

    def run(batches):
        for batch in slices(batches, 256, 1 << 20):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            files = store(raws)
            read = load(files)
            if digests:
                rows = [
                    [len(r) for r in raws],
                    [len(p) for p, _ in read],
                    [hashlib.sha256(p).hexdigest() for p, _ in read],
                    [zlib.crc32(p[-16:]) for p, _ in read],
                    [len(f) for f in files],
                    [hashlib.sha256(f).hexdigest() for f in files],
                    [f"frames={len(p) // FRAME};shots={len(c)};cuts={','.join(str(x['first']) for x in c)};level={c[0]['level']}" for p, c in read],
                ]
                arrays = [pa.array(r, pa.string() if isinstance(r[0], str) else pa.int64()) for r in rows]
            else:
                kind = pa.list_(pa.struct([("clip", pa.int32()), ("first", pa.int32()), ("end", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64())]))
                arrays = [pa.array(files, pa.binary()), pa.array([p for p, _ in read], pa.binary()), pa.array([len(p) // FRAME for p, _ in read], pa.int32()), pa.array([c for _, c in read], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], *names])

    return docs.select(*kept, F.col(text_col).cast("string").alias(own)).mapInArrow(run, StructType([*schema.fields, *[type(f)(n, f.dataType) for f, n in zip(extra.fields, names)]]))
