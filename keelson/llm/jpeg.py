"""Baseline JPEG images, decoded by the tables in their own headers (numpy, runs on executors).

Quantisation and Huffman tables, sampling factors, restart intervals, and scans of one or of several
components are followed; where a frame has no Huffman tables, as in motion-JPEG, the standard's are
used. Progressive, arithmetic-coded, lossless and 12-bit images raise ValueError, and so do broken ones.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the JPEG standard (Annex K): number of codes of each length from 1 to 16, then the symbols in order of code.
DC_COUNTS = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]))
DC_SYMBOLS = bytes(range(12))
AC_COUNTS = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]))
AC_SYMBOLS = (
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")
    + bytes.fromhex("090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a")
    + bytes.fromhex("838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da")
    + bytes.fromhex("e1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
    bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1".replace(" ", ""))
    + bytes.fromhex("1718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a")
    + bytes.fromhex("82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da")
    + bytes.fromhex("e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
)

#: Places of the 64 coefficients in the order in which they are stored: along the diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else -(k // 8))))
#: Rows are the cosines of the transform, scaled to unit length.
COSINES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@lru_cache(maxsize=64)
def huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next: symbol << 5 | length of its code, or 0."""
    table = [0] * 65536
    code = at = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if at >= len(symbols) or code >= 1 << length:
                raise ValueError("broken Huffman table")
            lo, hi = code << 16 - length, code + 1 << 16 - length
            table[lo:hi] = [symbols[at] << 5 | length] * (hi - lo)
            code, at = code + 1, at + 1
        code <<= 1
    return table


class Bits:
    """The bits of one entropy-coded segment, without stuffing."""

    def __init__(self, data: bytes):
        byte = np.frombuffer(data + b"\xff" * 5, np.uint8).astype(np.int64)
        self.words = ((byte[:-3] << 24) | (byte[1:-2] << 16) | (byte[2:-1] << 8) | byte[3:]).tolist()  # 32 bits from each byte
        self.at, self.end = 0, 8 * len(data)

    def peek(self, n: int) -> int:
        if self.at > self.end:
            raise ValueError("scan ends early")
        return (self.words[self.at >> 3] << (self.at & 7) & 0xFFFFFFFF) >> 32 - n

    def symbol(self, table: list[int]) -> int:
        found = table[self.peek(16)]
        if not found:
            raise ValueError("no such code")
        self.at += found & 31
        return found >> 5

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek(n)
        self.at += n
        return v if v >> n - 1 else v - (1 << n) + 1


def block(bits: Bits, dc: list[int], ac: list[int], before: int, out: np.ndarray) -> int:
    """Reads 64 coefficients; the DC, from which the next block's differs."""
    value = before + bits.signed(bits.symbol(dc))
    out[0] = value
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("too many coefficients")
        out[k] = bits.signed(size)
        k += 1
    return value


def segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from ``at`` on, split at restart markers, and where the next other marker begins."""
    out, start = [], at
    while True:
        i = data.find(b"\xff", at)
        if i < 0 or i + 1 >= len(data):
            raise ValueError("no end of image")
        m = data[i + 1]
        if m == 0:
            at = i + 2
        elif m == 0xFF:
            at = i + 1
        else:
            out.append(data[start:i].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= m <= 0xD7:
                return out, i
            at = start = i + 2


class Part:
    """A component: its sampling factors, tables and coefficients."""

    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table


def decode(data: bytes) -> list[np.ndarray]:
    """The planes of an image, each of its component's own resolution."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    quant: dict[int, np.ndarray] = {}
    tables = {(c, i): huffman((DC_COUNTS, AC_COUNTS)[c][i], (DC_SYMBOLS, AC_SYMBOLS[i])[c]) for c in (0, 1) for i in (0, 1)}
    parts: dict[int, Part] = {}
    height = width = restart = 0
    at = 2
    try:
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            while data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide, i = body[0] >> 4, body[0] & 15
                    quant[i] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    tables[body[0] >> 4, body[0] & 15] = huffman(counts, body[17 : 17 + sum(counts)])
                    body = body[17 + sum(counts) :]
            elif marker in (0xC0, 0xC1):
                depth, height, width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not height or not width or not n:
                    raise ValueError("not a baseline image")
                parts = {body[6 + 3 * i]: Part(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
                across, down = (max(getattr(p, x) for p in parts.values()) for x in "hv")
                mcus = (-(-height // (8 * down)), -(-width // (8 * across)))
                for p in parts.values():
                    p.size = (-(-height * p.v // down), -(-width * p.h // across))  # in samples
                    p.coefficients = np.zeros((mcus[0] * p.v, mcus[1] * p.h, 64), np.int64)
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                restart = struct.unpack_from(">H", body)[0]
            elif marker == 0xDA:
                chosen = [(parts[body[1 + 2 * i]], tables[0, body[2 + 2 * i] >> 4], tables[1, body[2 + 2 * i] & 15]) for i in range(body[0])]
                found, at = segments(data, at)
                scan(found, chosen, restart, mcus)
    except (IndexError, KeyError, struct.error, UnboundLocalError) as e:
        raise ValueError(f"broken image: {e}") from e
    if not parts:
        raise ValueError("no frame")
    out = []
    for p in parts.values():
        if p.table not in quant:
            raise ValueError("no quantisation table")
        flat = np.zeros(p.coefficients.shape)
        flat[:, :, ZIGZAG] = p.coefficients * quant[p.table]
        pixels = np.einsum("ux,abuv,vy->axby", COSINES, flat.reshape(*flat.shape[:2], 8, 8), COSINES, optimize=True)
        plane = np.clip(np.rint(pixels.reshape(8 * flat.shape[0], 8 * flat.shape[1])) + 128, 0, 255).astype(np.uint8)
        out.append(plane[: p.size[0], : p.size[1]])
    return out


def scan(found: list[bytes], chosen: list, restart: int, mcus: tuple[int, int]) -> None:
    """Reads the coefficients of one scan into its components."""
    if len(chosen) == 1:  # one component: its own blocks, without the padding to whole units
        p = chosen[0][0]
        rows, columns = (-(-s // 8) for s in p.size)
        units = [[(0, r, c)] for r in range(rows) for c in range(columns)]
    else:
        units = [[(i, my * p.v + y, mx * p.h + x) for i, (p, _, _) in enumerate(chosen) for y in range(p.v) for x in range(p.h)] for my in range(mcus[0]) for mx in range(mcus[1])]
    step = restart or len(units)
    if len(found) < -(-len(units) // step):
        raise ValueError("scan ends early")
    for segment, at in zip(found, range(0, len(units), step)):
        bits, before = Bits(segment), [0] * len(chosen)
        for unit in units[at : at + step]:
            for i, r, c in unit:
                p, dc, ac = chosen[i]
                before[i] = block(bits, dc, ac, before[i], p.coefficients[r, c])
