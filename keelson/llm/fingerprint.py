"""64-bit majority fingerprints of word shingles (pure numpy, runs on executors)."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

#: Shingle hashes that are turned into bit counts at once; bounds memory on very long texts.
CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one whole text.

    A-Z are lower-cased; words are runs of anything but space and \\t..\\r; shingles of
    ``width`` words (repeats included) are joined by one space and hashed with XXH64. A bit is
    set if more than half the hashes have it. Fewer words: the whole sequence is the only
    shingle; null or no words: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
