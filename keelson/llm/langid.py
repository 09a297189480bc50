"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

One model of order 4 per language, over lower-case letters and marks with everything else as one
space. The n-grams of up to GROUP languages share sorted arrays of 64-bit hashes (a bijection, so
there are no collisions) with a row of log-probabilities by language; further languages get arrays
of their own, so none is left out. N-grams that no language has seen fall back through the
languages' interpolation weights. A text's language has the lowest cross-entropy per character.
``rejected`` marks texts whose cross-entropy is above the REJECT quantile of texts of that language
that its model was not fitted on (every fifth of the sample; of all, where there are under 20).

The models are fitted on at most about PER_LANGUAGE texts of each language, chosen by a hash of
doc_id, and SAMPLE_BYTES in all; every text is scored whole. Defined results: null texts and texts
without a letter are ``und`` with score 0, and rejected; languages tie by name; repeated rows get the
same answer; columns of other names pass through, those named like a result keep their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices

ORDER, DISCOUNT = 4, 0.75
#: Texts of each language, and bytes of all, to fit on; languages that share arrays.
PER_LANGUAGE, SAMPLE_BYTES, GROUP = 1000, 128 << 20, 64
#: Bits of a character code: 0 is a space, 1 a letter that no fitted text has.
BITS = 16
REJECT = 0.999
ODD = np.uint64(0x9E3779B97F4A7C15)


def hashed(keys: np.ndarray) -> np.ndarray:
    return keys * ODD


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, 0 for the rest."""
    every = map(chr, range(0x110000))
    return np.fromiter((2 if c.isalpha() else unicodedata.category(c)[0] == "M" for c in every), np.uint8, 0x110000)


class Codes:
    """Texts as arrays of character codes: 0 anything but letters and marks (runs become one)."""

    def __init__(self, letters: str):
        self.table = (kinds() > 0).astype(np.uint16)
        self.table[[ord(c) for c in letters]] = np.arange(2, 2 + len(letters))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all texts end to end, each begun by a space, the text of each code, and which texts have a letter."""
        lowered = [" " + t.lower() for t in texts]
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
        codes, doc = self.table[points], np.repeat(np.arange(len(texts)), sizes)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (doc[1:] != doc[:-1])
        lettered = np.bincount(doc, kinds()[points] == 2, len(texts)) > 0
        return codes[keep], doc[keep], lettered


def low(n: int) -> np.uint64:
    """Mask of the last n characters of a key."""
    return np.uint64((1 << BITS * n) - 1)


def grams(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each code; characters before a text count as spaces."""
    out = codes.astype(np.uint64)
    for back in range(1, n):
        before = np.zeros(len(codes), np.uint64)
        before[back:] = np.where(doc[back:] == doc[:-back], codes[:-back], 0)
        out |= before << np.uint64(BITS * back)
    return out


class Sorted:
    """Rows of floats by key, in an array sorted by the keys' hash."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashed(keys))
        self.hashes, self.rows = hashed(keys)[order], rows[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.hashes):
            return np.full(len(keys), -1)
        h = hashed(keys)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


class Group:
    """Models of some languages over one alphabet of ``size`` codes."""

    def __init__(self, coder: Codes, texts: list[list[str]], size: int):
        self.n, self.size = len(texts), size
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for ts in texts:
            codes, doc, _ = coder.of(ts)
            levels = [np.unique(grams(codes, doc, ORDER), return_counts=True)]
            for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters before an n-gram
                levels.insert(0, np.unique(levels[0][0] & low(n), return_counts=True))
            counts.append(levels)
        self.probs: list[Sorted] = []  # by order: log-probability of the last character
        self.back: list[Sorted] = []  # by length of context: log-weight of the shorter context
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c[n - 1][0] for c in counts]))
            contexts = np.unique(keys >> np.uint64(BITS))
            at = np.searchsorted(contexts, keys >> np.uint64(BITS))
            short = np.exp(self.log_probs(keys & low(n - 1), n - 1))
            p, back = np.zeros((len(keys), self.n)), np.ones((len(contexts), self.n))
            for i in range(self.n):
                seen, cnt = counts[i][n - 1]
                have = np.zeros(len(keys))
                have[np.searchsorted(keys, seen)] = cnt
                total = np.bincount(at, have, len(contexts))
                after = np.bincount(at, have > 0, len(contexts))
                safe = np.maximum(total, 1)
                back[:, i] = np.where(total > 0, DISCOUNT * after / safe, 1.0)
                p[:, i] = np.maximum(have - DISCOUNT, 0) / safe[at] + back[at, i] * short[:, i]
            self.probs.append(Sorted(keys, np.log(p)))
            self.back.append(Sorted(contexts, np.log(back)))

    def log_probs(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(keys), self.n), -np.log(self.size), np.float32)
        at = self.probs[n - 1].find(keys)
        out = self.probs[n - 1].rows[at]
        if len(miss := np.flatnonzero(at < 0)):
            k = keys[miss]
            context = self.back[n - 1].find(k >> np.uint64(BITS))
            weight = np.where(context[:, None] >= 0, self.back[n - 1].rows[context], np.float32(0))
            out[miss] = weight + self.log_probs(k & low(n - 1), n - 1)
        return out


class Model:
    def __init__(self, texts: dict[str, list[str]]):
        """texts: by language."""
        self.languages, self.letters = sorted(texts), ""
        if not texts:
            return
        seen: Counter[str] = Counter()
        for ts in texts.values():
            for t in ts:
                seen.update(t.lower())
        known = kinds()
        self.letters = "".join(sorted(c for c, _ in seen.most_common() if known[ord(c)])[: (1 << BITS) - 2])
        coder = Codes(self.letters)
        spare = {x: [t for i, t in enumerate(ts) if i % 5 == 4] if len(ts) >= 20 else ts for x, ts in texts.items()}
        used = {x: [t for i, t in enumerate(ts) if i % 5 != 4] if len(ts) >= 20 else ts for x, ts in texts.items()}
        self.groups = [Group(coder, [used[x] for x in self.languages[i : i + GROUP]], len(self.letters) + 2) for i in range(0, len(self.languages), GROUP)]
        fits = [self.entropies(*coder.of(spare[x])[:2], len(spare[x]))[:, i] for i, x in enumerate(self.languages)]
        self.limits = np.array([np.quantile(f, REJECT) if len(f) else np.inf for f in fits])

    def entropies(self, codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Cross-entropy per character of n coded texts by language."""
        keys = grams(codes, doc, ORDER)
        sizes = np.bincount(doc, minlength=n)
        starts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(g.log_probs(keys, ORDER), starts, axis=0, dtype=np.float64) if n else np.zeros((0, g.n)) for g in self.groups]
        return -np.concatenate(sums, axis=1) / sizes[:, None]


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part


def bounded_sample(rows: DataFrame, by: str, per: int, id_col: str = "doc_id", seed: int = 5) -> DataFrame:
    """About ``per`` rows of each value of ``by``, chosen by a hash of the id.

    Nothing is shuffled but one count a value; these counts are few where the values are labels.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    share = counts.select(F.col(by).alias("by_"), F.least(F.lit(1.0), F.lit(float(per)) / F.col("n")).alias("share_"))
    u = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(share, F.col(by) == F.col("by_")).filter(u < F.col("share_")).select(rows.columns)


def bounded_texts(rows: DataFrame, per: int, size: int) -> dict:
    """Texts of ``rows`` (key, text) by key: at most ``per`` of each key, and about ``size`` characters in all.

    Rows come to the driver one partition at a time; texts are long and short alike, and whole.
    """
    out: dict = {}
    for r in rows.toLocalIterator():
        texts = out.setdefault(r[0], [])
        if len(texts) < per and len(r[1]) <= size:
            texts.append(r[1])
            size -= len(r[1])
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    return Model(bounded_texts(bounded_sample(rows, "lang", per_language).select("lang", "text"), 2 * per_language, SAMPLE_BYTES))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred, score and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = fresh("__text", docs.columns)
    kept = [c for c in docs.columns if c != text_col]
    added = [fresh(c, docs.columns) for c in ("lang_pred", "score", "rejected")]

    def run(batches):
        m = sent.value
        coder = Codes(m.letters)
        names = [*m.languages, "und"]
        for batch in slices(batches, 256, 2 << 20):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            codes, doc, lettered = coder.of(texts)
            if m.languages:
                h = m.entropies(codes, doc, len(texts))
                best = h.argmin(axis=1)
                least = h[np.arange(len(texts)), best]
                n = np.bincount(doc, minlength=len(texts))
                # likelihood of the best among all, as if 40 characters at most were independent
                score = 1 / np.exp(np.minimum(n, 40)[:, None] * (least[:, None] - h)).sum(axis=1)
                rejected = least > m.limits[best]
            else:
                best, score, rejected = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
                lettered[:] = False
            pick = np.where(lettered, best, len(names) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([names[i] for i in pick]), pa.array(np.where(lettered, score, 0.0)), pa.array(rejected | ~lettered)], [*batch.schema.names[:-1], *added])

    schema = docs.select(*kept).withColumns(dict(zip(added, (F.lit(""), F.lit(0.0), F.lit(True))))).schema
    return docs.select(*kept, F.col(text_col).cast("string").alias(own)).mapInArrow(run, schema)
