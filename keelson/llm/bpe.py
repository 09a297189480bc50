"""BPE encoding and decoding with a lexicon automaton for frequent words.

Frequent words are compiled, with the ids that merging gives them, into a minimal acyclic
transducer (``lexicon``); each Python worker maps its image and walks it for all new words of a
batch in step. Words that it lacks are merged exactly, pair by pair, so the result never depends
on which words were compiled.

Defined results: a null text counts as empty (no tokens, empty decoding); special-token strings
in a text become their ids, as the library does; rows may repeat; other columns pass untouched.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices
from .lexicon import Lexicon, build

#: Unicode white space, as the tokenizer's own pattern language sees it (no U+001C to U+001F).
SPACE = "\t-\r \x85\xa0  -     　"
#: A word that makes up this share of all words is certain to be compiled.
SHARE = 2e-5
#: Words that the lexicon holds beside the vocabulary's own whole words; the others are merged.
CAPACITY = 65_536
#: Texts encoded at once, and texts' distinct chunks that a worker remembers.
ROWS, REMEMBERED = 512, 400_000
#: Words of more bytes are merged one by one. The rank of pairs that do not merge.
LONG, NONE = 64, 2**31 - 1


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Lists:
    """Many lists of integers, end to end in one array."""

    def __init__(self):
        self.flat, self.lens, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, lens: np.ndarray):
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.lens = np.concatenate([self.lens, lens.astype(np.int64)])
        self.starts = np.cumsum(self.lens) - self.lens

    def take(self, at: np.ndarray) -> Lists:
        out = Lists()
        each = self.lens[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out.add(self.flat[np.repeat(self.starts[at] - (ends - each), each) + np.arange(total)], each)
        return out

    def to_lists(self) -> list[list[int]]:
        flat, starts = self.flat.tolist(), self.starts.tolist()
        return [flat[a : a + n] for a, n in zip(starts, self.lens.tolist())]


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file; small and of fixed size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.firsts = np.array([self.ids[c] for c in self.letters], np.int64)
        self.lasts = np.array([self.ids[c + self.end] for c in self.letters], np.int64)
        self.size = max(self.ids.values()) + 1
        keys = np.array([self.ids[a] * self.size + self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int32)  # a merge's rank is its place in the file
        self.pair_made = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == want, self.pair_ranks[at], NONE).astype(np.int32)

    def merge_all(self, words: list[bytes]) -> Lists:
        """Ids of many words, merged in step: in every round each word merges its pair of lowest rank, leftmost first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        flats, lens, at = [], [], 0
        while at < len(order):
            group = order[at : at + 4096]
            if sizes[group[0]] > LONG:
                group = group[:1]
                flat = np.array(self.merge_long(words[group[0]]), np.int64)
                each = np.array([len(flat)])
            else:
                group = group[sizes[group] <= LONG]
                flat, each = self.merge_block([words[i] for i in group.tolist()], int(sizes[group[-1]]))
            at += len(group)
            flats.append(flat)
            lens.append(each)
        out = Lists()
        if flats:
            out.add(np.concatenate(flats), np.concatenate(lens))
        return out.take(np.argsort(order))

    def merge_block(self, words: list[bytes], width: int) -> list[list[int]]:
        n, cols = len(words), width + 2  # a border column on each side
        sizes = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        symbol = np.full((n, cols), -1, np.int64)
        symbol[:, 1:-1] = self.firsts[data]
        symbol[np.arange(n), sizes] = self.lasts[data[np.arange(n), sizes - 1]]
        symbol[:, 1:-1][np.arange(width) >= sizes[:, None]] = -1
        rank = np.full((n, cols), NONE, np.int32)
        both = (symbol[:, :-1] >= 0) & (symbol[:, 1:] >= 0)
        rank[:, :-1][both] = self.rank_of(symbol[:, :-1][both], symbol[:, 1:][both])
        after = np.tile(np.arange(1, cols + 1), (n, 1))
        before = np.tile(np.arange(-1, cols - 1), (n, 1))
        rows = np.arange(n)
        while True:
            i = rank[rows].argmin(axis=1)
            live = rank[rows, i] != NONE
            rows, i = rows[live], i[live]
            if not len(rows):
                break
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            symbol[rows, i] = self.pair_made[rank[rows, i]]
            symbol[rows, j] = -1
            rank[rows, j] = NONE
            after[rows, i] = k
            before[rows, k] = i
            me, right, left = symbol[rows, i], symbol[rows, k], symbol[rows, h]
            rank[rows, i] = np.where(right >= 0, self.rank_of(me, right), NONE)
            rank[rows, h] = np.where(left >= 0, self.rank_of(left, me), NONE)
        kept = symbol >= 0
        return symbol[kept], kept.sum(axis=1)

    def merge_long(self, word: bytes) -> list[int]:
        """One long word, with a heap over a linked list."""
        import heapq

        parts = [self.letters[b] for b in word]
        parts[-1] += self.end
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [self.ids[p] for p in parts if p and p in self.ids]

    def whole_words(self) -> dict[bytes, list[int]]:
        """The vocabulary's own whole words that merging turns into just their token."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        found = {}
        for token, i in self.ids.items():
            body = token.removesuffix(self.end) if self.end and token.endswith(self.end) else ""
            if body and all(c in byte_of for c in body):
                found[bytes(byte_of[c] for c in body)] = [i]
        return {w: ids for (w, ids), made in zip(found.items(), self.merge_all(list(found)).to_lists()) if made == ids}


class Codec:
    """Encoder and decoder of one worker: vocabulary, mapped lexicon, and remembered chunks."""

    def __init__(self, vocabulary: Vocabulary, image: bytes):
        import regex

        self.v, self.lexicon = vocabulary, Lexicon.mapped(image)
        names = {i: t for t, i in [*vocabulary.ids.items(), *vocabulary.special.items()]}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.split = re.compile(f"[{SPACE}]+").split
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.forget()

    def forget(self):
        self.slot: dict[str, int] = {}
        self.lists = Lists()

    def chunks(self, text: str) -> list[str]:
        """White-space-free parts of the normalised text; a special token is a part of its own."""
        if self.special and any(s in text for s in self.v.special):
            parts = self.special.split(text)
            return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else self.chunks_of(p))]
        return self.chunks_of(text)

    def chunks_of(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        text = text.lower()
        if re.search("[\x1c-\x1f]", text):
            return [c for c in self.split(text) if c]
        return text.split()

    def learn(self, chunks: list[str]):
        """Encode chunks that aren't remembered yet."""
        special = self.v.special
        cut = [[c] if c.isalpha() else [] if c in special else self.pieces(c) for c in chunks]
        place: dict[str, int] = {}
        at = [place.setdefault(p, len(place)) for ps in cut for p in ps]
        raw = [p.encode("utf-8", "surrogatepass") for p in place]
        found = self.lexicon.find(raw)
        unseen = np.flatnonzero(found < 0)
        known = Lists()
        known.add(self.lexicon.ids, np.diff(self.lexicon.starts))
        merged = self.v.merge_all([raw[i] for i in unseen.tolist()])
        known.add(merged.flat, merged.lens)
        found[unseen] = len(self.lexicon) + np.arange(len(unseen))
        pieces = known.take(found[np.array(at, np.int64)])
        per = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.concatenate([[0], np.cumsum(pieces.lens)])[np.concatenate([[0], np.cumsum(per)])]
        flat, lens = pieces.flat, np.diff(ends)
        if hold := [i for i, c in enumerate(chunks) if c in special]:
            flat = np.insert(flat, ends[hold], [special[chunks[i]] for i in hold])
            lens[hold] = 1
        self.slot |= zip(chunks, range(len(self.slot), len(self.slot) + len(chunks)))
        self.lists.add(flat, lens)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.slot) > REMEMBERED:
            self.forget()
        parts = [self.chunks(t or "") for t in texts]
        slot = self.slot
        if new := set().union(*parts).difference(slot):
            self.learn(list(new))
        at = np.fromiter((slot[c] for p in parts for c in p), np.int64, sum(map(len, parts)))
        ids = self.lists.take(at)
        ends = np.concatenate([[0], np.cumsum(ids.lens)])[np.cumsum([0, *map(len, parts)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.flat, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """Token strings joined by a space: what the library does for a tokenizer without a decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")


_CODECS: dict[int, Codec] = {}


def frequent_words(docs: DataFrame, text_col: str = "text", share: float = SHARE, capacity: int = CAPACITY) -> list[str]:
    """Words (lower-case, white space apart) by frequency, counted over every whole text.

    Each batch reports the words that make up at least ``share`` of its own words; a word with
    that share of the corpus has it in some batch, so none is missed, and a batch reports at most
    1 / share words. Only the ``capacity`` most frequent are kept: the lexicon's size.
    """

    def count(batches):
        for batch in slices(batches, 4096, 32 << 20):
            words: Counter[str] = Counter()
            for text in batch.column(0):
                words.update((text.as_py() or "").lower().split())
            least = max(2, share * words.total())
            kept = [(w, n) for w, n in words.items() if n >= least and w.isalpha()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(capacity)
    return [r.word for r in top.select("word").toLocalIterator()]


def compile_lexicon(vocabulary: Vocabulary, words: list[str]) -> bytes:
    table = vocabulary.whole_words()
    more = {unicodedata.normalize("NFC", w).encode("utf-8", "surrogatepass") for w in words}
    more = [b for b in more if b and b not in table]
    return build(table | dict(zip(more, vocabulary.merge_all(more).to_lists())))


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """``docs`` with token_ids (array<int>) and decoded (string).

    tokenizer: path of a tokenizer file, read on the driver only. words: what to compile beside
    the vocabulary's whole words; None: count them over ``docs`` first. The vocabulary and the
    lexicon's image (both of bounded size) are broadcast. One pass, no shuffle of texts.
    """
    vocabulary = Vocabulary(tokenizer)
    image = compile_lexicon(vocabulary, frequent_words(docs, text_col) if words is None else words)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, image))
    key = hash((tokenizer, image))
    ids_col, decoded_col, own = fresh("token_ids", docs.columns), fresh("decoded", docs.columns), fresh("__text", docs.columns)

    def run(batches):
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(*sent.value)
        codec = _CODECS[key]
        for batch in slices(batches, ROWS):
            ids = codec.encode(batch.column(batch.num_columns - 1).to_pylist())
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, ids, codec.decode(ids)], [*batch.schema.names[:-1], ids_col, decoded_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])
    return docs.withColumn(own, F.col(text_col).cast("string")).mapInArrow(run, schema)
