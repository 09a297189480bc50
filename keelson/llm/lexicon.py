"""Minimal acyclic transducer: words in, their number out, in flat arrays that can be mapped.

The automaton is built from sorted words by the incremental algorithm for minimal acyclic
automata (Daciuk et al. 2000): equal suffixes share states. Each edge carries how many words
sort before the ones that it leads to, so the outputs along a word's path add up to the word's
position in the sorted list (Lucchesi & Kowaltowski 1993). That position indexes the id lists.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np


def build(words: dict[bytes, list[int]]) -> bytes:
    """Image of the transducer that maps each non-empty word to its list of ids."""
    listed = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[list[tuple[int, int]]] = []

    def freeze(node: list) -> int:
        final, out = node
        key = (final, tuple(out))
        if key not in register:
            register[key] = len(edges)
            finals.append(final)
            edges.append(list(out))
        return register[key]

    path: list[list] = [[False, []]]  # unfrozen states along the last word
    last = b""
    for word in listed:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        for depth in range(len(path) - 1, same, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for depth in range(len(path) - 1, 0, -1):
        path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
    root = freeze(path[0])

    count = np.zeros(len(edges), np.int64)  # words accepted from a state; children are frozen first
    for s, out in enumerate(edges):
        count[s] = finals[s] + sum(count[t] for _, t in out)
    keys, targets, outputs = [], [], []
    for s, out in enumerate(edges):
        before = int(finals[s])
        for label, t in out:
            keys.append(s << 8 | label)
            targets.append(t)
            outputs.append(before)
            before += int(count[t])
    ids = [words[w] for w in listed]
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [np.array([root], "<i4"), np.array(finals, "<i4"), np.array(keys, "<i4"), np.array(targets, "<i4"), np.array(outputs, "<i4"), starts.astype("<i4"), np.array([i for x in ids for i in x], "<i4")]
    return np.array([len(a) for a in arrays], "<i4").tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """Looks words up in an image; ``mapped`` puts it in an unlinked local file and maps that."""

    def __init__(self, image):
        sizes = np.frombuffer(image, "<i4", 7)
        flat = np.frombuffer(image, "<i4", offset=28)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        (self.root, self.finals, self.keys, self.targets, self.outputs, self.starts, self.ids) = parts
        self.root = int(self.root[0])

    @classmethod
    def mapped(cls, image: bytes) -> Lexicon:
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's position in the sorted list, or -1; all words walk in step."""
        if not len(self.keys) or not words:
            return np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root, np.int64)
        total = np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes)
        for step in range(int(sizes.max())):
            live = live[sizes[live] > step]
            if not len(live):
                break
            want = state[live] << 8 | data[ends[live] - sizes[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.targets[at]
            total[live] += self.outputs[at]
        good = (sizes > 0) & (state >= 0)
        good[good] = self.finals[state[good]] == 1
        return np.where(good, total, -1)

    def ids_of(self, index: int) -> list[int]:
        return self.ids[self.starts[index] : self.starts[index + 1]].tolist()
