"""SimHash near-duplicates by the generalised pigeonhole principle (Qin et al. 2018).

Fingerprints within distance 4 of each other agree on some part of the bits within that part's
threshold whenever the thresholds t_i satisfy sum(t_i + 1) = 4 + 1. Bits that go together are put
into one part; a dynamic program then gives the parts unequal thresholds so that the probes and
the candidates, estimated from how often bits and pairs of bits differ over all fingerprints, cost
least. Each fingerprint is indexed once per part and probes every value within the part's
threshold; what meets is verified by its exact distance within its bucket. A large bucket gives a
spanning forest of its links, never all of them.

Equal fingerprints are one row from the start, so exact copies are never paired. What is
gathered on the driver is one 64 x 64 table. A bucket is held by one worker as 8 bytes a distinct
fingerprint; buckets get smaller as parts get wider.

``similar`` is the same operator where texts, not fingerprints, must be alike; see there.

Defined results: null and wordless texts have fingerprint 0 and link like any other; repeated
rows share a component; an empty table gives no rows; columns of the input but the id and the text
are not in the result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, slices, whole_groups
from .components import connected_components
from .fingerprint import fingerprint

BITS = 64
#: Cost of shuffling one probe, relative to verifying one candidate.
PROBE_COST = 20.0
#: Fingerprints of more than this fraction of all rows (1 / HOT) are joined by broadcast.
HOT = 1000


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = 4) -> DataFrame:
    """``docs`` with the fingerprint (long, the 64 bits as they are) of every whole text."""
    own = fresh("__text", docs.columns)

    def run(batches):
        for batch in slices(batches, 512):
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*batch.schema.names[:-1], out])

    kept = [c for c in docs.columns if c != text_col]
    return docs.select(*kept, F.col(text_col).cast("string").alias(own)).mapInArrow(run, docs.select(*kept).withColumn(out, F.lit(0).cast("long")).schema)


def bit_table(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set."""

    def count(batches):
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array((bits.T @ bits).astype(np.int64).ravel()), pa.array(np.full(BITS * BITS, len(bits)))], ["cell", "n", "rows"])

    rows = fps.select("fp").mapInArrow(count, "cell long, n long, rows long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()
    table = np.zeros(BITS * BITS)
    for r in rows:
        table[r.cell] = r.n
    return (rows[0].rows if rows else 0), table.reshape(BITS, BITS)


def group_bits(n: int, table: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each is grown by the free bit most correlated with it."""
    p = np.diag(table) / max(n, 1)
    cov = table / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    cor = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(cor, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(free, key=lambda b: (cor[b, list(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            b = max(free, key=lambda b: (cor[b, group].sum(), -b))
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def near_share(n: int, table: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Share of pairs of fingerprints that differ in at most 0..most of a part's bits.

    Mean and variance of the number of bits that differ follow from how often each two bits are set
    together; a beta-binomial law with these moments stands for the rest.
    """
    both = table[np.ix_(group, group)] / n
    p = np.diag(both)
    one, other = p[:, None] - both, p[None, :] - both
    neither = 1 - both - one - other
    joint = 2 * (both * neither + one * other)  # chance that a pair of rows differs in both bits
    k, mean = len(group), float(np.diag(joint).sum())
    if mean < 1e-9:
        return np.ones(most + 1)
    rate = min(mean / k, 1 - 1e-9)
    spread = float(joint.sum()) - mean * mean
    tied = (spread / (k * rate * (1 - rate)) - 1) / max(1, k - 1)
    tied = min(max(tied, 1e-6), 0.999)
    a, b = rate * (1 - tied) / tied, (1 - rate) * (1 - tied) / tied
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return np.minimum(1, np.cumsum([comb(k, d) * exp(beta(d + a, k - d + b) - beta(a, b)) if d <= k else 0.0 for d in range(most + 1)]))


def allocate(n: int, table: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The parts' bits and thresholds (-1: unused) of least estimated cost, over 2 to distance + 1 parts."""
    n = max(n, 1)  # costs of nothing would not tell the plans apart
    best = None
    for parts in range(2, distance + 2):
        groups = group_bits(n, table, parts)
        budget = distance + 1  # sum of (threshold + 1)
        cost = [[0.0, *[n * sum(comb(len(g), k) for k in range(t + 1)) * PROBE_COST + n * n / 2 * near_share(n, table, g, t)[t] for t in range(distance + 1)]] for g in groups]
        table_dp = {0: (0.0, [])}
        for c in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (total, picks) in table_dp.items():
                for take in range(budget - used + 1):
                    option = (total + c[take], [*picks, take - 1])
                    if used + take not in nxt or option < nxt[used + take]:
                        nxt[used + take] = option
            table_dp = nxt
        total, picks = table_dp[budget]
        if best is None or total < best[0]:
            best = (total, list(zip(groups, picks)))
    return [(g, t) for g, t in best[1] if t >= 0]


def meet(frames, distance: int):
    """Links of buckets: every one of a small bucket, a spanning forest of a large one. Columns part, key, fp, probe."""
    for frame in whole_groups(frames, ["part", "key"]):
        fp = frame["fp"].to_numpy().view(np.uint64)
        probe = frame["probe"].to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = (frame["part"].to_numpy()[1:] != frame["part"].to_numpy()[:-1]) | (frame["key"].to_numpy()[1:] != frame["key"].to_numpy()[:-1])
        group = np.cumsum(new) - 1
        probes, held = np.bincount(group, probe), np.bincount(group, ~probe)
        out = []
        small = (probes * held <= SMALL) & (probes * held > 0)
        # all pairs of the small buckets at once: each probe beside each row held in its bucket
        i = np.flatnonzero(probe & small[group])
        inside = np.flatnonzero(~probe)
        first = np.searchsorted(group[inside], np.arange(len(probes)))
        count = held[group[i]].astype(np.int64)
        for lo in range(0, len(i), PAIRS // SMALL):
            x, c = i[lo : lo + PAIRS // SMALL], count[lo : lo + PAIRS // SMALL]
            left = np.repeat(x, c)
            at = np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            right = inside[np.repeat(first[group[x]], c) + at]
            near = (fp[left] < fp[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= distance)
            out.append((fp[left[near]], fp[right[near]]))
        for g in np.flatnonzero(probes * held > SMALL):
            rows = np.flatnonzero(group == g)
            out.append(forest(np.unique(fp[rows[probe[rows]]]), np.unique(fp[rows[~probe[rows]]]), distance))
        if out:
            a, b = (np.concatenate([o[k] for o in out]).view(np.int64) for k in (0, 1))
            yield pd.DataFrame({"a": a, "b": b})


def forest(probes: np.ndarray, held: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sorted sets of fingerprints, worked out in blocks."""
    nodes = np.union1d(probes, held)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    place, edges = np.searchsorted(nodes, held), []
    step = max(1, PAIRS // max(1, len(held)))
    for lo in range(0, len(probes), step):
        some = probes[lo : lo + step]
        x, y = np.nonzero(np.bitwise_count(some[:, None] ^ held[None, :]) <= distance)
        for p, q in zip(np.searchsorted(nodes, some)[x].tolist(), place[y].tolist()):
            u, v = find(p), find(q)
            if u != v:
                root[max(u, v)] = min(u, v)
                edges.append((p, q))
    ends = np.array(edges, np.int64).reshape(-1, 2)
    return nodes[ends[:, 0]], nodes[ends[:, 1]]


#: Pairs of a bucket up to which all its links are given; pairs that are compared at once.
SMALL, PAIRS = 1 << 10, 1 << 21


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in ``fps`` (fp: long) that differ in at most ``distance`` bits.

    They connect all that such links connect; of the links inside a large bucket only a spanning forest is given.
    """
    n, table = bit_table(fps)
    plan = allocate(n, table, distance)
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    rows = None
    for i, (bits, t) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        flips = [signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]
        index = fps.select(F.lit(i).alias("part"), own.alias("key"), "fp", F.lit(False).alias("probe"))
        probes = fps.select("fp", own.alias("own"), F.explode(F.array(*[F.lit(x).cast("long") for x in flips])).alias("x")).select(F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("x")).alias("key"), "fp", F.lit(True).alias("probe"))
        one = index.union(probes)
        rows = one if rows is None else rows.union(one)
    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
    return dealt.mapInPandas(lambda frames: meet(frames, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    marked = checkpoint(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    groups = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = checkpoint(links(groups, distance))
    comps = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    grouped = groups.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    heads = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    to_head = checkpoint(grouped.join(heads, "component").select("fp", "n", "component_id"))
    # a fingerprint may hold a third of all rows: fewer than HOT can hold more than 1/HOT of them, and those are
    # broadcast; the others meet their component by a plain join
    most = (groups.agg(F.sum("n")).first()[0] or 0) // HOT
    hot = to_head.filter(F.col("n") > most).select("fp", F.lit(True).alias("hot"), F.col("component_id").alias("hot_id"))
    flagged = marked.join(F.broadcast(hot), "fp", "left")
    rest = flagged.filter("hot is null").select("doc_id", "fp").join(to_head.filter(F.col("n") <= most), "fp").select("doc_id", "fp", "component_id")
    every = flagged.filter("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).union(rest)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
