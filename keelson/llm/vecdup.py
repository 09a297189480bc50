"""Near-duplicate vectors by collision-counting projections (after QALSH, Huang et al. 2015).

Vectors are projected on many random lines, and each line is sorted. Counting over the whole of each
line cannot be cheap: at cosine 0.9 a window that holds 87 % of the near pairs holds 36 % of all
pairs, however many vectors there are. So lines are first used in groups: a table cuts each of its
lines where the sorted projections of all vectors have their median, and the sides together are a
cell. Within a cell the other lines are sorted; for each vector and line the window around its own
projection is a range of ranks; a pair collides on the line if one lies in the other's range. Pairs
with enough collisions are verified by cosine in double precision.

How many lines a table cuts follows from the number of vectors. How many tables there are follows
from the recall asked for at exactly the threshold and from how dense the projections are at each
cut: a pair at the threshold is cut apart with a chance of its expected distance times that density.
The count follows from the binomial law.

Equal vectors are one row from the start. Cells above BLOCK rows are cut into blocks that meet
pairwise as groups of their own, so no group is larger than two blocks and none is dropped. A
group returns the number of links of each row and a spanning forest, never its pairs. A pair
that shares cells in several tables counts in the first of them only.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths never link; repeated rows link with each other, a
repeated vec_id stands for as many vectors; rows without a vec_id link, and have component_id null
where no other does; columns of the input but the id and the vector are not in the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, whole_groups
from .components import connected_components

BLOCK = 2048
#: Rows that a cell has on average, for vectors spread evenly. Larger cells need fewer tables, so fewer copies
#: of each row; smaller ones need fewer pairs, but the overhead of a group then outweighs them.
CELL = 128
#: Projections whose collisions are counted.
LINES = 32
#: Steps of a line from -1 to 1 (unit vectors on unit lines) in which projections are counted; lengths of vectors
#: whose medians are looked up, the most frequent ones; other lengths are cut at zero.
STEPS, LENGTHS = 512, 8
#: Copies of a class of equal vectors that its rows are dealt over when they get their result.
SALTS = 16


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    window: float  # largest distance of two projections that collide, as for lines of N(0, 1)
    least: int  # collisions that a pair needs
    cosine: float
    seed: int = 11
    cuts: dict = field(default_factory=dict, compare=False, hash=False)  # by length: a place on each line of the tables


def plan_for(n: int, cosine: float, recall: float) -> Plan:
    """Cells for n vectors such that pairs at ``cosine`` are found with ``recall``, if projections are spread evenly."""
    bits = max(2, math.ceil(math.log2(max(n, 2) / CELL)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(missed(recall)) / math.log(1 - same)))
    apart = math.sqrt(2 - 2 * cosine)  # distance of unit vectors; their projections differ by N(0, apart)
    window = 1.5 * apart
    p = 2 * NormalDist().cdf(1.5) - 1
    least, below = 0, 0.0
    while (below := below + math.comb(LINES, least) * p**least * (1 - p) ** (LINES - least)) <= (1 - recall) * 0.1:
        least += 1
    return Plan(bits, tables, window, least, cosine)


def missed(recall: float) -> float:
    return (1 - recall) * 0.9  # the rest of what may be missed is left to the count


@lru_cache(maxsize=8)
def lines(dim: int, tables: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are counted on, and the tables' unit lines; further tables do not change those before them."""
    cut = np.stack([np.random.default_rng([seed, dim, 1 + t]).standard_normal((dim, bits)) for t in range(tables)], axis=1).reshape(dim, -1)
    return np.random.default_rng([seed, dim, 0]).standard_normal((dim, LINES)), cut / np.linalg.norm(cut, axis=0)


def lines_of(dim: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    return lines(dim, plan.tables, plan.bits, plan.seed)


def unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in vectors])
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def with_medians(classes: DataFrame, plan: Plan, recall: float) -> Plan:
    """``plan`` with the medians of all sorted projections, and as many tables as these need.

    What is gathered is a histogram of each line, of at most LENGTHS lengths of vectors.
    """
    most = [r.dim for r in classes.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]

    def count(plan: Plan):
        def run(frames):
            sums: dict[int, np.ndarray] = {}
            for frame in frames:
                for dim, part in frame.groupby(frame["vec"].map(len)):
                    if dim in most:
                        step = np.clip(((unit(part["vec"]) @ lines_of(dim, plan)[1] + 1) * (STEPS / 2)).astype(np.int64), 0, STEPS - 1)
                        n = step.shape[1]
                        have = sums.setdefault(dim, np.zeros(n * STEPS, np.int64))
                        have += np.bincount((step + np.arange(n) * STEPS).ravel(), minlength=n * STEPS)
            for dim, have in sums.items():
                at = np.flatnonzero(have)
                yield pd.DataFrame({"dim": dim, "at": at, "n": have[at]})

        return run

    while True:
        rows = classes.select("vec").mapInPandas(count(plan), "dim int, at long, n long").groupBy("dim", "at").agg(F.sum("n").alias("n")).toPandas()
        cuts, worst = {}, 0.0
        for dim, part in rows.groupby("dim"):
            have = np.zeros((plan.tables * plan.bits, STEPS))
            have.ravel()[part["at"].to_numpy()] = part["n"].to_numpy()
            share = np.cumsum(have, axis=1) / have.sum(axis=1, keepdims=True)
            middle = (share < 0.5).sum(axis=1)
            cuts[int(dim)] = (middle + 0.5) * 2 / STEPS - 1
            around = np.clip(middle[:, None] + np.arange(-8, 9), 0, STEPS - 1)
            density = np.take_along_axis(have, around, axis=1).sum(axis=1) / have.sum(axis=1) / (17 * 2 / STEPS)
            distance = math.sqrt(2 - 2 * plan.cosine) * math.sqrt(2 / math.pi) / math.sqrt(dim)  # expected, on a unit line
            same = np.clip(1 - distance * density, 0, 1).reshape(plan.tables, plan.bits).prod(axis=1)
            worst = max(worst, float(np.exp(np.log1p(-np.minimum(same, 1 - 1e-12)).sum())))
        if worst <= missed(recall) or plan.tables >= 4096:
            return replace(plan, cuts=cuts)
        need = math.ceil(plan.tables * math.log(missed(recall)) / math.log(max(worst, 1e-9))) if worst < 1 else 2 * plan.tables
        plan = replace(plan, tables=min(4096, max(plan.tables + 1, need)))


def cells(classes: DataFrame, plan: Plan) -> DataFrame:
    """``classes`` with keys: array<int>, the cell in each table."""

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby(frame["vec"].map(len)):
                side = unit(part["vec"]) @ lines_of(dim, plan)[1] > plan.cuts.get(dim, 0.0)
                side = side.reshape(len(part), plan.tables, plan.bits)
                keys = side @ (1 << np.arange(plan.bits))
                yield part.assign(keys=list(keys.astype(np.int32)))

    return classes.mapInPandas(run, classes.withColumn("keys", F.expr("array(0)")).schema)


def ranges(left: np.ndarray, right: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By line: each right row's rank, and for each left row the first rank in its window and how many there are."""
    rank, first, count = (np.empty(a.shape, np.uint16) for a in (right, left, left))
    for k in range(right.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        rank[order, k] = np.arange(len(order))
        line = right[order, k]
        lo = np.searchsorted(line, left[:, k] - window, "left")
        first[:, k], count[:, k] = lo, np.searchsorted(line, left[:, k] + window, "right") - lo
    return rank.T.copy(), first.T.copy(), count.T.copy()


def compare(ids, mult, u, own, keys, block, first: int, i: int, j: int, plan: Plan):
    """Link counts and forest of one group; block: of each row, equal blocks are compared only if i == j."""
    links, edges, root = np.zeros(len(ids), np.int64), [], np.arange(len(ids))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    rank, first_in, n_in = ranges(own[left], own[right], plan.window)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        count = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(LINES):  # ranks below the window's first wrap around, and are no smaller than its length
            count += rank[k, None, :] - first_in[k, at : at + 512, None] < n_in[k, at : at + 512, None]
        a, b = np.nonzero(count >= plan.least)
        a, b = rows[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        for s in range(0, len(a), 1 << 16):
            x, y = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            good = np.einsum("ij,ij->i", u[x], u[y]) >= plan.cosine
            x, y = x[good], y[good]
            new = ~(keys[x, :first] == keys[y, :first]).any(axis=1)  # not met in an earlier table
            x, y = x[new], y[new]
            np.add.at(links, x, mult[y])
            np.add.at(links, y, mult[x])
            for p, q in zip(x.tolist(), y.tolist()):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((ids[p], ids[q]))
    return links, edges


def meet(spread: DataFrame, plan: Plan) -> DataFrame:
    """(id, links, other): link counts (other null) and forest edges of all groups."""
    key = ["t", "dim", "cell", "i", "j"]

    def solve(g: pd.DataFrame):
        head = g.iloc[0]
        u = unit(g["vec"])
        links, edges = compare(g["id"].to_numpy(), g["mult"].to_numpy(), u, u @ lines_of(int(head["dim"]), plan)[0], np.stack(g["keys"].to_numpy()), g["block"].to_numpy(), int(head["t"]), int(head["i"]), int(head["j"]), plan)
        has = np.flatnonzero(links)
        return [(g["id"].to_numpy()[has], links[has], None), *([(np.array([a for a, _ in edges]), np.zeros(len(edges), np.int64), [b for _, b in edges])] if edges else [])]

    def run(frames):
        for frame in whole_groups(frames, key):
            same = (frame[key].to_numpy()[1:] == frame[key].to_numpy()[:-1]).all(axis=1)
            starts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(frame)]
            out = []
            for a, b in zip(starts, starts[1:]):
                if b - a > 1:
                    out += solve(frame.iloc[a:b])
            if out:
                yield pd.DataFrame({"id": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out]), "other": pd.array([x for o in out for x in (o[2] or [None] * len(o[0]))], dtype="Int64")})

    return spread.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "id long, links long, other long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    kind = "array<double>" if "double" in vectors.select(vec_col).schema[0].dataType.simpleString() else "array<float>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    whole = F.coalesce(F.forall("vec", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    # equal vectors are told by 128 bits of them
    same = [F.xxhash64("vec", F.lit(i)).alias(f"h{i}") for i in (1, 2)]
    good = rows.filter(whole).select("vec_id", "vec", *same)
    classes = checkpoint(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("mult"), F.any_value("vec").alias("vec")).withColumn("id", F.monotonically_increasing_id()))
    plan = with_medians(classes, plan_for(classes.count(), cosine, recall), recall)
    keyed = checkpoint(cells(classes.select("id", "mult", "vec"), plan))
    each = keyed.select("id", "mult", "vec", "keys", F.size("vec").alias("dim"), F.posexplode("keys").alias("t", "cell"))
    place = ["t", "dim", "cell"]
    sizes = keyed.select(F.size("vec").alias("dim"), F.posexplode("keys").alias("t", "cell")).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    each = each.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = each.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = each.select("id", "mult", "vec", "keys", "t", "dim", "cell", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    found = checkpoint(meet(spread, plan))
    counts = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    named = classes.select("h1", "h2", "first", "mult", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    reps = named.join(heads, "component").join(counts, "id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    # one vector may hold a third of all rows: its result goes to SALTS places
    salted = reps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = good.select("vec_id", "h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["h1", "h2", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~whole).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
