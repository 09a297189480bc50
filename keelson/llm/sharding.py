"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, walked in cycles.

Rows get dense numbers 0..N-1: hash buckets of the row's key are laid end to end, and rows are
numbered within their bucket. The permutation acts on Z_a x Z_b with a*b >= N: rounds add a keyed
hash of one half to the other. A result of N or more is permuted again until it falls below N,
so that 0..N-1 is permuted onto itself. Position p gives shard p mod S and slot p div S: shard
sizes differ by one row at most, slots have no gaps, and either is computed from p alone.

Defined results: a null text counts as empty; rows with equal doc_id and text are numbered one
after another; an empty table gives no rows. DataFrame functions only; what is shuffled is a key
of three numbers and a count per distinct row, never a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

ROUNDS = 6
#: Cycle steps that are laid out in the plan. Fewer than one point in sqrt(N) lies outside 0..N-1,
#: and a cycle meets each of them once, so up to N = 1,024 this always suffices; beyond, the chance
#: that it does not is below 2**-150, and the query then fails instead of giving a wrong row.
STEPS = 32
#: Rows that are laid out at once for one row that is repeated.
REPEATS = 1 << 16
#: Rows of one numbering bucket, about.
BUCKET_ROWS = 20_000


def halves(n: int) -> tuple[int, int]:
    """a and b with a*b >= n and fewer than a points too many."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def step(x: Column, a: int, b: int, seed: int) -> Column:
    """One application of the permutation of pairs (l, r) in Z_a x Z_b; x is a struct of both."""
    for i in range(ROUNDS):
        key = F.lit(seed * 1_000_003 + i)

        def left(v, key=key):
            return F.struct(F.pmod(v["l"] + F.pmod(F.xxhash64(v["r"], key), F.lit(a)), F.lit(a)).alias("l"), v["r"].alias("r"))

        def right(v, key=key):
            return F.struct(v["l"].alias("l"), F.pmod(v["r"] + F.pmod(F.xxhash64(v["l"], key), F.lit(b)), F.lit(b)).alias("r"))

        # transform binds the pair to a name, so that no round repeats the ones before it
        x = F.transform(F.array(x), right if i % 2 else left)[0]
    return x


def permute(p: Column, n: int, seed: int) -> Column:
    """The permutation of 0..n-1 for a long column p."""
    a, b = halves(n)
    start = F.struct(F.floor(p / F.lit(b)).cast("long").alias("l"), F.pmod(p, F.lit(b)).cast("long").alias("r"), F.lit(False).alias("done"))

    def walk(acc: Column, _: Column) -> Column:
        nxt = step(acc, a, b, seed)
        return F.when(acc["done"], acc).otherwise(
            F.transform(F.array(nxt), lambda v: F.struct(v["l"].alias("l"), v["r"].alias("r"), (v["l"] * b + v["r"] < n).alias("done")))[0]
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["done"], acc["l"] * b + acc["r"]).otherwise(F.raise_error(F.lit("cycle walking took too many steps")).cast("long"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, a + 1))), start, walk, finish)


def shard(docs: DataFrame, shards: int = 24, seed: int = 20_240, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, size, text_crc32, position, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    distinct = checkpoint(key.groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    n = distinct.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_ROWS))
    placed = distinct.withColumn("bucket", F.pmod(F.xxhash64(id_col, "size", "text_crc32"), F.lit(buckets)))
    # offsets of the buckets: one row each, N / BUCKET_ROWS in all, summed in blocks of sqrt(buckets)
    block = max(1, math.isqrt(buckets))
    sums = placed.groupBy("bucket").agg(F.sum("copies").alias("n")).withColumn("block", F.floor(F.col("bucket") / block))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("block")) - F.col("n"))
    offsets = sums.join(blocks.select("block", "base"), "block").select(
        "bucket", (F.col("base") + F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")).alias("offset")
    )
    inside = Window.partitionBy("bucket").orderBy(id_col, "size", "text_crc32")
    numbered = (
        placed.join(offsets, "bucket")
        .withColumn("last", F.col("offset") + F.sum("copies").over(inside))
        # repeated rows are laid out REPEATS at a time, so that no array grows with their number
        .withColumn("from", F.explode(F.sequence(F.col("last") - F.col("copies"), F.col("last") - 1, F.lit(REPEATS).cast("long"))))
        .withColumn("row", F.explode(F.sequence("from", F.least(F.col("from") + REPEATS, F.col("last")) - 1)))
    )
    position = permute(F.col("row"), n, seed)
    return numbered.withColumn("position", position).select(
        id_col,
        "size",
        "text_crc32",
        "position",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
