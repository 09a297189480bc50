"""Shards, stable batch ids, idempotent application, and the shard table's states."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_of(key: Column, shards: int) -> Column:
    """Murmur3 (seed 42) modulo the number of shards: the partition that Spark's own exchange picks."""
    return F.pmod(F.hash(key), F.lit(shards))


def mod_hash_shard(key: Column, shards: int) -> Column:
    """31-polynomial hash of the key's bytes, signed, modulo the number of shards."""
    pairs = F.regexp_extract_all(F.hex(F.encode(key.cast("string"), "UTF-8")), F.lit("(..)"))
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    step = lambda acc, h: F.pmod(31 * acc + F.when(byte(h) > 127, byte(h) - 256).otherwise(byte(h)), F.lit(1 << 32))
    total = F.aggregate(pairs, F.lit(1).cast("long"), step)
    return F.pmod(F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total), F.lit(shards)).cast("int")


def batch_id(table: str, partition: int, flush: int, batches: dict[int, list[tuple[bytes, bytes | None]]]) -> str:
    """The same content gives the same id: SHA-256 over everything, shards in order, nulls marked."""
    h = hashlib.sha256(f"{table}\0{partition}\0{flush}".encode())
    for shard in sorted(batches):
        h.update(b"s%d:%d;" % (shard, len(batches[shard])))
        for key, value in batches[shard]:
            h.update(b"k%d:" % len(key) + key + (b"n" if value is None else b"v%d:" % len(value) + value))
    return f"nb-{partition}-{flush}-{h.hexdigest()[:32]}"


class Verdict(Enum):
    APPLY = "apply"
    DUPLICATE = "duplicate"
    RETRY = "retry"
    STALE_EPOCH = "stale_epoch"


@dataclass
class Deduper:
    """Epoch fence and a window of applied batches, for one shard."""

    window: int = 1024
    epoch: int = 0
    applied: OrderedDict = field(default_factory=OrderedDict)
    running: set = field(default_factory=set)

    def begin(self, epoch: int, batch: str) -> Verdict:
        if epoch < self.epoch:
            return Verdict.STALE_EPOCH
        if epoch > self.epoch:
            self.epoch, self.running = epoch, set()
        if batch in self.applied:
            return Verdict.DUPLICATE
        if batch in self.running:
            return Verdict.RETRY
        self.running.add(batch)
        return Verdict.APPLY

    def commit(self, batch: str) -> None:
        self.running.discard(batch)
        self.applied[batch] = True
        while len(self.applied) > self.window:
            self.applied.popitem(last=False)

    def abort(self, batch: str) -> None:
        self.running.discard(batch)


class Status(Enum):
    ASSIGNED = "assigned"
    PENDING_READY = "pending_ready"
    RECOVERING = "recovering"
    REASSIGNING = "reassigning"
    UNASSIGNED = "unassigned"


@dataclass(frozen=True)
class Slot:
    node: str
    number: int


@dataclass(frozen=True)
class Assignment:
    slot: Slot
    executor: str
    epoch: int


class ShardTable:
    """Which executor owns each shard; an owner's return to its slot is preferred, epochs only grow."""

    def __init__(self, shards: int):
        self.shards = shards
        self.executors: dict[Slot, str] = {}
        self.ready: set[str] = set()
        self.owner: dict[int, Assignment] = {}
        self.recovering: set[int] = set()
        self.history: dict[int, list[Assignment]] = {}

    def executor_up(self, executor: str, slot: Slot) -> None:
        self.executors[slot] = executor
        for shard, a in self.owner.items():
            if a.slot == slot and a.executor != executor:
                self._assign(shard, slot, recovering=True)

    def executor_ready(self, executor: str) -> None:
        self.ready.add(executor)

    def executor_down(self, executor: str) -> list[int]:
        """Shards that move, at once where another slot lives."""
        self.executors = {s: e for s, e in self.executors.items() if e != executor}
        self.ready.discard(executor)
        moved = [s for s, a in self.owner.items() if a.executor == executor]
        for shard in moved:
            if self.executors:
                self._assign(shard, self._pick(shard), recovering=True)
        return moved

    def _pick(self, shard: int) -> Slot:
        last = self.history.get(shard, [])
        if last and last[0].slot in self.executors:
            return last[0].slot  # where the shard lived first
        live = sorted(self.executors, key=lambda s: (s.node, s.number))
        return live[shard % len(live)]

    def _assign(self, shard: int, slot: Slot, recovering: bool) -> None:
        epoch = self.owner[shard].epoch + 1 if shard in self.owner else 1
        a = Assignment(slot, self.executors[slot], epoch)
        self.owner[shard] = a
        self.history.setdefault(shard, []).append(a)
        if recovering:
            self.recovering.add(shard)

    def lookup(self, shard: int) -> tuple[Status, Assignment | None]:
        if not 0 <= shard < self.shards:
            raise ValueError(f"no shard {shard}")
        if shard not in self.owner:
            if not self.executors:
                return Status.UNASSIGNED, None
            self._assign(shard, self._pick(shard), recovering=False)
        a = self.owner[shard]
        if self.executors.get(a.slot) != a.executor:
            return Status.REASSIGNING, None
        if shard in self.recovering:
            return Status.RECOVERING, a
        return (Status.ASSIGNED if a.executor in self.ready else Status.PENDING_READY), a

    def lookup_many(self, shards) -> dict:
        return {s: self.lookup(s) for s in shards}

    def recovered(self, shard: int, epoch: int) -> bool:
        """Ends recovery if the epoch is still the owner's."""
        if shard in self.owner and self.owner[shard].epoch == epoch:
            self.recovering.discard(shard)
            return True
        return False

    def reassign(self, shard: int, slot: Slot) -> Assignment:
        self._assign(shard, slot, recovering=True)
        return replace(self.owner[shard])


def unflushed(log: DataFrame, table: str, seq: str, marker: str) -> DataFrame:
    """Records after their table's last sync marker. One pre-aggregated maximum per table, joined back."""
    last = log.groupBy(table).agg(F.max(F.when(F.col(marker), F.col(seq))).alias("_last"))
    return log.join(last, table).filter(~F.col(marker) & (F.col("_last").isNull() | (F.col(seq) > F.col("_last")))).drop("_last")


def range_floor(rows: DataFrame, value: str, ranges: DataFrame, start: str, payload: list[str]) -> DataFrame:
    """For each row the range of greatest start not above its value, without a range join.

    Both sides are put in one order by range partitions, and written down with the number of their
    partition: a plan that is run twice may cut its ranges elsewhere. Each partition fills starts
    forward, and what it needs from before it is one row per partition.
    """
    from pyspark.sql.window import Window

    from ..sources.catalog import scratch

    spark = rows.sparkSession
    tagged = rows.select(F.col(value).alias("_v"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(ranges.select(F.struct(start, *payload)).schema[0].dataType).alias("_r"))
    starts = ranges.select(F.col(start).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), F.struct(start, *payload).alias("_r"))
    dealt = tagged.unionByName(starts).repartitionByRange("_v").withColumn("_p", F.spark_partition_id())
    path = f"{scratch(spark)}/ranges"
    dealt.write.parquet(path)
    both = spark.read.schema(dealt.schema).parquet(path)
    inside = Window.partitionBy("_p").orderBy("_v", "_side")
    filled = both.withColumn("_near", F.last("_r", ignorenulls=True).over(inside))
    # the last start of each partition, and for each partition the nearest of the ones before it
    ends = both.groupBy("_p").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_v"))).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_carry")
    out = filled.filter("_side = 1").join(F.broadcast(carried), "_p", "left")  # one row per partition
    hit = F.when(F.col("_v").isNotNull(), F.coalesce("_near", "_carry"))  # null is below every start
    return out.withColumn("_hit", hit).select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in (start, *payload)])
