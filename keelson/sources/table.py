"""Keyed and append-only tables: Parquet segments under a commit log, read as DataFrames.

A write is one segment and one exclusively created log file; a reader folds the log, drops the
segments that the predicate's key range rules out, and leaves the rest to Catalyst. Rows of a
keyed table carry the version that wrote them. Segments whose key ranges overlap form a cluster; in
a cluster of several the newest row of each key wins, by max_by, which combines before its shuffle
and sees only the columns that are needed; a segment of its own is read as it is.

Only predicates on the key go below that step: an older row may match what the newest does not.

Operations that are worked out from rows (update, delete, overwrite, compact) read one version, and
commit only if it still holds what they read: update and delete are worked out anew on a newer
version, compaction goes on if its segments are still there, since its rows keep their age, and
overwriting raises CommitConflict. Columns are stored under names that are never used again, so
a column that was dropped and added again starts empty.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, TimestampType

from ..functions import expr as E
from . import pruning
from .log import CommitConflict, Log, State

HIDDEN = ("_seq", "_commit_ts", "_op_type", "_hidden_pk")
RETRIES = 20


@dataclass(frozen=True)
class Result:
    """What an operation did; ``error`` is set instead of raising where the caller asks for it."""

    success: bool
    rows: int | None = None
    version: int | None = None
    message: str = ""
    error: Exception | None = None


class Table:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Log(spark, root.rstrip("/"))

    # --- definition ---

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: StructType, keys: tuple[str, ...] | list[str] = (), partition_by: tuple[str, ...] = (), buckets: tuple[str, int] | None = None, properties: dict | None = None) -> Table:
        """keys: primary key, none for an append-only table. buckets: column and number, a hidden hash partition."""
        names = [f.name for f in schema.fields]
        if not names or len(set(names)) != len(names):
            raise ValueError("a table needs columns of distinct names")
        if missing := [k for k in (*keys, *partition_by, *([buckets[0]] if buckets else [])) if k not in names]:
            raise ValueError(f"no such columns: {missing}")
        if clash := set(names) & {*HIDDEN, "_bucket"}:
            raise ValueError(f"reserved names: {clash}")
        t = cls(spark, root)
        meta = {"schema": schema.json(), "keys": list(keys), "partition_by": list(partition_by), "buckets": buckets, "properties": properties or {}, "schema_version": 1, "stored": {n: n for n in names}, "used": names}
        t.log.commit(0, "CREATE_TABLE", [{"metadata": meta}])
        return t

    def state(self, version: int | None = None) -> State:
        s = self.log.state(version)
        if s.metadata is None:
            raise ValueError(f"no table at {self.root}")
        return s

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(json.loads(self.state(version).metadata["schema"]))

    def drop(self) -> None:
        self.log.files.delete(self.root)

    def snapshots(self) -> list[dict]:
        return sorted(self.state().history, key=lambda h: h["version"])

    def refresh(self, since: int) -> tuple[int, int]:
        """The version known before, and the current one."""
        return since, self.state().version

    def manifest(self, version: int | None = None) -> list[dict]:
        return list(self.state(version).segments.values())

    # --- commits ---

    def _commit(self, operation: str, make) -> int:
        """make(state) -> actions that hold on any newer version, like an append; tried again on conflict."""
        for _ in range(RETRIES):
            state = self.state()
            try:
                return self.log.commit(state.version + 1, operation, make(state))
            except CommitConflict:
                time.sleep(0.02)
        raise CommitConflict(self.root)

    def _worked_out(self, work):
        """work(state) -> Result commits at state.version + 1, or raises CommitConflict and is worked out anew."""
        for _ in range(RETRIES):
            try:
                return work(self.state())
            except CommitConflict:
                time.sleep(0.02)
        raise CommitConflict(self.root)

    def _at(self, state: State, operation: str, actions: list[dict], segment: dict | None) -> int:
        """Commit just after ``state``; a segment that comes too late is removed."""
        try:
            return self.log.commit(state.version + 1, operation, actions + ([{"add": segment}] if segment else []))
        except CommitConflict:
            if segment:
                self.log.files.delete(segment["path"])
            raise

    def _segment(self, df: DataFrame, meta: dict, op: str, level: int = 0) -> dict | None:
        """Write one segment; its manifest entry without version, or None if it has no rows."""
        path = f"{self.root}/data/level={level}/seg-{uuid.uuid4().hex}"
        schema, stored = StructType.fromJson(json.loads(meta["schema"])), names_stored(meta)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(stored[f.name]) for f in schema.fields]).withColumn("_op_type", F.lit(op)).withColumn("_commit_ts", F.current_timestamp())
        if not meta["keys"]:
            df = df.withColumn("_hidden_pk", F.monotonically_increasing_id())
        parts = [stored[c] for c in meta["partition_by"]]
        if meta["buckets"]:
            name, n = meta["buckets"]
            df, parts = df.withColumn("_bucket", F.pmod(F.hash(stored[name]), F.lit(n))), [*parts, "_bucket"]
        if meta["keys"]:
            # tight row-group ranges; parts lead, or Spark would sort by them alone and drop this order
            df = df.sortWithinPartitions(*parts, *[stored[k] for k in meta["keys"]])
        (df.write.partitionBy(*parts) if parts else df.write).option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        lead = meta["keys"][0] if meta["keys"] else None
        stats = [F.count(F.lit(1)).alias("n")] + ([F.min(stored[lead]).alias("lo"), F.max(stored[lead]).alias("hi"), F.count(F.when(F.col(stored[lead]).isNull(), 1)).alias("nulls")] if lead else [])
        row = written.agg(*stats).first()  # answered from the footers of what was just written
        if not row.n:
            self.log.files.delete(path)
            return None
        known = lead and not row.nulls and not isinstance(schema[lead].dataType, TimestampType)  # instants depend on the reader's zone
        low, high = (pruning.stored(row.lo), pruning.stored(row.hi)) if known else (None, None)
        return {"path": path, "level": level, "rows": row.n, "min_key": low if high is not None else None, "max_key": high if low is not None else None}

    def _write(self, df: DataFrame, operation: str, op: str = "INSERT", batch: tuple[str, int] | None = None, dedupe: bool = True, order_by: Column | None = None) -> Result:
        """Rows that count whatever else is written: they are committed to the newest version."""
        state = self.state()
        meta = state.metadata
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return Result(True, 0, state.version, "batch applied before")
        if meta["keys"] and dedupe:
            df = newest(df, meta["keys"], order_by)
        seg = self._segment(df, meta, op)
        late = False

        def actions(s: State) -> list[dict]:
            nonlocal late
            late = bool(batch) and s.batches.get(batch[0], -1) >= batch[1]
            if names_stored(s.metadata) != names_stored(meta):
                raise ValueError("the schema changed while rows were written")
            if late:
                return []
            out = [{"add": {**seg, "seq": s.version + 1}}] if seg else []
            return out + ([{"txn": {"app": batch[0], "batch": batch[1]}}] if batch else [])

        try:
            version = self._commit(operation, actions)
        except Exception:
            if seg:
                self.log.files.delete(seg["path"])
            raise
        if late and seg:
            self.log.files.delete(seg["path"])
        return Result(True, 0 if late or not seg else seg["rows"], version)

    # --- writes ---

    def upsert(self, df: DataFrame, batch: tuple[str, int] | None = None, order_by: Column | None = None) -> Result:
        """Last write wins by key. order_by: which of a batch's rows of one key counts (default: the greatest row)."""
        return self._write(df, "UPSERT", batch=batch, order_by=order_by)

    insert = load = upsert

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> Result:
        return self._write(df, "APPEND", batch=batch, dedupe=False)

    def delete(self, where: E.Expr | Column) -> Result:
        """Tombstones for matching keys; rewritten rows for tables without a key."""

        def work(state: State) -> Result:
            if state.metadata["keys"]:
                return self._marked(state, "DELETE", self.scan(where, version=state.version))
            return self._replace(state, "DELETE", self.scan(version=state.version).filter(~_holds(where)))

        return self._worked_out(work)

    def update(self, assignments: dict[str, Any], where: E.Expr | Column) -> Result:
        """Values are literals, expressions or Columns over the row as it was."""
        if not assignments:
            raise ValueError("update needs assignments")

        def work(state: State) -> Result:
            if set(assignments) & set(state.metadata["keys"]):
                raise ValueError("keys cannot be assigned")
            if state.metadata["keys"]:
                return self._marked(state, "UPDATE", _assigned(self.scan(where, version=state.version), assignments))
            return self._replace(state, "UPDATE", _assigned(self.scan(version=state.version), assignments, where))

        return self._worked_out(work)

    def _marked(self, state: State, op: str, df: DataFrame) -> Result:
        """Rows of ``state`` written again, as of the version after it."""
        seg = self._segment(df, state.metadata, op)
        v = self._at(state, op, [], {**seg, "seq": state.version + 1} if seg else None)
        return Result(True, seg["rows"] if seg else 0, v)

    def update_lazily(self, assignments: dict[str, Any], where: E.Expr) -> str:
        """Deferred update: recorded in the log, applied to older rows when they are read."""
        if set(assignments) & set(self.state().metadata["keys"]):
            raise ValueError("keys cannot be assigned")
        entry = {"id": uuid.uuid4().hex, "where": E.to_json(where), "set": {c: E.to_json(E._operand(v)) for c, v in assignments.items()}}
        self._commit("LAZY_UPDATE", lambda s: [{"update": {**entry, "seq": s.version + 1}}])
        return entry["id"]

    def cancel_update(self, update_id: str) -> None:
        self._commit("CANCEL_UPDATE", lambda s: [{"update_remove": {"id": update_id}}])

    def overwrite(self, df: DataFrame, where: E.Expr | None = None) -> Result:
        """Replace all rows, or those that match; CommitConflict if rows were written meanwhile."""
        state = self.state()
        names = StructType.fromJson(json.loads(state.metadata["schema"])).fieldNames()
        kept = df.select(names) if where is None else self.scan(E.not_(where), version=state.version).unionByName(df.select(names))
        return self._replace(state, "OVERWRITE", kept)

    def _replace(self, state: State, operation: str, df: DataFrame) -> Result:
        """All rows of ``state`` replaced."""
        seg = self._segment(df, state.metadata, "INSERT")
        v = self._at(state, operation, removals(state), {**seg, "seq": state.version + 1} if seg else None)
        return Result(True, seg["rows"] if seg else 0, v)

    def compact(self, files: int | None = None) -> Result:
        """One level-1 segment of the current rows, clustered by key. What is written meanwhile stays, and stays newer."""
        state = self.state()
        df, keys = self.scan(version=state.version), state.metadata["keys"]
        if keys:
            df = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
        seg = self._segment(df, state.metadata, "INSERT", level=1)
        actions = removals(state) + ([{"add": {**seg, "seq": max(s["seq"] for s in state.segments.values()), "base": state.version}}] if seg else [])

        def still(s: State) -> list[dict]:
            if not state.segments.keys() <= s.segments.keys() or names_stored(s.metadata) != names_stored(state.metadata) or [u for u in state.updates if u not in s.updates]:
                raise CommitConflict(f"{self.root}: what was compacted is gone")
            return actions

        try:
            return Result(True, seg["rows"] if seg else 0, self._commit("COMPACT", still))
        except Exception:
            if seg:
                self.log.files.delete(seg["path"])
            raise

    def compact_if_needed(self, segments: int = 8, updates: int = 4) -> Result | None:
        """Compaction by policy: more segments in one cluster, or more deferred updates, than given."""
        state = self.state()
        most = max(map(len, pruning.clusters(list(state.segments.values()))), default=0) if state.metadata["keys"] else len(state.segments)
        return self.compact() if most > segments or len(state.updates) > updates else None

    def remove_orphans(self, older_than_s: float = 24 * 3600) -> list[str]:
        """Folders of segments that no version added: what writers left that failed. Returns what was removed."""
        known = {p.rstrip("/").rpartition("/")[2] for p in self.log.paths()}
        files, out = self.log.files, []
        for level in files.names(f"{self.root}/data"):
            for name in files.names(f"{self.root}/data/{level}"):
                path = f"{self.root}/data/{level}/{name}"
                if name not in known and files.age(path) >= older_than_s:
                    files.delete(path)
                    out.append(path)
        return out

    def alter(self, schema: StructType) -> int:
        """New columns read as null from older segments; dropped ones disappear for good."""
        state = self.state()
        meta = state.metadata
        names = schema.fieldNames()
        if missing := {*meta["keys"], *meta["partition_by"], *([meta["buckets"][0]] if meta["buckets"] else [])} - set(names):
            raise ValueError(f"keys and partition columns must stay: {missing}")
        if clash := set(names) & {*HIDDEN, "_bucket"}:
            raise ValueError(f"reserved names: {clash}")
        number, old, used = meta["schema_version"] + 1, names_stored(meta), list(meta.get("used", list(names_stored(meta).values())))
        stored = {n: old[n] if n in old else n if n not in used else f"{n}__{number}" for n in names}
        new = {**meta, "schema": schema.json(), "schema_version": number, "stored": stored, "used": list(dict.fromkeys([*used, *stored.values()]))}
        return self._at(state, "ALTER_SCHEMA", [{"metadata": new}], None)

    # --- reads ---

    def _read(self, segs: list[dict], meta: dict, schema: StructType, hidden: bool) -> DataFrame:
        """Columns of ``schema`` of segments of one write each, with _seq; columns that a segment lacks are null."""
        out, stored = None, names_stored(meta)
        for s in segs:
            df = self.spark.read.parquet(s["path"])
            cols = [(F.col(stored[f.name]).cast(f.dataType) if stored[f.name] in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
            df = df.select(*cols, F.lit(s["seq"]).cast("long").alias("_seq"), "_op_type", *(["_commit_ts"] if hidden else []), *(["_hidden_pk"] if hidden and "_hidden_pk" in df.columns else []))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def scan(self, where: E.Expr | Column | None = None, columns: list[str] | None = None, version: int | None = None, hidden: bool = False) -> DataFrame:
        """Rows at a version (default: the newest) that match, as a DataFrame. A Column filters after the merge."""
        if isinstance(where, Column):
            rows = self.scan(None, None if columns is None else self.schema(version).fieldNames(), version, hidden).filter(_holds(where))
            return rows if columns is None else rows.select(*columns, *([c for c in HIDDEN if c in rows.columns] if hidden else []))
        state = self.state(version)
        meta, schema = state.metadata, StructType.fromJson(json.loads(state.metadata["schema"]))
        keys = meta["keys"]
        where = E.simplify(where) if where is not None else None
        spec = pruning.extract(where, keys[0]) if keys else pruning.KeySpec(never=where == E.FALSE)
        segs = [s for s in state.segments.values() if pruning.may_hold(spec, s["min_key"], s["max_key"])]
        if not segs:
            df = self.spark.createDataFrame([], schema)
            return df.select(columns) if columns else df
        needed = {*(columns or schema.fieldNames()), *keys, *(E.references(where) if where is not None else ())}
        for u in reversed(state.updates):
            needed |= E.references(E.from_json(u["where"])) | {r for c, v in u["set"].items() if c in needed for r in E.references(E.from_json(v))}
        slim = StructType([f for f in schema.fields if f.name in needed])  # the merge would keep all others alive
        parts = [] if where is None else where.args if where.op == "and" else [where]
        early = [p for p in parts if E.only_keys(p, set(keys))] if keys else []
        df = None
        for group in pruning.clusters(segs) if keys else [segs]:
            one = self._read(group, meta, slim, hidden)
            if early:
                one = one.filter(E.to_filter(E.and_(*early)))
            if keys and len(group) > 1:
                one = newest(one, keys, F.col("_seq"), unique=True)
            df = one if df is None else df.unionByName(one, allowMissingColumns=True)
        if keys:
            df = df.filter("_op_type <> 'DELETE'")
        for u in sorted(state.updates, key=lambda u: u["seq"]):
            hit = (F.col("_seq") < u["seq"]) & E.to_column(E.from_json(u["where"]))
            new = {c: F.when(hit, E.to_column(E.from_json(v)).cast(schema[c].dataType)).otherwise(F.col(c)) for c, v in u["set"].items() if c in df.columns and c in schema.fieldNames()}
            df = df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])
        if where is not None:
            df = df.filter(E.to_filter(where))
        shown = columns or schema.fieldNames()
        return df.select(*shown, *([c for c in HIDDEN if c in df.columns] if hidden else []))

    def find(self, key: dict[str, Any], columns: list[str] | None = None, where: E.Expr | None = None, version: int | None = None) -> DataFrame:
        """The row of a key, or none."""
        keys = self.state(version).metadata["keys"]
        if set(key) != set(keys):
            raise ValueError(f"the key is {keys}, not {sorted(key)}")
        return self.scan(E.and_(*[E.eq(k, v) for k, v in key.items()], *([where] if where else [])), columns, version).limit(1)

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Rows written in versions after..upto, with _seq and _op_type: a change feed."""
        state = self.state(upto)
        segs = [s for s in state.segments.values() if s["seq"] > after]
        schema = StructType.fromJson(json.loads(state.metadata["schema"]))
        empty = self.spark.createDataFrame([], schema).withColumns({"_seq": F.lit(0).cast("long"), "_op_type": F.lit("")})
        return self._read(segs, state.metadata, schema, False) if segs else empty


def names_stored(meta: dict) -> dict[str, str]:
    """Columns and the names under which segments hold them."""
    return meta.get("stored") or {f["name"]: f["name"] for f in json.loads(meta["schema"])["fields"]}


def removals(state: State) -> list[dict]:
    return [{"remove": {"path": p}} for p in state.segments] + [{"update_remove": {"id": u["id"]}} for u in state.updates]


def newest(df: DataFrame, keys: list[str], order_by: Column | None = None, unique: bool = False) -> DataFrame:
    """The greatest row of each key, by order_by (null least), ties by the row itself. Aggregation, so partial before the shuffle.

    unique: order_by is never null and has no ties. Maps, which have no order, count by their JSON.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    if unique and order_by is not None:
        rank = order_by
    else:
        own = [F.to_json(F.struct(c)).alias(c) if has_map(df.schema[c].dataType) else F.col(c) for c in rest]
        rank = F.struct(*([order_by.isNotNull().alias("_known"), order_by.alias("_o")] if order_by is not None else []), *own)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*").select(df.columns)


def has_map(kind) -> bool:
    return isinstance(kind, MapType) or any(has_map(k) for k in ([kind.elementType] if hasattr(kind, "elementType") else [f.dataType for f in getattr(kind, "fields", [])]))


def _holds(where: E.Expr | Column) -> Column:
    """Two-valued: null counts as false."""
    return F.coalesce(where, F.lit(False)) if isinstance(where, Column) else E.to_column(E.simplify(where))


def _assigned(df: DataFrame, assignments: dict[str, Any], where: E.Expr | Column | None = None) -> DataFrame:
    new = {c: (v if isinstance(v, Column) else E.to_column(E._operand(v))).cast(df.schema[c].dataType) for c, v in assignments.items()}
    hit = _holds(where) if where is not None else None
    return df.select(*[F.col(c) if c not in new else (new[c] if hit is None else F.when(hit, new[c]).otherwise(F.col(c))).alias(c) for c in df.columns])
