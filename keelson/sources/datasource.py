"""``spark.read.format("keelson")`` and ``df.write.format("keelson")``: tables through Spark's Python data source API.

For use from SQL or other languages, on local or mounted folders; Python programs get a faster,
JVM-side plan from Table.scan. Segments that may hold the same keys are merged by ranges of keys, each
of about as many rows as a task can hold; row groups whose keys lie outside of a range are not read for it.
A write is one commit of what all tasks wrote; it appends to tables without a key, and else upserts.
"""

from __future__ import annotations

import uuid

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


def _root(options) -> str:
    return "file:///" + options["path"].removeprefix("file:").strip("/")


#: What a task merges at a time: rows, and bytes as they are stored. Rows of a row group that is written.
ROWS, BYTES, GROUP = 250_000, 16 << 20, 16_384


def _rank(key: tuple) -> tuple:
    """Nulls first."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in key)


def _below(batch, keys, cut):
    """Which rows have keys before ``cut``: nulls first, NaN after all."""
    import pyarrow as pa
    import pyarrow.compute as pc

    below, tied = (pa.repeat(pa.scalar(v), batch.num_rows) for v in (False, True))
    for k, v in zip(keys, cut):
        c = batch[k]
        less = pa.repeat(pa.scalar(False), len(c)) if v is None else pc.fill_null(pc.less(c, pa.scalar(v, c.type)), True)
        same = c.is_null() if v is None else pc.fill_null(pc.equal(c, pa.scalar(v, c.type)), False)
        below, tied = pc.or_(below, pc.and_(tied, less)), pc.and_(tied, same)
    return below


def _newest(table, keys):
    """Rows in order of key; of a key's rows the one of greatest _rank."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = table.num_rows
    if not n:
        return table
    table = table.combine_chunks()
    if any(pa.types.is_nested(table[k].type) for k in keys):  # Arrow does not sort these
        rows = list(zip(*(table[k].to_pylist() for k in keys)))
        by = table["_rank"].to_pylist()
        order = sorted(range(n), key=lambda i: (_rank(rows[i]), by[i]))
        return table.take([i for i, after in zip(order, [*order[1:], None]) if after is None or rows[i] != rows[after]])
    table = table.take(pc.sort_indices(table, [*((k, "ascending") for k in keys), ("_rank", "ascending")], null_placement="at_start")).combine_chunks()
    same = pa.repeat(pa.scalar(True), n - 1)
    for k in keys:
        c = table[k]
        a, b = c.slice(0, n - 1).combine_chunks(), c.slice(1).combine_chunks()
        alike = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        if pa.types.is_floating(c.type):
            alike = pc.or_(alike, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        same = pc.and_(same, alike)
    return table.filter(pa.concat_arrays([pc.invert(same), pa.array([True])]))


class KeelsonSource(DataSource):
    """Options path: the table's folder; version: which to read (default: the newest); pushdown: true, where the
    session has spark.sql.python.filterPushdown.enabled, lets comparisons with the key choose segments."""

    @classmethod
    def name(cls) -> str:
        return "keelson"

    def _state(self):
        from .log import Log

        version = self.options.get("version")
        state = Log(None, _root(self.options)).state(None if version is None else int(version))
        if state.metadata is None:
            raise ValueError(f"no table at {self.options['path']}")
        return state

    def schema(self):
        import json

        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(self._state().metadata["schema"]))

    def reader(self, schema):
        state = self._state()
        if state.updates:
            raise ValueError("the table has deferred updates: compact it first, or read it with Table.scan")
        return (_PushingReader if self.options.get("pushdown", "").lower() == "true" else _Reader)(state, schema)

    def writer(self, schema, overwrite):
        return _Writer(_root(self.options), schema, self._state(), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, state, schema):
        self.state, self.schema, self.spec = state, schema, []

    def partitions(self):
        import glob

        from ..functions import expr as E
        from . import pruning
        from .log import plain_path

        keys = self.state.metadata["keys"]
        files = lambda s: sorted(glob.glob(f"{plain_path(s['path'])}/**/*.parquet", recursive=True))
        segments = list(self.state.segments.values())
        if not keys:
            return [InputPartition(([(f, 0, None)], None)) for s in segments for f in files(s)]
        spec = pruning.extract(E.and_(*self.spec), keys[0]) if self.spec else pruning.KeySpec()
        segments = [s for s in segments if pruning.may_hold(spec, s["min_key"], s["max_key"])]
        out = []
        for group in pruning.clusters(segments):
            every = [f for s in sorted(group, key=lambda s: (s["seq"], s.get("part", 0))) for f in files(s)]
            out += [InputPartition(([(f, 0, None)], None)) for f in every] if len(group) == 1 else [InputPartition(c) for c in self._cut(every)]
        return out

    def _cut(self, files):
        """Files, the newest last, as ranges of keys: for each the row groups that it needs, and its bounds."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        from .table import names_stored

        keys, lead = self.state.metadata["keys"], names_stored(self.state.metadata)[self.state.metadata["keys"][0]]
        kinds = to_arrow_schema(StructType([self._whole()[k] for k in keys]))
        pieces, size = [], 0
        for rank, file in enumerate(files):
            source = pq.ParquetFile(file)
            place = source.schema_arrow.names.index(lead) if lead in source.schema_arrow.names else None
            told = place is not None and source.schema_arrow.field(lead).type == kinds.field(0).type
            column = next((i for i in range(len(source.schema)) if source.schema.column(i).path == lead), None) if told else None
            for g in range(source.metadata.num_row_groups):
                group = source.metadata.row_group(g)
                stats = group.column(column).statistics if column is not None else None
                low, high = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
                some_null = stats is None or not stats.has_null_count or stats.null_count > 0
                pieces.append((file, rank, g, low, None if pa.types.is_floating(kinds.field(0).type) else high, some_null))
                size += max(group.num_rows / ROWS, group.total_byte_size / BYTES)
        cuts = []
        if size > 1 and not any(pa.types.is_nested(k.type) for k in kinds):
            # the key of every so many rows, few enough for what the files have between two of them to fit
            step = max(256, min(GROUP, ROWS // len(files)))
            marks = []
            for file, _, g, *_ in pieces:
                for batch in self._batches(file, pa.schema([]), keys, [g], step):
                    marks.append(tuple(batch[k][0].as_py() for k in keys))
            marks = sorted((m for m in marks if all(v == v for v in m)), key=_rank)
            many = min(len(marks), int(size) + 1)
            cuts = sorted({marks[len(marks) * i // many] for i in range(1, many)}, key=_rank) if marks else []
        out = []
        for low, high in zip([None, *cuts], [*cuts, None]):
            need = {}
            for file, rank, g, least, most, some_null in pieces:
                past = low is not None and low[0] is not None and most is not None and most < low[0]
                ahead = high is not None and least is not None and (high[0] is None or least > high[0]) and (not some_null or (low is not None and low[0] is not None))
                if not past and not ahead:
                    need.setdefault((file, rank), []).append(g)
            out.append(([(file, rank, groups) for (file, rank), groups in need.items()], (low, high)))
        return out

    def _whole(self):
        import json

        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(self.state.metadata["schema"]))

    def _merged(self, pieces, span, arrow):
        """The newest row of each key of a range, tombstones included."""
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, (low, high), kept = self.state.metadata["keys"], span, []
        for file, rank, groups in pieces:
            for batch in self._batches(file, arrow, keys, groups):
                if low is not None:
                    batch = batch.filter(pc.invert(_below(batch, keys, low)))
                if high is not None:
                    batch = batch.filter(_below(batch, keys, high))
                if batch.num_rows:
                    kept.append(pa.Table.from_batches([batch]).append_column("_rank", pa.repeat(pa.scalar(rank, pa.int64()), batch.num_rows)))
        return _newest(pa.concat_tables(kept), keys) if kept else None

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, names, keys = to_arrow_schema(self.schema), self.schema.fieldNames(), self.state.metadata["keys"]
        pieces, span = partition.value
        if span is None:
            batches = self._batches(pieces[0][0], arrow)
        else:
            merged = self._merged(pieces, span, arrow)
            batches = merged.to_batches(max_chunksize=10_000) if merged is not None else []
        for batch in batches:
            kept = batch.filter(pa.compute.not_equal(batch["_op_type"], "DELETE")) if keys else batch
            yield pa.RecordBatch.from_arrays([kept[n] for n in names], schema=arrow)

    def _batches(self, file, arrow, more=(), groups=None, rows=GROUP):
        """Columns by the names of the table: what a file lacks is null or, for partition columns, in its path."""
        import urllib.parse

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        from .table import names_stored

        stored = names_stored(self.state.metadata)
        whole = to_arrow_schema(self._whole())
        types = {n: whole.field(n).type for n in dict.fromkeys([*arrow.names, *more])}
        source = pq.ParquetFile(file)
        have = set(source.schema_arrow.names)
        fixed = dict(p.split("=", 1) for p in file.split("/") if "=" in p and not p.startswith("level="))
        wanted = [stored[n] for n in types if stored[n] in have] + ["_op_type"]
        for batch in source.iter_batches(batch_size=rows, row_groups=groups, columns=wanted):
            columns = []
            for n, kind in types.items():
                if stored[n] in have:
                    columns.append(batch[stored[n]].cast(kind, safe=False))
                elif stored[n] in fixed and fixed[stored[n]] != "__HIVE_DEFAULT_PARTITION__":
                    columns.append(pa.array([urllib.parse.unquote(fixed[stored[n]])] * batch.num_rows, pa.string()).cast(kind))
                else:
                    columns.append(pa.nulls(batch.num_rows, kind))
            yield pa.RecordBatch.from_arrays([*columns, batch["_op_type"]], [*types, "_op_type"])


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        """Comparisons with the leading key choose segments; all are checked again by Spark."""
        from ..functions import expr as E

        keys = self.state.metadata["keys"]
        make = {"EqualTo": E.eq, "GreaterThan": E.gt, "GreaterThanOrEqual": E.ge, "LessThan": E.lt, "LessThanOrEqual": E.le}
        for f in filters:
            if type(f).__name__ in make and getattr(f, "attribute", None) == tuple(keys[:1]):
                self.spec.append(make[type(f).__name__](keys[0], f.value))
            yield f


class _Written(WriterCommitMessage):
    def __init__(self, file, rows, low, high, nulls):
        self.file, self.rows, self.low, self.high, self.nulls = file, rows, low, high, nulls


class _Writer(DataSourceArrowWriter):
    """Each task writes one file: runs that are sorted in memory, merged by ranges."""

    def __init__(self, root, schema, state, overwrite):
        if state.metadata["partition_by"] or state.metadata["buckets"]:
            raise ValueError("partitioned tables are written with Table")
        import json

        names = schema.fieldNames()
        expected = [f["name"] for f in json.loads(state.metadata["schema"])["fields"]]
        if set(names) != set(expected):
            raise ValueError(f"the table has columns {expected}, not {names}")
        self.root, self.schema, self.state, self.overwrite = root, schema, state, overwrite
        self.path = f"{root}/data/level=0/seg-{uuid.uuid4().hex}"

    def write(self, iterator):
        import datetime
        import os
        import tempfile

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        from .log import plain_path
        from .table import names_stored

        meta, folder = self.state.metadata, plain_path(self.path)
        stored, keys = names_stored(meta), meta["keys"]
        os.makedirs(folder, exist_ok=True)
        arrow = to_arrow_schema(self.schema)
        reader = _Reader(self.state, self.schema)
        file, now = f"{folder}/part-{uuid.uuid4().hex}.parquet", datetime.datetime.now(datetime.timezone.utc)

        def sorted_runs():
            """What of the rows fits in memory at a time; of equal keys the last row stays."""
            held, count, size = [], 0, 0
            for batch in iterator:
                held.append(batch)
                count, size = count + batch.num_rows, size + batch.nbytes
                if count >= ROWS or size >= BYTES:
                    yield run(held)
                    held, count, size = [], 0, 0
            if count:
                yield run(held)

        def run(held):
            table = pa.Table.from_batches(held)
            if table.schema != arrow:
                table = table.select(arrow.names).cast(arrow)
            if keys:
                table = _newest(table.append_column("_rank", pa.array(range(table.num_rows), pa.int64())), keys).drop_columns("_rank")
            return table.rename_columns([stored[n] for n in arrow.names]).append_column("_op_type", pa.repeat(pa.scalar("INSERT"), table.num_rows))

        def whole_runs(aside):
            """Runs as they are, or merged where there are several and they have keys."""
            files = []
            for table in sorted_runs():
                if not keys:
                    yield table
                    continue
                files.append(f"{aside}/{len(files)}.parquet")
                pq.write_table(table, files[-1], compression="zstd", row_group_size=GROUP)
            for pieces, span in reader._cut(files) if files else []:
                table = reader._merged(pieces, span, arrow)
                if table is not None:
                    yield table.select([*arrow.names, "_op_type"]).rename_columns([*(stored[n] for n in arrow.names), "_op_type"])

        rows, low, high, unknown, out = 0, None, None, 0, None
        with tempfile.TemporaryDirectory() as aside:
            for table in whole_runs(aside):
                table = table.append_column("_commit_ts", pa.repeat(pa.scalar(now, pa.timestamp("us", "UTC")), table.num_rows))
                if keys:
                    lead = table[stored[keys[0]]]
                    unknown += lead.null_count + (pc.sum(pc.is_nan(lead)).as_py() or 0 if pa.types.is_floating(lead.type) else 0)
                    if not pa.types.is_nested(lead.type):
                        ends = [v for v in (low, high, *pc.min_max(lead).as_py().values()) if v is not None]
                        low, high = min(ends, default=None), max(ends, default=None)
                else:
                    table = table.append_column("_hidden_pk", pa.array([uuid.uuid4().int >> 65 for _ in range(table.num_rows)], pa.int64()))
                out = out or pq.ParquetWriter(file, table.schema, compression="zstd")
                out.write_table(table, row_group_size=GROUP)
                rows += table.num_rows
        if out is None:
            return _Written([], [], [], [], 0)
        out.close()
        return _Written([file], [rows], [low], [high], unknown)

    def commit(self, messages):
        """Each file is a segment of its own: two tasks may hold the same key."""
        import os

        from pyspark.sql.types import TimestampType

        from . import pruning
        from .log import CommitConflict, Log, plain_path

        log, keys = Log(None, self.root), self.state.metadata["keys"]
        made = []
        for m in messages:
            for file, rows, low, high in zip(m.file, m.rows, m.low, m.high):
                path = f"{self.path}-{len(made)}"
                os.makedirs(plain_path(path))
                os.rename(file, f"{plain_path(path)}/{os.path.basename(file)}")
                known = keys and not m.nulls and not isinstance(self.schema[keys[0]].dataType, TimestampType)
                low, high = (pruning.stored(low), pruning.stored(high)) if known else (None, None)
                made.append({"path": path, "level": 0, "rows": rows, "min_key": low if high is not None else None, "max_key": high if low is not None else None})
        for _ in range(20):
            now = log.state()
            if self.overwrite and now.version != self.state.version:
                raise CommitConflict(f"{self.root}: rows were written meanwhile")
            gone = [{"remove": {"path": p}} for p in now.segments] + [{"update_remove": {"id": u["id"]}} for u in now.updates] if self.overwrite else []
            try:
                log.commit(now.version + 1, "OVERWRITE" if self.overwrite else "UPSERT" if keys else "APPEND", gone + [{"add": {**s, "seq": now.version + 1, "part": i}} for i, s in enumerate(made)])
                return
            except CommitConflict:
                continue
        raise CommitConflict(self.root)

    def abort(self, messages):
        import shutil

        from .log import plain_path

        shutil.rmtree(plain_path(self.path), ignore_errors=True)
