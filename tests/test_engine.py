"""What SQL cannot express: pruning, conflicts, idempotence, service, routing."""

import pytest
from pyspark.sql import functions as F

from keelson.functions import expr as E
from keelson.operators import routing as R
from keelson.operators.service import JobState, SqlService, load_score, pressure
from keelson.sources import pruning
from keelson.sources.catalog import Catalog, scratch
from keelson.sources.log import CommitConflict
from keelson.sources.table import Table

KV = "key string not null, value string"


@pytest.fixture
def kv(spark):
    from pyspark.sql.types import StructType

    return Table.create(spark, f"{scratch(spark)}/kv", StructType.fromDDL(KV), ["key"])


def put(t, *pairs):
    return t.upsert(t.spark.createDataFrame(pairs, "key string, value string"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_write_read_point_range_null_duplicate(kv):
    assert rows(kv.scan()) == []
    put(kv, *[(f"k{i}", f"v{i}") for i in range(1, 6)])
    put(kv, ("k1", "v9"), ("n", None))
    assert rows(kv.find({"key": "k3"})) == [("k3", "v3")]
    assert rows(kv.scan(E.range_("key", "k2", True, "k4", False))) == [("k2", "v2"), ("k3", "v3")]
    assert rows(kv.find({"key": "k1"})) == [("k1", "v9")]
    assert rows(kv.find({"key": "n"})) == [("n", None)]


def test_special_characters(kv):
    odd = ["a b", "a-b", "a.b", "a/b", "键", "😀", "x\n\ty", "", "'q'"]
    put(kv, *[(k, k) for k in odd])
    assert sorted(r.key for r in kv.scan().collect()) == sorted(odd)


def test_older_version_does_not_come_back(kv):
    put(kv, ("a", "x"))
    put(kv, ("a", "y"))
    assert rows(kv.scan(E.eq("value", "x"))) == []


def test_pruning_reads_only_needed_segments(kv):
    for p in "abc":
        put(kv, *[(f"{p}{i}", p) for i in range(5)])
    assert len(kv.scan().inputFiles()) > len(kv.scan(E.eq("key", "b1")).inputFiles()) > 0
    assert kv.scan(E.and_(E.eq("key", "b1"), E.eq("key", "b2"))).count() == 0
    assert len(kv.scan(E.or_(E.eq("key", "b1"), E.eq("value", "c"))).inputFiles()) == len(kv.scan().inputFiles())


def test_key_filter_reaches_the_scan(kv):
    put(kv, ("a", "x"))
    plan = kv.scan(E.eq("key", "a"))._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan


def test_key_spec():
    s = pruning.extract(E.and_(E.ge("k", 3), E.lt("k", 9), E.in_("k", [1, 4, 9])), "k")
    assert s.points == {4}
    assert pruning.may_hold(s, 0, 4) and not pruning.may_hold(s, 5, 9)
    assert pruning.extract(E.eq("k", None), "k").never
    assert pruning.extract(E.not_(E.eq("k", 1)), "k") == pruning.KeySpec()
    assert pruning.extract(E.eq("k", "x"), "k") and pruning.may_hold(pruning.extract(E.eq("k", "x"), "k"), 1, 2)


def test_conflicting_commit_is_refused(kv):
    put(kv, ("a", "x"))
    with pytest.raises(CommitConflict):
        kv.log.commit(1, "X", [])


def test_batch_applied_once(kv):
    df = kv.spark.createDataFrame([("a", "1")], KV)
    assert kv.upsert(df, batch=("app", 3)).rows == 1
    assert kv.upsert(df, batch=("app", 3)).rows == 0
    assert kv.upsert(df, batch=("app", 2)).rows == 0


def test_lazy_update_before_and_after_upsert(kv):
    put(kv, ("a", "x"), ("b", "x"))
    uid = kv.update_lazily({"value": "z"}, E.eq("value", "x"))
    put(kv, ("b", "x"))  # newer than the update: stays
    assert rows(kv.scan()) == [("a", "z"), ("b", "x")]
    kv.cancel_update(uid)
    assert rows(kv.scan()) == [("a", "x"), ("b", "x")]


def test_create_validates(spark):
    from pyspark.sql.types import StructType

    with pytest.raises(ValueError):
        Table.create(spark, f"{scratch(spark)}/t", StructType.fromDDL(KV), ["nope"])


def test_catalog(spark):
    c = Catalog(spark, scratch(spark))
    c.create_as("Db.T", spark.range(3), ["id"])
    assert c.tables("db") == ["t"] and c.load("db.t").scan().count() == 3
    with pytest.raises(ValueError):
        c.create("db.T", spark.range(1).schema)
    c.drop("db.t")
    with pytest.raises(KeyError):
        c.load("db.t")


def test_data_source(spark, kv):
    from keelson.sources.datasource import KeelsonSource

    spark.dataSource.register(KeelsonSource)
    put(kv, ("a", "1"), ("b", "2"))
    assert rows(spark.read.format("keelson").option("path", kv.root).load()) == [("a", "1"), ("b", "2")]


def test_simplify_and_json():
    assert E.simplify(E.and_(E.lit(True), E.eq("a", 1), E.eq("a", 1))) == E.eq("a", 1)
    assert E.simplify(E.or_(E.lit(True), E.eq("a", 1))) == E.TRUE
    assert E.simplify(E.between("a", 3, 1)) == E.FALSE
    assert E.simplify(E.ne(E.lit(1), E.lit(None))) == E.FALSE
    e = E.and_(E.in_("a", ["x", None]), E.between("b", 1, 2, False), E.like("c", "a%", False))
    assert E.from_json(E.to_json(e)) == e
    assert E.is_key_equality(E.and_(E.eq("a", 1), E.eq("b", 2)), {"a", "b"}) and not E.is_key_equality(E.gt("a", 1), {"a"})
    assert E.key_values(E.and_(E.eq("a", 1), E.gt("b", 2)), {"a", "b"}) == {"a": 1}


def test_shard_matches_exchange(spark):
    df = spark.range(500).withColumn("key", F.col("id").cast("string")).repartition(7, "key")
    assert df.filter(F.spark_partition_id() != R.shard_of(F.col("key"), 7)).count() == 0


def test_mod_hash(spark):
    def brute(b: bytes, n: int) -> int:
        h = 1
        for x in b:
            h = (31 * h + (x - 256 if x > 127 else x)) & 0xFFFFFFFF
        return (h - (1 << 32) if h >= 1 << 31 else h) % n

    got = spark.createDataFrame([("abc",), ("é",), ("",)], "k string").select("k", R.mod_hash_shard(F.col("k"), 13).alias("s")).collect()
    assert all(r.s == brute(r.k.encode(), 13) for r in got)


def test_batch_ids_and_deduper():
    a = R.batch_id("t", 1, 2, {3: [(b"k", None)], 1: [(b"k", b"")]})
    assert a == R.batch_id("t", 1, 2, {1: [(b"k", b"")], 3: [(b"k", None)]}) != R.batch_id("t", 1, 2, {1: [(b"k", None)], 3: [(b"k", b"")]})
    d = R.Deduper(window=2)
    assert d.begin(1, "a") is R.Verdict.APPLY and d.begin(1, "a") is R.Verdict.RETRY
    d.commit("a")
    assert d.begin(1, "a") is R.Verdict.DUPLICATE and d.begin(0, "b") is R.Verdict.STALE_EPOCH


def test_failover():
    t = R.ShardTable(2)
    assert t.lookup(0)[0] is R.Status.UNASSIGNED
    a, b = R.Slot("n1", 0), R.Slot("n2", 0)
    t.executor_up("e1", a)
    assert t.lookup(0)[0] is R.Status.PENDING_READY
    t.executor_ready("e1")
    assert t.lookup(0) == (R.Status.ASSIGNED, R.Assignment(a, "e1", 1))
    t.executor_up("e2", b)
    t.executor_down("e1")
    status, owner = t.lookup(0)
    assert status is R.Status.RECOVERING and owner.executor == "e2" and owner.epoch == 2
    assert not t.recovered(0, 1) and t.recovered(0, 2)


def test_range_floor_over_partitions(spark):
    got = R.range_floor(spark.range(0, 1000, 7).withColumnRenamed("id", "v"), "v", spark.createDataFrame([(10, "a"), (500, "b")], "s long, n string"), "s", ["n"]).collect()
    assert all(r.n == (None if r.v < 10 else "a" if r.v < 500 else "b") for r in got) and len(got) == 143


def test_service(spark):
    s = SqlService(spark, Catalog(spark, scratch(spark)))
    steps = list(s.run("SELECT 1 AS id, 'hello' AS name"))
    assert steps[1][0] == "SUCCEEDED" and steps[2] == ("CHUNK", [{"id": 1, "name": "hello"}])
    bad = s.submit("SELECT nope FROM nowhere")
    assert s.wait(bad) is JobState.FAILED and s.jobs[bad].error
    with pytest.raises(KeyError):
        s.status("job-x")
    slow = s.submit("SELECT count(*) FROM range(100000000000) a WHERE hash(a.id) = 1 AND hash(a.id + 1) = 2")
    import time

    while s.status(slow) is JobState.PENDING:
        time.sleep(0.05)
    assert s.cancel(slow) and s.wait(slow) is JobState.CANCELLED
    out = f"{scratch(spark)}/out"
    job = s.submit("SELECT 1 AS id, 'test' AS name", output_path=out, format="csv")
    assert s.wait(job) is JobState.SUCCEEDED and spark.read.csv(out).count() == 1
    assert s.validate("SELECT 1")[0] and s.report()["ended"] >= 4
    s.shutdown()


def test_pressure():
    assert pressure(load_score(0)) == "NORMAL" and pressure(load_score(100, 1, 1)) == "WARNING" and pressure(load_score(100, 1, 1, 1, 1)) == "REJECTING"


def meanwhile(t, monkeypatch, method, commit):
    """Runs ``commit`` once, between what an operation reads and what it commits."""
    real, done = Table._segment, []

    def segment(self, df, meta, op, level=0):
        out = real(self, df, meta, op, level)
        if self is t and not done:
            done.append(1)
            commit(Table(t.spark, t.root))
        return out

    monkeypatch.setattr(Table, "_segment", segment)
    try:
        return method()
    finally:
        monkeypatch.setattr(Table, "_segment", real)


def test_rows_committed_meanwhile_stay(kv, monkeypatch):
    put(kv, *[(f"k{i}", "1") for i in range(5)])
    meanwhile(kv, monkeypatch, kv.compact, lambda t: put(t, ("k0", "new"), ("z1", "1"), ("z2", "1")))
    assert kv.scan().count() == 7 and rows(kv.find({"key": "k0"})) == [("k0", "new")]
    meanwhile(kv, monkeypatch, lambda: kv.update({"value": E.call("concat", E.col("value"), "!")}, E.starts_with("key", "k")), lambda t: put(t, ("k0", "99")))
    assert rows(kv.find({"key": "k0"})) == [("k0", "99!")]
    meanwhile(kv, monkeypatch, lambda: kv.delete(E.eq("value", "99!")), lambda t: put(t, ("k0", "kept")))
    assert rows(kv.find({"key": "k0"})) == [("k0", "kept")]
    with pytest.raises(CommitConflict):
        meanwhile(kv, monkeypatch, lambda: kv.overwrite(kv.scan(E.eq("key", "k1"))), lambda t: put(t, ("z3", "1")))
    assert kv.scan().count() == 8
    assert kv.remove_orphans(0) == []  # what came too late was removed at once


def test_append_only_rows_committed_meanwhile_stay(spark, monkeypatch):
    t = Table.create(spark, f"{scratch(spark)}/a", spark.range(1).schema)
    t.append(spark.range(5))
    meanwhile(t, monkeypatch, lambda: t.update({"id": E.add("id", 100)}, E.lt("id", 3)), lambda x: x.append(spark.range(2)))
    assert sorted(r.id for r in t.scan().collect()) == [3, 4, 100, 100, 101, 101, 102]
    meanwhile(t, monkeypatch, lambda: t.delete(E.ge("id", 100)), lambda x: x.append(spark.range(200, 202)))
    assert sorted(r.id for r in t.scan().collect()) == [3, 4]


def test_orphans_of_failed_writers_go(kv):
    put(kv, ("a", "1"))
    kv._segment(kv.scan(), kv.state().metadata, "INSERT")
    assert len(kv.remove_orphans(3600)) == 0 and len(kv.remove_orphans(0)) == 1
    assert rows(kv.scan()) == [("a", "1")]


def test_log_is_folded(kv):
    for i in range(23):
        kv.update_lazily({"value": str(i)}, E.eq("key", "a"))
    put(kv, ("a", "1"))
    names = kv.log.files.names(kv.log.folder)
    assert sum(n.endswith(".state") for n in names) == 2 and not any(n.endswith(".tmp") for n in names)
    assert len(kv.state().updates) == 23 and kv.state(21).version == 21 and len(kv.state(9).updates) == 9
    assert len(kv.snapshots()) == 25 and kv.compact_if_needed() is not None and not kv.state().updates


def test_column_that_comes_back_is_empty(kv):
    from pyspark.sql.types import StructType

    put(kv, ("a", "1"))
    whole = kv.schema()
    kv.alter(StructType([whole["key"]]))
    kv.alter(whole)
    assert rows(kv.scan()) == [("a", None)]
    put(kv, ("b", "2"))
    assert rows(kv.scan()) == [("a", None), ("b", "2")] and kv.compact().rows == 2
    assert rows(kv.scan(E.eq("value", "2"))) == [("b", "2")]


def test_newest_takes_null_order_ties_and_maps(spark):
    from keelson.sources.table import newest

    df = spark.createDataFrame([("a", None, 1), ("b", 2, 5), ("b", None, 9), ("c", 1, 1), ("c", 1, 2)], "k string, o int, v int")
    assert rows(newest(df, ["k"], F.col("o"))) == [("a", None, 1), ("b", 2, 5), ("c", 1, 2)]
    m = df.withColumn("m", F.create_map(F.lit("x"), F.col("v")))
    t = Table.create(spark, f"{scratch(spark)}/m", m.schema, ["k"])
    t.upsert(m)
    assert t.scan().filter("m['x'] = v").count() == 3


def test_disjoint_segments_are_not_merged_and_merges_are_slim(spark):
    import datetime

    df = spark.range(10).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d"), F.col("id").alias("v"), F.lit("x").alias("w"))
    t = Table.create(spark, f"{scratch(spark)}/d", df.schema, ["d"])
    t.upsert(df.filter("v < 5"))
    t.upsert(df.filter("v >= 5"))
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan(t.scan()) and t.scan().count() == 10
    assert len(t.scan(E.eq("d", datetime.date(2024, 1, 8))).inputFiles()) < len(t.scan().inputFiles())
    t.upsert(df.filter("v = 7").withColumn("v", F.lit(70).cast("long")))
    assert "Aggregate" in plan(t.scan()) and "w#" not in plan(t.scan(columns=["v"])).split("ReadSchema")[0].split("FileScan")[-1]
    assert sorted(r.v for r in t.scan(columns=["v"]).collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 70]


def test_data_source_writes_merges_and_pushes(spark, kv):
    from keelson.sources.datasource import KeelsonSource

    spark.dataSource.register(KeelsonSource)
    for n, value in ((30, "old"), (10, "new")):
        df = spark.range(n).select(F.format_string("k%02d", "id").alias("key"), F.lit(value).alias("value"))
        df.write.format("keelson").option("path", kv.root).mode("append").save()
    kv.delete(E.eq("key", "k05"))
    read = spark.read.format("keelson").option("path", kv.root)
    assert rows(read.load()) == rows(kv.scan()) and read.load().count() == 29
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert rows(read.option("pushdown", "true").load().filter("key = 'k03'")) == [("k03", "new")]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    kv.scan(E.eq("key", "k01")).write.format("keelson").option("path", kv.root).mode("overwrite").save()
    assert rows(kv.scan()) == [("k01", "new")]


def test_folding_is_what_spark_gives():
    assert E.simplify(E.mod(E.lit(-7), E.lit(3))) == E.lit(-1) and E.simplify(E.add(E.lit(2), E.lit(3))) == E.lit(5)
    big = E.add(E.lit(1 << 62), E.lit(1 << 62))
    assert E.simplify(big) == big and E.simplify(E.power(E.lit(-8.0), E.lit(0.5))).op == "pow"
    assert E.simplify(E.between("a", "x", 1)).op == "between" and E.simplify(E.gt(E.lit("a"), E.lit(1))).op == "gt"


def test_proto_and_json_keep_every_kind_of_value():
    import datetime
    from decimal import Decimal

    e = E.and_(E.in_("a", ["x", None, 2**70, -5, 2.5, True]), E.eq("d", Decimal("1.20")), E.eq("e", datetime.date(2020, 1, 2)), E.eq("f", b"\x00"), E.case((E.eq("a", 1), "x"), otherwise=-(2**63)))
    for dump, load in E.SERIALIZERS.values():
        assert load(dump(e)) == e


def test_range_floor_is_exact_where_sampling_is_partial(spark):
    import bisect

    n = 300_000
    starts = [(i * 97, str(i)) for i in range(20_000)]
    df = spark.range(n).select((F.xxhash64("id") % 2_000_000).alias("v")).union(spark.createDataFrame([(None,)], "v long"))
    got = R.range_floor(df, "v", spark.createDataFrame(starts, "s long, n string"), "s", ["n"]).collect()
    lows = [s for s, _ in starts]
    wrong = sum((r.s != (None if r.v is None or r.v < 0 else lows[bisect.bisect_right(lows, r.v) - 1])) for r in got)
    assert len(got) == n + 1 and wrong == 0


def test_service_statements_sessions_and_results(spark):
    s = SqlService(spark, Catalog(spark, scratch(spark)))
    s.execute("CREATE TABLE t (k INT, v STRING) USING keelson OPTIONS (primary 'k')")
    s.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, NULL)")
    s.execute("UPDATE t SET v = concat(v, ', where') WHERE k <= 2 AND v <> 'b'")
    s.execute("DELETE FROM t WHERE v = 'b'")
    assert rows(s.execute("SELECT * FROM t")) == [(1, "a, where"), (3, None)]
    s.execute("INSERT OVERWRITE t SELECT 9, 'z'")
    a, b = s.create_session(), s.create_session()
    assert s.wait(s.submit("CREATE TEMP VIEW mine AS SELECT 1 AS x", a)) is JobState.SUCCEEDED
    assert s.wait(s.submit("SELECT * FROM mine", b)) is JobState.FAILED
    job = s.submit("SELECT k, k FROM t", b)
    assert s.wait(job) is JobState.SUCCEEDED and list(s.result(job)) == [[(9, 9)]]
    many = s.submit("SELECT id FROM range(25000)")
    assert s.wait(many) is JobState.SUCCEEDED and [len(c) for c in s.result(many)] == [1000] * 25
    raised = []
    s.watch("many jobs", lambda r: r["jobs"] > 2, lambda n, r: raised.append(n))
    assert s.check_alerts() == ["many jobs"] and s.check_alerts() == [] and raised == ["many jobs"]
    s.execute("DROP TABLE t")
    s.execute("DROP TABLE IF EXISTS t")
    with pytest.raises(Exception):
        s.execute("SELECT * FROM t").collect()
    s.shutdown()


def test_files_of_partitioned_tables_are_sorted_by_key(spark):
    import glob

    import pyarrow.parquet as pq

    df = spark.range(0, 4000, 1, 8).selectExpr("id AS k", "concat('p-of-this-row-', id % 3) AS p")
    for n, how in enumerate(({"partition_by": ("p",)}, {"buckets": ("k", 3)})):
        t = Table.create(spark, f"{scratch(spark)}/t{n}", df.schema, ["k"], **how)
        t.upsert(df)
        before = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")  # one task reads several files
        try:
            t.delete(E.ge("k", 10))
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", before)
        for f in glob.glob(f"{t.root.removeprefix('file://')}/data/**/*.parquet", recursive=True):
            keys = pq.ParquetFile(f).read(columns=["k"])["k"].to_pylist()
            assert keys == sorted(keys)


def test_session_stream_gives_every_session_and_keeps_none(spark):
    from pyspark.sql.streaming import StreamingQueryListener

    from keelson.plans.catalogue import QUERIES

    held = []

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            held.extend(o.numRowsTotal for o in event.progress.stateOperators)

        def onQueryTerminated(self, event):
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        got = QUERIES["stream_session"](spark, "/root/testdata/sf0.01")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(watch)
    assert got.agg(F.sum("n")).first()[0] == 10_000
    assert held[-1] == 1 and max(held) < 0.6 * got.count()  # the closing row; sessions of two micro-batches of four
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_streams_take_files_in_order_of_time(spark):
    from keelson.plans import tables

    spans = []
    q = tables._stream(spark, "/root/testdata/sf0.01").writeStream.foreachBatch(lambda b, n: spans.append(b.agg(F.min("ts"), F.max("ts")).first()))
    q.option("checkpointLocation", f"{scratch(spark)}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_large_micro_batch_is_dealt_to_files_that_tasks_can_sort(spark, monkeypatch):
    from keelson.plans import tables

    monkeypatch.setattr(tables, "FILE_ROWS", 1500, raising=False)
    seen = []
    s = tables._stream(spark, "/root/testdata/sf0.01", 1).withColumn("file", F.input_file_name())
    q = s.writeStream.foreachBatch(lambda b, n: seen.append((b.count(), b.select("file").distinct().count())))
    q.option("checkpointLocation", f"{scratch(spark)}/ckpt").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(10_000, 7)]


def test_data_source_merges_by_ranges_of_keys(spark, monkeypatch):
    from collections import Counter

    from keelson.sources import datasource

    monkeypatch.setattr(datasource, "ROWS", 300, raising=False)
    monkeypatch.setattr(datasource, "GROUP", 64, raising=False)
    number = F.col("id").cast("long")
    kinds = {
        "long": ["k"], "text": ["t"], "float": ["f"], "hot": ["h", "k"], "instant": ["i"],
    }
    df = spark.range(0, 3000, 1, 3).select(
        number.alias("k"), F.when(number != 7, F.format_string("k%05d", "id")).alias("t"), F.when(number == 9, F.lit(float("nan"))).when(number != 8, number / 7).alias("f"),
        F.when(number > 5, F.lit(1)).alias("h"), F.timestamp_seconds(number * 100).alias("i"), F.lit("old").alias("v"))
    for name, keys in kinds.items():
        t = Table.create(spark, f"{scratch(spark)}/{name}", df.schema, keys)
        t.upsert(df)
        t.upsert(df.filter("k % 3 = 0 OR k < 10").withColumn("v", F.lit("new")))
        t.delete(E.eq("v", "new") if name == "text" else E.in_("k", [8, 9, 11, 2000]))
        source = datasource.KeelsonSource({"path": t.root})
        reader = source.reader(source.schema())
        parts = reader.partitions()
        got = [[tuple(str(v) for v in r.values()) for b in reader.read(p) for r in b.select(["k", "t", "f", "h", "v"]).to_pylist()] for p in parts]
        expected = Counter(tuple(str(v) for v in r) for r in t.scan().select("k", "t", "f", "h", "v").collect())
        assert Counter(r for g in got for r in g) == expected
        assert len(parts) > 5 and max(map(len, got)) < 900, name


def test_data_source_writes_one_sorted_file_a_task(spark, kv, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from keelson.sources import datasource

    monkeypatch.setattr(datasource, "ROWS", 100, raising=False)
    source = datasource.KeelsonSource({"path": kv.root})
    writer = source.writer(source.schema(), False)
    batch = lambda n: pa.RecordBatch.from_pydict({"key": [f"k{(i * 37) % 450:03d}" for i in range(60 * n, 60 * n + 60)], "value": [str(n)] * 60})
    done = writer.write(batch(n) for n in range(10))
    keys = pq.read_table(done.file[0])["key"].to_pylist()
    assert len(done.file) == 1 and keys == [f"k{i:03d}" for i in range(450)] and (done.low, done.high, done.rows) == (["k000"], ["k449"], [450])
    writer.commit([done])
    last = {f"k{(i * 37) % 450:03d}": str(i // 60) for i in range(600)}
    assert rows(kv.scan()) == sorted(last.items())
