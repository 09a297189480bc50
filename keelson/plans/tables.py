"""Queries of the table engine: predicates, assignments, scans, writes, history, routing, streams, service."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..operators import merging, routing
from ..operators.service import SqlService, column_stats, histogram
from ..sources.catalog import Catalog, scratch
from ..sources.log import Files
from ..sources.table import Table
from ..streaming.sinks import upsert_sink
from .flagship import flagship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type is null for errors, value for every seventh event."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.expr("nullif(event_type, 'error')").alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


NULLS = "(SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"


# --- predicates ---

def _pred(name: str, table: str, columns: str, predicate: E.Expr, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events_with_nulls(spark, sf_dir) if table == "nulls" else read(spark, sf_dir, table)
        return df.filter(E.to_filter(E.simplify(predicate))).select(columns.split(", "))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT {columns} FROM {NULLS if table == 'nulls' else table} WHERE {where}"


for _name, _table, _cols, _p, _sql in (
    ("pred_eq", "orders", "o_orderkey, o_custkey", E.eq("o_custkey", 77), "o_custkey = 77"),
    ("pred_ne", "nulls", "event_id, event_type", E.ne("event_type", "click"), "event_type <> 'click'"),
    ("pred_gt", "orders", "o_orderkey", E.gt("o_totalprice", 450000.0), "o_totalprice > 450000"),
    ("pred_ge", "orders", "o_orderkey", E.ge("o_orderkey", 14000), "o_orderkey >= 14000"),
    ("pred_lt", "orders", "o_orderkey", E.lt("o_totalprice", 2000.0), "o_totalprice < 2000"),
    ("pred_le", "orders", "o_orderkey", E.le("o_orderkey", 50), "o_orderkey <= 50"),
    ("pred_in", "nulls", "event_id", E.in_("event_type", ["click", "view"]), "event_type IN ('click', 'view')"),
    ("pred_in_empty", "nulls", "event_id", E.in_("event_type", []), "false"),
    ("pred_in_single", "nulls", "event_id", E.in_("event_type", ["signup"]), "event_type = 'signup'"),
    ("pred_not_in_null_true", "nulls", "event_id, event_type", E.not_in("event_type", ["click", "view"]), "coalesce(event_type NOT IN ('click', 'view'), true)"),
    ("pred_not_in_empty", "nulls", "event_id", E.not_in("event_type", []), "true"),
    ("pred_not_in_single_null", "nulls", "event_id, event_type", E.not_in("event_type", ["click"]), "coalesce(event_type NOT IN ('click'), true)"),
    ("pred_between", "orders", "o_orderkey", E.between("o_orderkey", 100, 200), "o_orderkey BETWEEN 100 AND 200"),
    ("pred_between_exclusive", "orders", "o_orderkey", E.between("o_orderkey", 100, 200, False), "o_orderkey > 100 AND o_orderkey < 200"),
    ("pred_between_reversed", "orders", "o_orderkey", E.between("o_orderkey", 200, 100), "false"),
    ("pred_like", "part", "p_partkey, p_name", E.like("p_name", "%ring%"), "p_name LIKE '%ring%'"),
    ("pred_ilike", "part", "p_partkey, p_name", E.like("p_name", "RED%", False), "p_name ILIKE 'RED%'"),
    ("pred_like_underscore", "part", "p_partkey, p_brand", E.like("p_brand", "Brand#_"), "p_brand LIKE 'Brand#_'"),
    ("pred_like_empty", "part", "p_partkey", E.like("p_name", ""), "p_name LIKE ''"),
    ("pred_like_escape", "part", "p_partkey", E.like("p_brand", r"Brand\_%"), r"p_brand LIKE 'Brand\_%' ESCAPE '\'"),
    ("pred_starts", "part", "p_partkey, p_name", E.starts_with("p_name", "red"), "starts_with(p_name, 'red')"),
    ("pred_ends", "part", "p_partkey, p_name", E.ends_with("p_name", "ring"), "suffix(p_name, 'ring')"),
    ("pred_contains", "part", "p_partkey, p_name", E.contains("p_name", "l r"), "contains(p_name, 'l r')"),
    ("pred_is_null", "nulls", "event_id", E.is_null("value"), "value IS NULL"),
    ("pred_is_not_null", "nulls", "event_id", E.is_not_null("event_type"), "event_type IS NOT NULL"),
    ("pred_and_or_not_two_valued", "nulls", "event_id", E.not_(E.or_(E.eq("event_type", "click"), E.and_(E.gt("value", 5.0), E.ne("event_type", "view")))), "NOT (coalesce(event_type = 'click', false) OR (coalesce(value > 5, false) AND coalesce(event_type <> 'view', false)))"),
    ("pred_range_half_open", "orders", "o_orderkey", E.range_("o_orderkey", 10, True, 40, False), "o_orderkey >= 10 AND o_orderkey < 40"),
    ("pred_range_unbounded", "orders", "o_orderkey", E.range_("o_orderkey"), "true"),
    ("pred_simplify_equiv", "nulls", "event_id", E.and_(E.lit(True), E.or_(E.in_("user_id", [3]), E.lit(False), E.in_("user_id", [3])), E.not_(E.not_(E.gt("value", 1.0)))), "user_id = 3 AND value > 1"),
    ("pred_json_roundtrip", "nulls", "event_id", E.from_json(E.to_json(E.and_(E.between("value", 1.0, 20.0, False), E.not_in("event_type", ["click"]), E.starts_with("event_type", "v")))), "value > 1 AND value < 20 AND coalesce(event_type NOT IN ('click'), true) AND starts_with(event_type, 'v')"),
):
    _pred(_name, _table, _cols, _p, _sql)


# --- assignments ---

OPEN = E.eq("o_orderstatus", "O")
for _name, _value, _sql in (
    ("assign_direct", E.lit(1.5), "1.5"),
    ("assign_add", E.add("o_totalprice", 10.0), "o_totalprice + 10"),
    ("assign_sub", E.sub("o_totalprice", 10.0), "o_totalprice - 10"),
    ("assign_mul", E.mul("o_totalprice", 2.0), "o_totalprice * 2"),
    ("assign_div_zero_null", E.div("o_totalprice", 0.0), "NULL"),
    ("assign_mod", E.mod("o_totalprice", 7.0), "o_totalprice % 7"),
    ("assign_pow", E.power("o_totalprice", 2.0), "pow(o_totalprice, 2)"),
):
    QUERIES[_name] = lambda spark, sf_dir, v=_value: E.assign(read(spark, sf_dir, "orders"), "o_totalprice", v, OPEN).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    ORACLES[_name] = f"SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'O' THEN {_sql} ELSE o_totalprice END, 2) AS price FROM orders"


# --- tables ---

def orders_table(spark: SparkSession, sf_dir: str, parts: int = 4) -> Table:
    """orders by key, in segments of consecutive keys."""
    orders = read(spark, sf_dir, "orders")
    t = Table.create(spark, f"{scratch(spark)}/orders", orders.schema, ["o_orderkey"])
    top = orders.agg(F.max("o_orderkey")).first()[0] + 1
    for i in range(parts):
        t.upsert(orders.filter(F.col("o_orderkey").between(top * i // parts, top * (i + 1) // parts - 1)))
    return t


for _name, _p, _cols, _sql in (
    ("scan_full", None, ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders"),
    ("scan_projection", None, ["o_orderpriority"], "SELECT o_orderpriority FROM orders"),
    ("scan_key_range", E.range_("o_orderkey", 500, True, 900, False), ["o_orderkey", "o_custkey"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 900"),
    ("scan_key_range_exclusive", E.between("o_orderkey", 500, 900, False), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 AND o_orderkey < 900"),
    ("scan_point", E.eq("o_orderkey", 321), ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey = 321"),
    ("scan_key_in", E.in_("o_orderkey", [1, 77, 999, -5]), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 77, 999, -5)"),
    ("scan_contradiction", E.and_(E.lt("o_orderkey", 5), E.gt("o_orderkey", 10)), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE false"),
    ("scan_nonkey_pred", E.and_(E.eq("o_orderstatus", "P"), E.ge("o_orderkey", 100)), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey >= 100"),
):
    QUERIES[_name] = lambda spark, sf_dir, p=_p, c=_cols: orders_table(spark, sf_dir).scan(p, c)
    ORACLES[_name] = _sql


@query("SELECT o_orderkey, o_custkey FROM orders WHERE false")
def scan_empty_table(spark, sf_dir):
    t = Table.create(spark, f"{scratch(spark)}/empty", read(spark, sf_dir, "orders").schema, ["o_orderkey"])
    return t.scan(columns=["o_orderkey", "o_custkey"])


for _name, _key, _where, _sql in (
    ("find_hit", 42, None, "o_orderkey = 42"),
    ("find_miss", -1, None, "false"),
    ("find_with_filter", 42, E.gt("o_totalprice", 1e9), "o_orderkey = 42 AND o_totalprice > 1e9"),
):
    QUERIES[_name] = lambda spark, sf_dir, k=_key, w=_where: orders_table(spark, sf_dir).find({"o_orderkey": k}, ["o_orderkey", "o_totalprice"], w)
    ORACLES[_name] = f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_sql}"


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def find_composite_pk(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    t = Table.create(spark, f"{scratch(spark)}/nation", nation.schema, ["n_regionkey", "n_nationkey"])
    t.upsert(nation)
    region = nation.filter("n_nationkey = 7").first().n_regionkey
    return t.find({"n_regionkey": region, "n_nationkey": 7}).select("n_regionkey", "n_nationkey", "n_name")


@query("SELECT c_name AS key, base64(encode(c_name)) AS key_base64, CAST(octet_length(encode(c_name)) AS INT) AS key_length, CAST(octet_length(encode(c_mktsegment)) AS INT) AS value_length FROM customer")
def kv_pseudo_columns(spark, sf_dir):
    rows = merging.key_value(customers(spark, sf_dir).scan(), ["c_name"], ["c_mktsegment"])
    return rows.select(F.col("_key").alias("key"), F.col("_key_base64").alias("key_base64"), F.col("_key_length").alias("key_length"), F.col("_value_length").alias("value_length"))


USERS = "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {0}) WHERE rn = 1"


def users_table(spark, sf_dir, bounds, df=None):
    """The last event of each user; batches of events by id."""
    e = (read(spark, sf_dir, "events") if df is None else df).select("user_id", "event_id", "value")
    t = Table.create(spark, f"{scratch(spark)}/users", e.schema, ["user_id"])
    for lo, hi in bounds:
        t.upsert(e.filter((F.col("event_id") >= lo) & (F.col("event_id") < hi)), order_by=F.col("event_id"))
    return t


@query(USERS.format("events"))
def upsert_last_write_wins(spark, sf_dir):
    return users_table(spark, sf_dir, [(0, 1 << 60)]).scan()


@query(USERS.format("events"))
def upsert_multi_batch(spark, sf_dir):
    return users_table(spark, sf_dir, [(0, 100), (100, 3000), (3000, 1 << 60)]).scan()


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id < 500 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_unordered_batches(spark, sf_dir):
    """The batch written last wins, though its events are older."""
    return users_table(spark, sf_dir, [(500, 1 << 60), (0, 500)]).scan()


@query(USERS.format(NULLS))
def upsert_null_value_kept(spark, sf_dir):
    return users_table(spark, sf_dir, [(0, 1 << 60)], events_with_nulls(spark, sf_dir)).scan()


def appended(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = Table.create(spark, f"{scratch(spark)}/lines", li.schema)
    t.append(li)
    t.append(li.filter("l_orderkey < 10"))
    return t


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey < 10")
def append_only_keeps_duplicates(spark, sf_dir):
    return appended(spark, sf_dir).scan()


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_keys FROM (SELECT l_orderkey FROM lineitem UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey < 10)")
def append_hidden_pk_unique(spark, sf_dir):
    return appended(spark, sf_dir).scan(hidden=True).agg(F.count("*").alias("n"), F.count_distinct("_seq", "_hidden_pk").alias("n_keys"))


PRICES = "SELECT o_orderkey, o_orderstatus, round({0}, 2) AS price FROM orders"


def prices(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


@query(PRICES.format("CASE WHEN o_orderstatus = 'O' AND o_totalprice > 1000 THEN 1.0 ELSE o_totalprice END"))
def update_where(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.update({"o_totalprice": 1.0}, E.and_(OPEN, E.gt("o_totalprice", 1000.0)))
    return prices(t.scan())


@query(PRICES.format("CASE WHEN o_orderkey = 11 THEN -1.0 ELSE o_totalprice END"))
def update_pk_equality(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.update({"o_totalprice": -1.0}, E.eq("o_orderkey", 11))
    return prices(t.scan())


@query(PRICES.format("CASE WHEN o_orderkey < 500 THEN o_totalprice * 2 ELSE o_totalprice END"))
def update_arith(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.update({"o_totalprice": E.mul("o_totalprice", 2.0)}, E.lt("o_orderkey", 500))
    return prices(t.scan())


@query("SELECT o_orderkey, o_orderstatus, round(CASE WHEN p > 300000 THEN 7.0 ELSE p END, 2) AS price FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS p FROM orders)")
def lazy_update_overlap(spark, sf_dir):
    """Two deferred updates; the second sees what the first makes of a row."""
    t = orders_table(spark, sf_dir)
    t.update_lazily({"o_totalprice": E.mul("o_totalprice", 2.0)}, OPEN)
    t.update_lazily({"o_totalprice": 7.0}, E.gt("o_totalprice", 300000.0))
    return prices(t.scan())


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' OR o_orderkey BETWEEN 100 AND 300)")
def delete_where(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.delete(E.or_(E.eq("o_orderstatus", "P"), E.between("o_orderkey", 100, 300)))
    return t.scan(columns=["o_orderkey", "o_orderstatus"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 1000 OR o_orderkey < 10")
def delete_then_reinsert(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.delete(E.lt("o_orderkey", 1000))
    t.upsert(read(spark, sf_dir, "orders").filter("o_orderkey < 10"))
    return t.scan(columns=["o_orderkey"])


@query(f"SELECT event_id, event_type FROM {NULLS} WHERE NOT coalesce(event_type = 'click', false)")
def delete_null_pred_kept(spark, sf_dir):
    e = events_with_nulls(spark, sf_dir)
    t = Table.create(spark, f"{scratch(spark)}/events", e.schema, ["event_id"])
    t.upsert(e)
    t.delete(E.eq("event_type", "click"))
    return t.scan(columns=["event_id", "event_type"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey < 77")
def overwrite_full(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.overwrite(read(spark, sf_dir, "orders").filter("o_orderkey < 77"))
    return t.scan(columns=["o_orderkey", "o_orderpriority"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey + 1000000, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def overwrite_partition(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    urgent = E.eq("o_orderpriority", "1-URGENT")
    t.overwrite(read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000), urgent)
    return t.scan(columns=["o_orderkey", "o_orderpriority"])


def customers(spark, sf_dir, **options):
    c = read(spark, sf_dir, "customer")
    t = Table.create(spark, f"{scratch(spark)}/customer", c.schema, ["c_custkey"], **options)
    t.upsert(c)
    return t


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey < 20 THEN 'gold' END AS tier FROM customer")
def alter_add_column_null_fill(spark, sf_dir):
    t = customers(spark, sf_dir)
    t.alter(t.schema().add("tier", "string"))
    t.upsert(t.scan(E.lt("c_custkey", 20)).withColumn("tier", F.lit("gold")))
    return t.scan(columns=["c_custkey", "c_name", "tier"])


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def alter_drop_column(spark, sf_dir):
    from pyspark.sql.types import StructType

    t = customers(spark, sf_dir)
    t.alter(StructType([f for f in t.schema().fields if f.name != "c_acctbal"]))
    return t.scan()


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey < 400")
def time_travel_v1(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    t = Table.create(spark, f"{scratch(spark)}/orders", orders.schema, ["o_orderkey"])
    t.upsert(orders.filter("o_orderkey < 400"))
    t.upsert(orders.withColumn("o_totalprice", F.lit(0.0)))
    return prices(t.scan(version=1))


@query("SELECT * FROM (VALUES (0, 'CREATE_TABLE'), (1, 'UPSERT'), (2, 'UPSERT'), (3, 'DELETE'), (4, 'COMPACT')) AS t(version, operation)")
def snapshot_history(spark, sf_dir):
    t = orders_table(spark, sf_dir, parts=2)
    t.delete(E.lt("o_orderkey", 5))
    t.compact()
    return spark.createDataFrame([(s["version"], s["operation"]) for s in t.snapshots()], "version int, operation string")


@query("SELECT CAST(count(*) AS BIGINT) AS before, CAST(count(*) + 1 AS BIGINT) AS after FROM orders")
def refresh_sees_new(spark, sf_dir):
    t = orders_table(spark, sf_dir, 1)
    seen = t.state().version
    before = t.scan(version=seen).agg(F.count("*").alias("before"))
    Table(spark, t.root).upsert(read(spark, sf_dir, "orders").limit(1).withColumn("o_orderkey", F.lit(-1).cast("long")))
    return before.crossJoin(t.scan(version=t.refresh(seen)[1]).agg(F.count("*").alias("after")))


@query("SELECT 0 AS level, CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_orderkey < 10 UNION ALL SELECT 1, CAST(count(*) AS BIGINT) FROM orders")
def file_manifest_level(spark, sf_dir):
    t = orders_table(spark, sf_dir)
    t.compact()
    t.upsert(read(spark, sf_dir, "orders").filter("o_orderkey < 10"))
    return spark.createDataFrame([(s["level"], s["rows"]) for s in t.manifest()], "level int, rows long")


@query(USERS.format("events"))
def compact_equivalence(spark, sf_dir):
    t = users_table(spark, sf_dir, [(0, 100), (100, 3000), (3000, 1 << 60)])
    t.compact(4)
    return t.scan()


@query("SELECT n_nationkey, 'INSERT' AS op, true AS stamped FROM nation")
def hidden_columns_visible(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    t = Table.create(spark, f"{scratch(spark)}/nation", n.schema, ["n_nationkey"])
    t.upsert(n)
    return t.scan(hidden=True).select("n_nationkey", F.col("_op_type").alias("op"), F.col("_commit_ts").isNotNull().alias("stamped"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, 8 AS buckets FROM customer")
def partition_hash_buckets(spark, sf_dir):
    t = customers(spark, sf_dir, buckets=("c_custkey", 8))
    df = spark.read.parquet(t.manifest()[0]["path"])
    return df.agg(F.count("*").alias("n"), F.count_distinct("_bucket").cast("int").alias("buckets"))


@query("SELECT c_custkey FROM customer ORDER BY c_custkey")
def partition_range(spark, sf_dir):
    """Compacted into files of consecutive key ranges."""
    t = customers(spark, sf_dir)
    t.compact(8)
    return t.scan(columns=["c_custkey"])


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_mktsegment")
def partition_value(spark, sf_dir):
    return customers(spark, sf_dir, partition_by=("c_mktsegment",)).scan(E.eq("c_mktsegment", "BUILDING")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


# --- routing, durability ---

@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(16 AS BIGINT) AS shards, true AS even FROM orders")
def shard_route_counts(spark, sf_dir):
    """Every order has one of 16 shards, none of which is twice its share."""
    counts = read(spark, sf_dir, "orders").groupBy(routing.shard_of(F.col("o_orderkey"), 16).alias("shard")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n"), F.count("*").alias("shards"), (F.max("n") < 2 * F.avg("n")).alias("even"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 7 <> 3")
def shard_mod_hash_partition(spark, sf_dir):
    """31-polynomial hash of the key's text: the same key, the same shard, so grouping by shard loses and doubles nothing."""
    o = read(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 3").select("o_orderkey", routing.mod_hash_shard(F.col("o_orderkey"), 13).alias("shard"))
    return o.groupBy("shard").agg(F.count_distinct("o_orderkey").alias("n")).agg(F.sum("n").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM events")
def stable_batch_dedupe(spark, sf_dir):
    """The same batch written twice counts once."""
    e = read(spark, sf_dir, "events").select("event_id", "value")
    t = Table.create(spark, f"{scratch(spark)}/events", e.schema)
    for number in (0, 1, 1, 0):
        t.append(e.filter(F.col("event_id") % 2 == number), batch=("loader", number))
    return t.scan().agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events e WHERE event_id % 100 <> 0 AND event_id > coalesce((SELECT max(event_id) FROM events m WHERE m.event_type = e.event_type AND m.event_id % 100 = 0), -1)")
def wal_replay_after_marker(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 100 == 0).alias("marker"))
    return routing.unflushed(e, "event_type", "event_id", "marker").select("event_id", "event_type")


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT event_id FROM events ORDER BY k")
def kway_merge_sorted(spark, sf_dir):
    sources = [read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), read(spark, sf_dir, "events").select(F.col("event_id").alias("k"))]
    return merging.merge_sorted(sources, ["k"])


@query("SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o DESC) AS rn FROM (SELECT o_orderkey AS k, o_totalprice AS v, 1 AS o FROM orders UNION ALL SELECT event_id, value, 2 FROM events)) WHERE rn = 1")
def kway_merge_newest(spark, sf_dir):
    """Of a key in several sources the row of the last one stays."""
    sources = [read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(1).alias("o")), read(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("value").alias("v"), F.lit(2).alias("o"))]
    return merging.merge_sorted(sources, ["k"], F.col("o")).select("k", "v")


@query("SELECT o_orderkey, s AS start FROM orders ASOF JOIN (SELECT c_custkey * 10 AS s FROM customer) ON o_orderkey >= s")
def range_floor_lookup(spark, sf_dir):
    """Ranges of all customers: they grow with the orders, so that every range partition has its own."""
    ranges = read(spark, sf_dir, "customer").select((F.col("c_custkey") * 10).alias("start"), "c_name")
    return routing.range_floor(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", ranges, "start", ["c_name"]).select("o_orderkey", "start").filter("start is not null")


@query("SELECT o_orderkey, event_id FROM (SELECT o_orderkey, o_custkey % 150 AS u, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * o_orderkey AS at FROM orders) o ASOF JOIN (SELECT user_id, ts, event_id FROM events) e ON o.u = e.user_id AND o.at >= e.ts")
def join_asof(spark, sf_dir):
    """Each order's last event of its user before it: one sort per user instead of a range join."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("user_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, o_orderkey)").alias("at"), "o_orderkey", F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), F.lit(None).cast("long").alias("o_orderkey"), "event_id", F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("at", "side", "event_id")
    both = o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w))
    return both.filter("side = 1 and event_id is not null").select("o_orderkey", "event_id")


# --- user-defined functions ---

@query("SELECT event_id, event_type || '!' AS shout FROM events")
def udf_scalar(spark, sf_dir):
    shout = F.udf(lambda s: None if s is None else s + "!", "string", useArrow=True)
    return read(spark, sf_dir, "events").select("event_id", shout("event_type").alias("shout"))


@query("SELECT event_id, round(value * 2 + 1, 4) AS v FROM events")
def pandas_udf_vec(spark, sf_dir):
    @F.pandas_udf("double")
    def line(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return read(spark, sf_dir, "events").select("event_id", F.round(line("value"), 4).alias("v"))


@query("SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY event_type")
def udaf_group(spark, sf_dir):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(spread("value"), 4).alias("spread"))


@query("SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer")
def udtf_split(spark, sf_dir):
    @F.udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for p in text.split("#"):
                yield (p,)

    spark.udtf.register("parts", Parts)
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, part FROM customer, LATERAL parts(c_name)")


# --- streams ---

#: Rows of a stream's file, which one task sorts.
FILE_ROWS = 1_000_000


def _stream(spark, sf_dir, batches: int = 4, rows: int | None = None, closing: str | None = None):
    """events as a stream, in micro-batches in order of time; event time as an instant (UTC).

    rows: of a micro-batch at most, about; large inputs have more of them. closing: a last row that
    is null but for its time, that long after all others, so that the watermark passes these.
    """
    folder = f"{scratch(spark)}/stream"
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = events.count()
    batches = max(batches, -(-n // rows)) if rows else batches
    each = max(1, -(-n // (batches * FILE_ROWS)))
    events.repartitionByRange(batches * each, "ts").sortWithinPartitions("ts").write.parquet(folder)
    files, schema = Files(spark, folder), spark.read.parquet(folder).schema
    written = lambda f: [f"{f}/{n}" for n in files.names(f) if n.startswith("part-")]
    order = written(folder)
    if closing:
        end = spark.read.schema(schema).parquet(folder).agg((F.max("ts") + F.expr(f"INTERVAL {closing}")).alias("ts"))
        end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(f"{folder}/closing")
        order += written(f"{folder}/closing")
    files.put_in_order(order)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).option("recursiveFileLookup", True).parquet(folder)


def _drain(df: DataFrame, mode: str, stores: int | None = None) -> DataFrame:
    """stores: parts of the state at most; each costs some time in each micro-batch, however little it holds."""
    spark = df.sparkSession
    base = scratch(spark)
    if mode == "complete":
        name = "drain_" + base[-32:]
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if stores:
            spark.conf.set("spark.sql.shuffle.partitions", min(int(before), stores))
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)  # the query took its own copy when it started
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _utc(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    agg = _stream(spark, sf_dir).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _drain(agg, "complete").select(_utc("w.start").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * i AS start, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES (0), (1)) AS t(i) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    agg = _stream(spark, sf_dir).groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return _drain(agg, "complete").select(_utc("w.start").alias("start"), "n")


@query("SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_session(spark, sf_dir):
    """A session is written once the watermark has passed it, so state holds those of two micro-batches, not all."""
    s = _stream(spark, sf_dir, rows=2_000_000, closing="1 DAY").withWatermark("ts", "0 seconds")
    agg = s.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return _drain(agg, "append", stores=24).select("user_id", _utc("w.start").alias("start"), "n")


@query("SELECT CAST(0 AS BIGINT) AS wrong, true AS some, true AS held_back")
def stream_watermark_late(spark, sf_dir):
    """Finished hours only: what the watermark has passed is final and equals the hour's count, later hours are held back."""
    agg = _stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    emitted = _drain(agg, "append").select(_utc("w.start").alias("start"), "n")
    whole = read(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("whole")).select(_utc("w.start").alias("start"), "whole")
    both = whole.join(emitted, "start", "full")
    return both.agg(F.count(F.when(F.col("n").isNotNull() & ~F.col("n").eqNullSafe(F.col("whole")), 1)).alias("wrong"), (F.count("n") > 0).alias("some"), (F.count("n") < F.count("whole")).alias("held_back"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    s = _stream(spark, sf_dir)
    twice = s.union(s).withWatermark("ts", "100 days").dropDuplicates(["event_id"]).select("event_id", "user_id")
    return _drain(twice, "append")


@query(USERS.format("events"))
def stream_upsert_sink(spark, sf_dir):
    """Events into a keyed table; the last of each user stays."""
    base = scratch(spark)
    s = _stream(spark, sf_dir, batches=1).select("user_id", "event_id", "value")
    t = Table.create(spark, f"{base}/users", s.schema, ["user_id"])
    upsert_sink(s, t, "events", f"{base}/ckpt", order_by=F.col("event_id")).awaitTermination()
    return t.scan()


@query("SELECT event_id, user_id FROM events WHERE event_id >= 3000")
def change_feed(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    t = Table.create(spark, f"{scratch(spark)}/events", e.schema, ["event_id"])
    t.upsert(e.filter("event_id < 3000"))
    t.upsert(e.filter("event_id >= 3000"))
    return t.changes(1).select("event_id", "user_id")


# --- service ---

@query("SELECT 'o_orderkey' AS \"column\", CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS nulls, CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max, round(avg(o_orderkey), 4) AS mean FROM orders UNION ALL SELECT 'o_orderstatus', CAST(count(*) AS BIGINT), 0, min(o_orderstatus), max(o_orderstatus), NULL FROM orders UNION ALL SELECT 'o_custkey', CAST(count(*) AS BIGINT), 0, CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), round(avg(o_custkey), 4) FROM orders", name="column_stats")
def _column_stats(spark, sf_dir):
    return column_stats(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")).withColumn("mean", F.round("mean", 4)).drop("n_distinct_approx")


def _served(spark, sql: list[str], schema: str, **options):
    service = SqlService(spark, Catalog(spark, scratch(spark)))
    try:
        for text in sql:
            job = service.submit(text, **options)
            state = service.wait(job, 300)
            if state.value != "SUCCEEDED":
                raise RuntimeError(service.jobs[job].error)
        rows = [r for chunk in service.result(job) for r in chunk]
        return spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    finally:
        service.shutdown()


@query("SELECT * FROM (VALUES ('k2', 'it''s, (so)'), ('k3', NULL), ('k4', 'v4')) AS t(key, value)")
def svc_sql_roundtrip(spark, sf_dir):
    return _served(spark, ["CREATE TABLE kv (key STRING, value STRING) USING keelson OPTIONS (primary 'key')", "INSERT INTO kv VALUES ('k1', 'v1'), ('k2', 'it\\'s, (so)'), ('k3', NULL)", "INSERT INTO KV VALUES ('k4', 'v4'), ('k5', 'v5')", "SELECT key, value FROM kv WHERE key >= 'k2' AND key < 'k5' ORDER BY key"], "key string, value string")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def svc_max_rows(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return _served(spark, ["SELECT o_orderkey FROM orders ORDER BY o_orderkey"], "o_orderkey long", max_rows=5)


@query("SELECT CAST(least(9, floor((o_totalprice - lo) / ((hi - lo) / 10))) AS INT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1", name="column_histogram")
def _histogram(spark, sf_dir):
    return histogram(read(spark, sf_dir, "orders"), "o_totalprice").select("bucket", "n")


KEPT_SQL = "SELECT c_custkey, c_mktsegment, round(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END, 2) AS bal FROM customer WHERE c_nationkey <> 3"


@query(KEPT_SQL)
def svc_dml(spark, sf_dir):
    """CREATE TABLE AS, ALTER, UPDATE and DELETE as SQL."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    service = SqlService(spark, Catalog(spark, scratch(spark)))
    try:
        for text in (
            "CREATE TABLE cust USING keelson OPTIONS (primary 'c_custkey') AS SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, c_name FROM customer",
            "ALTER TABLE cust DROP COLUMN c_name",
            "ALTER TABLE cust ADD COLUMNS (note STRING)",
            "UPDATE cust SET c_acctbal = greatest(c_acctbal, 0.0), note = 'a, b (where)' WHERE c_acctbal < 0",
            "DELETE FROM cust WHERE c_nationkey = 3",
        ):
            service.execute(text)
        return service.execute("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS bal FROM cust")
    finally:
        service.shutdown()


def _source(spark) -> None:
    from ..sources.datasource import KeelsonSource

    spark.dataSource.register(KeelsonSource)


@query("SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS price FROM orders")
def ds_write_read(spark, sf_dir):
    """Written twice and read through the data source: segments of the same keys are merged as streams."""
    _source(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = Table.create(spark, f"{scratch(spark)}/orders", orders.schema, ["o_orderkey"])
    orders.repartition(2).write.format("keelson").option("path", t.root).mode("append").save()
    orders.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1).write.format("keelson").option("path", t.root).mode("append").save()
    return prices(spark.read.format("keelson").option("path", t.root).load())


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT'")
def ds_altered_partitioned(spark, sf_dir):
    """The source reads partitioned and altered tables, tombstones included."""
    _source(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    t = Table.create(spark, f"{scratch(spark)}/orders", orders.schema, ["o_orderkey"], partition_by=("o_orderpriority",))
    t.upsert(orders)
    t.alter(t.schema().add("extra", "integer"))
    t.delete(E.eq("o_orderpriority", "1-URGENT"))
    return spark.read.format("keelson").option("path", t.root).load().filter("extra is null").select("o_orderkey")


def _helpers(name: str, sql: str, predicate) -> None:
    QUERIES[name] = lambda spark, sf_dir: read(spark, sf_dir, "orders").filter(E.to_filter(predicate())).select("o_orderkey")
    ORACLES[name] = f"SELECT o_orderkey FROM orders WHERE {sql}"


_helpers("expr_merge", "o_orderkey < 500 AND o_orderstatus = 'O'", lambda: E.merge(E.lt("o_orderkey", 500), E.merge(None, E.eq("o_orderstatus", "O"))))
_helpers("expr_key_values", "o_orderkey = 33", lambda: E.eq("o_orderkey", E.key_values(E.and_(E.eq("o_orderkey", 33), E.gt("o_totalprice", 0)), {"o_orderkey"})["o_orderkey"]))
_helpers("expr_key_only_part", "o_orderkey >= 100 AND o_orderkey < 200", lambda: E.and_(*[p for p in E.and_(E.ge("o_orderkey", 100), E.lt("o_orderkey", 200), E.eq("o_orderstatus", "F")).args if E.only_keys(p, {"o_orderkey"})]))
_helpers("expr_proto_roundtrip", "o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority IN ('1-URGENT', '5-LOW')", lambda: E.from_proto(E.to_proto(E.and_(E.between("o_totalprice", 1000.0, 90000.0), E.in_("o_orderpriority", ["1-URGENT", "5-LOW"])))))
_helpers("expr_case_call", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END = 1 AND length(o_orderpriority) = 5", lambda: E.and_(E.eq(E.case((E.eq("o_orderstatus", "O"), 1), otherwise=2), 1), E.eq(E.call("length", E.col("o_orderpriority")), 5)))


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n_orders, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1.1 ELSE o_totalprice END), 2) AS total FROM orders WHERE o_orderkey >= 100 AND o_orderstatus IN ('O', 'F') GROUP BY o_orderpriority", name="flagship")
def _flagship(spark, sf_dir):
    return flagship(spark, sf_dir)
