"""Queries over whole tables: every row of both sides counts."""

from keelson.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def test_full_join_has_every_row_and_misses_on_both_sides(spark):
    got = QUERIES["join_full"](spark, SF).collect()
    for column, table in (("c_custkey", "customer"), ("o_orderkey", "orders")):
        every = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect()}
        assert {r[column] for r in got} - {None} == every
        assert any(r[column] is None for r in got)


def test_range_floor_reaches_ranges_of_all_customers(spark):
    orders = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    starts = sorted(10 * r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect())
    got = {r.o_orderkey: r.start for r in QUERIES["range_floor_lookup"](spark, SF).collect()}
    assert got == {k: max(s for s in starts if s <= k) for k in orders if k >= starts[0]}
    assert len(set(got.values())) > 1000
