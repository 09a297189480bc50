"""The flagship plan: a keyed table of orders, re-priced by upsert, scanned by key range, aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.catalog import scratch
from ..sources.table import Table


def repriced_orders(spark: SparkSession, sf_dir: str) -> Table:
    """orders keyed by o_orderkey; a second batch raises the price of open orders by a tenth."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    table = Table.create(spark, f"{scratch(spark)}/orders", orders.schema, ["o_orderkey"])
    table.upsert(orders)
    table.upsert(orders.filter("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") * 1.1))
    return table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repriced_orders(spark, sf_dir).scan(E.and_(E.between("o_orderkey", 100, 100_000_000), E.in_("o_orderstatus", ["O", "F"])))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("o_orderpriority")
