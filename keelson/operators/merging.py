"""Sorted merges, and a keyed table's rows as keys and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.table import newest


def merge_sorted(sources: list[DataFrame], keys: list[str], order_by: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Rows of all sources in order of key: range partitions in order, each sorted; null keys first.

    order_by: only the row of a key for which it is greatest stays (of later sources on a tie); it is
    combined before the rows are dealt out. Without it all rows stay.
    """
    if not sources:
        raise ValueError("nothing to merge")
    numbered = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    if order_by is not None:
        rows = newest(rows, keys, F.struct(order_by, F.col("_source")))
    rows = rows.drop("_source")
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def key_value(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``df`` with what a key-value store shows of a row: key, key_base64, and the bytes of key and value.

    Several columns are joined by a zero byte; a null among them counts as empty, all null give null.
    """

    def joined(columns: list[str]) -> Column:
        one = [F.encode(F.col(c).cast("string"), "UTF-8") for c in columns]
        if len(one) == 1:
            return one[0]
        every = F.concat(*[x for c in one for x in (F.lit(b"\x00"), F.coalesce(c, F.lit(b"")))])
        return F.when(F.coalesce(*one).isNotNull(), F.substring(every, F.lit(2), F.octet_length(every) - 1))

    key, value = joined(keys), joined(values)
    return df.select(*df.columns, F.decode(key, "UTF-8").alias("_key"), F.base64(key).alias("_key_base64"), F.octet_length(key).alias("_key_length"), F.octet_length(value).alias("_value_length"))
