"""Catalogs: tables by name, in a directory or in memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .table import Table


class Catalog:
    """database.table below a root folder; names are matched in lower case."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _place(self, name: str) -> str:
        db, _, table = name.rpartition(".")
        return f"{self.root}/{(db or 'default').lower()}/{table.lower()}"

    def exists(self, name: str) -> bool:
        return bool(Table(self.spark, self._place(name)).log.files.names(f"{self._place(name)}/_log"))

    def create(self, name: str, schema: StructType, keys=(), **options) -> Table:
        if self.exists(name):
            raise ValueError(f"table exists: {name}")
        return Table.create(self.spark, self._place(name), schema, keys, **options)

    def create_as(self, name: str, df: DataFrame, keys=(), **options) -> Table:
        t = self.create(name, df.schema, keys, **options)
        t.upsert(df) if keys else t.append(df)
        return t

    def load(self, name: str) -> Table:
        if not self.exists(name):
            raise KeyError(f"no table {name}")
        return Table(self.spark, self._place(name))

    def drop(self, name: str) -> None:
        self.load(name).drop()

    def tables(self, database: str = "default") -> list[str]:
        files = Table(self.spark, self.root).log.files
        return [t for t in files.names(f"{self.root}/{database.lower()}") if self.exists(f"{database}.{t}")]

    def view(self, name: str, version: int | None = None) -> None:
        """Register the table's rows as a temporary view of its name."""
        self.load(name).scan(version=version).createOrReplaceTempView(name.rpartition(".")[2])


def scratch(spark: SparkSession) -> str:
    """A fresh folder for tables: in the cluster's shared folder where one is named."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        import tempfile

        shared = f"file://{tempfile.mkdtemp(prefix='keelson-')}"
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"
