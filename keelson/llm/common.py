"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="keelson-ckpt-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables written by ``checkpoint`` within the innermost ``scratch``.
_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch():
    """Gives a ``keep`` that is ``checkpoint``; every other table that is checkpointed inside is removed at the end.

    What is kept belongs to the scratch around this one, if there is one.
    """
    tables: list = []
    kept: list = []

    def keep(df: DataFrame) -> DataFrame:
        out = checkpoint(df)
        kept.append(tables.pop())
        return out

    token = _scratch.set(tables)
    try:
        yield keep
    finally:
        _scratch.reset(token)
        if (around := _scratch.get()) is not None:
            around.extend(kept)
        for spark, path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as Parquet into the shared folder, and read back.

    Unlike a checkpointed plan, which keeps the size estimates of the plan that it replaces and so
    multiplies them from round to round of an iteration, a written table has its real size.
    """
    path = f"{shared_folder(df.sparkSession)}/keelson-{uuid.uuid4().hex}"
    if (tables := _scratch.get()) is not None:
        tables.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-case A-Z; other letters may change case too, but none of them becomes ASCII.

    Only U+0130 and U+212A have lower case in ASCII; texts with them take the slow, exact way.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = F.contains(col, F.lit("\u0130")) | F.contains(col, F.lit("\u212a"))
    return F.when(odd, F.translate(col, upper, upper.lower())).otherwise(F.lower(col))


def fresh(name: str, columns) -> str:
    """``name``, with underscores added until no column has it (any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(frames, key: list[str]):
    """pandas frames that are sorted by ``key``, cut so that no group of equal keys is spread over two of them."""
    held: list = []
    for frame in frames:
        if not len(frame):
            continue
        last = np.ones(len(frame), bool)
        for k in key:
            last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
        cut = len(frame) - int(last.sum())
        if held and all(held[-1][k].iloc[-1] == frame[k].iloc[0] for k in key) and cut == 0:
            held.append(frame)
            continue
        start = 0
        if held:
            same = np.ones(len(frame), bool)
            for k in key:
                same &= (frame[k] == held[-1][k].iloc[-1]).to_numpy()
            start = int(same.sum())  # rows that go on with the group that is held
            yield pd.concat([*held, frame.iloc[:start]], ignore_index=True)
        if cut > start:
            yield frame.iloc[start:cut].reset_index(drop=True)
        held = [frame.iloc[max(cut, start) :]]
    if held and len(held[0]):
        yield pd.concat(held, ignore_index=True)


def slices(batches, rows: int, size: int = 8 << 20):
    """Cut Arrow batches into pieces of at most ``rows`` rows and, single rows aside, ``size`` bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1) or 1))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
