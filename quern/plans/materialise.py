"""Cutting lineage between the steps of a plan."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a plan's shuffle files go as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of each open block, innermost last.
_open: list[list[tuple[DataFrame, str]]] = []


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder, which is set if it was not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder (one of our own only where none is named)."""
    _folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _open:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _open[-1].append((out, file.get()))
    return out


def stored(df: DataFrame) -> DataFrame:
    """The same rows from columns written in the shared folder: a fraction of a checkpoint's bytes, for tables that grow with the input."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append((out, path))
    return out


@contextmanager
def passing(spark: SparkSession):
    """What is cut or stored in the block is deleted at its end, but for the tables given to ``keep``; ``drop`` deletes one earlier.

    Nothing may go on from a deleted table: what leaves the block has itself been cut or stored. Shuffle files go with the plan that wrote them.
    """
    mine: list[tuple[DataFrame, str]] = []
    staying: list[tuple[DataFrame, str]] = []

    def delete(path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def keep(df: DataFrame) -> DataFrame:
        staying.extend(x for x in mine if x[0] is df)
        mine[:] = [x for x in mine if x[0] is not df]
        return df

    def drop(df: DataFrame) -> None:
        for rows in (mine, staying):
            for _, path in [x for x in rows if x[0] is df]:
                delete(path)
            rows[:] = [x for x in rows if x[0] is not df]

    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    _open.append(mine)
    try:
        yield keep, drop
    finally:
        _open.pop()
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        for _, path in mine:
            delete(path)
        mine.clear()
        if _open:
            _open[-1].extend(staying)
        # Shuffles of tables that were kept in memory have no plan that ends: they go once nothing refers to them.
        spark._jvm.System.gc()


def bounded(side: DataFrame, rows: int = 10_000) -> DataFrame:
    """A side of a join, computed once; it is broadcast only if it has at most so many rows."""
    side = cut(side)
    return F.broadcast(side) if side.count() <= rows else side
