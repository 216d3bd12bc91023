"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open: ContextVar[Scope | None] = ContextVar("scratch scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder that goes at exit on a local master, an error on a cluster."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lexaudit-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        where = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which the open scope will delete."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if (scope_ := _open.get()) is not None:
        scope_.held.append(path)
    return path


def stored(df: DataFrame, label: str, options: Mapping[str, int] | None = None) -> DataFrame:
    """Writes df to the shared folder, with these options of the writer, and reads it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = place(spark, label)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() returned, once nothing reads them any more; others are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """The tables written while it is open."""

    def __init__(self, outer: Scope | None):
        self.outer, self.held = outer, []

    def keep(self, table: DataFrame) -> DataFrame:
        """A stored table that outlives this scope; it becomes the outer one's, if there is one."""
        path = _paths[table]
        self.held.remove(path)
        if self.outer is not None:
            self.outer.held.append(path)
        return table


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Frees, when it ends, all tables that operators wrote in it: write or collect their results inside.

    with scope(spark): groups(docs).write.parquet(where)
    """
    mine = Scope(_open.get())
    token = _open.set(mine)
    try:
        yield mine
    finally:
        _open.reset(token)
        for path in mine.held:
            _delete(spark, path)
