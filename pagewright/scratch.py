"""Tables written to the folder that every executor shares, to cut lineage.

A written table survives a lost executor, unlike a local checkpoint. The folder is the
session's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Setting of the rows that Spark sends to a Python worker at once.
SENT = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def sent_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, queries that are run send Python workers at most so many rows at once; fewer, if the session says so."""
    before = spark.conf.get(SENT)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(SENT, rows)
    try:
        yield
    finally:
        spark.conf.set(SENT, before)


class Scratch:
    """One folder per operator call; ``drop`` frees a table that later steps no longer read.

    ``rows``: what Spark sends to a Python worker at once while a table is written; if not given, what the session says.

    What is left when the driver ends is removed then: results are lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, name: str, rows: int | None = None) -> None:
        self.spark, self.rows = spark, rows
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with sent_at_once(self.spark, self.rows) if self.rows else nullcontext():
            df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            store, place = _store(self.spark, path)
            store.delete(place, True)
        except Exception:  # noqa: BLE001  the session may have ended; leftovers are harmless
            pass


def _store(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def is_there(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    store, place = _store(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(place) if x.isDirectory()) if store.exists(place) else []
