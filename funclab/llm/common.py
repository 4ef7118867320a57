"""What several operators share: tables, scratch folders and caches of Python workers."""

from __future__ import annotations

import gc
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funclab.plans.settle import free_name, lookup_join, scratch_path, settle_table

__all__ = ["read_table", "scratch_path", "settle_table", "keyed_join", "free_name", "store_at", "new_name", "worker_store", "let_go", "tidy"]

#: A key that more rows than this have is looked up where the rows lie.
HOT_KEY = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_join(rows: DataFrame, keyed: DataFrame, on, count: str, spread: str) -> DataFrame:
    """Left join of rows with a stored table that has a row for each key, and in ``count`` how many rows share it.

    Rows of a key that very many share do not meet in one task: such keys are few, are looked up
    (broadcast within its bounds, else salted by ``spread``), and only the rest is shuffled. Rows
    with a null key match none. ``count`` is not returned.
    """
    keyed, names = keyed.withColumnRenamed(count, "rows of the key"), list(rows.columns)
    hot = settle_table(keyed.filter(F.col("rows of the key") > HOT_KEY), "hot")
    marked = lookup_join(rows, hot, on, "left", spread=spread)
    done = marked.filter(F.col("rows of the key").isNotNull()).drop("rows of the key")
    rest = marked.filter(F.col("rows of the key").isNull()).select(*names)
    cold = keyed.filter(F.col("rows of the key") <= HOT_KEY).drop("rows of the key")
    return done.unionByName(rest.join(cold, list(on), "left"))


def store_at(uri: str):
    """File system and path of a shared folder, usable inside tasks (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_name() -> str:
    return uuid.uuid4().hex


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker.

    Functions reach workers by value, so their globals last one task only. Tasks of one worker
    share what is kept here; it must be a cache that any task could build anew. What an earlier
    operator kept under another name is let go at once, objects that refer to each other too.
    """
    held = sys.modules.setdefault("_funclab_worker", types.ModuleType("_funclab_worker"))
    if getattr(held, "name", None) != name:
        full = bool(getattr(held, "kept", None))
        held.name, held.kept = name, {}
        if full:
            gc.collect()
            let_go()
    return held.kept


def let_go() -> None:
    """Give the memory that a Python worker has freed back to the system.

    Workers wait for their next task, and what they hold meanwhile is taken from their executor.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(run):
    """A function over the batches of a task that keeps nothing in the worker, before it or after."""

    def tidied(batches):
        worker_store("")
        yield from run(batches)
        let_go()

    return tidied
