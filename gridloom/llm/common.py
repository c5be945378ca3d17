"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import time
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``.

    Where it is unset, as in tests, a temporary one is made, on one machine only:
    elsewhere executors would not see it, so an error is raised.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or _temporary.get(context.applicationId)
    if not shared:
        if not (context.master or "").startswith("local") or "cluster" in context.master:
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
        shared = _temporary[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
    return shared


_temporary: dict[str, str] = {}


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if time.monotonic() - _released[0] > RELEASE_S:
        release(df.sparkSession)
    return out


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """(a table that is written to the shared folder as compressed Parquet and read again, its folder for ``delete_folder``)."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


#: Up to so many ids (8 bytes each) are broadcast to a join; more are joined by a shuffle, with equal results.
BROADCAST_IDS = 1_000_000


def joinable(ids: DataFrame) -> DataFrame:
    """A checkpointed table of ids, marked for broadcast if it is counted to be small."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also fold other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Seconds between releases, and when the last one was.
RELEASE_S = 2.0
_released = [0.0]


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little
    to do puts off; checkpoints call this between the rounds of an operator.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released[0] = time.monotonic()


def row_key(id_: Column, text: Column) -> Column:
    """What tells rows apart: the id, null among them, and a hash of the text."""
    return F.struct(id_.alias("id"), F.xxhash64(text).alias("hash"))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(owner: str, version: object, make):
    """``make()``, kept by a Python worker for the tasks to come until another operator or version asks.

    Workers outlive tasks and stages, so what an operator keeps would otherwise
    lie beside what all later ones need.
    """
    kept = _kept()
    if getattr(kept, "of", None) != (owner, version):
        _forget(kept)
        kept.value = make()
        kept.of = (owner, version)
    return kept.value


def _kept() -> types.ModuleType:
    """Where ``worker_cache`` keeps: it stays where this module is sent by value and forgotten."""
    return sys.modules.setdefault("_gridloom_kept", types.ModuleType("_gridloom_kept"))


def _forget(kept: types.ModuleType) -> None:
    kept.of = kept.value = None
    gc.collect()
    give_back()


def tidy(run, owner: str | None = None):
    """``run``, a function on Arrow batches, with memory given back when a task ends; workers wait for the next one with all they have.

    What ``worker_cache`` keeps for others than ``owner`` goes before the task begins.
    """

    def all_of(batches):
        if (getattr(kept := _kept(), "of", None) or (owner,))[0] != owner:
            _forget(kept)
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_of


def give_back() -> None:
    """Return a Python worker's freed memory to the system, where the libraries can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
