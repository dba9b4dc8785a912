"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

# The splitting pattern of byte-level BPE for texts below U+0100, in which letters, numbers and white space are these (fixed values).
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_WORDS = f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]++| ?[{_NUMBERS}]++| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]++|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for data that cuts lineage.

    The cluster names it in spark.checkpoint.dir. A folder of our own is made
    only where neither that setting nor the context has one, on a local master (tests).
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpus-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``staged`` tables from which nothing will be read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession | None = None) -> None:
    """Return freed memory of this Python process to the system, and with ``spark`` that of the driver's JVM.

    The JVM's heap grows with what planning leaves behind long before it is
    full; collected between the steps of a job, it shrinks to what is in use.
    """
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(step):
    """The generator function ``step`` for mapInArrow, giving memory back when a partition ends.

    Python workers stay for later tasks and would otherwise keep what their largest one took.
    """

    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
