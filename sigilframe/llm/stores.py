"""Where operators keep intermediate tables and files that all executors must reach."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Ids that may be broadcast: some 16 MB.
MAX_BROADCAST_IDS = 1_000_000


#: Bytes of a batch between the JVM and Python; a task holds a few of them on either side.
BATCH_BYTES = "16m"

_LIBC = ctypes.CDLL(None)


def bound_batches(spark: SparkSession, size: str = BATCH_BYTES) -> SparkSession:
    """Keep Arrow batches small whatever the rows' widths, so that long texts do not add up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def trim() -> None:
    """Give a Python worker's free memory back: workers stay for the next stages, beside an executor's full heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc's own
        _LIBC.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own is set, on a single machine only."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return re.sub("^file:/(?!/)", "file:///", held.get())
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='sigilframe-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Folders made inside each open scope; the first list's are kept until release().
_SCOPES: list[list[str]] = [[]]


def new_dir(spark: SparkSession, kind: str, outside: bool = False) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _SCOPES[-2 if outside and len(_SCOPES) > 1 else -1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, but for those kept ``outside``: nothing may still read them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            discard(spark, path)


def release(spark: SparkSession) -> None:
    """Remove all tables and files of operators whose results have been written or are not wanted any more."""
    while _SCOPES[0]:
        discard(spark, _SCOPES[0].pop())


def keep(df: DataFrame, kind: str = "table", outside: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_dir(spark, kind, outside)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ids(df: DataFrame, ids: DataFrame, how: str, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """left_semi or left_anti of wide rows with one column of distinct ids.

    The ids are broadcast where a count shows that they are few; beyond that both sides are shuffled.
    """
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids, ids.columns, how)
