"""Tables that are written once and read by many plans, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one of our own is set, on a single machine only."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if configured or held.isDefined():
        if not held.isDefined():
            context.setCheckpointDir(configured)
        return configured or re.sub("^file:/(?!/)", "file:///", held.get())
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='sigilframe-')}"
    context.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and readers take only their columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
