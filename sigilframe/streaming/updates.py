"""Change logs as streams: the last meaning of each symbol, and imports as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import columns as X
from ..operators.library import apply_meanings


def latest_meanings(updates: DataFrame) -> DataFrame:
    """Streaming (ordinal, id, meaning): the meaning with the largest ordinal of each id, kept as state.

    State is one row an id; run with the update or complete output mode.
    """
    valid = updates.filter(X.valid_meaning("id", X.trim_all("meaning")))
    return valid.groupBy("id").agg(F.max_by("meaning", "ordinal").alias("meaning"))


def apply_stream(updates: DataFrame, symbols: DataFrame, path: str, source: str = "remote") -> DataStreamWriter:
    """Write a new version of the symbols after each batch, numbered, so that a batch that is run again overwrites itself."""

    def publish(batch: DataFrame, number: int) -> None:
        apply_meanings(symbols, batch, source).write.mode("overwrite").parquet(f"{path}/version={number}")

    return latest_meanings(updates).writeStream.outputMode("complete").foreachBatch(publish)


def import_counts(files: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Streaming (arrived, name, mime): accepted and rejected uploads by window; later rows than ``delay`` are left out."""
    ok = X.is_pdf_upload("name", "mime")
    return files.withWatermark("arrived", delay).groupBy(F.window("arrived", window)).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
