"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``.  Stages that change a text count ``n_chars`` anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sigilframe.llm import minhash, packing, quality, secrets, substring
from sigilframe.llm.stores import bound_batches, keep, scope


#: Bytes of a batch in every stage: an executor's heap is full after the first ones, and its Python workers stay.
BATCH_BYTES = "4m"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the isolation forest reject go."""
    labels = bound_batches(spark, BATCH_BYTES).read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.kept_rows(docs, labels)
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id."""
    bound_batches(spark, BATCH_BYTES)
    return minhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that already stand in an earlier document are cut out."""
    bound_batches(spark, BATCH_BYTES)
    return _counted(substring.without_repeats(docs), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their kinds."""
    bound_batches(spark, BATCH_BYTES)
    return _counted(secrets.redacted(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 4096, with the ids of each piece."""
    bound_batches(spark, BATCH_BYTES)
    return packing.pack(docs, with_ids=True)


def _counted(changed: DataFrame, like: DataFrame) -> DataFrame:
    kind = like.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.char_length("text").cast(kind)).select(like.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The forest, the sketch and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's own tables go once its result is written; results stay until ``stores.release``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = keep(stage(spark, docs, sf_dir), name, outside=True)
    return STAGES[-1][1](spark, docs, sf_dir)
