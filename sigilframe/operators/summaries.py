"""Replies of summary models: reading them, checking them against the batch that was asked, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Symbols per request, characters of a definition sent, meaning lengths, error length.
BATCH, EXCERPT, MAX_MEANING, MAX_CHINESE, MAX_ERROR = 16, 1200, 240, 24, 180
_REPLY = "choices array<struct<message:struct<content:string,reasoning_content:string>,delta:struct<content:string,reasoning_content:string>>>"
_ITEMS = "array<struct<id:string,meaning:string>>"


def completion(raw: Column | str) -> Column:
    """{content, reasoning} of one JSON reply, or of the data lines of an event stream; broken frames are skipped."""
    c = F.col(raw) if isinstance(raw, str) else raw
    part = lambda x, k: F.coalesce(x["choices"][0]["message"][k], x["choices"][0]["delta"][k], F.lit(""))
    whole = F.from_json(c, _REPLY)
    frames = F.transform(F.filter(F.split(c, r"\r?\n"), lambda x: x.rlike(r"^\s*data:")), lambda x: F.regexp_replace(x, r"^\s*data:\s*|\s+$", ""))
    frames = F.transform(F.filter(frames, lambda x: x != "[DONE]"), lambda x: F.from_json(x, _REPLY))
    joined = lambda k: F.array_join(F.transform(F.filter(frames, lambda x: x.isNotNull()), lambda x: part(x, k)), "")
    is_json = F.coalesce(F.get_json_object(c, "$").isNotNull(), F.lit(False))
    return F.struct(F.when(is_json, part(whole, "content")).otherwise(joined("content")).alias("content"), F.when(is_json, part(whole, "reasoning_content")).otherwise(joined("reasoning_content")).alias("reasoning"))


def batches(symbols: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds the request a symbol goes in, by its ordinal, and the part of its definition that is sent."""
    return symbols.withColumn("batch", F.floor(F.col("ordinal") / size).cast("int")).withColumn("sent", F.substring("definition", 1, EXCERPT))


def checked_replies(replies: DataFrame, asked: DataFrame, language: str = "en") -> DataFrame:
    """replies: (batch, content); asked: (batch, id).  Per batch: items, error (null if all is right).

    A batch is right only if it is an object with an items array that names each asked id exactly once,
    with a meaning of 1 to 240 characters (24 in Chinese) after white space is collapsed.
    """
    limit = MAX_CHINESE if language == "zh" else MAX_MEANING
    items = replies.select("batch", F.from_json(F.get_json_object("content", "$.items"), _ITEMS).alias("items"))
    rows = items.select("batch", F.posexplode("items").alias("k", "x")).select("batch", "k", F.col("x.id").alias("id"), F.trim(F.regexp_replace("x.meaning", r"(?U)\s+", " ")).alias("meaning"))
    marked = rows.join(asked.select("batch", "id", F.lit(True).alias("known")), ["batch", "id"], "left")
    good = F.coalesce(F.col("known") & F.char_length("meaning").between(1, limit), F.lit(False))
    per = marked.groupBy("batch").agg(F.bool_and(good).alias("good"), F.countDistinct("id").alias("ids"), F.count("*").alias("n"))
    want = asked.groupBy("batch").agg(F.countDistinct("id").alias("want"))
    error = (
        F.when(F.col("items").isNull(), "no items array").when(F.coalesce("n", F.lit(0)) != F.col("want"), "wrong number of items")
        .when(F.col("ids") != F.col("want"), "an id repeats").when(~F.col("good"), "an item is not valid")
    )
    return want.join(items, "batch", "left").join(per, "batch", "left").select("batch", "items", error.alias("error"))


def outcome(checked: DataFrame) -> DataFrame:
    """One row: failed batches and the first one's error."""
    bad = F.col("error").isNotNull()
    return checked.agg(F.count_if(bad).alias("failed_batches"), F.min_by(F.when(bad, F.substring("error", 1, MAX_ERROR)), F.when(bad, F.col("batch"))).alias("first_error"))


def accepted(checked: DataFrame) -> DataFrame:
    """(ordinal, id, meaning) of the batches without error."""
    rows = checked.filter("error is null").select("batch", F.posexplode("items").alias("k", "x"))
    return rows.select((F.col("batch") * BATCH + F.col("k")).alias("ordinal"), "x.id", "x.meaning")
