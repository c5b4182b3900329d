"""Human review of glyphs without an identity: confirm or dismiss, as joins over the paper's tables.

Tables: queue (paper_id, page, review_id, kind, line_id, bbox), lines, events (with ``line_ids``),
symbols (paper_id, id, surface, status, evidence_level, ...), resolutions (paper_id, review_id,
surface, ignored).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import columns as X
from ..functions.gloss import NO_GLOSS
from .library import Rejected, _require

IDENTITY = "unresolved_glyph_identity"


def _targets(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The queued items asked for; each must exist and be a glyph's."""
    keys = ["paper_id", "review_id"]
    _require(ids.join(queue, keys, "left_anti"), "no such review item")
    hit = queue.join(ids, keys)
    _require(hit.filter(F.col("kind") != IDENTITY), "only glyphs can be reviewed")
    return hit


def dismiss(queue: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue without the items, resolutions to append)."""
    hit = _targets(queue, ids)
    return queue.join(ids, ["paper_id", "review_id"], "left_anti"), hit.select("paper_id", "review_id", F.lit(None).cast("string").alias("surface"), F.lit(True).alias("ignored"))


def attach(queue: DataFrame, lines: DataFrame, events: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Each confirmation with its evidence level and event: the first on its page that holds its line, else a new one."""
    if confirmations.filter(~F.coalesce(X.valid_surface(X.trim_all("surface")), F.lit(False))).take(1):
        raise Rejected("a surface has 1 to 32 characters, none of them white space or control")
    hit = _targets(queue, confirmations.withColumn("surface_new", X.trim_all("surface")).drop("surface"))
    hit = hit.join(lines.select("paper_id", "page", "line_id", F.col("text").alias("line_text"), F.col("bbox").alias("line_bbox"), "definition_like"), ["paper_id", "page", "line_id"])
    on = events.select("paper_id", "page", "ordinal", "definition_id", "text", F.explode("line_ids").alias("line_id"))
    first = on.groupBy("paper_id", "page", "line_id").agg(F.min_by(F.struct("definition_id", "text"), "ordinal").alias("event"))
    level = F.when(F.col("definition_like"), 3).otherwise(2)
    token = F.regexp_replace("review_id", ":identity$", "")
    fresh = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(":visual-definition:"), token)
    return hit.join(first, ["paper_id", "page", "line_id"], "left").select(
        "paper_id", "page", "line_id", "bbox", "review_id", F.col("surface_new").alias("surface"), level.alias("level"), X.evidence_type(level).alias("type"),
        F.coalesce("event.definition_id", fresh).alias("definition_id"), F.coalesce("event.text", "line_text").alias("text"),
        F.col("event").isNull().alias("is_new"), "line_bbox", token.alias("token_id"),
    )


def new_events(attached: DataFrame) -> DataFrame:
    """Events to append for confirmations outside all events."""
    return attached.filter("is_new").select("paper_id", "page", "definition_id", F.array("line_id").alias("line_ids"), "text", F.col("line_bbox").alias("bbox"), F.lit("visual_confirmation").alias("trigger"))


def event_symbol_rows(attached: DataFrame) -> DataFrame:
    """Symbols to append to events that lack the surface."""
    return attached.select("paper_id", "definition_id", "surface", F.array("token_id").alias("token_ids"), F.lit("visual_confirmed").alias("identity_status"), F.col("level").alias("evidence_level"), F.array("type").alias("evidence_types"))


def confirm_symbols(symbols: DataFrame, attached: DataFrame) -> DataFrame:
    """The pool with confirmations merged in by surface.

    A level never falls; a confirmed symbol stays confirmed; level 3 confirms.  A surface the pool lacks
    becomes a new symbol, numbered behind the paper's others, without identity or style.
    """
    new = attached.groupBy("paper_id", "surface").agg(
        F.max("level").alias("new_level"), F.array_sort(F.collect_set("definition_id")).alias("new_events"), F.array_sort(F.collect_set("type")).alias("new_types"),
        F.count("*").alias("new_occurrences"), F.min_by("text", "review_id").alias("new_text"), F.min("page").alias("new_page"),
    )
    # Only the first symbol of a surface is the one confirmed.
    place = F.row_number().over(Window.partitionBy("paper_id", "surface").orderBy("ordinal"))
    size = symbols.groupBy("paper_id").agg(F.count("*").alias("size"))
    s = symbols.withColumn("place", place)
    out = s.join(new.withColumn("place", F.lit(1)), ["paper_id", "surface", "place"], "full_outer").join(size, "paper_id", "left")
    fresh = F.col("id").isNull()
    rank = F.row_number().over(Window.partitionBy("paper_id", fresh).orderBy("surface")) - 1
    number = F.coalesce("ordinal", F.coalesce("size", F.lit(0)) + rank)
    level = F.greatest("evidence_level", "new_level")
    status = F.when(F.col("new_level").isNull(), F.col("status")).when((F.col("new_level") >= 3) | (F.col("status") == "confirmed"), "confirmed").otherwise("review")
    none = F.array().cast("array<string>")
    return out.select(
        "paper_id", F.coalesce("id", F.concat(F.lit("symbol:"), "surface", F.lit(":"), number.cast("string"))).alias("id"), "surface", number.cast("int").alias("ordinal"), status.alias("status"), level.alias("evidence_level"),
        F.array_union(F.coalesce("evidence_types", none), F.coalesce("new_types", none)).alias("evidence_types"),
        F.array_union(F.coalesce("definition_events", none), F.coalesce("new_events", none)).alias("definition_events"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("new_occurrences", F.lit(0))).alias("occurrences"),
        F.when(fresh, F.lit(NO_GLOSS)).otherwise(F.col("meaning")).alias("meaning"),
    )


@dataclass
class Reviewed:
    """The new versions of all tables that a confirmation touches; ``resolutions`` are rows to append."""

    queue: DataFrame
    events: DataFrame
    symbols: DataFrame
    occurrences: DataFrame
    resolutions: DataFrame
    totals: DataFrame


def confirm(queue: DataFrame, lines: DataFrame, events: DataFrame, symbols: DataFrame, occurrences: DataFrame, confirmations: DataFrame) -> Reviewed:
    """One command: (paper_id, review_id, surface) rows leave the queue and become events, symbols and occurrences.

    Every row must name a queued glyph and a valid surface, none twice; else nothing changes.
    """
    keys = ["paper_id", "review_id"]
    _require(confirmations.groupBy(*keys).count().filter("count > 1"), "an item is confirmed twice")
    attached = attach(queue, lines, events, confirmations)
    left = queue.join(confirmations.select(*keys), keys, "left_anti")
    pool = confirm_symbols(symbols, attached)
    seen = attached.select("paper_id", "page", "token_id", "line_id", "bbox", "surface", "definition_id", F.lit("visual").alias("kind"), F.lit("visual_confirmed").alias("status"))
    resolved = confirmations.select(*keys, X.trim_all("surface").alias("surface"), F.lit(False).alias("ignored"))
    more = new_events(attached)
    every = events.unionByName(more.withColumn("page", F.col("page").cast(events.schema["page"].dataType)), allowMissingColumns=True)
    return Reviewed(left, every, pool, occurrences.unionByName(seen, allowMissingColumns=True), resolved, counters(left, pool))


def counters(queue: DataFrame, symbols: DataFrame) -> DataFrame:
    """The two totals a review changes: (paper_id, visual_review_items, review_symbols)."""
    pending = queue.groupBy("paper_id").agg(F.count("*").alias("visual_review_items"))
    open_ = symbols.groupBy("paper_id").agg(F.count_if(F.col("status") == "review").alias("review_symbols"))
    return pending.join(open_, "paper_id", "full_outer").na.fill(0)
