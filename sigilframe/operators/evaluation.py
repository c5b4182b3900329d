"""Gold-set recall and layout audits.

gold: (gold_id, paper_id, page, lo, hi, expected array, aliases map<string,array<string>>, identity
map<string,boolean>); lo and hi are line numbers, null if unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as X

NEAR, MARGIN, GUTTER = 8, 2, 6.0
#: Height of the bands in which boxes look for each other.
BAND = 32.0
_KEY = ["gold_id", "symbol"]


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joined where both sides are dealt by their keys.

    Rows unpacked from nested pages are many times the size that the planner takes from their files: it would
    broadcast all glyphs.
    """
    return left.join(right.hint("merge"), on, how)


def line_number(line_id: Column | str) -> Column:
    c = F.col(line_id) if isinstance(line_id, str) else line_id
    return F.nullif(F.regexp_extract(c, r":line(\d+)$", 1), F.lit("")).try_cast("int")


def gold_symbols(gold: DataFrame) -> DataFrame:
    """One row per expected symbol, with all accepted surfaces and the preferred one."""
    own = F.coalesce(F.try_element_at("aliases", F.col("symbol")), F.array().cast("array<string>"))
    rows = gold.withColumn("symbol", F.explode("expected"))
    return rows.select("gold_id", "paper_id", "page", "lo", "hi", "symbol", F.array_union(F.array("symbol"), own).alias("accepted"), F.coalesce(F.try_element_at(own, F.lit(1)), "symbol").alias("preferred"), F.try_element_at("identity", F.col("symbol")).alias("trusted"))


def line_distance(lo_a: str, hi_a: str, lo_b: str, hi_b: str) -> Column:
    return F.greatest(F.col(lo_a) - F.col(hi_b), F.col(lo_b) - F.col(hi_a), F.lit(0))


def passage_candidates(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """(gold_id, surface): glyphs within two lines of the passage; of the whole page where there are none."""
    c = candidates.withColumn("n", line_number("line_id"))
    near = F.coalesce(F.col("n").between(F.col("lo") - MARGIN, F.col("hi") + MARGIN), F.lit(False))
    on_page = _met(gold.select("gold_id", "paper_id", "page", "lo", "hi"), c, ["paper_id", "page"]).select("gold_id", near.alias("near"), F.explode(F.array("surface", "surface_normalized")).alias("surface"))
    found = on_page.groupBy("gold_id", "surface").agg(F.max("near").alias("near"))
    found = found.withColumn("any", F.max("near").over(Window.partitionBy("gold_id")))
    return found.filter(F.col("near") | ~F.col("any")).select("gold_id", "surface")


def near_events(gold: DataFrame, events: DataFrame, near: int = NEAR) -> DataFrame:
    """(gold_id, definition_id, local): events of the gold row's page, and whether they are within ``near`` lines."""
    e = events.select("paper_id", "page", "definition_id", F.array_min(F.transform("line_ids", line_number)).alias("e_lo"), F.array_max(F.transform("line_ids", line_number)).alias("e_hi"))
    pairs = _met(gold.select("gold_id", "paper_id", "page", "lo", "hi"), e, ["paper_id", "page"])
    close = F.coalesce(line_distance("lo", "hi", "e_lo", "e_hi") <= near, F.lit(True))
    return pairs.select("gold_id", "definition_id", close.alias("local"))


def _banded(rows: DataFrame, box: str) -> DataFrame:
    """Each row once for every band its box touches: boxes that overlap share one, so they meet by equality."""
    at = lambda k: F.floor(F.col(box)[k] / BAND)
    return rows.withColumn("band", F.explode(F.sequence(at(1), at(3))))


def glyphs_in_events(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper_id, definition_id, surface): glyphs on an event's lines, or whose box overlaps its box on the same page."""
    e = events.select("paper_id", "page", "definition_id", "line_ids", F.col("bbox").alias("event_box"))
    by_line = _met(e.withColumn("line_id", F.explode("line_ids")), candidates, ["paper_id", "page", "line_id"]).select("paper_id", "definition_id", "surface", "surface_normalized")
    by_box = _met(_banded(e, "event_box"), _banded(candidates, "bbox"), ["paper_id", "page", "band"]).filter(X.boxes_overlap(F.col("event_box"), F.col("bbox"))).select("paper_id", "definition_id", "surface", "surface_normalized")
    return by_line.unionByName(by_box).select("paper_id", "definition_id", F.explode(F.array("surface", "surface_normalized")).alias("surface")).distinct()


def recall(gold: DataFrame, candidates: DataFrame, events: DataFrame, symbols: DataFrame, pool: DataFrame) -> DataFrame:
    """Per gold row: whether all its symbols are found, by each measure.

    symbols: (paper_id, definition_id, surface) of events; pool: (paper_id, surface, definition_events).
    """
    wanted = gold_symbols(gold)
    spread = wanted.withColumn("surface", F.explode("accepted"))
    passage = passage_candidates(gold, candidates)
    true = F.lit(True)
    # The preferred surface is an accepted one, and a local event an event: each table is met once for both measures.
    seen = _met(spread, passage, ["gold_id", "surface"]).groupBy(*_KEY).agg(F.max(true).alias("candidate"), F.max(F.col("surface") == F.col("preferred")).alias("canonical"))
    owned = _met(_met(spread, near_events(gold, events), "gold_id"), symbols, ["paper_id", "definition_id", "surface"]).select(*_KEY, "paper_id", "definition_id", "accepted", "local")
    inside = glyphs_in_events(events, candidates).withColumnRenamed("surface", "glyph")
    owned = _met(owned, inside, ["paper_id", "definition_id"]).filter(F.array_contains("accepted", F.col("glyph"))).groupBy(*_KEY).agg(F.max(true).alias("event"), F.max("local").alias("local_event"))
    pooled = _met(spread, pool.filter(F.size("definition_events") > 0).select("paper_id", "surface").distinct(), ["paper_id", "surface"]).groupBy(*_KEY).agg(F.max(true).alias("pool"))
    out = wanted
    for part in (seen, owned, pooled):
        out = _met(out, part, _KEY, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    pending = ~F.coalesce("trusted", F.lit(True))
    return out.groupBy("gold_id").agg(
        F.bool_and(yes("candidate")).alias("candidate_position"),
        F.bool_and(yes("canonical")).alias("canonical_surface"),
        F.bool_and(F.coalesce("trusted", yes("candidate"))).alias("trusted_identity"),
        F.bool_and(yes("event")).alias("page_definition_event_link"),
        F.bool_and(yes("local_event")).alias("local_definition_event_link"),
        F.bool_and(yes("pool")).alias("final_pool_link"),
        F.bool_and(yes("pool") | pending).alias("final_pool_link_eligible"),
        F.bool_or(pending).alias("visual_pending"),
    )


def corpus_counts(per_gold: DataFrame) -> DataFrame:
    flags = [c for c in per_gold.columns if c not in ("gold_id", "visual_pending")]
    return per_gold.agg(F.count("*").alias("total"), *(F.count_if(c).alias(c) for c in flags), F.count_if(~F.col("visual_pending")).alias("eligible"))


def compare(first: DataFrame, second: DataFrame, flag: str) -> DataFrame:
    """Two versions' results of the same gold rows."""
    return first.select("gold_id", F.col(flag).alias("before")).join(second.select("gold_id", F.col(flag).alias("after")), "gold_id")


def coverage(rows: DataFrame, keys: list[str], selected: str) -> DataFrame:
    """selected, total and their ratio to four places; null where nothing is counted."""
    n = F.count_if(selected)
    return rows.groupBy(*keys).agg(n.alias("selected"), F.count("*").alias("total"), F.bround(F.try_divide(n, F.count("*")), 4).alias("coverage"))


def math_dominant(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("meaningful") >= 2) & (F.col("math") >= 2) & (F.try_divide("math", "meaningful") >= 0.35))


def crossing_gutter(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Events whose box reaches across their page's gutter."""
    e = events.join(boundaries.filter("boundary is not null"), ["paper_id", "page"])
    return e.filter((F.col("bbox")[0] < F.col("boundary") - GUTTER) & (F.col("bbox")[2] > F.col("boundary") + GUTTER))


def required_and_forbidden(pool: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """Per paper: required surfaces that are missing, and forbidden ones that are there."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    own = pool.groupBy("paper_id").agg(F.collect_set("surface").alias("own"))
    return own.select("paper_id", F.array_sort(F.array_except(lit(required), "own")).alias("missing"), F.array_sort(F.array_intersect(lit(forbidden), "own")).alias("forbidden"))


def glyph_inventory(glyphs: DataFrame) -> DataFrame:
    """Per font and text: count, pages, the first five boxes and three lines; and the distinct codes of each font."""
    keys = ["fontname", "text"]
    # A rank with a bound is applied before the shuffle, so no task sees all glyphs of a common letter.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(c for c in ("page", "index", "paper_id") if c in glyphs.columns)))
    few = glyphs.withColumn("k", place).filter("k <= 5").select(*keys, "k", "bbox", "line_id")
    first = lambda c, n: F.slice(F.transform(F.array_sort(F.collect_list(F.struct("k", c))), lambda x: x[c]), 1, n)
    counts = glyphs.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    return counts.join(few.groupBy(*keys).agg(first("bbox", 5).alias("boxes"), first("line_id", 3).alias("lines")), keys)


def font_frequency(glyphs: DataFrame) -> DataFrame:
    """Fonts by falling count; ties by first appearance."""
    return glyphs.groupBy("fontname").agg(F.count("*").alias("n"), F.min(F.struct("page", "index")).alias("first")).orderBy(F.desc("n"), "first").drop("first")


def detached_operators(operators: DataFrame, lines: DataFrame, reach: float = 5.0) -> DataFrame:
    """Each operator with the first line of its page whose band, widened by ``reach``, holds its centre."""
    o = operators.withColumn("cy", (F.col("top") + F.col("bottom")) / 2).select("paper_id", "page", F.col("index"), "cy")
    hit = o.join(lines.select("paper_id", "page", "line", "bbox"), ["paper_id", "page"]).filter(F.col("cy").between(F.col("bbox")[1] - reach, F.col("bbox")[3] + reach))
    return hit.groupBy("paper_id", "page", "index").agg(F.min("line").alias("line"))


def surface_counts(candidates: DataFrame, surfaces: list[str]) -> DataFrame:
    """Per page, how often each of the given surfaces stands on it, one column each."""
    return candidates.groupBy("paper_id", "page").agg(*(F.count_if(F.col("surface") == s).alias(s) for s in surfaces))


def seen_codes(glyphs: DataFrame) -> DataFrame:
    """The distinct private codes of each font."""
    code = X.glyph_code("text")
    return glyphs.select("paper_id", "fontname", code.alias("code")).filter("code is not null").groupBy("paper_id", "fontname").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def in_boxes(candidates: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes: (box_id, paper_id, page, area): the glyphs whose box overlaps an audited area of their page."""
    return _banded(boxes, "area").join(_banded(candidates, "bbox"), ["paper_id", "page", "band"]).filter(X.boxes_overlap(F.col("area"), F.col("bbox"))).select("box_id", *candidates.columns).distinct()
