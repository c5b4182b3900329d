"""From positioned glyphs to a paper's pool of author-defined symbols.

Pages are grouped once by (paper_id, page); a page's glyphs are bounded by what fits on it, so the
grouped pass holds one page at a time.  What crosses pages (the paper's median gutter, the references
flag, the pool, occurrences, glosses) is DataFrame operations on much smaller tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schemas as S
from ..functions import characters as C
from ..functions import columns as X
from ..functions import gloss
from ..operators.events import EventFinder
from ..operators.layout import follows_boundary, gutter
from ..operators.lines import HEADING, Glyph, box, group_lines
from ..sources.shared import written

PAGE = ["paper_id", "page"]
CONTEXT = 6


def decoded_glyphs(glyphs: DataFrame, font_codes: DataFrame | None) -> DataFrame:
    """Adds decoded and identity_status: a private code is looked up by font family, then by full font name.

    The font table is a dimension: the planner broadcasts it while it is small.
    """
    g = glyphs.withColumn("family", X.font_family("fontname")).withColumn("code", X.glyph_code("text"))
    if font_codes is None:
        mapped = F.lit(None).cast("string")
    else:
        for key, name in (("family", "by_family"), ("fontname", "by_font")):
            g = g.join(font_codes.select("paper_id", F.col("font").alias(key), "code", F.col("ch").alias(name)), ["paper_id", key, "code"], "left")
        mapped = F.coalesce("by_family", "by_font")
    text, status = X.decode_surface("text", mapped)
    return g.withColumns({"decoded": text, "identity_status": status}).select("paper_id", "page", "index", "text", "decoded", "identity_status", "fontname", "x0", "x1", "top", "bottom", "size", "upright")


def _page_glyphs(pdf: pd.DataFrame) -> list[Glyph]:
    """Upright glyphs with visible text; a missing size is 10."""
    out = []
    for r in pdf.sort_values("index").itertuples():
        if r.upright is False or r.upright == False or not (r.decoded or "").strip():  # noqa: E712
            continue
        num = lambda v: 0.0 if v is None or v != v else float(v)
        out.append(Glyph(int(r.index_), r.text, r.decoded, r.identity_status, r.fontname or "", num(r.x0), num(r.x1), num(r.top), num(r.bottom), num(r.size_) or 10.0))
    return out


def _renamed(glyphs: DataFrame) -> DataFrame:
    return glyphs.withColumnsRenamed({"index": "index_", "size": "size_"}).withColumn("index", F.col("index_"))


def page_boundaries(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, page, boundary): each page's own gutter, null without one; only positions are shuffled."""
    visible = X.nonspace("decoded", "upright")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    marks = glyphs.select("paper_id", "page", visible.alias("visible"), zero("x0"), zero("x1"), zero("top"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        first, seen = pdf.iloc[0], pdf[pdf.visible]
        width = None if pd.isna(first.width) else first.width
        return pd.DataFrame([(first.paper_id, first.page, gutter(seen.x0.to_numpy(), seen.x1.to_numpy(), seen.top.to_numpy(), width))], columns=["paper_id", "page", "boundary"])

    return marks.join(pages.select(*PAGE, "width").hint("merge"), PAGE, "left").groupBy(PAGE).applyInPandas(find, "paper_id string, page int, boundary double")


def with_paper_boundary(boundaries: DataFrame) -> DataFrame:
    """Adds the median of the paper's found gutters."""
    median = boundaries.groupBy("paper_id").agg(F.median("boundary").alias("paper_boundary"))
    return boundaries.join(median.hint("merge"), "paper_id")


def _parse_page(pdf: pd.DataFrame) -> pd.DataFrame:
    page, paper = int(pdf.page.iloc[0]), pdf.paper_id.iloc[0]
    own, shared = (None if pd.isna(v) else float(v) for v in (pdf.boundary.iloc[0], pdf.paper_boundary.iloc[0]))
    lines = group_lines(_page_glyphs(pdf), page)
    boundary = own if own is not None else shared if follows_boundary(lines, shared) else None
    headings = [i for i, line in enumerate(lines) if HEADING.search(line.text.strip())]
    stop = headings[-1] if headings else None

    def events(started: bool) -> dict:
        gated = [line.definition and not started and not (headings and i >= headings[0]) for i, line in enumerate(lines)]
        found, claimed = EventFinder(lines, gated, stop, boundary).events()
        as_symbol = lambda s: {"surface": s.surface, "identity_key": s.identity_key, "style": s.style, "status": s.status, "level": s.level, "types": s.types, "token_ids": s.token_ids, "texts": s.texts}
        return {
            "events": [{"definition_id": e.definition_id, "line_ids": e.line_ids, "text": e.text, "bbox": e.bbox, "trigger": e.trigger, "window": e.window, "symbols": [as_symbol(s) for s in e.symbols]} for e in found],
            "claimed": claimed,
        }

    rows = [{"line": i, "line_id": x.id, "text": x.text, "bbox": box(x.g), "definition_like": x.definition, "formula_like": x.formula, "heading": i in headings, "has_token": bool(x.tokens)} for i, x in enumerate(lines)]
    tokens = [{"token_id": t.token_id, "line_id": x.id, "kind": t.kind, "surface": t.surface, "identity_key": t.identity, "style": t.style, "status": t.status, "bbox": t.bbox} for x in lines for t in x.tokens]
    glyphs = [
        {
            "token_id": f"p{page}:char{g.index}", "line": i, "line_id": x.id, "surface": g.text, "surface_normalized": C.normal_form(g.text), "status": g.status,
            "style": g.style, "bbox": box([g]), "font": g.font, "font_family": g.family, "size": round(g.size, 3),
        }
        for i, x in enumerate(lines) for g in x.g
    ]
    return pd.DataFrame([{"paper_id": paper, "page": page, "boundary": boundary, "lines": rows, "tokens": tokens, "candidates": glyphs, "open": events(False), "closed": events(True)}])


def parse_pages(glyphs: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row a page with its lines, tokens, glyphs and events (schemas.PARSED_PAGE).

    The rows of pages grow with the papers; they meet the glyphs where these are grouped anyway, and the driver holds none.
    """
    return _renamed(glyphs).join(with_paper_boundary(boundaries).hint("merge"), PAGE).groupBy(PAGE).applyInPandas(_parse_page, S.PARSED_PAGE)


def with_reference_flag(parsed: DataFrame) -> DataFrame:
    """Adds ``started``: whether an earlier page of the paper has a references heading; picks the events that fit."""
    before = Window.partitionBy("paper_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce(F.max(F.exists("lines", lambda x: x["heading"])).over(before), F.lit(False))
    return parsed.withColumn("started", started).withColumn("found", F.when(F.col("started"), F.col("closed")).otherwise(F.col("open"))).drop("open", "closed")


def line_table(pages: DataFrame) -> DataFrame:
    """Lines; ``definition_like`` is false from the first references heading of the paper on."""
    rows = pages.select("paper_id", "page", "started", F.explode("lines").alias("x")).select("paper_id", "page", "started", "x.*")
    seen = F.max("heading").over(Window.partitionBy("paper_id", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("definition_like", F.col("definition_like") & ~F.col("started") & ~seen).drop("started")


def occurrence_table(pages: DataFrame) -> DataFrame:
    """Every token of every line, references included."""
    return pages.select("paper_id", "page", F.posexplode("tokens").alias("ordinal", "x")).select("paper_id", "page", "ordinal", "x.*")


def _line_classes(pages: DataFrame) -> DataFrame:
    """Adds ``classes``: of each line of the page its source, formula_like and definition_like.

    A line's number is its place in the page's row, so all of it is read there.
    """
    references = F.array_position("lines.heading", F.lit(True))
    definition = F.transform("lines.definition_like", lambda d, i: d & ~F.col("started") & ((references == 0) | (i + 1 < references)))
    rows = pages.withColumn("definition", definition)

    def classes(formula: Column, i: Column) -> Column:
        own, first = F.get("definition", i), F.greatest(i - CONTEXT, F.lit(0))
        near = F.exists(F.slice("definition", first + 1, i + CONTEXT + 1 - first), lambda d: d) | F.array_contains("found.claimed", i)
        source = F.when(formula & own, "definition_line_all_glyphs").when(formula, "formula_line_all_glyphs").when(near, "definition_context")
        return F.struct(source.alias("source"), formula.alias("formula_like"), own.alias("definition_like"))

    return rows.withColumn("classes", F.transform("lines.formula_like", classes)).drop("definition")


def candidate_table(pages: DataFrame) -> DataFrame:
    """Glyphs of formula and definition lines, of six lines around definitions, and of event windows.

    A glyph belongs to one line, so its source is the first that holds in this order.  Nothing leaves the
    page's row before the glyphs do: no table of lines is joined, broadcast or shuffled.
    """
    rows = _line_classes(pages).select("paper_id", "page", "classes", F.explode("candidates").alias("x"))
    rows = rows.select("paper_id", "page", "x.*", F.get("classes", F.col("x.line")).alias("class")).filter("class.source is not null")
    return rows.select("paper_id", "page", "line", *(c for c in rows.columns if c not in ("paper_id", "page", "line", "class")), "class.*")


def review_queue(pages: DataFrame) -> DataFrame:
    """Glyphs without an identity on formula or definition lines, and definition lines without a token."""
    glyphs = candidate_table(pages).filter((F.col("formula_like") | F.col("definition_like")) & X.reviewable("status", "font_family"))
    glyphs = glyphs.select("paper_id", "page", F.concat("token_id", F.lit(":identity")).alias("review_id"), F.lit("unresolved_glyph_identity").alias("kind"), "line_id", "bbox", "surface")
    bare = line_table(pages).filter("definition_like and not has_token")
    bare = bare.select("paper_id", "page", F.concat("line_id", F.lit(":missing-math-token")).alias("review_id"), F.lit("definition_without_text_math_token").alias("kind"), "line_id", "bbox", F.lit(None).cast("string").alias("surface"))
    return glyphs.unionByName(bare)


def event_table(pages: DataFrame) -> DataFrame:
    return pages.select("paper_id", "page", F.posexplode("found.events").alias("ordinal", "e")).select("paper_id", "page", "ordinal", "e.*")


def event_symbols(events: DataFrame) -> DataFrame:
    """One row per event and symbol; ``seq`` orders them within the paper."""
    rows = events.select("paper_id", "page", "ordinal", "definition_id", F.col("text").alias("event_text"), F.posexplode("symbols").alias("k", "s"))
    return rows.select("paper_id", "page", "definition_id", "event_text", F.struct("page", "ordinal", "k").alias("seq"), "s.*")


def symbol_pool(events: DataFrame) -> DataFrame:
    """Symbols with evidence of level 2 or more, by identity, in order of first appearance."""
    s = event_symbols(events).filter("level >= 2")
    pool = s.groupBy("paper_id", "identity_key").agg(
        F.min("seq").alias("first"),
        F.min_by("surface", "seq").alias("surface"),
        F.min_by("style", "seq").alias("style"),
        F.max("level").alias("evidence_level"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "types"))), lambda x: x["types"]))).alias("evidence_types"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "definition_id"))), lambda x: x["definition_id"]).alias("definition_events"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "texts"))), lambda x: x["texts"]))).alias("texts"),
        F.min_by("event_text", "seq").alias("event_text"),
        F.min("page").alias("def_page"),
        F.max((F.col("status") == "unresolved")).alias("hidden"),
    )
    ordinal = F.row_number().over(Window.partitionBy("paper_id").orderBy("first")) - 1
    pool = pool.withColumn("ordinal", ordinal).withColumn("status", X.pool_status("evidence_level", F.col("hidden")))
    return pool.withColumn("id", F.concat(F.lit("symbol:"), "identity_key", F.lit(":"), F.col("ordinal").cast("string"))).drop("first", "hidden")


def with_occurrences(pool: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Adds how often and where each identity occurs anywhere in its paper."""
    at = occurrences.filter("status <> 'unresolved'").groupBy("paper_id", "identity_key").agg(
        F.count("*").alias("occurrences"),
        F.array_sort(F.collect_list(F.struct("page", "ordinal", "token_id", "line_id", "bbox", "surface", "style"))).alias("occurrence_locations"),
    )
    return pool.join(at, ["paper_id", "identity_key"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))


def with_gloss(pool: DataFrame) -> DataFrame:
    """Adds meaning, definition and location, from the first evidence that yields a gloss, else the first."""
    texts = pool.select("paper_id", "id", "surface", F.posexplode_outer("texts").alias("k", "text"))
    plain = gloss.gloss("surface", "text")["meaning"] == gloss.NO_GLOSS
    best = texts.groupBy("paper_id", "id").agg(F.min_by("text", F.struct(plain.alias("plain"), "k")).alias("evidence"))
    source = F.coalesce(F.nullif("evidence", F.lit("")), "event_text")
    out = pool.join(best, ["paper_id", "id"], "left").withColumn("said", gloss.gloss("surface", source))
    out = out.withColumn("meaning", F.col("said.summary")).withColumn("definition", F.col("said.definition"))
    return out.withColumn("location", X.page_label("def_page")).withColumn("meaning_source", F.lit("local")).drop("evidence", "said", "texts", "event_text")


def totals(pages: DataFrame, pool: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The counters of a paper; ``regions`` are sources.documents.image_regions, where images are known."""
    lines = line_table(pages).groupBy("paper_id").agg(F.count_if("definition_like").alias("definition_lines"), F.count_if(F.col("formula_like") & ~F.col("definition_like")).alias("formula_lines"))
    queue = review_queue(pages).groupBy("paper_id").agg(F.count("*").alias("visual_review_items"))
    candidates = candidate_table(pages).groupBy("paper_id").agg(F.count("*").alias("candidate_chars"), F.count_if(F.col("status") == "unresolved").alias("unresolved_candidates"))
    events = event_table(pages).groupBy("paper_id").agg(F.count("*").alias("definition_events"))
    symbols = pool.groupBy("paper_id").agg(F.count("*").alias("final_symbols"), F.count_if(F.col("status") == "review").alias("review_symbols"))
    images = pages.select("paper_id").distinct().withColumn("visual_fallback_regions", F.lit(0)) if regions is None else regions.groupBy("paper_id").agg(F.count("*").alias("visual_fallback_regions"))
    out = pages.groupBy("paper_id").agg(F.count("*").alias("pages"))
    for part in (lines, queue, candidates, events, symbols, images):  # all are dealt by paper already; the planner would broadcast them by the size of packed files
        out = out.join(part.hint("merge"), "paper_id", "left")
    return out.na.fill(0)


def documents(papers: "Papers") -> DataFrame:
    """One nested document a paper: symbols, events and review queue in order, and the totals."""
    nested = lambda df, name, *order: df.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in ("paper_id", *order))))).alias(name))
    out = papers.pages.groupBy("paper_id").agg(F.max("page").alias("last_page"))
    out = out.join(nested(papers.pool, "symbols", "ordinal"), "paper_id", "left").join(nested(papers.events, "definition_events", "page", "ordinal"), "paper_id", "left")
    return out.join(nested(papers.review_queue, "review_queue", "page", "review_id"), "paper_id", "left").join(totals(papers.pages, papers.pool).select("paper_id", F.struct("definition_lines", "formula_lines", "visual_review_items", "candidate_chars", "unresolved_candidates", "visual_fallback_regions", F.col("final_symbols"), "review_symbols").alias("totals")), "paper_id", "left")


class Papers:
    """The tables of some papers, each a lazy DataFrame over the parsed pages, which are written once and read by all."""

    def __init__(self, glyphs: DataFrame, pages: DataFrame, font_codes: DataFrame | None = None):
        decoded = decoded_glyphs(glyphs, font_codes)
        self.boundaries = written(page_boundaries(decoded, pages), "boundaries")
        self.pages = written(with_reference_flag(parse_pages(decoded, self.boundaries)), "pages")
        self.lines, self.events, self.occurrences = line_table(self.pages), event_table(self.pages), occurrence_table(self.pages)
        self.pool = with_gloss(with_occurrences(symbol_pool(self.events), self.occurrences))
        self.review_queue, self.candidates = review_queue(self.pages), candidate_table(self.pages)

