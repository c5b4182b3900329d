"""The engine from glyphs to pool, review and recall over the manuscripts, each step as a query.

The oracle's rows come from the templates and from what can be read off them by hand
(``manuscripts.SQL``); it shares no rule with the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .adapters import Tables
from .manuscripts import LEFT, PITCH, RIGHT, SQL, STEP, WIDTH, manuscripts
from .operators import evaluation, review
from .plans import symbol_pool as plan
from .registry import query

_IDS = "paper_id"
#: Texts of which a small letter and the recovered letter have no gloss but their beginning.
_PLAIN = "CASE WHEN style = 'font:PrivateMath' THEN 'W = ' || b || ' we define the loss function ' ELSE a || ' = ' || b || ' + ' || c || ' let ' || c || ' be a vector of weights ' || a || '(' || c || ') is the loss. ' END || 'let ' || c || ' be a vector of weights ' || a || '(' || c || ') is the loss'"
_GLOSS = "CASE WHEN style = 'mixed:italic+roman' THEN 'the loss' WHEN style = 'italic' AND surface = a THEN 'the mixing matrix' WHEN style = 'italic' AND surface = b THEN 'the number of rows' END"
_OTHER_KIND = "CASE WHEN len(kinds) = 2 THEN CASE first_kind WHEN 'direct_definition' THEN ',formula_context' ELSE ',direct_definition' END ELSE '' END"
_NEAR = "(SELECT paper_id, page, line FROM gated g WHERE EXISTS (SELECT 1 FROM gated d WHERE d.paper_id = g.paper_id AND d.page = g.page AND d.def AND abs(d.line - g.line) <= 6) UNION SELECT g.paper_id, g.page, g.line FROM gated g JOIN event e ON e.paper_id = g.paper_id AND e.page = g.page AND g.line BETWEEN e.lo AND e.hi)"
_CANDIDATES = f"""cand AS (
    SELECT g.paper_id, g.page, g.line, CASE WHEN formula AND def THEN 'definition_line_all_glyphs' WHEN formula THEN 'formula_line_all_glyphs' ELSE 'definition_context' END AS source, n.n AS glyphs, n.lost
    FROM gated g JOIN (SELECT paper_id, page, line, sum(length(replace(raw, ' ', ''))) AS n, sum(length(regexp_replace(raw, '[^◊○]', '', 'g'))) AS lost FROM part_ GROUP BY ALL) n ON n.paper_id = g.paper_id AND n.page = g.page AND n.line = g.line
    LEFT JOIN {_NEAR} x ON x.paper_id = g.paper_id AND x.page = g.page AND x.line = g.line WHERE formula OR x.line IS NOT NULL)"""
_QUEUE = """queue AS (
    SELECT paper_id, page, 'unresolved_glyph_identity' AS kind, 'p1:char15000:identity' AS review_id, line, '(cid:7)' AS surface FROM gated WHERE page = 1 AND line = 15
    UNION ALL SELECT g.paper_id, g.page, 'definition_without_text_math_token', 'p' || g.page || ':line' || g.line || ':missing-math-token', g.line, NULL FROM gated g
    WHERE def AND NOT EXISTS (SELECT 1 FROM token t WHERE t.paper_id = g.paper_id AND t.page = g.page AND t.line = g.line))"""


def papers(t: Tables) -> plan.Papers:
    return plan.Papers(*manuscripts(t.table("supplier")))


def _text(name: str):
    return F.array_join(name, ",").alias(name)


@query(f"WITH {SQL} SELECT paper_id, page, line, 'p' || page || ':line' || line AS line_id, text, x0, top, x1, top + 10 AS bottom, def AS definition_like, formula AS formula_like FROM gated")
def page_lines(t: Tables) -> DataFrame:
    """Glyphs put together to lines, with boxes and classes; the references heading ends definitions."""
    box = [F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "top", "x1", "bottom"))]
    return papers(t).lines.select(_IDS, F.col("page").cast("long"), F.col("line").cast("long"), "line_id", "text", *box, "definition_like", "formula_like")


@query(f"WITH {SQL} SELECT paper_id, page, line_id, token_id, kind, surface, style, surface || '|' || style AS identity_key, status, x0, row_number() OVER (PARTITION BY paper_id, page ORDER BY k) - 1 AS ordinal FROM token")
def page_tokens(t: Tables) -> DataFrame:
    """Single letters and composites with identity, style and status, in order along the page."""
    return papers(t).occurrences.select(_IDS, F.col("page").cast("long"), "line_id", "token_id", "kind", "surface", "style", "identity_key", "status", F.col("bbox")[0].alias("x0"), F.col("ordinal").cast("long"))


@query(f"""WITH {SQL},
    glyph AS (SELECT paper_id, page, if(side = 0, {LEFT}, {RIGHT}) + {STEP} * (i - 1) AS x0, line * {PITCH} + 10 AS top FROM part_, range(1, 60) r(i) WHERE i <= length(raw) AND substr(raw, i, 1) <> ' '),
    size_ AS (SELECT paper_id, page, count(*) AS n FROM glyph GROUP BY ALL),
    cell AS (SELECT DISTINCT paper_id, page, (x0 + i)::INT AS x, floor(top / 2) AS band FROM glyph, range(0, 6) r(i)),
    dens AS (SELECT s.paper_id, s.page, s.n, x.x, (SELECT count(*) FROM cell c WHERE c.paper_id = s.paper_id AND c.page = s.page AND c.x = x.x) AS d FROM size_ s, range(1, {int(WIDTH)}) x(x) WHERE s.n >= 40),
    peak AS (SELECT *, max(d) OVER (PARTITION BY paper_id, page) AS p FROM dens),
    sparse AS (SELECT *, x - row_number() OVER (PARTITION BY paper_id, page ORDER BY x) AS island FROM peak WHERE d <= greatest(1, floor(0.22 * p))),
    gap AS (SELECT paper_id, page, n, p, min(x) AS lo, max(x) + 1 AS hi, avg(d) AS mean FROM sparse GROUP BY paper_id, page, n, p, island),
    fit AS (
        SELECT *, (lo + hi) / 2 AS mid FROM gap WHERE p >= 2 AND hi - lo >= 8 AND mean <= 0.12 * p AND abs((lo + hi) / 2 - {WIDTH / 2}) <= 0.07 * {WIDTH}
            AND (SELECT count(*) FROM glyph g WHERE g.paper_id = gap.paper_id AND g.page = gap.page AND g.x0 + {STEP} <= lo) >= 0.12 * n AND (SELECT count(*) FROM glyph g WHERE g.paper_id = gap.paper_id AND g.page = gap.page AND g.x0 >= hi) >= 0.12 * n
    ),
    best AS (SELECT paper_id, page, arg_max(mid, (hi - lo) * 1000 - abs(mid - {WIDTH / 2})) AS boundary FROM fit GROUP BY ALL)
    SELECT s.paper_id, s.page, boundary, median(boundary) OVER (PARTITION BY s.paper_id) AS paper_boundary FROM size_ s LEFT JOIN best b ON b.paper_id = s.paper_id AND b.page = s.page""")
def page_gutters(t: Tables) -> DataFrame:
    """Each page's gutter by density, and the median over its paper."""
    rows = plan.with_paper_boundary(plan.page_boundaries(plan.decoded_glyphs(*_decodable(t)), manuscripts(t.table("supplier"))[1]))
    return rows.select(_IDS, F.col("page").cast("long"), "boundary", "paper_boundary")


def _decodable(t: Tables) -> tuple[DataFrame, DataFrame]:
    glyphs, _, codes = manuscripts(t.table("supplier"))
    return glyphs, codes


@query(f"WITH {SQL} SELECT status, decoded, count(*) AS n FROM (SELECT CASE ch WHEN '●' THEN 'recovered' WHEN '◊' THEN 'unresolved' WHEN '○' THEN 'unresolved' ELSE 'native' END AS status, CASE ch WHEN '§' THEN a WHEN '¤' THEN b WHEN '£' THEN c WHEN '◊' THEN '(cid:7)' WHEN '○' THEN '(cid:8)' WHEN '●' THEN 'W' ELSE ch END AS decoded FROM (SELECT a, b, c, unnest(string_split(raw, '')) AS ch FROM part_)) WHERE decoded <> ' ' GROUP BY ALL")
def decoded_glyphs(t: Tables) -> DataFrame:
    """Private codes looked up by font family; what no table knows stays unresolved."""
    return plan.decoded_glyphs(*_decodable(t)).groupBy(F.col("identity_status").alias("status"), "decoded").agg(F.count("*").alias("n"))


@query(f"WITH {SQL} SELECT paper_id, page, ordinal, definition_id, line_ids, text, trigger, x0, x1, hi - lo + 1 AS window_lines FROM event")
def definition_events(t: Tables) -> DataFrame:
    """Greedy windows behind each seed, on the side of the gutter that holds the definition, to the sentence's end."""
    e = papers(t).events
    return e.select(_IDS, F.col("page").cast("long"), F.col("ordinal").cast("long"), "definition_id", _text("line_ids"), "text", "trigger", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"), F.size("window").cast("long").alias("window_lines"))


@query(f"WITH {SQL} SELECT paper_id, page, definition_id, identity_key, surface, style, n_tokens, level, first_kind || {_OTHER_KIND} AS types FROM es")
def event_symbols(t: Tables) -> DataFrame:
    """Tokens of an event by identity, with the greatest level and all kinds of evidence."""
    s = plan.event_symbols(papers(t).events)
    return s.select(_IDS, F.col("page").cast("long"), "definition_id", "identity_key", "surface", "style", F.size("token_ids").cast("long").alias("n_tokens"), F.col("level").cast("long"), _text("types"))


@query(f"""WITH {SQL} SELECT q.paper_id, ordinal, 'symbol:' || identity_key || ':' || ordinal AS id, surface, style, evidence_level, CASE WHEN evidence_level >= 3 THEN 'confirmed' ELSE 'review' END AS status, first_kind || {_OTHER_KIND} AS evidence_types, events AS definition_events,
    (SELECT count(*) FROM token t WHERE t.paper_id = q.paper_id AND t.surface = q.surface AND t.style = q.style) AS occurrences, '第 ' || def_page || ' 页' AS location,
    coalesce({_GLOSS}, rtrim(substr({_PLAIN}, 1, 37)) || '…') AS meaning, coalesce(surface || ': ' || {_GLOSS}, {_PLAIN}) AS definition
    FROM pool q JOIN paper p ON p.paper_id = q.paper_id""")
def symbol_pool(t: Tables) -> DataFrame:
    """The flagship: every paper's symbols in order, with evidence, occurrences and glosses."""
    p = papers(t).pool
    return p.select(_IDS, F.col("ordinal").cast("long"), "id", "surface", "style", F.col("evidence_level").cast("long"), "status", _text("evidence_types"), _text("definition_events"), "occurrences", "location", "meaning", "definition")


@query(f"WITH {SQL} SELECT q.paper_id, q.identity_key, t.page, t.token_id, t.line_id FROM pool q JOIN token t ON t.paper_id = q.paper_id AND t.surface = q.surface AND t.style = q.style")
def symbol_occurrences(t: Tables) -> DataFrame:
    """Where each pooled identity stands in its paper."""
    p = papers(t).pool.select(_IDS, "identity_key", F.explode("occurrence_locations").alias("x"))
    return p.select(_IDS, "identity_key", F.col("x.page").cast("long").alias("page"), "x.token_id", "x.line_id")


@query(f"WITH {SQL}, {_QUEUE} SELECT paper_id, page, kind, review_id, 'p' || page || ':line' || line AS line_id, surface FROM queue")
def review_queue(t: Tables) -> DataFrame:
    """Glyphs without an identity in fonts that are no structure, and definition lines without a token."""
    return papers(t).review_queue.select(_IDS, F.col("page").cast("long"), "kind", "review_id", "line_id", "surface")


@query(f"WITH {SQL}, {_CANDIDATES} SELECT paper_id, page, line, source, glyphs::BIGINT AS glyphs FROM cand")
def formula_candidates(t: Tables) -> DataFrame:
    """Glyphs of formula and definition lines, of six lines around definitions and of claimed lines, by their source."""
    return papers(t).candidates.groupBy(_IDS, F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), "source").agg(F.count("*").alias("glyphs"))


@query(f"WITH {SQL} SELECT paper_id, page, line, page = 3 AND line = 1 AS heading, raw_def AND page = 3 AND line > 1 AS ended FROM line_")
def references_flag(t: Tables) -> DataFrame:
    """The references heading, and the lines behind it that would be definitions without it."""
    p = papers(t)
    raw = p.pages.select(_IDS, "page", F.explode("lines").alias("x")).select(_IDS, "page", "x.line", F.col("x.definition_like").alias("raw"))
    both = p.lines.select(_IDS, "page", "line", "heading", "definition_like").join(raw, [_IDS, "page", "line"])
    return both.select(_IDS, F.col("page").cast("long"), F.col("line").cast("long"), "heading", (F.col("raw") & ~F.col("definition_like")).alias("ended"))


_TOTALS = f"""{_CANDIDATES}, {_QUEUE}, total AS (
    SELECT p.paper_id, if(two, 3, 2) AS pages, (SELECT count(*) FROM gated g WHERE g.paper_id = p.paper_id AND def) AS definition_lines, (SELECT count(*) FROM gated g WHERE g.paper_id = p.paper_id AND formula AND NOT def) AS formula_lines,
        (SELECT count(*) FROM queue q WHERE q.paper_id = p.paper_id) AS visual_review_items, (SELECT sum(glyphs) FROM cand c WHERE c.paper_id = p.paper_id)::BIGINT AS candidate_chars, (SELECT sum(lost) FROM cand c WHERE c.paper_id = p.paper_id)::BIGINT AS unresolved_candidates,
        (SELECT count(*) FROM event e WHERE e.paper_id = p.paper_id) AS definition_events, (SELECT count(*) FROM pool q WHERE q.paper_id = p.paper_id) AS final_symbols, (SELECT count(*) FROM pool q WHERE q.paper_id = p.paper_id AND evidence_level < 3) AS review_symbols
    FROM paper p)"""


@query(f"WITH {SQL}, {_TOTALS} SELECT * FROM total")
def paper_totals(t: Tables) -> DataFrame:
    """The counters of each paper."""
    p = papers(t)
    out = plan.totals(p.pages, p.pool).drop("visual_fallback_regions")
    return out.select(_IDS, *(F.col(c).cast("long").alias(c) for c in out.columns if c != _IDS))


@query(f"WITH {SQL}, {_TOTALS} SELECT paper_id, if(two, 3, 3) AS last_page, final_symbols AS symbols, total.definition_events, visual_review_items AS queued, definition_lines, review_symbols, (SELECT string_agg(surface, ' ' ORDER BY ordinal) FROM pool q WHERE q.paper_id = total.paper_id) AS surfaces FROM total JOIN paper USING (paper_id)")
def paper_documents(t: Tables) -> DataFrame:
    """The nested document of each paper, told by its parts' sizes and its symbols in order."""
    d = plan.documents(papers(t))
    size = lambda c, name: F.size(c).cast("long").alias(name)
    total = lambda c: F.col(f"totals.{c}").cast("long").alias(c)
    return d.select(_IDS, F.col("last_page").cast("long").alias("last_page"), size("symbols", "symbols"), size("definition_events", "definition_events"), size("review_queue", "queued"), total("definition_lines"), total("review_symbols"), F.array_join(F.transform("symbols", lambda x: x["surface"]), " ").alias("surfaces"))


# Review and recall --------------------------------------------------------------------------------


@query(f"""WITH {SQL}, {_QUEUE},
    new AS (SELECT paper_id, CASE WHEN CAST(paper_id AS BIGINT) % 2 = 0 THEN 'Z' ELSE a END AS surface, a FROM paper)
    SELECT p.paper_id, (SELECT count(*) FROM queue q WHERE q.paper_id = p.paper_id) - 1 AS visual_review_items, n AS symbols, (open_ + (surface = 'Z')::INT)::BIGINT AS review_symbols, surface AS confirmed, CASE WHEN surface = 'Z' THEN 'review' ELSE 'confirmed' END AS status, CASE WHEN surface = 'Z' THEN 2 ELSE 3 END AS evidence_level,
        CASE WHEN surface = 'Z' THEN 1 ELSE 1 + (SELECT count(*) FROM token t WHERE t.paper_id = p.paper_id AND t.surface = p.a AND t.style = 'italic') END AS occurrences, 'p1:definition12' AS definition_id, 'p1:char15000:identity' AS resolved
    FROM new p JOIN (SELECT q.paper_id, count(*) + (CAST(q.paper_id AS BIGINT) % 2 = 0)::INT AS n, count_if(evidence_level < 3) AS open_ FROM pool q GROUP BY 1) USING (paper_id)""")
def review_confirmed(t: Tables) -> DataFrame:
    """The lost glyph of every paper confirmed in one command: as a new letter in every other paper, else as a known one."""
    p = papers(t)
    queue = p.review_queue
    letter = F.char(F.lit(ord("A")) + F.col(_IDS).cast("long") % 13)
    said = queue.filter(F.col("kind") == review.IDENTITY).select(_IDS, "review_id", F.when(F.col(_IDS).cast("long") % 2 == 0, "Z").otherwise(letter).alias("surface"))
    done = review.confirm(queue, p.lines, p.events, p.pool, p.occurrences, said)
    own = done.symbols.join(said.select(_IDS, "surface"), [_IDS, "surface"]).select(_IDS, F.col("surface").alias("confirmed"), "status", F.col("evidence_level").cast("long").alias("evidence_level"), F.col("occurrences").cast("long").alias("occurrences"))
    size = done.symbols.groupBy(_IDS).agg(F.count("*").alias("symbols"))
    resolved = done.resolutions.select(_IDS, F.col("review_id").alias("resolved"))
    where = done.occurrences.filter("status = 'visual_confirmed'").select(_IDS, "definition_id")
    return done.totals.join(size, _IDS).join(own, _IDS).join(resolved, _IDS).join(where, _IDS)


_GOLD = f"""gold AS (
    SELECT paper_id, a, b, c, two, paper_id || ':' || k AS gold_id, k FROM paper, range(1, 4) r(k))"""


def _gold(t: Tables) -> DataFrame:
    """Three gold rows a paper: two letters of the second event, one of the second page, and one that is nowhere."""
    letter = lambda first, key, n: F.char(F.lit(ord(first)) + F.col(key) % n)
    s = t.table("supplier").select(F.col("s_suppkey").cast("string").alias(_IDS), letter("A", "s_suppkey", 13).alias("a"), letter("N", "s_nationkey", 12).alias("b"), letter("b", "s_suppkey", 7).alias("c"))
    none, untrusted = F.lit(None).cast("map<string,boolean>"), F.create_map(F.lit("zz"), F.lit(False))
    alias = lambda x: F.create_map(x, F.array(x))
    row = lambda k, page, lo, hi, expected, aliases, identity: F.struct(F.lit(k).alias("k"), F.lit(page).alias("page"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), expected.alias("expected"), aliases.alias("aliases"), identity.alias("identity"))
    rows = F.array(row(1, 1, 12, 14, F.array("a", "c"), alias(F.col("c")), none), row(2, 2, 3, 4, F.array("b"), alias(F.col("b")), none), row(3, 1, 1, 2, F.array(F.col("b"), F.lit("zz")), alias(F.col("b")), untrusted))
    return s.select(_IDS, F.explode(rows).alias("g")).select(F.concat_ws(":", _IDS, "g.k").alias("gold_id"), _IDS, "g.page", "g.lo", "g.hi", "g.expected", "g.aliases", "g.identity")


def _recall(t: Tables) -> DataFrame:
    p = papers(t)
    symbols = plan.event_symbols(p.events).select(_IDS, "definition_id", "surface")
    return evaluation.recall(_gold(t), p.candidates, p.events, symbols, p.pool)


@query(f"""WITH {SQL}, {_GOLD} SELECT gold_id, k < 3 AND (k = 1 OR two) AS candidate_position, k < 3 AND (k = 1 OR two) AS canonical_surface, k < 3 AND (k = 1 OR two) AS trusted_identity, k < 3 AND (k = 1 OR two) AS page_definition_event_link,
    k < 3 AND (k = 1 OR two) AS local_definition_event_link, k < 3 AS final_pool_link, true AS final_pool_link_eligible, k = 3 AS visual_pending FROM gold""")
def gold_recall(t: Tables) -> DataFrame:
    """Whether each gold row's symbols are found, by every measure."""
    return _recall(t)


@query(f"WITH {SQL}, {_GOLD}, f AS (SELECT k, k < 3 AND (k = 1 OR two) AS x FROM gold) SELECT count(*) AS total, count_if(x) AS candidate_position, count_if(x) AS canonical_surface, count_if(x) AS trusted_identity, count_if(x) AS page_definition_event_link, count_if(x) AS local_definition_event_link, count_if(k < 3) AS final_pool_link, count(*) AS final_pool_link_eligible, count_if(k <> 3) AS eligible FROM f".replace("count_if(x)", "count_if(x)::BIGINT").replace("count_if(k < 3)", "count_if(k < 3)::BIGINT").replace("count_if(k <> 3)", "count_if(k <> 3)::BIGINT"))
def gold_report(t: Tables) -> DataFrame:
    """The corpus' counts, with denominators that leave pending rows out."""
    return evaluation.corpus_counts(_recall(t))


@query(f"WITH {SQL}, {_GOLD}, want AS (SELECT *, if(k = 2, 2, 1) AS page, CASE k WHEN 1 THEN 12 WHEN 2 THEN 3 ELSE 1 END AS lo, CASE k WHEN 1 THEN 14 WHEN 2 THEN 4 ELSE 2 END AS hi FROM gold) SELECT gold_id, definition_id, greatest(want.lo - e.stop, e.lo - want.hi, 0) <= 8 AS local FROM want JOIN event e ON e.paper_id = want.paper_id AND e.page = want.page")
def gold_events(t: Tables) -> DataFrame:
    """The events of each gold row's page, and whether they are within eight lines."""
    return evaluation.near_events(_gold(t), papers(t).events)


@query(f"WITH {SQL} SELECT paper_id, definition_id, x0, x1 FROM event WHERE x0 < 150 - 6 AND x1 > 150 + 6")
def gutter_crossings(t: Tables) -> DataFrame:
    """Events that would reach across a gutter at 150."""
    p = papers(t)
    moved = p.boundaries.withColumn("boundary", F.lit(150.0))
    return evaluation.crossing_gutter(p.events, moved).select(_IDS, "definition_id", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"))


@query(f"WITH {SQL} SELECT font, count(*) AS n FROM (SELECT CASE WHEN ch IN ('§', '¤', '£') THEN 'CMMI10' WHEN ch = '◊' THEN 'PublisherMath' WHEN ch = '○' THEN 'CMSY10' WHEN ch = '●' THEN 'ABCDEF+PrivateMath' ELSE 'CMR10' END AS font, ch FROM (SELECT unnest(string_split(raw, '')) AS ch FROM part_)) WHERE ch <> ' ' GROUP BY 1")
def font_counts(t: Tables) -> DataFrame:
    """Fonts by falling count."""
    return evaluation.font_frequency(manuscripts(t.table("supplier"))[0]).withColumnRenamed("fontname", "font")


@query(f"WITH {SQL} SELECT paper_id, font, code AS codes FROM paper, (VALUES ('PublisherMath', '7'), ('CMSY10', '8'), ('ABCDEF+PrivateMath', '9')) v(font, code)")
def private_codes(t: Tables) -> DataFrame:
    """The private codes that each font uses."""
    seen = evaluation.seen_codes(manuscripts(t.table("supplier"))[0])
    return seen.select(_IDS, F.col("fontname").alias("font"), _text("codes"))


@query(f"""WITH {SQL}, g AS (SELECT paper_id, page, line * 1000 + side * 500 + i - 1 AS idx, substr(raw, i, 1) AS ch, if(side = 0, {LEFT}, {RIGHT}) + {STEP} * (i - 1) AS x0 FROM part_, range(1, 60) r(i) WHERE i <= length(raw) AND substr(raw, i, 1) IN ('R', '('))
    SELECT ch AS text, count(*) AS n, count(DISTINCT page) AS pages, string_agg(x0::INT, ',' ORDER BY k) FILTER (WHERE k <= 5) AS first FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY page, idx, paper_id) AS k FROM g) GROUP BY 1""")
def glyph_inventory(t: Tables) -> DataFrame:
    """Count, pages and the first five places of each font and text, here of two texts."""
    rows = manuscripts(t.table("supplier"))[0].filter(F.col("text").isin("R", "(") & (F.col("fontname") == "CMR10"))
    rows = rows.withColumns({"bbox": F.array("x0", "top", "x1", "bottom"), "line_id": F.lit("")})
    out = evaluation.glyph_inventory(rows)
    return out.select("text", "n", "pages", F.array_join(F.transform("boxes", lambda b: b[0].cast("int").cast("string")), ",").alias("first"))


@query(f"WITH {SQL} SELECT paper_id, page, count_if(surface = 'W')::BIGINT AS w, count_if(surface = 'N')::BIGINT AS n FROM (SELECT paper_id, page, CASE ch WHEN '§' THEN a WHEN '¤' THEN b WHEN '£' THEN c WHEN '●' THEN 'W' ELSE ch END AS surface FROM (SELECT p.paper_id, p.page, a, b, c, unnest(string_split(raw, '')) AS ch FROM part_ p JOIN (SELECT paper_id, page, line FROM gated g WHERE formula OR EXISTS (SELECT 1 FROM {_NEAR} x WHERE x.paper_id = g.paper_id AND x.page = g.page AND x.line = g.line)) g ON g.paper_id = p.paper_id AND g.page = p.page AND g.line = p.line)) GROUP BY 1, 2")
def surface_counts(t: Tables) -> DataFrame:
    """How often given surfaces stand among a page's candidates."""
    out = evaluation.surface_counts(papers(t).candidates, ["W", "N"])
    return out.select(_IDS, F.col("page").cast("long"), F.col("W").alias("w"), F.col("N").alias("n"))
