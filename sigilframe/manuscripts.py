"""Small papers typeset from the driver's suppliers, so that the whole engine has true work to do.

Every supplier is a paper of three pages: definitions in one column, two columns with a gutter, and the
references.  The letters it defines follow its keys.  A template line is a text and a mask that gives
each character's font; the same lines are the fixture's glyphs and, as VALUES, the oracle's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Placeholders: two capitals, a small letter, and glyphs with private codes that no table, or one, resolves.
CAPITAL, OTHER, SMALL, LOST, STRUCTURAL, FOUND = "§", "¤", "£", "◊", "○", "●"
FONTS = {CAPITAL: "CMMI10", OTHER: "CMMI10", SMALL: "CMMI10", LOST: "PublisherMath", STRUCTURAL: "CMSY10", FOUND: "ABCDEF+PrivateMath"}
CODES = {LOST: 7, STRUCTURAL: 8, FOUND: 9}
FOUND_LETTER = "W"
LEFT, RIGHT, WIDTH, STEP, PITCH = 40.0, 330.0, 600.0, 5.0, 14.0

_NEUTRAL = (
    "All values were measured twice.", "No run was left out of the mean.", "Each test took about one hour.", "Small errors come from rounding.", "The seed was the same each time.",
    "Few outliers were seen at all.", "More runs cost too much time.", "The code is short and simple.", "No data were lost on the way.",
)

#: (page, line, side, text).
LINES = [
    (1, 0, 0, "Notation used in this paper"),
    (1, 1, 0, "where § denotes the mixing matrix"),
    (1, 2, 0, "and ¤ is the number of rows."),
    *((1, 3 + k, 0, text) for k, text in enumerate(_NEUTRAL)),
    (1, 12, 0, "§ = ¤ + £"),
    (1, 13, 0, "let £ be a vector of weights"),
    (1, 14, 0, "§(£) is the loss."),
    (1, 15, 0, "◊ = £"),
    (1, 16, 0, "○ = ¤"),
    (1, 17, 0, "● = ¤"),
    (1, 18, 0, "we define the loss function"),
    (2, 0, 0, "Results of the second test"), (2, 0, 1, "Values come from the tables"),
    (2, 1, 0, _NEUTRAL[0]), (2, 1, 1, _NEUTRAL[1]),
    (2, 2, 0, _NEUTRAL[2]), (2, 2, 1, _NEUTRAL[3]),
    (2, 3, 0, "The plots agree in all runs."), (2, 3, 1, "where ¤ represents the noise"),
    (2, 4, 0, "Later work may extend this."), (2, 4, 1, "level of every sensor."),
    (2, 5, 0, _NEUTRAL[4]), (2, 5, 1, _NEUTRAL[5]),
    (2, 6, 0, _NEUTRAL[6]), (2, 6, 1, _NEUTRAL[7]),
    (2, 7, 0, "All plots use the same scale."), (2, 7, 1, _NEUTRAL[8]),
    (3, 0, 0, "A short closing remark."),
    (3, 1, 0, "References"),
    (3, 2, 0, "where ¤ denotes a test"),
]


def manuscripts(suppliers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(glyphs, pages, font_codes).  Suppliers in debt have no second page, so no gutter anywhere.

    The template is a small constant table; everything else follows from the supplier's own row.
    """
    spark = suppliers.sparkSession
    template = F.broadcast(spark.createDataFrame(LINES, "page int, line int, side int, text string"))
    letter = lambda first, key, n: F.char(F.lit(ord(first)) + F.col(key) % n)
    papers = suppliers.select(
        F.col("s_suppkey").cast("string").alias("paper_id"), (F.col("s_acctbal") >= 0).alias("two"),
        letter("A", "s_suppkey", 13).alias("capital"), letter("N", "s_nationkey", 12).alias("other"), letter("b", "s_suppkey", 7).alias("small"),
    )
    lines = papers.withColumn("page", F.explode(F.expr("if(two, array(1, 2, 3), array(1, 3))"))).join(template, "page")
    chars = lines.select("*", F.posexplode(F.split("text", "")).alias("col", "mark")).filter("mark <> '' and mark <> ' '")
    font = F.create_map(*[F.lit(x) for pair in FONTS.items() for x in pair])
    shown = F.when(F.col("mark") == CAPITAL, F.col("capital")).when(F.col("mark") == OTHER, F.col("other")).when(F.col("mark") == SMALL, F.col("small"))
    for mark, code in CODES.items():
        shown = shown.when(F.col("mark") == mark, f"(cid:{code})")
    x0, top = F.when(F.col("side") == 0, LEFT).otherwise(RIGHT) + F.col("col") * STEP, F.col("line") * PITCH + 10
    glyphs = chars.select(
        "paper_id", "page", (F.col("line") * 1000 + F.col("side") * 500 + F.col("col")).alias("index"), shown.otherwise(F.col("mark")).alias("text"),
        F.coalesce(F.try_element_at(font, F.col("mark")), F.lit("CMR10")).alias("fontname"),
        x0.alias("x0"), (x0 + STEP).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(10.0).alias("size"), F.lit(True).alias("upright"),
    )
    pages = papers.select("paper_id", F.explode(F.expr("if(two, array(1, 2, 3), array(1, 3))")).alias("page"), F.lit(WIDTH).alias("width"), F.lit(800.0).alias("height"))
    codes = papers.select("paper_id", F.lit("PrivateMath").alias("font"), F.lit(CODES[FOUND]).alias("code"), F.lit(FOUND_LETTER).alias("ch"))
    return glyphs, pages, codes


# What the oracle starts from ---------------------------------------------------------------------


def _values(rows, names: str) -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS v({names})"


#: Read off the templates by hand: definition lines, and formula lines that are none.
DEFINITIONS = {(1, 1), (1, 2), (1, 13), (1, 14), (1, 18), (2, 3), (3, 2)}
FORMULAS = {(1, 12), (1, 15), (1, 16), (1, 17)}
#: Token places: (page, line, side, first column, last column, kind, style, status), in order along each line.
TOKENS = [
    (1, 1, 0, 6, 6, "single_letter", "italic", "native"), (1, 2, 0, 4, 4, "single_letter", "italic", "native"),
    (1, 12, 0, 0, 0, "single_letter", "italic", "native"), (1, 12, 0, 4, 4, "single_letter", "italic", "native"), (1, 12, 0, 8, 8, "single_letter", "italic", "native"),
    (1, 13, 0, 4, 4, "single_letter", "italic", "native"),
    (1, 14, 0, 0, 0, "single_letter", "italic", "native"), (1, 14, 0, 2, 2, "single_letter", "italic", "native"), (1, 14, 0, 0, 3, "composite", "mixed:italic+roman", "native"),
    (1, 15, 0, 4, 4, "single_letter", "italic", "native"), (1, 16, 0, 4, 4, "single_letter", "italic", "native"),
    (1, 17, 0, 0, 0, "single_letter", "font:PrivateMath", "recovered"), (1, 17, 0, 4, 4, "single_letter", "italic", "native"),
    (2, 3, 1, 6, 6, "single_letter", "italic", "native"),
    (3, 2, 0, 6, 6, "single_letter", "italic", "native"),
]
#: Events: (page, first line, last line of the window, last line of the sentence, side or null, trigger).
EVENTS = [(1, 1, 2, 2, None, "where"), (1, 12, 18, 18, None, "let"), (2, 3, 3, 4, 1, "where")]

_SHOW = "replace(replace(replace(replace(replace(replace({}, '§', a), '¤', b), '£', c), '◊', '(cid:7)'), '○', '(cid:8)'), '●', 'W')"
SQL = f"""
    tpl AS (SELECT * FROM {_values(LINES, "page, line, side, raw")}),
    paper AS (SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, s_acctbal >= 0 AS two, chr((65 + s_suppkey % 13)::INT) AS a, chr((78 + s_nationkey % 12)::INT) AS b, chr((98 + s_suppkey % 7)::INT) AS c FROM supplier),
    part_ AS (SELECT paper_id, a, b, c, page, line, side, raw, {_SHOW.format("raw")} AS text FROM paper JOIN tpl ON two OR page <> 2),
    line_ AS (
        SELECT paper_id, page, line, string_agg(text, ' ' ORDER BY side) AS text, min(if(side = 0, {LEFT}, {RIGHT})) AS x0, max(if(side = 0, {LEFT}, {RIGHT}) + {STEP} * length(raw)) AS x1, line * {PITCH} + 10 AS top,
            list_contains([{", ".join(f"{p * 100 + k}" for p, k in sorted(DEFINITIONS))}], page * 100 + line) AS raw_def, list_contains([{", ".join(f"{p * 100 + k}" for p, k in sorted(FORMULAS))}], page * 100 + line) AS only_formula
        FROM part_ GROUP BY ALL
    ),
    gated AS (SELECT *, raw_def AND NOT (page = 3 AND line >= 1) AS def, raw_def OR only_formula AS formula FROM line_),
    spot AS (SELECT *, row_number() OVER () AS k FROM {_values(TOKENS, "page, line, side, lo, hi, kind, style, status")}),
    token AS (
        SELECT p.paper_id, s.*, substr({_SHOW.format("substr(raw, lo + 1, hi - lo + 1)")}, 1) AS surface, if(s.side = 0, {LEFT}, {RIGHT}) + {STEP} * lo AS x0, 'p' || s.page || ':line' || s.line AS line_id,
            CASE WHEN kind = 'composite' THEN 'p' || s.page || ':token:p' || s.page || ':line' || s.line || ':' || lo || '-' || hi ELSE 'p' || s.page || ':char' || (s.line * 1000 + s.side * 500 + lo) END AS token_id
        FROM spot s JOIN part_ p ON p.page = s.page AND p.line = s.line AND p.side = s.side
    ),
    ev AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY lo) - 1 AS ordinal, 'p' || page || ':definition' || lo AS definition_id FROM {_values(EVENTS, "page, lo, hi, stop, side, trigger")}),
    event AS (
        SELECT p.paper_id, ev.page, ordinal, definition_id, trigger, lo, hi, stop, string_agg(p.text, ' ' ORDER BY p.line) AS text, min(if(p.side = 0, {LEFT}, {RIGHT})) AS x0, max(if(p.side = 0, {LEFT}, {RIGHT}) + {STEP} * length(raw)) AS x1,
            string_agg('p' || ev.page || ':line' || p.line, ',' ORDER BY p.line) AS line_ids
        FROM ev JOIN part_ p ON p.page = ev.page AND p.line BETWEEN lo AND stop AND (ev.side IS NULL OR p.side = ev.side) GROUP BY ALL
    ),
    es AS (
        SELECT t.paper_id, t.page, e.ordinal, e.definition_id, t.surface || '|' || t.style AS identity_key, t.surface, t.style, min(t.k) AS k, count(*) AS n_tokens, max(if(g.def, 3, if(g.formula, 2, 1))) AS level,
            list(DISTINCT if(g.def, 'direct_definition', if(g.formula, 'formula_context', 'event_context'))) AS kinds, min_by(if(g.def, 'direct_definition', if(g.formula, 'formula_context', 'event_context')), t.k) AS first_kind
        FROM token t JOIN event e ON e.paper_id = t.paper_id AND e.page = t.page AND t.line BETWEEN e.lo AND e.hi JOIN gated g ON g.paper_id = t.paper_id AND g.page = t.page AND g.line = t.line GROUP BY ALL
    ),
    pool AS (
        SELECT paper_id, identity_key, surface, style, row_number() OVER (PARTITION BY paper_id ORDER BY min(page * 1000 + k)) - 1 AS ordinal, max(level) AS evidence_level,
            string_agg(definition_id, ',' ORDER BY page, ordinal) AS events, min(page) AS def_page, list_distinct(flatten(list(kinds))) AS kinds, min_by(first_kind, page * 1000 + k) AS first_kind
        FROM es GROUP BY paper_id, identity_key, surface, style
    )"""
