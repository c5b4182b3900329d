"""Scalar functions and predicates as Columns: fonts, identities, classification, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P

UNKNOWN_AUTHOR = "Unknown author"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(text: Column | str, patterns, exact: str | None = None) -> Column:
    """One alternation, so that a text is prepared and walked once; ``exact`` heeds case."""
    parts = [f"(?:{p})" for p in patterns] + ([f"(?-i:{exact})"] if exact else [])
    return _col(text).rlike("(?iU)" + "|".join(parts))


def collapse(text: Column | str) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(_col(text), r"(?U)\s+", " "), r"^ | $", "")


def trim_all(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


# Fonts, characters, identities ---------------------------------------------------------------


def font_family(font: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(font), F.lit("")), P.SUBSET_PREFIX, "")


def font_style(font: Column | str) -> Column:
    family = font_family(font)
    upper, out = F.upper(family), None
    for style, pattern in P.FONT_STYLES:
        hit = upper.rlike(pattern)
        out = F.when(hit, style) if out is None else out.when(hit, style)
    return out.when(family == "", "font:unknown").otherwise(F.concat(F.lit("font:"), family))


def symbol_style(given: Column | str, unicode_style: Column | str, font: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(given), F.lit("")), _col(unicode_style), font_style(font))


def identity_key(surface: Column | str, style: Column | str) -> Column:
    """surface|style; null without a surface, so that no key is made of a style alone."""
    surface = F.nullif(_col(surface), F.lit(""))
    return F.when(surface.isNotNull(), F.concat(surface, F.lit("|"), _col(style)))


def symbol_surface(surface: Column | str, status: Column | str, kind: Column | str) -> Column:
    s = _col(surface)
    composite = (_col(kind) == "composite") & s.rlike(r"(?s)^\p{L}") & s.rlike(r"[()\[\]{}|_^]")
    return F.when((_col(status) != "unresolved") & (s.rlike(r"^\p{L}$") | F.coalesce(composite, F.lit(False))), s)


def decode_surface(text: Column | str, mapped: Column | str) -> tuple[Column, Column]:
    """(text, status) of a raw glyph text and what the font maps give for its code; never guesses."""
    t, m = F.coalesce(_col(text), F.lit("")), _col(mapped)
    private = t.rlike(r"^\(cid:\d+\)$")
    status = F.when(t == "", "empty").when(~private, "native").when(m.isNotNull(), "recovered").otherwise("unresolved")
    return F.when(private & m.isNotNull(), m).otherwise(t), status


def glyph_code(text: Column | str) -> Column:
    return F.expr("try_cast(nullif(regexp_extract({}, '^\\\\(cid:(\\\\d+)\\\\)$', 1), '') as int)".format(text)) if isinstance(text, str) else F.nullif(F.regexp_extract(text, r"^\(cid:(\d+)\)$", 1), F.lit("")).try_cast("int")


def code_point(hex_code: Column | str) -> Column:
    """The character of a hexadecimal code point; null beyond the range."""
    h = F.lpad(_col(hex_code), 8, "0")
    return F.when(F.conv(h, 16, 10).cast("long") <= 0x10FFFF, F.decode(F.unhex(h), "UTF-32"))


# Predicates ----------------------------------------------------------------------------------


def nonspace(text: Column | str, upright: Column | str) -> Column:
    return (trim_all(F.coalesce(_col(text), F.lit(""))) != "") & F.coalesce(_col(upright), F.lit(True))


def has_math_char(text: Column | str) -> Column:
    return _col(text).rlike("[" + P.MATH_CHARS.replace("^", r"\^").replace("-", r"\-").replace("|", r"\|") + "]")


def is_math_glyph(text: Column | str, font: Column | str, math_character: Column | str) -> Column:
    """``math_character``: whether the character is in the dimension of mathematical characters."""
    family = font_family(font)
    return family.rlike("(?i)" + P.MATH_FONT) | family.rlike("(?i)" + P.BOLD_MATH_FONT) | _col(math_character) | has_math_char(text)


def is_bold_math_glyph(font: Column | str, unicode_style: Column | str) -> Column:
    return font_family(font).rlike("(?i)" + P.BOLD_MATH_FONT) | F.coalesce(_col(unicode_style).isin("bold", "bold_italic", "blackboard"), F.lit(False))


def definition_like(text: Column | str) -> Column:
    return any_of(collapse(text), P.DEFINITION, P.GIVEN_CAPITAL)


def formula_signal(text: Column | str) -> Column:
    return any_of(collapse(text), P.FORMULA_SIGNAL, P.GIVEN_CAPITAL)


def formula_like(text: Column | str, operators: Column | str, math: Column | str, family: Column | str) -> Column:
    return (trim_all(text) != "") & (
        definition_like(text) | ((_col(operators) >= 1) & (_col(math) >= 1)) | (_col(family) >= 2) | ((_col(math) >= 2) & (F.char_length(_col(text)) <= 80))
    )


def generic_definition(text: Column | str) -> Column:
    return _col(text).rlike("(?iU)" + P.GENERIC_DEFINITION)


def references_heading(text: Column | str) -> Column:
    return trim_all(text).rlike("(?iU)" + P.REFERENCES_HEADING)


def reviewable(status: Column | str, font: Column | str) -> Column:
    return (_col(status) == "unresolved") & ~font_family(font).rlike("(?i)" + P.STRUCTURAL_FONT)


def safe_paper_id(x: Column | str) -> Column:
    return F.coalesce(_col(x).rlike(r"^[A-Za-z0-9-]+\z"), F.lit(False))


def stored_paths(paper_id: Column | str, root: str) -> Column:
    """{pdf, document} of a stored paper below ``root``; null for ids that could lead anywhere else."""
    base = F.concat(F.lit(root.rstrip("/") + "/"), _col(paper_id))
    return F.when(safe_paper_id(paper_id), F.struct(F.concat(base, F.lit(".pdf")).alias("pdf"), F.concat(base, F.lit(".json")).alias("document")))


def valid_folder_name(x: Column | str) -> Column:
    return F.char_length(_col(x)).between(1, 80) & ~_col(x).rlike(r"\p{Cc}")


def valid_title(x: Column | str) -> Column:
    return F.octet_length(trim_all(x)).between(1, 240)


def valid_surface(x: Column | str) -> Column:
    return F.char_length(_col(x)).between(1, 32) & ~_col(x).rlike(r"(?U)[\s\p{Cc}]")


def valid_meaning(symbol_id: Column | str, meaning: Column | str) -> Column:
    return F.octet_length(_col(symbol_id)).between(1, 240) & F.char_length(_col(meaning)).between(1, 240) & ~_col(meaning).rlike(r"\p{Cc}")


def is_pdf_upload(name: Column | str, mime: Column | str) -> Column:
    return F.coalesce(F.lower(_col(name)).endswith(".pdf"), F.lit(False)) | F.coalesce(_col(mime) == "application/pdf", F.lit(False))


def kept_image(width: Column | str, height: Column | str) -> Column:
    w, h = F.coalesce(_col(width), F.lit(0.0)), F.coalesce(_col(height), F.lit(0.0))
    return (w > 0) & (h > 0) & (w < 20 * h) & (h < 20 * w)


def boxes_overlap(a: Column, b: Column) -> Column:
    """Strict overlap of [x0, top, x1, bottom] arrays."""
    return (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))


# Levels, labels and views --------------------------------------------------------------------


def evidence_type(level: Column | str) -> Column:
    return F.when(_col(level) >= 3, "direct_definition").when(_col(level) == 2, "formula_context").otherwise("event_context")


def pool_status(level: Column | str, unresolved: Column | bool = False) -> Column:
    hidden = F.lit(unresolved) if isinstance(unresolved, bool) else unresolved
    return F.when(hidden, "unresolved").when(_col(level) >= 3, "confirmed").otherwise("review")


def view_status(status: Column | str) -> Column:
    return F.when(_col(status) == "unresolved", "review").otherwise(_col(status))


def size_label(size: Column | str) -> Column:
    return F.concat(F.greatest(F.lit(1), F.round(_col(size) / 1024).cast("long")).cast("string"), F.lit(" KB"))


def page_label(page: Column | str) -> Column:
    return F.concat(F.lit("第 "), _col(page).cast("string"), F.lit(" 页"))


def page_of_label(label: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(label), r"第\s*(\d+)\s*页", 1), F.lit("")).try_cast("int")


def clamp_page(page: Column | str, pages: Column | str) -> Column:
    return F.least(F.greatest(F.lit(1), _col(page)), F.greatest(F.lit(1), _col(pages)))


def clamp_sidebar(width: Column | str) -> Column:
    return F.least(F.greatest(_col(width), F.lit(180)), F.lit(420))


def hotspot(bbox: Column, width: Column | str, height: Column | str) -> Column:
    """A box in percent of its page, with the least width and height a pointer can hit."""
    w, h = _col(width), _col(height)
    return F.struct(
        (bbox[0] / w * 100).alias("left"), (bbox[1] / h * 100).alias("top"),
        F.greatest(F.lit(0.8), (bbox[2] - bbox[0]) / w * 100).alias("width"), F.greatest(F.lit(1.2), (bbox[3] - bbox[1]) / h * 100).alias("height"),
    )


def display_authors(authors: Column | str, fallback: str = UNKNOWN_AUTHOR) -> Column:
    a = trim_all(F.coalesce(_col(authors), F.lit("")))
    return F.when(a == "", fallback).otherwise(a)


#: LaTeX names of common symbols.
LATEX = (
    ("α", r"\alpha "), ("β", r"\beta "), ("γ", r"\gamma "), ("δ", r"\delta "), ("ε", r"\epsilon "), ("θ", r"\theta "), ("λ", r"\lambda "), ("μ", r"\mu "), ("σ", r"\sigma "),
    ("φ", r"\phi "), ("ω", r"\omega "), ("Δ", r"\Delta "), ("Ω", r"\Omega "), ("∈", r"\in "), ("≤", r"\leq "), ("≥", r"\geq "), ("∞", r"\infty "), ("∑", r"\sum "), ("∇", r"\nabla "),
)
_COMMAND = {"bold": "mathbf", "bold_italic": "boldsymbol", "blackboard": "mathbb", "fraktur": "mathfrak", "script": "mathcal", "sans": "mathsf", "monospace": "mathtt", "roman": "mathrm"}


def latex_surface(surface: Column | str, style: Column | str) -> Column:
    s = out = _col(surface)
    for char, name in LATEX:
        out = F.replace(out, F.lit(char), F.lit(name))
    out = F.regexp_replace(F.regexp_replace(out, r"_([^{\s])", r"_{$1}"), r"\^([^{\s])", r"^{$1}")
    for name, command in _COMMAND.items():
        out = F.when((F.char_length(s) == 1) & (_col(style) == name), F.concat(F.lit(f"\\{command}{{"), out, F.lit("}"))).otherwise(out)
    return out


# Titles, years, metadata ---------------------------------------------------------------------

_PLACEHOLDER = ("paper", "untitled", "document", "microsoft word")


def real_title(title: Column | str) -> Column:
    """The trimmed title, or null if it is empty, a placeholder or a file name."""
    t = trim_all(F.coalesce(_col(title), F.lit("")))
    return F.when((t != "") & ~F.lower(t).isin(*_PLACEHOLDER) & ~F.lower(t).endswith(".pdf"), t)


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(name), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def imported_title(title: Column | str, name: Column | str) -> Column:
    return F.coalesce(real_title(title), file_stem(name))


def year_in(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"((?:19|20)\d{2})", 1), F.lit(""))


def filename_metadata(name: Column | str) -> Column:
    """{authors, year, title} of ``Authors - 2020 - Title``; all null unless all are there."""
    pattern = r"^\s*(.+?)\s+-\s+((?:19|20)\d{2})\s+-\s+(.+?)\s*$"
    stem = file_stem(name)
    part = lambda k: F.when(stem.rlike(pattern), F.regexp_extract(stem, pattern, k))
    return F.struct(part(1).alias("authors"), part(2).alias("year"), part(3).alias("title"))


def first_year(*texts: Column, first_page: Column | str) -> Column:
    return F.coalesce(*(year_in(t) for t in texts), year_in(F.substring(_col(first_page), 1, 8000)), F.lit(""))
